"""Operators on the relation (doc_id, term, tf), which every modality shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tessera.functions import text as T
from tessera.functions import weights
from tessera.functions.porter import stem_word
from tessera.session import ship, stored

#: Bytes of texts whose words are counted at once.
SLICE = 8_000_000
#: The terms of most documents, whose document frequencies go to every task.
COMMON = 100_000


def repeated(df: DataFrame, id_col: str) -> bool:
    """Whether an id is that of more than one row; only the ids are read."""
    return not df.groupBy(F.col(id_col)).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def term_frequencies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop: list[str] | None = None, stem: bool = False, again: bool | None = None) -> DataFrame:
    """(doc_id, term, tf) of texts: tokens, then stopwords, then stems, then counts.

    A row's words are counted in arrays where the row is read.  again: whether several rows can have one id (else looked up); only then
    are counts summed over rows, by a shuffle.
    """
    if again is None:
        again = repeated(df, id_col)
    texts = df.select(F.col(id_col).alias("doc_id"), T.spaced(F.col(text_col)).alias("text"))
    ship(df.sparkSession)
    dropped = pa.array(["", *(stop or [])], pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                # SLICE bytes of texts at once, one text at least.
                before = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, before + SLICE, side="right")))
                ids, texts = batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first)
                first = last
                words = pc.split_pattern(texts, " ")
                coded = words.flatten().dictionary_encode()
                names = coded.dictionary
                held = ~pc.is_in(names, value_set=dropped.cast(names.type)).to_numpy(zero_copy_only=False)
                place = np.arange(len(names))
                if stem:
                    kept = names.filter(pa.array(held))
                    stems = pa.array([stem_word(w) for w in kept.to_pylist()], names.type).dictionary_encode()
                    place[held] = stems.indices.to_numpy()
                    names = stems.dictionary
                code, row = coded.indices.to_numpy(), pc.list_parent_indices(words).to_numpy()
                mine = held[code]
                n = max(1, len(names))
                key, tf = np.unique(row[mine].astype(np.int64) * n + place[code[mine]], return_counts=True)
                if len(key):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(key // n)), names.take(pa.array(key % n)), pa.array(tf.astype(np.int32))], ["doc_id", "term", "tf"])

    tf = texts.mapInArrow(count, StructType([texts.schema["doc_id"], StructField("term", StringType()), StructField("tf", IntegerType())]))
    return tf.groupBy("doc_id", "term").agg(F.sum("tf").cast("int").alias("tf")) if again else tf


def from_maps(df: DataFrame, id_col: str = "id", map_col: str = "tf") -> DataFrame:
    """(doc_id, term, tf) of a map column."""
    return df.select(F.col(id_col).alias("doc_id"), F.explode(map_col).alias("term", "tf"))


def positive(tf: DataFrame) -> DataFrame:
    return tf.where("tf > 0")


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df): documents that have the term, also with a count of 0."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def with_df(tf: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """tf with df.  Document frequencies are written once (or given, stored); those of the COMMON terms of most documents go to every task, and
    only the postings of the others are shuffled by term, so that neither a common term nor a large vocabulary is one task's or the driver's."""
    if vocab is None:
        vocab = stored(document_frequency(tf), "df")
    n, least = 0, None  # how many terms have a df from `least` on; there are far fewer values of df than terms
    for r in vocab.groupBy("df").agg(F.count("*").alias("n")).orderBy(F.desc("df")).toLocalIterator():
        n += r["n"]
        if n > COMMON:
            break
        least = r["df"]
    else:
        return tf.join(F.broadcast(vocab), "term")  # COMMON terms at most
    if least is None:
        return tf.join(vocab, "term")
    common = vocab.where(F.col("df") >= least)
    others = tf.join(F.broadcast(common.select("term")), "term", "left_anti").join(vocab.where(F.col("df") < least), "term")
    return tf.join(F.broadcast(common), "term").unionByName(others)


def document_count(tf: DataFrame) -> DataFrame:
    """(n_docs): documents with a posting."""
    return positive(tf).agg(F.countDistinct("doc_id").alias("n_docs"))


def weighted(tf: DataFrame, use_log_tf: bool = True, n_docs: DataFrame | None = None, with_zero: bool = False, vocab: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, df, w): TF-IDF weights.  n_docs: one row, else counted; with_zero: zero counts enter df; vocab: df, stored, else made.  tf is read several times."""
    own = tf if with_zero else positive(tf)
    total = n_docs if n_docs is not None else own.agg(F.countDistinct("doc_id").alias("n_docs"))
    joined = with_df(own, vocab).crossJoin(F.broadcast(total))  # one row
    return joined.select("doc_id", "term", "tf", "df", weights.tfidf(F.col("tf"), F.col("df"), F.col("n_docs"), use_log_tf).alias("w"))


def norms(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, norm) of vectors (key, term, w)."""
    return vectors.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def l2_normalized(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """The vectors at unit length; zero vectors stay.  The vectors are shuffled once and not sorted."""
    return vectors.join(norms(vectors, key).hint("shuffle_hash"), key).withColumn("w", weights.divided(F.col("w"), F.col("norm"))).drop("norm")


def postings(tf: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of positive counts, for range-sorted storage; document lists stay unnested so that a frequent
    term doesn't meet in one row."""
    return positive(tf).select("term", "doc_id", "tf")


def posting_lists(tf: DataFrame) -> DataFrame:
    """(term, df, postings): lists sorted by document, for small collections and exports."""
    lists = positive(tf).groupBy("term").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))
    return lists.select("term", F.size("postings").cast("bigint").alias("df"), "postings")


def top_terms(tf: DataFrame, k: int) -> DataFrame:
    """(term, n): the codebook, k terms of the highest collection frequency, equal ones by term."""
    return tf.groupBy("term").agg(F.sum("tf").cast("bigint").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def within_codebook(tf: DataFrame, codebook: DataFrame) -> DataFrame:
    """Only the codebook's terms; the codebook has k rows by construction."""
    return tf.join(F.broadcast(codebook.select("term")), "term", "left_semi").select(tf.columns)


def row_histograms(tf: DataFrame, row_of: Column) -> DataFrame:
    """(stem, term, tf): chunk counts summed over whole rows."""
    return tf.select(row_of.alias("stem"), "term", "tf").groupBy("stem", "term").agg(F.sum("tf").cast("int").alias("tf"))


def as_maps(tf: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, hist): positive counts as a map with sorted keys."""
    entries = F.sort_array(F.collect_list(F.struct("term", "tf")))
    return positive(tf).groupBy(key).agg(F.map_from_entries(entries).alias("hist"))


def vocabulary_histogram(tf: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, term, n): counts over a fixed vocabulary of bounded size, zeros kept."""
    grid = tf.select("doc_id").distinct().crossJoin(F.broadcast(vocabulary.select("term")))  # k rows for each document is the result
    return grid.join(within_codebook(tf, vocabulary), ["doc_id", "term"], "left").select("doc_id", "term", F.coalesce("tf", F.lit(0)).cast("bigint").alias("n"))
