"""The inverted index: build, store, open and search.

Stored as four tables: postings (term, doc_id, tf) range-sorted by term so that row groups are skipped for a query's terms,
vocab (term, df), doc_norms (doc_id, norm) and corpus_stats (n_docs).  Weights follow from tf, df and the norm and are made where a search
needs them, so that no posting is shuffled to be weighted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import weights
from tessera.operators import scoring, terms
from tessera.session import stored

#: Query terms up to this number are looked up as literals, which reach the scan of the postings.
LITERAL_TERMS = 500


class InvertedIndex:
    """TF-IDF cosine ranking over postings.

    Candidates touch a known query term, also with score 0; equal scores are ordered by document.
    """

    def __init__(self, postings: DataFrame, vocab: DataFrame, doc_norms: DataFrame, n_docs: int):
        self.postings, self.vocab, self.doc_norms, self.n_docs = postings, vocab, doc_norms, n_docs
        self.terms_read = 0

    @staticmethod
    def build(tf: DataFrame) -> InvertedIndex:
        """An index of (doc_id, term, tf); counts that aren't positive don't enter.  An empty collection is an error."""
        own = terms.postings(tf)
        n_docs = own.agg(F.countDistinct("doc_id")).first()[0]
        if not n_docs:
            raise ValueError("the collection has no term")
        vocab = stored(terms.document_frequency(own), "vocab")
        weighted = terms.with_df(own.where("doc_id IS NOT NULL"), vocab).select("doc_id", weights.tfidf(F.col("tf"), F.col("df"), F.lit(n_docs)).alias("w"))
        return InvertedIndex(own.where("doc_id IS NOT NULL"), vocab, terms.norms(weighted), n_docs)

    def write(self, path: str) -> InvertedIndex:
        """Stores the tables and opens them again; the collection is read for the norms, for the sample of the ranges, and for the postings."""
        spark = self.postings.sparkSession
        self.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.vocab.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocab")
        self.doc_norms.write.mode("overwrite").parquet(f"{path}/doc_norms")
        spark.createDataFrame([(self.n_docs,)], "n_docs bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus_stats")
        return InvertedIndex.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> InvertedIndex:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return InvertedIndex(read("postings"), read("vocab"), read("doc_norms"), read("corpus_stats").first()["n_docs"])

    def __enter__(self) -> InvertedIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for table in (self.vocab, self.doc_norms):
            table.unpersist()

    def vocab_size(self) -> int:
        return self.vocab.count()

    def df(self, term: str) -> int:
        row = self.vocab.where(F.col("term") == term).first()
        return row["df"] if row else 0

    def has_term(self, term: str) -> bool:
        return self.df(term) > 0

    def get_postings(self, term: str) -> DataFrame:
        """(doc_id, tf) by document; none for an unknown term."""
        self.terms_read += 1
        return self.postings.where(F.col("term") == term).select("doc_id", "tf").orderBy("doc_id")

    def reset_counters(self) -> None:
        self.terms_read = 0

    def query_weights(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, wq, q_norm): known terms only, and only queries with a positive norm."""
        known = terms.positive(queries).join(self.vocab, "term")
        own = known.select("query_id", "term", weights.tfidf(F.col("tf"), F.col("df"), F.lit(self.n_docs)).alias("wq"), "df")
        sized = own.groupBy("query_id").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("q_norm")).where("q_norm > 0")
        return own.join(sized, "query_id")

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, wq, df): known terms at the query's unit length."""
        return self.query_weights(queries).select("query_id", "term", (F.col("wq") / F.col("q_norm")).alias("wq"), "df")

    def entries(self, wanted: list[str]) -> DataFrame:
        """(term, doc_id, tf) of the wanted terms, as literals of the scan while they are few."""
        return self.postings.where(F.col("term").isin(wanted)) if len(wanted) <= LITERAL_TERMS else self.postings

    def unit_weight(self) -> Column:
        """Of tf, df and norm: the TF-IDF weight at unit length of the document, 0 in a zero vector."""
        size = F.col("norm")
        w = weights.tfidf(F.col("tf"), F.col("df"), F.lit(self.n_docs))
        return F.when(size > 0, w / F.when(size > 0, size)).otherwise(0.0)

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of all candidates of all queries."""
        hits = self.postings.join(self.asked(queries), "term").join(self.doc_norms, "doc_id")
        return hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("wq") * self.unit_weight()).alias("score"))

    def search_batch(self, queries: DataFrame, k: int = 10, digits: int | None = None) -> DataFrame:
        """(query_id, rank, doc_id, score): the best k of each query (query_id, term, tf).

        Few queries are a matrix that goes to every task: postings are dealt by document, HITS of them to a partition, and each
        partition keeps its best k for each query, so no row for a (query, document) pair is shuffled.  Larger query sets are joined.
        """
        if self.n_docs <= 0:
            raise ValueError("the index holds no document")
        q = self.asked(queries)
        asked, rows = scoring.Asked.of(q, "wq")
        if asked is None:
            return best(self.scores(queries), k, digits)
        df = {r["term"]: r["df"] for r in rows}
        idf = np.log10(self.n_docs / np.array([df[t] for t in asked.wanted], float))
        weight, wanted = asked.weight, asked.has

        def score(own: np.ndarray, has: np.ndarray, norm: np.ndarray, _: np.ndarray) -> np.ndarray:
            unit = np.where(has, (1 + np.log10(np.where(has, own, 1))) * idf, 0.0) / np.where(norm > 0, norm, np.inf)[:, None]
            return np.where(scoring.meets(has, wanted), unit @ weight, np.nan)

        hits = self.entries(asked.wanted).join(asked.places(self.postings), "term").select("doc_id", "i", F.col("tf").alias("v"))
        docs = self.doc_norms.select("doc_id", F.col("norm").alias("v"), F.lit(0.0).alias("rest"))
        return best(scoring.scores(asked, hits, docs, score, max(1, -(-sum(df.values()) // scoring.HITS)), k, digits), k)

    def search_topk(self, query_tf: dict[str, int], k: int = 10) -> DataFrame:
        """(rank, doc_id, score) for one query; its terms reach the postings scan as literals."""
        spark = self.postings.sparkSession
        given = {t: n for t, n in query_tf.items() if n > 0}
        queries = spark.createDataFrame([("q", t, int(n)) for t, n in given.items()], "query_id string, term string, tf int")
        if len(given) > LITERAL_TERMS:
            return self.search_batch(queries, k).drop("query_id")
        # Only the terms that the vocabulary has are read.
        df = {r["term"]: r["df"] for r in self.vocab.where(F.col("term").isin(list(given))).collect()}
        self.terms_read += len(df)
        narrow = InvertedIndex(self.postings.where(F.col("term").isin(list(df))), spark.createDataFrame(list(df.items()), "term string, df bigint"), self.doc_norms, self.n_docs)
        rows = self.entries(list(df)).join(F.broadcast(narrow.asked(queries).select("term", "wq", "df")), "term").join(self.doc_norms, "doc_id")  # LITERAL_TERMS at most
        top = rows.groupBy("doc_id").agg(F.sum(F.col("wq") * self.unit_weight()).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
        return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id"))).select("rank", "doc_id", "score")


def best(scores: DataFrame, k: int, digits: int | None = None, descending: bool = True) -> DataFrame:
    """(query_id, rank, doc_id, score): k rows for each query, equal scores by document.

    Spark keeps k rows for each query and partition before the shuffle (WindowGroupLimit), so no query's candidates meet in one task.
    """
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    order = [F.desc("score") if descending else F.asc("score"), F.col("doc_id")]
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", "score")
