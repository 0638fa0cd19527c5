"""The registered queries over the driver's tables, and the DuckDB SQL that must give the same rows.

documents stand for texts, benchmark for query texts, embeddings for feature vectors, labels for relevance, part for a product
catalogue and events for a search log.  Exhaustive searches take as queries the rows whose id is divisible by 20.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors, weights
from tessera.operators import clustering, evaluation, fulltext, index, pairing, similarity, terms, vector_search
from tessera import schema
from tessera.plans import fixtures, pipelines
from tessera.session import scratch, stored
from tessera.sources import catalogues, files, synthetic
from tessera.sources.tables import Store
from tessera.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
K, DIGITS, CODEBOOK, WORDS, CENTROIDS, EVERY = 10, 6, 1000, 32, 8, 20


def _table(name: str) -> Query:
    return lambda spark, sf: spark.read.parquet(f"{sf}/{name}.parquet")


documents, embeddings, benchmark, labels, part, events = (_table(n) for n in ("documents", "embeddings", "benchmark", "labels", "part", "events"))


def _tf(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_frequencies(documents(spark, sf))


def _stored_tf(spark: SparkSession, sf: str) -> DataFrame:
    return stored(_tf(spark, sf), "tf")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_frequencies(benchmark(spark, sf), "item_id").withColumnRenamed("doc_id", "query_id")


def _few_queries(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_frequencies(benchmark(spark, sf).where(F.col("item_id") % EVERY == 0), "item_id").withColumnRenamed("doc_id", "query_id")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


# ---- terms and weights -----------------------------------------------------------------------------------------------


def idf(spark: SparkSession, sf: str) -> DataFrame:
    tf = _tf(spark, sf)
    n = tf.agg(F.countDistinct("doc_id").alias("n_docs"))
    own = terms.document_frequency(tf).crossJoin(F.broadcast(n))  # one row
    return own.select("term", "df", F.round(weights.idf(F.col("df"), F.col("n_docs")), DIGITS).alias("idf"))


def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(terms.weighted(_stored_tf(spark, sf)).select("doc_id", "term", "w"), "w")


def l2_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(terms.l2_normalized(terms.weighted(_stored_tf(spark, sf)).select("doc_id", "term", "w")), "w").select("doc_id", "term", "w")


def doc_norms(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(terms.norms(terms.weighted(_stored_tf(spark, sf))), "norm")


def postings(spark: SparkSession, sf: str) -> DataFrame:
    return terms.with_df(terms.postings(_stored_tf(spark, sf))).select("term", "df", "doc_id", "tf")


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    tf = _tf(spark, sf)
    return tf.agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("term").alias("vocab_size"), F.count("*").alias("n_postings"))


def codebook_topk(spark: SparkSession, sf: str) -> DataFrame:
    return terms.top_terms(_tf(spark, sf), CODEBOOK)


def codebook_filtered_tf(spark: SparkSession, sf: str) -> DataFrame:
    tf = _tf(spark, sf)
    return terms.within_codebook(tf, terms.top_terms(tf, CODEBOOK)).select("doc_id", "term", "tf")


def prepare_query(spark: SparkSession, sf: str) -> DataFrame:
    return terms.within_codebook(_queries(spark, sf), terms.top_terms(_tf(spark, sf), CODEBOOK)).select("query_id", "term", "tf")


def stopwords_tf(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_frequencies(documents(spark, sf), stop=T.STOPWORDS)


def stem_tf(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_frequencies(documents(spark, sf), stop=T.STOPWORDS, stem=True)


def split_text(spark: SparkSession, sf: str) -> DataFrame:
    return T.chunks(documents(spark, sf), "doc_id", "text", mark="\n").select(F.col("doc_id").alias("chunk_id"), F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def hist_to_dense(spark: SparkSession, sf: str) -> DataFrame:
    tf = stored(_tf(spark, sf), "tf")
    keys = sorted(r["term"] for r in terms.top_terms(tf, WORDS).collect())  # WORDS rows
    hists = terms.as_maps(tf.where(F.col("term").isin(keys)))
    return hists.select("doc_id", F.posexplode(vectors.hist_to_dense(F.col("hist"), keys)).alias("dim", "value")).select("doc_id", "dim", F.round("value", DIGITS).alias("value"))


def word_quantizer_hist(spark: SparkSession, sf: str) -> DataFrame:
    tf = _stored_tf(spark, sf)
    return terms.vocabulary_histogram(tf, terms.top_terms(tf, WORDS))


def row_histogram(spark: SparkSession, sf: str) -> DataFrame:
    own = documents(spark, sf)
    chunked = stored(terms.term_frequencies(T.chunks(own, "doc_id", "text", mark="\n"), again=terms.repeated(own, "doc_id")), "chunks")
    kept = terms.within_codebook(chunked, terms.top_terms(chunked, CODEBOOK))
    return terms.row_histograms(kept, F.regexp_replace("doc_id", pipelines.CHUNK, ""))


# ---- ranking ---------------------------------------------------------------------------------------------------------


def _index(spark: SparkSession, sf: str) -> index.InvertedIndex:
    return index.InvertedIndex.build(stored(_tf(spark, sf), "tf")).write(scratch(spark, "index"))


def spimi_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: the document of the least id as query."""
    docs = documents(spark, sf)
    first = docs.orderBy("doc_id").select("doc_id", "text").limit(1)
    query = terms.term_frequencies(first).withColumnRenamed("doc_id", "query_id")
    return _index(spark, sf).search_batch(query, K, DIGITS).select("rank", "doc_id", "score")


def spimi_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).search_batch(_queries(spark, sf), K, DIGITS)


def _asked_and_docs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The few queries at unit length, and all documents' weights, not at unit length."""
    tf = _stored_tf(spark, sf)
    vocab = stored(terms.document_frequency(tf), "vocab")
    return stored(similarity.vectorize_queries(_few_queries(spark, sf), tf, vocab=vocab), "queries"), similarity.build_tfidf(tf, normalize=False, vocab=vocab)


def _dense(metric: str | float) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        asked, docs = _asked_and_docs(spark, sf)
        return similarity.top_k(asked, docs, K, metric, DIGITS, unit=True)

    return run


def dense_topk_minkowski3(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(3)(spark, sf)


def sparse_dot(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(similarity.dots(*_asked_and_docs(spark, sf)), "dot")


def pgvector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of raw counts over the codebook, without IDF."""
    tf = stored(_tf(spark, sf), "tf")
    codebook = stored(terms.top_terms(tf, CODEBOOK), "codebook")
    raw = lambda own: terms.within_codebook(own, codebook).withColumn("w", F.col("tf").cast("double")).drop("tf")
    return similarity.top_k(stored(raw(_few_queries(spark, sf)), "queries"), stored(raw(tf), "vectors"), K, "cosine", DIGITS)


def feature_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Feature vectors to codewords to an index: a label's vectors are one medium, every 20th vector a query of its own."""
    own = embeddings(spark, sf)
    rows = own.select(F.col("label").cast("string").alias("doc_id"), F.col("vec_id").cast("int").alias("vec_idx"), F.col("embedding").alias("features"))
    made = pipelines.index_features(rows, CENTROIDS * 4, scratch(spark, "features"), "v")
    asked = _vector_queries(spark, sf).select(F.col("query_id").alias("doc_id"), F.col("embedding").alias("features"))
    return made.index.search_batch(clustering.codeword_tf(asked, made.centroids, "v").withColumnRenamed("doc_id", "query_id"), K, DIGITS)


def etl_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the music application from the documents: index, histograms, dense vectors, ids, codebook."""
    folder = scratch(spark, "etl")
    texts = documents(spark, sf).select(F.col("doc_id").cast("string").alias("stem"), "text")
    index_of = pipelines.index_text(texts, CODEBOOK, f"{folder}/lyrics", mark="\n")
    items = documents(spark, sf).select(F.col("doc_id").cast("string").alias("stem"), F.col("doc_id").cast("string").alias("title"), F.col("source").alias("artist"), F.col("lang").alias("genre"), F.col("text").alias("lyrics_text"))
    store = Store(spark, f"{folder}/store")
    pipelines.load_songs(store, items, index_of)
    return store.read("songs").select("title", "artist", F.size("lyrics_hist").alias("n_terms"), F.size("lyrics_emb").alias("n_dims"))


def fts_and_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Conjunctive search for all words of each query text."""
    asked = benchmark(spark, sf).select(F.col("item_id").alias("query_id"), F.explode(T.tokens(F.col("text"))).alias("term"))
    return fulltext.search(_tf(spark, sf), asked, K, DIGITS)


def text_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraph chunks, stopwords, stems, codebook, stored index, batch of queries."""
    folder = scratch(spark, "text-index")
    texts = documents(spark, sf).select(F.col("doc_id").cast("string").alias("stem"), "text")
    own = pipelines.index_text(texts, CODEBOOK, folder, mark="\n")
    asked = terms.term_frequencies(benchmark(spark, sf), "item_id", stop=T.STOPWORDS, stem=True).withColumnRenamed("doc_id", "query_id")
    return own.index.search_batch(terms.within_codebook(asked, own.codebook), K, DIGITS)


# ---- vectors ---------------------------------------------------------------------------------------------------------


def _vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings(spark, sf).where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def vector_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vector_search.cosine_top_k_batch(embeddings(spark, sf), _vector_queries(spark, sf), K, digits=DIGITS)


def vector_cosine_one(spark: SparkSession, sf: str) -> DataFrame:
    rows = embeddings(spark, sf)
    return vector_search.cosine_top_k(rows, list(rows.orderBy("vec_id").first()["embedding"]), K, digits=DIGITS)


def lsh_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every 20th vector against all by hashing; tests hold its recall against the exact search."""
    return vector_search.lsh_top_k_batch(embeddings(spark, sf), _vector_queries(spark, sf), K, digits=DIGITS)


def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    own = embeddings(spark, sf).select(F.col("vec_id").alias("doc_id"), "label")
    return _rounded(evaluation.recall_at_k(vector_cosine_topk(spark, sf), own, K), "recall")


def _first_centroids(spark: SparkSession, sf: str) -> np.ndarray:
    return np.array([r[0] for r in embeddings(spark, sf).orderBy("vec_id").select("embedding").limit(CENTROIDS).collect()], np.float64)


def quantize_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.quantize(embeddings(spark, sf), _first_centroids(spark, sf), "embedding").select("vec_id", "idx")


def codeword_hist(spark: SparkSession, sf: str) -> DataFrame:
    """Codewords of all vectors of a label, as a medium of many vectors."""
    features = embeddings(spark, sf).select(F.col("label").cast("string").alias("doc_id"), F.col("embedding").alias("features"))
    return clustering.codeword_tf(features, _first_centroids(spark, sf), "v")


def codeword_full_hist(spark: SparkSession, sf: str) -> DataFrame:
    coded = clustering.quantize(embeddings(spark, sf), _first_centroids(spark, sf), "embedding").select(F.col("label").alias("doc_id"), "idx")
    return clustering.full_histogram(coded, CENTROIDS)


def centroid_update(spark: SparkSession, sf: str) -> DataFrame:
    coded = clustering.quantize(embeddings(spark, sf), _first_centroids(spark, sf), "embedding")
    return _rounded(clustering.centroid_means(coded, "embedding"), "mean")


def _codebook(algorithm: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        own = clustering.cluster(clustering.sample_rows(embeddings(spark, sf), clustering.SAMPLE, ["vec_id"]), CENTROIDS, ["vec_id"], algorithm, "embedding")
        return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(own)], "idx int, c array<double>")

    return run


# ---- joins, metadata and evaluation ----------------------------------------------------------------------------------


def _stems(df: DataFrame, id_col: str, ext: str) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("stem"), F.concat(F.col(id_col).cast("string"), F.lit(ext)).alias("path"))


def collect_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.collect_files(_stems(documents(spark, sf), "doc_id", ".txt"), _stems(part(spark, sf), "p_partkey", ".wav"))


def coverage_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.coverage(collect_full_outer(spark, sf))


def pair_inner(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.pair_files(_stems(part(spark, sf), "p_partkey", ".png"), _stems(documents(spark, sf), "doc_id", ".txt"))


def metadata_left(spark: SparkSession, sf: str) -> DataFrame:
    meta = part(spark, sf).select(F.col("p_partkey").cast("string").alias("stem"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    return pairing.with_metadata(_stems(documents(spark, sf), "doc_id", ".txt"), meta, "title")


def not_cached(spark: SparkSession, sf: str) -> DataFrame:
    have = labels(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"))
    return pairing.not_cached(_stems(documents(spark, sf), "doc_id", ".txt"), have)


def extension_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Items that have a text or a picture or both: the picture first."""
    both = _stems(documents(spark, sf), "doc_id", ".txt").withColumn("ext", F.lit(".txt")).union(_stems(part(spark, sf), "p_partkey", ".png").withColumn("ext", F.lit(".png")))
    return pairing.first_by_extension(both, [".png", ".txt"])


def safe_stem(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf).select("p_partkey", T.safe_stem(F.concat_ws("_", "p_brand", "p_name")).alias("stem"))


def unique_stems(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.unique_stems(part(spark, sf).select("p_partkey", "p_type"), F.col("p_type"), [F.col("p_partkey")]).select("p_partkey", "stem")


def compose_desc(spark: SparkSession, sf: str) -> DataFrame:
    row = {"productDisplayName": F.col("p_name"), "masterCategory": F.col("p_brand"), "subCategory": F.col("p_type"), "season": F.when(F.col("p_size") > 25, F.concat(F.lit("S"), F.col("p_size").cast("string")))}
    return part(spark, sf).select("p_partkey", T.product_description(row).alias("description"))


def short_desc(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf).select("p_partkey", T.short_description(F.col("p_name"), F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type"))).alias("description"))


def first_given(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf).select("p_partkey", T.first_given(F.when(F.col("p_size") > 40, F.col("p_name")), F.when(F.col("p_size") > 20, F.lit("  ")), F.col("p_brand")).alias("name"))


def append_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """A second collection appended to the first, and its stems once."""
    return _stems(documents(spark, sf), "doc_id", ".txt").select("stem").unionByName(_stems(part(spark, sf), "p_partkey", ".txt").select("stem")).distinct()


def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.label_counts(embeddings(spark, sf))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.latency_summary(events(spark, sf), "value", ["event_type"])


def search_log_hours(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of searches, each trigger's whole result replacing the one before."""
    folder = scratch(spark, "log-hours")
    stream = spark.readStream.schema(events(spark, sf).schema).parquet(f"{sf}/events.parquet*")
    # The table's times have no zone; they are read in the session's and turned back.
    own = ingest.search_log_windows(stream.withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("avg_latency", DIGITS).alias("avg_latency"))
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/windows")  # noqa: ARG005, E731
    own.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/windows")


def result_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as the search facade shows them."""
    found = spimi_topk(spark, sf)
    return found.join(documents(spark, sf).select("doc_id", F.col("source").alias("name")), "doc_id").select(F.col("doc_id").alias("id"), "name", "score", F.lit("spimi").alias("engine"))


def codebook_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Three codebooks, one of them saved again with its new size."""
    store = Store(spark, scratch(spark, "store"))
    n = documents(spark, sf).count()
    for app, modality, size in (("music", "text", n), ("music", "audio", 200), ("fashion", "text", 50), ("music", "text", n + 1)):
        store.save_codebook(app, modality, size)
    return store.read("codebooks").select(F.col("app").cast("string").alias("app"), F.col("modality").cast("string").alias("modality"), F.col("codebook_size").cast("bigint").alias("codebook_size"))


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents streamed into the term table, which then ranks the batch of queries."""
    folder = scratch(spark, "stream")
    given = documents(spark, sf)
    stream = spark.readStream.schema(given.schema).parquet(f"{sf}/documents.parquet*")
    ingest.ingest(stream, f"{folder}/terms", f"{folder}/checkpoint").awaitTermination()
    return index.InvertedIndex.build(stored(ingest.term_table(spark, f"{folder}/terms"), "terms")).search_batch(_queries(spark, sf), K, DIGITS)


def sampled_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Query spans of two to five words of sampled documents."""
    own = synthetic.sampled(documents(spark, sf), 100, "doc_id")
    return own.select("doc_id", synthetic.text_span(F.col("text"), F.col("doc_id")).alias("query"))


def sampled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.sample_rows(embeddings(spark, sf), 100, ["vec_id"]).select("vec_id", "label")


def synthetic_topk(spark: SparkSession, sf: str) -> DataFrame:
    """As many synthetic documents as there are documents, and 100 synthetic queries."""
    own = stored(synthetic.corpus(spark, documents(spark, sf).count()), "corpus")
    return index.InvertedIndex.build(own).write(scratch(spark, "index")).search_batch(synthetic.queries(spark, 100), K, DIGITS)


def demo_metrics(spark: SparkSession, sf: str) -> DataFrame:  # noqa: ARG001
    return fixtures.demo(spark)


def ranked_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The three longest documents of each source."""
    own = documents(spark, sf).select("source", "doc_id", "n_chars")
    by = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return own.withColumn("rank", F.row_number().over(by)).where("rank <= 3")


# ---- sources and sinks -----------------------------------------------------------------------------------------------


def _items(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """The products as items of a collection: stem and three columns of the given names, some blank."""
    blank = F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_name"))
    return part(spark, sf).select(F.col("p_partkey").cast("string").alias("stem"), blank.alias(names[0]), F.col("p_brand").alias(names[1]), F.col("p_type").alias(names[2]))


def _csv_back(names: tuple[str, str, str], read: Callable[[SparkSession, str], DataFrame]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        folder = scratch(spark, "metadata")
        _items(spark, sf, *names).write.option("header", True).csv(folder)
        return read(spark, folder)

    return run


def jsonl_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Term maps written as JSON lines and read as a corpus."""
    folder = scratch(spark, "jsonl")
    terms.as_maps(_tf(spark, sf)).select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("hist").alias("tf"))).alias("value")).write.text(folder)
    return catalogues.corpus(spark, folder)


def block_import(spark: SparkSession, sf: str) -> DataFrame:
    """Posting lists of the query texts written as blocks of JSON lines and read back."""
    folder = scratch(spark, "blocks")
    lists = terms.posting_lists(_queries(spark, sf).withColumnRenamed("query_id", "doc_id"))
    pairs = F.transform("postings", lambda p: F.array(p["doc_id"].cast("string"), p["tf"].cast("string")))
    lists.select(F.to_json(F.struct(F.col("term").alias("t"), pairs.alias("p"))).alias("value")).write.text(folder)
    return catalogues.blocks(spark, folder)


def lyrics_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a catalogue of lyrics under other column names; short ones drop out."""
    rows = documents(spark, sf).select(F.col("text").alias("lyrics"), F.col("doc_id").cast("string").alias("track_name"), F.col("source").alias("track_artist"), F.col("lang").alias("playlist_genre"))
    return catalogues.lyrics_catalogue(rows).select("title", "artist", "genre", F.md5("lyrics").alias("lyrics_md5"))


def text_files(spark: SparkSession, sf: str) -> DataFrame:
    """The query texts materialised as files with their metadata, and read back."""
    folder = scratch(spark, "files")
    own = benchmark(spark, sf).select(F.col("item_id").cast("string").alias("stem"), "text", F.char_length("text").alias("n_chars"))
    files.write_texts(own, folder)
    listed = spark.read.csv(f"{folder}/metadata.csv", header=True, escape='"')
    return files.read_texts(spark, folder).join(listed, "stem").select("stem", F.md5("text").alias("text_md5"), F.col("n_chars").cast("bigint").alias("n_chars"))


def posting_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The postings of the term of most documents, looked up in the stored index, with its df and the vocabulary's size."""
    own = _index(spark, sf)
    term = own.vocab.orderBy(F.desc("df"), "term").first()["term"]
    return own.get_postings(term).select("doc_id", "tf", F.lit(own.df(term)).cast("bigint").alias("df"), F.lit(own.vocab_size()).cast("bigint").alias("vocab_size"))


def cached_features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows cached twice: the second time only documents that the cache lacks are added."""
    store = Store(spark, scratch(spark, "features"))
    rows = embeddings(spark, sf).select(F.col("label").cast("string").alias("doc_id"), F.col("vec_id").cast("int").alias("vec_idx"), F.col("embedding").cast("array<double>").alias("features"))
    store.cache_features(rows.where("doc_id < '5'"))
    store.cache_features(rows)
    return store.read("features").select("doc_id", "vec_idx", F.size("features").alias("n_dims"))


def codebook_terms(spark: SparkSession, sf: str) -> DataFrame:
    """A codebook saved with its words and loaded again."""
    store = Store(spark, scratch(spark, "store"))
    tf = stored(_tf(spark, sf), "tf")
    bag = [r["term"] for r in terms.top_terms(tf, CODEBOOK).collect()]  # CODEBOOK rows
    store.save_codebook("music", "text", len(bag), bag)
    loaded = store.load_bag("music", "text", tf)
    return spark.createDataFrame([(i, t) for i, t in enumerate(loaded)], "place int, term string")


def search_log(spark: SparkSession, sf: str) -> DataFrame:  # noqa: ARG001
    """Six logged searches of two applications."""
    store = Store(spark, scratch(spark, "log"))
    for i in range(6):
        store.log_search("music" if i % 2 else "fashion", "text", "spimi", f"query {i}", float(i), i)
    return store.read("search_logs").groupBy("app").agg(F.count("*").alias("n"), F.sum("latency_ms").alias("latency"), F.sum("n_results").cast("bigint").alias("results"))


def inserted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Products inserted in two batches after a reset: ids go on from the table's last, missing columns are null and maps empty."""
    store = Store(spark, scratch(spark, "rows"))
    store.reset("songs", schema.SONGS)
    items = part(spark, sf).select(F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    first = store.save_rows("songs", items, schema.SONGS)
    second = store.save_rows("songs", items, schema.SONGS)
    rows = store.read("songs")
    return rows.groupBy("title", "artist").agg(F.count("*").alias("n"), F.sum(F.size("lyrics_hist")).cast("bigint").alias("entries")).crossJoin(F.broadcast(rows.agg(F.min("id").alias("least"), F.max("id").alias("most"), F.countDistinct("id").alias("ids")))).withColumn("firsts", F.lit(f"{first},{second}"))  # one row


_OWN: list[Query] = [
    idf, tfidf_weights, l2_normalized, doc_norms, postings, corpus_stats, codebook_topk, codebook_filtered_tf, prepare_query, stopwords_tf, stem_tf, split_text, hist_to_dense, word_quantizer_hist,
    row_histogram, spimi_topk, spimi_topk_batch, dense_topk_minkowski3, sparse_dot, pgvector_topk, feature_index_topk, etl_rows, fts_and_topk, text_index_topk, vector_cosine_topk, vector_cosine_one, lsh_topk, recall_at_k, quantize_nearest,
    codeword_hist, codeword_full_hist, centroid_update, collect_full_outer, coverage_counts, pair_inner, metadata_left, not_cached, extension_priority, safe_stem, unique_stems, compose_desc,
    short_desc, first_given, append_distinct, label_counts, latency_percentiles, search_log_hours, result_envelope, codebook_upsert, stream_ingest, sampled_spans, sampled_vectors, synthetic_topk,
    demo_metrics, ranked_labels, jsonl_corpus, block_import, lyrics_rows, text_files, posting_lookup, cached_features, codebook_terms, search_log, inserted_rows,
]


def queries() -> dict[str, Query]:
    own: dict[str, Query] = {"tf": _tf, "df": lambda spark, sf: terms.document_frequency(_tf(spark, sf))}
    own |= {q.__name__: q for q in _OWN}
    own |= {f"dense_topk_{m}": _dense(m) for m in similarity.METRICS}
    own["music_metadata"] = _csv_back(("title", "artist", "genre"), catalogues.music_metadata)
    own["fashion_metadata"] = _csv_back(("name", "category", "subcategory"), catalogues.fashion_metadata)
    return own | {"kmeans_codebook": _codebook("kmean"), "kmedoid_codebook": _codebook("kmedoid")}


def oracle_sql() -> dict[str, str]:
    from tessera.plans import oracle

    return oracle.statements()
