"""Small literal collections for demonstrations and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Term frequencies of three books, and small collections of texts, images and audio with their queries.
AUSTEN = {
    "SS_sentido_sensibilidad": {"afecto": 115, "celosa": 10, "chisme": 2, "borrascoso": 0},
    "OP_orgullo_prejuicio": {"afecto": 58, "celosa": 7, "chisme": 0, "borrascoso": 0},
    "CB_cumbres_borrascosas": {"afecto": 20, "celosa": 11, "chisme": 6, "borrascoso": 38},
}
TEXT = {
    "doc_001_love": {"love": 8, "heart": 6, "you": 5, "night": 2, "dance": 1},
    "doc_002_love": {"love": 7, "heart": 7, "you": 4, "night": 3, "dance": 2},
    "doc_003_party": {"dance": 9, "night": 8, "club": 6, "music": 5, "love": 1},
    "doc_004_party": {"dance": 10, "night": 7, "club": 7, "music": 4, "love": 2},
    "doc_005_sad": {"cry": 9, "alone": 7, "rain": 6, "night": 4, "heart": 3},
    "doc_006_sad": {"cry": 8, "alone": 8, "rain": 5, "night": 5, "heart": 2},
}
TEXT_QUERIES = {"q_love": {"love": 7, "heart": 6, "you": 4}, "q_party": {"dance": 9, "night": 7, "club": 6}, "q_sad": {"cry": 8, "alone": 7, "rain": 5}}
IMAGE = {
    "img_001_shoe": {"v0": 9, "v1": 4, "v2": 7, "v5": 2, "v9": 1},
    "img_002_shoe": {"v0": 8, "v1": 5, "v2": 6, "v5": 3, "v9": 2},
    "img_003_shirt": {"v1": 3, "v3": 8, "v4": 10, "v6": 5, "v8": 2},
    "img_004_shirt": {"v1": 2, "v3": 9, "v4": 11, "v6": 4, "v8": 3},
    "img_005_watch": {"v2": 1, "v5": 2, "v7": 12, "v8": 8, "v9": 6},
    "img_006_watch": {"v2": 2, "v5": 1, "v7": 13, "v8": 7, "v9": 5},
}
IMAGE_QUERIES = {"q_shoe": {"v0": 8, "v1": 4, "v2": 6, "v5": 2}, "q_watch": {"v7": 11, "v8": 7, "v9": 5}}
AUDIO = {
    "song_001_rock": {"a0": 12, "a1": 5, "a2": 8, "a4": 3, "a7": 1},
    "song_002_rock": {"a0": 10, "a1": 6, "a2": 7, "a4": 4, "a8": 2},
    "song_003_pop": {"a1": 4, "a3": 9, "a5": 11, "a6": 6, "a9": 2},
    "song_004_pop": {"a1": 3, "a3": 10, "a5": 12, "a6": 5, "a9": 3},
    "song_005_jazz": {"a2": 2, "a4": 1, "a7": 14, "a8": 9, "a9": 7},
    "song_006_jazz": {"a2": 3, "a4": 2, "a7": 13, "a8": 10, "a9": 6},
    "song_007_silence": {"a0": 1, "a9": 1},
}
AUDIO_QUERIES = {"q_rocky": {"a0": 9, "a1": 5, "a2": 7, "a4": 3}, "q_poppy": {"a3": 8, "a5": 10, "a6": 5, "a9": 2}, "q_jazzy": {"a7": 12, "a8": 8, "a9": 6}}


def relation(spark: SparkSession, collection: dict[str, dict[str, int]], key: str = "doc_id") -> DataFrame:
    """(key, term, tf) of a literal collection."""
    rows = [(name, term, n) for name, terms in collection.items() for term, n in terms.items()]
    return spark.createDataFrame(rows, f"{key} string, term string, tf int")


def demo(spark: SparkSession, k: int = 3) -> DataFrame:
    """(modality, metric, query_id, rank, doc_id, score): all four metrics over the three small collections."""
    from pyspark.sql import functions as F

    from tessera.operators import similarity

    out = None
    for modality, docs, queries in (("text", TEXT, TEXT_QUERIES), ("image", IMAGE, IMAGE_QUERIES), ("audio", AUDIO, AUDIO_QUERIES)):
        tf, asked = relation(spark, docs), relation(spark, queries, "query_id")
        vectors, q = similarity.build_tfidf(tf), similarity.vectorize_queries(asked, tf)
        for metric in similarity.METRICS:
            ranked = similarity.top_k(q, vectors, k, metric, 6).select(F.lit(modality).alias("modality"), F.lit(metric).alias("metric"), "query_id", "rank", "doc_id", "score")
            out = ranked if out is None else out.union(ranked)
    return out
