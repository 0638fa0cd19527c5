"""Search facade: application x modality x engine.

Unknown engines, applications and k outside 1..100 are ValueErrors, missing indexes and codebooks LookupErrors.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import vectors
from tessera.operators import fulltext, vector_search
from tessera.operators.index import InvertedIndex
from tessera.plans import pipelines
from tessera.sources import audio, images
from tessera.sources.tables import Store

TEXT_ENGINES, MEDIA_ENGINES = ("spimi", "gin", "gist", "pgvector"), ("spimi", "pgvector")
LEAST_K, MOST_K, DEFAULT_K = 1, 100, 10


@dataclass(frozen=True)
class Modality:
    """Where an application keeps a modality: its table, name column, vector and text columns, index folder and codeword prefix."""

    table: str
    kind: object
    name_col: str
    emb_col: str
    folder: str
    text_col: str | None = None
    prefix: str | None = None
    extractor: object = None


MODALITIES = {
    ("music", "text"): Modality("songs", schema.SONGS, "title", "lyrics_emb", "lyrics", "lyrics_text"),
    ("music", "audio"): Modality("songs", schema.SONGS, "title", "audio_emb", "audio", None, "a", audio.mfcc),
    ("fashion", "text"): Modality("products", schema.PRODUCTS, "name", "desc_emb", "descriptions", "description"),
    ("fashion", "image"): Modality("products", schema.PRODUCTS, "name", "image_emb", "images", None, "v", images.gradients),
}


@dataclass
class SearchService:
    """Searches over one folder of indexes and a store of rows."""

    spark: SparkSession
    store: Store
    folder: str
    _indexes: dict = field(default_factory=dict)
    _bags: dict = field(default_factory=dict)
    _centroids: dict = field(default_factory=dict)

    def clear_caches(self) -> None:
        for cache in (self._indexes, self._bags, self._centroids):
            cache.clear()

    def index(self, app: str, modality: str) -> InvertedIndex:
        key = (app, modality)
        if key not in self._indexes:
            self.store.load_codebook(*key)
            self._indexes[key] = InvertedIndex.open(self.spark, f"{self.folder}/{MODALITIES[key].folder}")
        return self._indexes[key]

    def bag(self, app: str, modality: str) -> list[str]:
        key = (app, modality)
        if key not in self._bags:
            self._bags[key] = self.store.load_bag(app, modality, self.index(app, modality).vocab)
        return self._bags[key]

    def centroids(self, app: str, modality: str) -> np.ndarray:
        key = (app, modality)
        if key not in self._centroids:
            self.store.load_codebook(*key)
            self._centroids[key] = pipelines.load_centroids(self.spark, f"{self.folder}/{MODALITIES[key].folder}")
        return self._centroids[key]

    def query_terms(self, app: str, modality: str, query: str | bytes) -> dict[str, int]:
        """Term frequencies of a query text or medium."""
        m = MODALITIES[app, modality]
        if m.text_col:
            codebook = self.spark.createDataFrame([(t,) for t in self.bag(app, modality)], "term string")
            tf = pipelines.prepare_text_query(self.spark, str(query), codebook)
        else:
            tf = pipelines.prepare_media_query(self.spark, bytes(query), m.extractor, self.centroids(app, modality), m.prefix)  # type: ignore[arg-type]
        return {r["term"]: r["tf"] for r in tf.collect()}  # the terms of one query

    def keys(self, app: str, modality: str) -> list[str]:
        m = MODALITIES[app, modality]
        return self.bag(app, modality) if m.text_col else [f"{m.prefix}_{i:04d}" for i in range(len(self.centroids(app, modality)))]

    def ranking(self, app: str, modality: str, query: str | bytes, engine: str, k: int) -> DataFrame:
        m = MODALITIES[app, modality]
        if engine == "spimi":
            found = self.index(app, modality).search_topk(self.query_terms(app, modality, query), k)
            return found.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("name"), "score", F.lit(engine).alias("engine"))
        rows = self.store.read(m.table, m.kind)  # type: ignore[arg-type]
        if engine == "pgvector":
            hist = self.query_terms(app, modality, query)
            counts = np.array([hist.get(t, 0) for t in self.keys(app, modality)], np.float64)
            size = np.linalg.norm(counts)
            unit = (counts / size if size else counts).tolist()
            scored = rows.where(F.col(m.emb_col).isNotNull()).select("id", F.col(m.name_col).alias("name"), vectors.cosine(F.col(m.emb_col), F.array(*(F.lit(x) for x in unit))).alias("score"))
            return scored.orderBy(F.desc("score"), "id").limit(k).withColumn("engine", F.lit(engine))
        from tessera.functions import text as T
        from tessera.operators import terms

        tf = terms.term_frequencies(rows, "id", m.text_col, T.STOPWORDS, stem=True)  # type: ignore[arg-type]
        asked = pipelines.prepare_text_query(self.spark, str(query))
        found = fulltext.search(tf, asked, k).withColumnRenamed("doc_id", "id")
        return found.join(rows.select("id", F.col(m.name_col).alias("name")), "id").orderBy("rank").select("id", "name", "score", F.lit(engine).alias("engine"))

    def search(self, app: str, modality: str, query: str | bytes, engine: str = "spimi", k: int = DEFAULT_K) -> dict:
        """The response: application, modality, engine, query, k, latency and ranked results."""
        if (app, modality) not in MODALITIES:
            raise ValueError(f"unknown application or modality: {app}/{modality}")
        if engine not in (TEXT_ENGINES if MODALITIES[app, modality].text_col else MEDIA_ENGINES):
            raise ValueError(f"unknown engine: {engine}")
        if not LEAST_K <= k <= MOST_K:
            raise ValueError(f"k must be between {LEAST_K} and {MOST_K}")
        began = time.perf_counter()
        results = [r.asDict() for r in self.ranking(app, modality, query, engine, k).collect()]  # k rows
        ms = round((time.perf_counter() - began) * 1000, 3)
        shown = query if isinstance(query, str) else f"<{len(query)} bytes>"
        self.store.log_search(app, modality, engine, shown, ms, len(results))
        return {"app": app, "modality": modality, "engine": engine, "query": shown, "k": k, "latency_ms": ms, "results": results}

    def search_music_lyrics(self, query: str, engine: str = "spimi", k: int = DEFAULT_K) -> dict:
        return self.search("music", "text", query, engine, k)

    def search_music_audio(self, content: bytes, engine: str = "spimi", k: int = DEFAULT_K) -> dict:
        return self.search("music", "audio", content, engine, k)

    def search_fashion_desc(self, query: str, engine: str = "spimi", k: int = DEFAULT_K) -> dict:
        return self.search("fashion", "text", query, engine, k)

    def search_fashion_image(self, content: bytes, engine: str = "spimi", k: int = DEFAULT_K) -> dict:
        return self.search("fashion", "image", content, engine, k)

    def health(self) -> dict:
        """Whether the session answers, and which tables and engines there are."""
        alive = self.spark.range(1).count() == 1
        return {"status": "ok" if alive else "down", "tables": self.store.status(["songs", "products", "codebooks", "search_logs"]), "engines": list(TEXT_ENGINES)}

    def nearest(self, app: str, modality: str, vector: list[float], k: int = DEFAULT_K, approximate: bool = False) -> DataFrame:
        """Rows nearest to a vector, exactly or by hashing."""
        m = MODALITIES[app, modality]
        rows = self.store.read(m.table, m.kind)  # type: ignore[arg-type]
        search = vector_search.lsh_top_k if approximate else vector_search.cosine_top_k
        return search(rows, vector, k, "id", m.emb_col)
