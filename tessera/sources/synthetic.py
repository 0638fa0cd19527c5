"""Synthetic corpora and query sets, and samples of queries from stored rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship


def _zipf(vocab_size: int) -> np.ndarray:
    weights = 1 / np.arange(1, vocab_size + 1)
    return np.cumsum(weights) / weights.sum()


def corpus(spark: SparkSession, n_docs: int, vocab_size: int = 5000, least: int = 50, most: int = 200, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """(doc_id, term, tf): documents of `least` to `most` Zipf draws; a document depends on its number and the seed only."""
    ship(spark)
    steps = _zipf(vocab_size)

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array([f"t_{i:05d}" for i in range(vocab_size)])
        for pdf in batches:
            for start in range(0, len(pdf), 2000):
                docs, found, numbers = [], [], []
                for doc in pdf["id"].iloc[start : start + 2000]:
                    draw = np.random.default_rng([seed, int(doc)])
                    terms, counts = np.unique(np.searchsorted(steps, draw.random(draw.integers(least, most + 1))), return_counts=True)
                    docs.append(np.full(len(terms), doc))
                    found.append(terms)
                    numbers.append(counts)
                if docs:
                    ids = np.concatenate(docs)
                    yield pd.DataFrame({"doc_id": [f"doc_{i:07d}" for i in ids], "term": names[np.concatenate(found)], "tf": np.concatenate(numbers).astype(np.int32)})

    ids = spark.range(0, n_docs, 1, partitions) if partitions else spark.range(n_docs)
    return ids.mapInPandas(sample, "doc_id string, term string, tf int")


def queries(spark: SparkSession, n_queries: int, vocab_size: int = 5000, seed: int = 7) -> DataFrame:
    """(query_id, term, tf): 1 to 5 Zipf draws a query."""
    steps, draw = _zipf(vocab_size), np.random.default_rng(seed)
    rows = []
    for q in range(n_queries):
        terms, counts = np.unique(np.searchsorted(steps, draw.random(draw.integers(1, 6))), return_counts=True)
        rows += [(f"q_{q:04d}", f"t_{t:05d}", int(n)) for t, n in zip(terms, counts)]
    return spark.createDataFrame(rows, "query_id string, term string, tf int")


def sampled(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, by a hash of the key."""
    return rows.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def text_span(text: Column, key: Column, least: int = 2, most: int = 5, seed: int = 42) -> Column:
    """A span of `least` to `most` words of the text; where it starts follows from a hash of the key."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    size = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(most - least + 1)) + least
    start = F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.greatest(F.size(words) - size + 1, F.lit(1))) + 1
    return F.array_join(F.slice(words, start.cast("int"), size.cast("int")), " ")
