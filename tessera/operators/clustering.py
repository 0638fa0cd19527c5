"""Codebooks of vectors: sampling, k-means and k-medoids, quantising, and codeword histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.session import ship

#: Training vectors of a codebook, as a bound of the sample; members of a cluster that a medoid update compares at a time.
SAMPLE, BLOCK = 50_000, 2048


def sample_rows(rows: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows without replacement: the least hashes of the keys, whatever the partitions."""
    return rows.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def nearest(vector: Column, centroids: list[list[float]]) -> Column:
    """Index of the nearest centroid, the lowest of equals."""
    table = F.array(*(F.struct(vectors.minkowski(vector, F.array(*(F.lit(float(x)) for x in c)), 2).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)))
    return F.array_min(table)["i"]


def quantize(rows: DataFrame, centroids: np.ndarray, vec_col: str = "features") -> DataFrame:
    """The rows with `idx`, the nearest centroid by |x|2 + |c|2 - 2xc in Arrow batches."""
    ship(rows.sparkSession)
    c = np.asarray(centroids, np.float64)
    squares = (c * c).sum(axis=1)

    @F.pandas_udf("int")
    def assign(batch: pd.Series) -> pd.Series:
        x = np.array(batch.tolist(), np.float64).reshape(len(batch), -1)
        return pd.Series((squares[None, :] - 2 * x @ c.T).argmin(axis=1).astype(np.int32))

    return rows.withColumn("idx", assign(F.col(vec_col)))


def initial_centroids(rows: DataFrame, k: int, keys: list[str], vec_col: str = "features", seed: int = 42) -> np.ndarray:
    """min(k, distinct vectors) rows of the data, by the order of a seeded hash."""
    points = sample_rows(rows.dropDuplicates([vec_col]), k, keys, seed).select(vec_col).collect()  # k rows
    return np.array([r[0] for r in points], np.float64)


def kmeans(rows: DataFrame, k: int, keys: list[str], vec_col: str = "features", seed: int = 42, most: int = 100, tolerance: float = 1e-6, start: np.ndarray | None = None) -> np.ndarray:
    """Centroids by Lloyd's iterations: partial sums for each task, k rows a task to the shuffle.

    An empty cluster keeps its centroid; it ends when no centroid moves by `tolerance`.
    """
    ship(rows.sparkSession)
    c = initial_centroids(rows, k, keys, vec_col, seed) if start is None else np.asarray(start, np.float64)
    if not len(c):
        raise ValueError("no vectors to cluster")
    points = rows.select(vec_col).cache()
    try:
        for _ in range(most):
            squares = (c * c).sum(axis=1)

            def partial(batches: Iterator[pd.DataFrame], c: np.ndarray = c, squares: np.ndarray = squares) -> Iterator[pd.DataFrame]:
                sums, counts = np.zeros_like(c), np.zeros(len(c))
                for pdf in batches:
                    if len(pdf):
                        x = np.array(pdf[vec_col].tolist(), np.float64)
                        at = (squares[None, :] - 2 * x @ c.T).argmin(axis=1)
                        np.add.at(sums, at, x)
                        counts += np.bincount(at, minlength=len(c))
                yield pd.DataFrame({"idx": np.arange(len(c)), "n": counts, "s": list(sums)})

            parts = points.mapInPandas(partial, "idx int, n double, s array<double>")
            each = [F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(c.shape[1])]
            moved = c.copy()
            for r in parts.groupBy("idx").agg(F.sum("n").alias("n"), *each).collect():  # k rows
                if r["n"] > 0:
                    moved[r["idx"]] = [r[f"s{d}"] / r["n"] for d in range(c.shape[1])]
            gap = np.linalg.norm(moved - c, axis=1).max()
            c = moved
            if gap < tolerance:
                break
    finally:
        points.unpersist()
    return c


def kmedoids(rows: DataFrame, k: int, keys: list[str], vec_col: str = "features", seed: int = 42, most: int = 100, sample: int = SAMPLE) -> np.ndarray:
    """Medoids of a bounded sample: the member with the least sum of distances to its cluster, in blocks of rows.

    The sample bounds what a cluster can hold; the sums are quadratic in it.
    """
    points = sample_rows(rows, sample, keys, seed).select(vec_col).collect()
    x = np.array([r[0] for r in points], np.float64)
    if not len(x):
        raise ValueError("no vectors to cluster")
    c = initial_centroids(rows, k, keys, vec_col, seed)
    for _ in range(most):
        at = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        moved = c.copy()
        for j in range(len(c)):
            own = x[at == j]
            if len(own):
                squares = (own * own).sum(axis=1)
                costs = np.concatenate([np.sqrt(np.maximum(squares[i : i + BLOCK, None] + squares[None, :] - 2 * own[i : i + BLOCK] @ own.T, 0)).sum(axis=1) for i in range(0, len(own), BLOCK)])
                moved[j] = own[costs.argmin()]
        gap = np.linalg.norm(moved - c, axis=1).max()
        c = moved
        if gap < 1e-6:
            break
    return c


def cluster(rows: DataFrame, k: int, keys: list[str], algorithm: str = "kmean", vec_col: str = "features", seed: int = 42) -> np.ndarray:
    if algorithm not in ("kmean", "kmedoid"):
        raise ValueError(f"unknown clustering algorithm: {algorithm}")
    return kmeans(rows, k, keys, vec_col, seed) if algorithm == "kmean" else kmedoids(rows, k, keys, vec_col, seed)


def train_codebook(features: DataFrame, k: int, sample: int = SAMPLE, seed: int = 42, algorithm: str = "kmean") -> np.ndarray:
    """Centroids of at most `sample` feature vectors (doc_id, vec_idx, features)."""
    return cluster(sample_rows(features, sample, ["doc_id", "vec_idx"], seed), k, ["doc_id", "vec_idx"], algorithm, "features", seed)


def codeword_tf(features: DataFrame, centroids: np.ndarray, prefix: str) -> DataFrame:
    """(doc_id, term, tf): how many vectors of a document fall to each codeword; codewords without any are absent."""
    coded = quantize(features, centroids)
    return coded.select("doc_id", vectors.codeword(prefix, F.col("idx")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"))


def full_histogram(coded: DataFrame, k: int) -> DataFrame:
    """(doc_id, idx, n) with zeros for all k codewords."""
    spark = coded.sparkSession
    grid = coded.select("doc_id").distinct().crossJoin(F.broadcast(spark.range(k).select(F.col("id").cast("int").alias("idx"))))  # k rows
    return grid.join(coded.groupBy("doc_id", "idx").agg(F.count("*").alias("n")), ["doc_id", "idx"], "left").select("doc_id", "idx", F.coalesce("n", F.lit(0)).alias("n"))


def centroid_means(coded: DataFrame, vec_col: str) -> DataFrame:
    """(idx, dim, mean) of assigned vectors, in DataFrame functions."""
    return coded.select("idx", F.posexplode(vec_col).alias("dim", "x")).groupBy("idx", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def ranked(rows: DataFrame, by: list[Column], within: list[str]) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(W.partitionBy(*within).orderBy(*by)))
