"""Nearest vectors: exact cosine for a stated query set in blocks, and locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import index
from tessera.session import ship

#: Vectors of a block: of rows, and of queries.
BLOCK = 2048
#: Packed queries up to this size go to every task; more are joined.
BROADCAST_BYTES = 64_000_000


def cosine_top_k(rows: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", emb_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """(doc_id, score) of the k rows nearest to one query by 1 - cosine distance; null vectors are left out."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    score = vectors.cosine(F.col(emb_col), literal)
    scored = rows.where(F.col(emb_col).isNotNull()).select(F.col(id_col).alias("doc_id"), (F.round(score, digits) if digits is not None else score).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def _blocks(df: DataFrame, id_col: str, emb_col: str, hash_col: str | None = None) -> DataFrame:
    """(block, ids, vectors, hashes): rows as matrices of BLOCK rows at most, packed: 64-bit floats and 32-bit bucket numbers (none without hash_col)."""
    kind = df.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                own = batch.slice(i, BLOCK)
                packed = [own.column(c + 1).flatten().to_numpy(zero_copy_only=False).astype(as_type).tobytes() if c + 1 < own.num_columns else b"" for c, as_type in enumerate(("<f8", "<i4"))]
                yield pa.RecordBatch.from_arrays([pa.array([own.column(0).to_pylist()], pa.list_(own.column(0).type)), *(pa.array([p], pa.binary()) for p in packed)], ["ids", "vectors", "hashes"])

    rows = df.where(F.col(emb_col).isNotNull()).select(id_col, emb_col, *([hash_col] if hash_col else []))
    return rows.mapInArrow(pack, f"ids array<{kind}>, vectors binary, hashes binary")


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a have a bucket in common with which of b: the same number in the same column."""
    if a.size and b.size and max(np.abs(a).max(), np.abs(b).max()) < 128:
        a, b = a.astype(np.int8), b.astype(np.int8)
    met = np.zeros((len(a), len(b)), bool)
    for t in range(a.shape[1]):
        met |= a[:, t, None] == b[None, :, t]
    return met


def _best_in_blocks(rows: DataFrame, queries: DataFrame, k: int, id_col: str, emb_col: str, query_col: str, digits: int | None, hash_col: str | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) by cosine; with hash_col (array<int>) only of pairs that share a bucket.

    Queries and rows are blocks, packed on the executors; each block of rows meets each block of queries once, by a join on the
    query block's number (by broadcast up to BROADCAST_BYTES of queries).  A task keeps the best k of each query over all its blocks,
    so that the last shuffle carries k rows for each query and task, and no pair is ever a row.
    """
    ship(rows.sparkSession)
    n_queries = queries.count()
    parts = max(1, -(-n_queries // BLOCK))
    number = F.pmod(F.xxhash64(query_col), F.lit(parts)).cast("int")
    dealt = queries.withColumn("__b", number).repartition(parts, "__b") if parts > 1 else queries.coalesce(1)
    asked = _blocks(dealt, query_col, emb_col, hash_col).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("hashes").alias("q_hashes"))
    # Blocks of queries are numbered by a hash of their first id, those of rows are dealt to every number.
    asked = asked.withColumn("b", F.pmod(F.xxhash64(F.col("q_ids")[0]), F.lit(parts)).cast("int"))
    wide = queries.where(F.col(emb_col).isNotNull()).select(F.size(emb_col)).first()
    if n_queries * (wide[0] if wide else 0) * 8 <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    held = _blocks(rows, id_col, emb_col, hash_col).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    row_type, query_type = rows.schema[id_col].dataType.simpleString(), queries.schema[query_col].dataType.simpleString()

    def top(row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
        """The best k of each row, by score and then by id."""
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[keep], ids[keep], score[keep]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        types = None
        for batch in batches:
            types = batch.column(3).type.value_type, batch.column(0).type.value_type
            for i in range(batch.num_rows):
                ids, names = batch.column(0)[i].values, batch.column(3)[i].values
                x, q = (np.frombuffer(batch.column(c)[i].as_py()).reshape(n, -1) for c, n in ((1, len(ids)), (4, len(names))))
                both = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
                score = np.where(both > 0, (q @ x.T) / np.where(both > 0, both, 1), 0.0)
                if digits is not None:
                    score = np.round(score, digits)
                if hash_col:
                    hx, hq = (np.frombuffer(batch.column(c)[i].as_py(), "<i4").reshape(n, -1) for c, n in ((2, len(ids)), (5, len(names))))
                    score = np.where(_shared(hq, hx), score, -np.inf)
                # All that reach the block's k-th best score, which the task's best so far may cut further.
                n = min(k, len(ids))
                least = -np.partition(-score, n - 1, axis=1)[:, n - 1 : n]
                held = found.setdefault((names[0].as_py(), names[-1].as_py(), batch.column(4)[i].as_py()), [names, np.empty(0, np.int64), np.array(ids.to_pylist())[:0], np.empty(0), np.full((len(names), 1), -np.inf)])
                row, at = np.nonzero((score >= np.maximum(least, held[4])) & (score > -np.inf))
                held[1:4] = top(np.concatenate([held[1], row]), np.concatenate([held[2], np.array(ids.to_pylist())[at]]), np.concatenate([held[3], score[row, at]]))
                full = np.nonzero(np.bincount(held[1], minlength=len(names)) == k)[0]
                held[4][full, 0] = held[3][np.searchsorted(held[1], full, side="right") - 1]
        for names, row, ids, score, _ in found.values():
            yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), pa.array(ids.tolist(), types[1]), pa.array(score)], ["query_id", "doc_id", "score"])

    met = held.join(asked, "b").select("ids", "vectors", "hashes", "q_ids", "q_vectors", "q_hashes")
    return index.best(met.mapInArrow(near, f"query_id {query_type}, doc_id {row_type}, score double"), k)


def cosine_top_k_batch(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", emb_col: str = "embedding", query_col: str = "query_id", digits: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) for a stated set of queries (query_col, emb_col)."""
    return _best_in_blocks(rows, queries, k, id_col, emb_col, query_col, digits)


def lsh_top_k_batch(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", emb_col: str = "embedding", query_col: str = "query_id", tables: int = 16, width: float = 1.0, seed: int = 42, digits: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): approximate nearest by Euclidean hashing of unit vectors, exact cosines of what shares a bucket.

    Buckets of so few tables and such a width hold large parts of all rows, so pairs that share one aren't listed: bucket numbers are compared in blocks.
    """
    unit = lambda df, key: df.where(F.col(emb_col).isNotNull()).select(F.col(key), vectors.normalized(F.col(emb_col)).alias("unit")).withColumn("features", array_to_vector("unit"))
    held, asked = unit(rows, id_col), unit(queries, query_col)
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(held.limit(1))
    buckets = lambda df, key: model.transform(df).select(key, "unit", F.transform("hashes", lambda h: vector_to_array(h)[0].cast("int")).alias("buckets"))
    return _best_in_blocks(buckets(held, id_col), buckets(asked, query_col), k, id_col, "unit", query_col, digits, "buckets")


def lsh_top_k(rows: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", emb_col: str = "embedding", tables: int = 8, width: float = 0.5, seed: int = 42) -> DataFrame:
    """(doc_id, score): approximate nearest by Euclidean hashing of unit vectors; scores are exact cosines."""
    unit = rows.where(F.col(emb_col).isNotNull()).select(F.col(id_col).alias("doc_id"), vectors.normalized(F.col(emb_col)).alias("unit"))
    hashed = unit.withColumn("features", array_to_vector("unit"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(hashed)
    size = float(np.linalg.norm(query)) or 1.0
    from pyspark.ml.linalg import Vectors

    found = model.approxNearestNeighbors(hashed, Vectors.dense([x / size for x in query]), k)
    return found.select("doc_id", (1 - F.col("distCol") * F.col("distCol") / 2).alias("score")).orderBy(F.desc("score"), "doc_id")
