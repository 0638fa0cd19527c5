"""Conjunctive full-text search over whole rows.

A row matches if it has every term of the query; an empty query matches nothing.  The rank is the mean of log-TF over the
query's terms (our own score), equal scores by row.  Both engine labels of the API give the same rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import weights
from tessera.operators import index, scoring


def search(row_tf: DataFrame, queries: DataFrame, k: int = 10, digits: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) of rows (doc_id, term, tf) for queries (query_id, term): matched and ranked in blocks of rows, and by joins
    for query sets that are too large for a matrix."""
    wanted = queries.select("query_id", "term").distinct()
    asked, _ = scoring.Asked.of(wanted.withColumn("w", F.lit(1.0)), "w")
    if asked is not None:
        held, n_terms = asked.weight, asked.has.sum(axis=0)

        def score(own: np.ndarray, has: np.ndarray, _: np.ndarray, __: np.ndarray) -> np.ndarray:
            logs = np.where(has, 1 + np.log10(np.where(has, own, 1)), 0.0)
            return np.where(has.astype(np.float32) @ held.astype(np.float32) == n_terms, logs @ held / n_terms, np.nan)

        near = row_tf.where("tf > 0").join(asked.places(row_tf), "term").select("doc_id", "i", F.col("tf").alias("v"))
        return index.best(scoring.scores(asked, near, None, score, None, k, digits), k)
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    hits = row_tf.where("tf > 0").join(wanted, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.avg(weights.log_tf(F.col("tf"))).alias("score"))
    matched = hits.join(sizes, "query_id").where("n = n_terms").select("query_id", "doc_id", "score")
    return index.best(matched, k, digits)
