"""Exhaustive ranking over sparse vectors with a choice of metric; the check of the inverted index.

A query set that fits a matrix goes to every task: of a document only its weights in the queries' terms are dealt out, with its norm and one
number of its other terms (`in_blocks`), which give its exact score under each metric.

For larger query sets, documents that share a term with a query are scored by joins on terms.  What the others are scored follows from one number of
the document, in the same order for all queries, so the few of them that can be among any query's best k are found
once (`fill_cosine`, `fill_minkowski`) and laid beside each query: documents and queries are never crossed.  Chebyshev alone compares
maps of documents with those of the stated query set there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tessera.functions import weights
from tessera.operators import index, scoring, terms
from tessera.session import ship


def build_tfidf(tf: DataFrame, use_log_tf: bool = True, normalize: bool = True, vocab: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, w): every key counts for df, also with tf 0; all documents count, empty ones included as rows allow."""
    vectors = terms.weighted(tf, use_log_tf, with_zero=True, vocab=vocab).select("doc_id", "term", "w")
    return terms.l2_normalized(vectors) if normalize else vectors


def vectorize_queries(queries: DataFrame, tf: DataFrame, use_log_tf: bool = True, normalize: bool = True, vocab: DataFrame | None = None) -> DataFrame:
    """(query_id, term, w) of queries under the collection's df; unknown terms drop out."""
    total = tf.agg(F.countDistinct("doc_id").alias("n_docs"))
    known = queries.join(terms.document_frequency(tf) if vocab is None else vocab, "term").crossJoin(F.broadcast(total))  # one row
    own = known.select("query_id", "term", weights.tfidf(F.col("tf"), F.col("df"), F.col("n_docs"), use_log_tf).alias("w")).where("w <> 0")
    return terms.l2_normalized(own, "query_id") if normalize else own


def sparse_dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, doc_id, dot) of vectors a (query_id, term, w) and b (doc_id, term, w) that share a term."""
    return a.join(b.withColumnRenamed("w", "wd"), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("wd")).alias("dot"))


def all_pairs(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id) of a stated query set against all documents; what follows cuts it before any shuffle."""
    return docs.select("doc_id").distinct().crossJoin(queries.select("query_id").distinct())


def cosine_touched(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of documents that share a term with a query."""
    dots = sparse_dot(queries, docs)
    sized = dots.join(terms.norms(docs), "doc_id").withColumnRenamed("norm", "nd").join(terms.norms(queries, "query_id"), "query_id")
    size = F.col("nd") * F.col("norm")
    return sized.select("query_id", "doc_id", F.when(size > 0, F.col("dot") / F.when(size > 0, size)).otherwise(0.0).alias("score"))


def _power(p: float) -> Callable[[Column], Column]:
    return lambda c: F.abs(c) if p == 1 else c * c if p == 2 else F.pow(F.abs(c), F.lit(float(p)))


def _root(total: Column, p: float) -> Column:
    own = F.greatest(total, F.lit(0.0))
    return own if p == 1 else F.sqrt(own) if p == 2 else F.pow(own, F.lit(1 / p))


def minkowski_apart(queries: DataFrame, docs: DataFrame, p: float) -> DataFrame:
    """(query_id, doc_id, score) as if no term were shared: no shared term makes a distance of non-negative weights larger."""
    power = _power(p)
    doc_sums = docs.groupBy("doc_id").agg(F.sum(power(F.col("w"))).alias("d"))
    query_sums = queries.groupBy("query_id").agg(F.sum(power(F.col("w"))).alias("q"))
    return doc_sums.crossJoin(query_sums).select("query_id", "doc_id", _root(F.col("d") + F.col("q"), p).alias("score"))


def minkowski_touched(queries: DataFrame, docs: DataFrame, p: float) -> DataFrame:
    """(query_id, doc_id, score) of documents that share a term: both sums, and corrections on the shared terms."""
    power = _power(p)
    doc_sums = docs.groupBy("doc_id").agg(F.sum(power(F.col("w"))).alias("d"))
    query_sums = queries.groupBy("query_id").agg(F.sum(power(F.col("w"))).alias("q"))
    shared = queries.join(docs.withColumnRenamed("w", "wd"), "term")
    fixes = shared.groupBy("query_id", "doc_id").agg(F.sum(power(F.col("w") - F.col("wd")) - power(F.col("w")) - power(F.col("wd"))).alias("fix"))
    return fixes.join(doc_sums, "doc_id").join(query_sums, "query_id").select("query_id", "doc_id", _root(F.col("d") + F.col("q") + F.col("fix"), p).alias("score"))


def chebyshev_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the largest gap, from a map of each document and each query of the stated set."""
    left = docs.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("a"))
    right = queries.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("b"))
    weight = lambda m, t: F.coalesce(F.try_element_at(m, t), F.lit(0.0))
    own = F.array_max(F.transform(F.map_entries("a"), lambda x: F.abs(x["value"] - weight(F.col("b"), x["key"]))))
    other = F.array_max(F.transform(F.map_entries("b"), lambda x: F.abs(x["value"] - weight(F.col("a"), x["key"]))))
    return left.crossJoin(right).select("query_id", "doc_id", F.greatest(F.coalesce(own, F.lit(0.0)), F.coalesce(other, F.lit(0.0))).alias("score"))


def minkowski_scores(queries: DataFrame, docs: DataFrame, p: float) -> DataFrame:
    """(query_id, doc_id, score): distance over the union of keys, missing ones 0, for every query and document."""
    if p == float("inf"):
        return chebyshev_scores(queries, docs)
    both = minkowski_apart(queries, docs, p).join(minkowski_touched(queries, docs, p).withColumnRenamed("score", "near"), ["query_id", "doc_id"], "left")
    return both.select("query_id", "doc_id", F.coalesce("near", "score").alias("score"))


def cosine_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) for every query and document; 0 where a norm is 0 or no term is shared."""
    return all_pairs(queries, docs).join(cosine_touched(queries, docs), ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def fill_cosine(docs: DataFrame, k: int) -> list[tuple]:
    """(doc_id, 0.0) of the k documents of least id: untouched documents score 0, and no touched one scores less."""
    return [(r["doc_id"], 0.0) for r in docs.select("doc_id").distinct().orderBy("doc_id").limit(k).collect()]


def fill_minkowski(queries: DataFrame, docs: DataFrame, k: int, p: float, digits: int | None) -> list[tuple]:
    """(doc_id, own sum) of the documents that can be among the best k of a query with which they share no term.

    Without a shared term a distance grows with the document's own sum of powers.  Of documents with equal sums (to 12 digits) the
    k of least id count; of sums the k least, and those that rounding to `digits` can make equal to the k-th.
    """
    power = _power(p)
    sums = docs.groupBy("doc_id").agg(F.round(F.sum(power(F.col("w"))), 12).alias("d"))
    own = sums.withColumn("r", F.row_number().over(Window.partitionBy("d").orderBy("doc_id"))).where(F.col("r") <= k)
    least = [r["d"] for r in own.select("d").distinct().orderBy("d").limit(k).collect()]
    if not least:
        return []
    step = 0.0 if digits is None else 10.0**-digits
    widest = queries.groupBy("query_id").agg(F.sum(power(F.col("w"))).alias("q")).agg(F.max("q")).first()[0] or 0.0
    score = (least[-1] + widest) ** (1 / p) + step
    limit = least[-1] + 1.01 * p * score ** (p - 1) * step + 1e-9 * (1 + least[-1])
    return [(r["doc_id"], r["d"]) for r in own.where(F.col("d") <= limit).select("doc_id", "d").collect()]


def beside(queries: DataFrame, fill: list[tuple], kind: DataType) -> DataFrame:
    """(query_id and the other columns, doc_id, d): the fill's rows beside each query, as literals."""
    rows = F.array(*(F.struct(F.lit(i).cast(kind).alias("doc_id"), F.lit(float(d)).alias("d")) for i, d in fill))
    return queries.withColumn("f", F.explode(rows)).select(*queries.columns, "f.doc_id", "f.d")


def best_of(touched: DataFrame, apart: DataFrame, k: int, digits: int | None, descending: bool) -> DataFrame:
    """The best k of each query, where sharing a term never makes a score worse, from scores of touched documents and of the fill."""
    rest = apart.join(touched, ["query_id", "doc_id"], "left_anti")
    return index.best(touched.unionByName(rest), k, digits, descending)


METRICS = ("cosine", "manhattan", "euclidean", "chebyshev")
POWERS = {"manhattan": 1.0, "euclidean": 2.0, "chebyshev": float("inf")}


def _raised(x: np.ndarray, p: float) -> np.ndarray:
    x = np.abs(x)
    return x if p in (1, float("inf")) else x * x if p == 2 else x * x * x if p == 3 else x**p


def in_blocks(asked: scoring.Asked, docs: DataFrame, metric: str | float, unit: bool) -> tuple[DataFrame, DataFrame, scoring.Score]:
    """Hits, documents and score for `scoring.scores`: cosine, dot (of documents that share a term) or Minkowski's p.

    unit: documents count at unit length.  rest is the sum of powers (Chebyshev: the largest) of a document's weights in terms of no query.
    """
    p = POWERS.get(metric) if isinstance(metric, str) else float(metric)
    placed = docs.join(asked.places(docs), "term", "left")
    other = F.when(F.col("i").isNull(), F.abs("w")).otherwise(0.0)
    rest = F.lit(0.0) if p is None else F.max(other) if p == float("inf") else F.sum(_power(p)(other))
    sums = placed.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("v"), rest.alias("rest"))
    weight, wanted = asked.weight, asked.has
    size = np.linalg.norm(weight, axis=0)

    def score(own: np.ndarray, has: np.ndarray, norm: np.ndarray, rest: np.ndarray) -> np.ndarray:
        length = np.where(norm > 0, norm, 1.0)
        if unit:
            own = own / length[:, None]
        if p is None:
            dots = own @ weight
            if metric == "dot":
                return np.where(scoring.meets(has, wanted), dots, np.nan)
            both = (np.where(norm > 0, 1.0, 0.0) if unit else norm)[:, None] * size[None, :]
            return np.where(both > 0, dots / np.where(both > 0, both, 1), 0.0)
        if unit:
            rest = rest / (length if p == float("inf") else length**p)
        out = np.empty((len(own), weight.shape[1]))
        powers = _raised(own, p)
        for q in range(weight.shape[1]):
            # Terms of the query, of other queries, and of none: nothing is subtracted, so that small distances keep their digits.
            mine = wanted[:, q]
            near, far = _raised(own[:, mine] - weight[mine, q], p), powers[:, ~mine]
            out[:, q] = np.maximum(rest, np.maximum(near.max(axis=1, initial=0), far.max(axis=1, initial=0))) if p == float("inf") else rest + near.sum(axis=1) + far.sum(axis=1)
        return out if p in (1, float("inf")) else np.sqrt(out) if p == 2 else np.cbrt(out) if p == 3 else out ** (1 / p)

    near = docs.where(F.col("term").isin(asked.wanted)) if len(asked.wanted) <= index.LITERAL_TERMS else docs  # literals reach the scan
    return near.join(asked.places(docs), "term").select("doc_id", "i", F.col("w").alias("v")), sums, score


def dots(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, dot) of queries with documents at unit length, documents (doc_id, term, w) of any length, where a term is shared."""
    asked, _ = scoring.Asked.of(queries, "w")
    if asked is None:
        return sparse_dot(queries, terms.l2_normalized(docs))
    return scoring.scores(asked, *in_blocks(asked, docs, "dot", True), None, None, None, name="dot")


def top_k(queries: DataFrame, docs: DataFrame, k: int = 5, metric: str | float = "cosine", digits: int | None = None, unit: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, score) over all documents with non-negative weights; a number is Minkowski's p.  unit: documents count at unit length."""
    p = POWERS.get(metric) if isinstance(metric, str) else float(metric)
    if metric != "cosine" and (p is None or p < 1):
        raise ValueError(f"unknown metric: {metric}")
    asked, _ = scoring.Asked.of(queries, "w")
    if asked is not None:
        down = metric == "cosine"
        return index.best(scoring.scores(asked, *in_blocks(asked, docs, metric, unit), None, k, digits, down), k, descending=down)
    if unit:
        docs = terms.l2_normalized(docs)
    kind = docs.schema["doc_id"].dataType
    if metric == "cosine":
        apart = beside(queries.select("query_id").distinct(), fill_cosine(docs, k), kind).withColumnRenamed("d", "score")
        return best_of(cosine_touched(queries, docs), apart, k, digits, descending=True)
    if p == float("inf"):
        return index.best(chebyshev_scores(queries, docs), k, digits, descending=False)
    power = _power(p)
    sums = queries.groupBy("query_id").agg(F.sum(power(F.col("w"))).alias("q"))
    apart = beside(sums, fill_minkowski(queries, docs, k, p, digits), kind).select("query_id", "doc_id", _root(F.col("d") + F.col("q"), p).alias("score"))
    return best_of(minkowski_touched(queries, docs, p), apart, k, digits, descending=False)


def top_k_by(queries: DataFrame, docs: DataFrame, metric: Callable[[dict[str, float], dict[str, float]], float], k: int = 5, higher_is_better: bool = True) -> DataFrame:
    """The same with any Python metric of two maps; the slow path, a row at a time within Arrow batches."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(metric(dict(x), dict(y))) for x, y in zip(a, b)])

    as_map: Column = F.map_from_entries(F.collect_list(F.struct("term", "w")))
    left, right = queries.groupBy("query_id").agg(as_map.alias("a")), docs.groupBy("doc_id").agg(as_map.alias("b"))
    return index.best(right.crossJoin(left).select("query_id", "doc_id", scored("a", "b").alias("score")), k, None, higher_is_better)
