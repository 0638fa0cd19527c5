"""Recall of rankings by labels, and latency statistics."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_counts(labels: DataFrame, label_col: str = "label") -> DataFrame:
    return labels.groupBy(label_col).agg(F.count("*").alias("n"))


def recall_at_k(ranking: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall): hits of the query's label among its first k, itself left out, over the label's other members.

    ranking (query_id, rank, doc_id), labels (doc_id, label).  Queries whose label has no other member have no row.
    """
    sizes = label_counts(labels).withColumnRenamed("n", "size")
    own = labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("wanted"))
    queries = ranking.select("query_id").distinct().join(own, "query_id").join(sizes.withColumnRenamed("label", "wanted"), "wanted").where("size > 1")
    hits = ranking.where((F.col("rank") <= k) & (F.col("doc_id") != F.col("query_id"))).join(labels, "doc_id")
    both = queries.join(hits.select("query_id", "label"), "query_id", "left")
    found = F.count_if(F.col("label") == F.col("wanted"))
    return both.groupBy("query_id", "size").agg(found.alias("tp")).select("query_id", (F.col("tp") / (F.col("size") - 1)).alias("recall"))


def latency_summary(rows: DataFrame, latency: str, by: list[str], success: str | None = None) -> DataFrame:
    """(by, n, avg_ms, p50_ms, p95_ms, throughput_qps, with_results), percentiles interpolated."""
    avg = F.avg(latency)
    ok = F.count_if(F.expr(success)) if success else F.count(latency)
    return rows.groupBy(*by).agg(
        F.count(latency).alias("n"), F.round(avg, 4).alias("avg_ms"), F.round(F.percentile(latency, 0.5), 4).alias("p50_ms"), F.round(F.percentile(latency, 0.95), 4).alias("p95_ms"),
        F.round(F.when(avg > 0, 1000 / avg).otherwise(0.0), 2).alias("throughput_qps"), ok.alias("with_results"),
    )


def timed(run: Callable[[], DataFrame]) -> tuple[list, float]:
    """(rows, milliseconds) of a query."""
    began = time.perf_counter()
    rows = run().collect()
    return rows, (time.perf_counter() - began) * 1000


def benchmark(engines: dict[str, Callable[[object], DataFrame]], queries: Iterable[object]) -> list[dict]:
    """One record for each engine and query: latency and number of results; an error is a record without results."""
    out = []
    for query in queries:
        for name, engine in engines.items():
            try:
                rows, ms = timed(lambda: engine(query))  # noqa: B023
                out.append({"engine": name, "latency_ms": ms, "n_results": len(rows), "error": None})
            except Exception as e:  # noqa: BLE001  an engine that fails is a result of the benchmark
                out.append({"engine": name, "latency_ms": None, "n_results": 0, "error": str(e)[:200]})
    return out


def markdown_report(records: list[dict]) -> str:
    """A table of summary records with the same keys."""
    if not records:
        return ""
    names = list(records[0])
    lines = ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(str(r[n]).replace("\n", " ") for n in names) + " |" for r in records)]) + "\n"


def json_report(records: list[dict], **about: object) -> str:
    return json.dumps({**about, "results": records}, indent=1, default=str)
