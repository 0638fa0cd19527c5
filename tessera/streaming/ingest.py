"""Streaming ingestion: new documents extend the postings; vocabulary, norms and counts are made anew when asked.

A new document changes N and df, hence every weight, so norms aren't kept incrementally; term frequencies are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import terms
from tessera.operators.index import InvertedIndex
from tessera.session import stored


def ingest(stream: DataFrame, folder: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Writes term frequencies of streamed documents below `folder`, one folder a batch: a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        own = terms.term_frequencies(batch, id_col, text_col)
        own.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_table(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, term, tf) of all batches; of a document that came more than once the last batch counts."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc_id", "batch"]).select("doc_id", "term", "tf")


def rebuild(spark: SparkSession, folder: str, index_folder: str) -> InvertedIndex:
    return InvertedIndex.build(stored(term_table(spark, folder), "terms")).write(index_folder)


def search_log_windows(stream: DataFrame, width: str = "1 hour", late: str = "2 hours", time_col: str = "ts", engine_col: str = "event_type", latency_col: str = "value") -> DataFrame:
    """Counts and mean latency of a stream of searches by window and engine, with a watermark for late rows."""
    return (
        stream.withWatermark(time_col, late)
        .groupBy(F.window(time_col, width).alias("w"), engine_col)
        .agg(F.count("*").alias("n"), F.avg(latency_col).alias("avg_latency"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), engine_col, "n", "avg_latency")
    )
