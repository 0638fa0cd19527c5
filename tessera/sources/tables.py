"""Stored tables: appends, truncation, codebook upserts, embedding dimensions, feature caches and the search log."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schema

_log = logging.getLogger(__name__)


class Store:
    """Parquet tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def complete(self, table: str) -> bool:
        """Whether a write of the table has ended."""
        return self.exists(f"{table}/_SUCCESS")

    def exists(self, table: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def read(self, table: str, kind: T.StructType | None = None) -> DataFrame:
        """The table; an empty one of the schema if it isn't there."""
        if not self.exists(table):
            if kind is None:
                raise LookupError(f"no table {table}")
            return self.spark.createDataFrame([], kind)
        return self.spark.read.parquet(self.path(table))

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path(table))

    def replace(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.path(table))

    def reset(self, table: str, kind: T.StructType) -> None:
        """Truncates a table."""
        self.replace(table, self.spark.createDataFrame([], kind))

    def status(self, tables: list[str]) -> dict[str, bool]:
        return {t: self.exists(t) for t in tables}

    def save_rows(self, table: str, rows: DataFrame, kind: T.StructType) -> int:
        """Appends rows with ids that follow the table's; columns that rows lack are null (maps: empty).  The first id is returned.

        Rows may be numbered already (`numbered_rows`), before joins that would be computed once more to count them.
        """
        last = self.read(table, kind).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        columns = []
        for field in kind.fields:
            if field.name == "id":
                columns.append((F.lit(last) + F.col("__n")).cast("bigint").alias("id"))
            elif field.name == "created_at":
                columns.append(F.current_timestamp().alias("created_at"))
            elif field.name in rows.columns:
                own = F.col(field.name)
                columns.append((F.coalesce(own, F.create_map().cast(field.dataType)) if isinstance(field.dataType, T.MapType) else own).cast(field.dataType).alias(field.name))
            else:
                columns.append((F.create_map() if isinstance(field.dataType, T.MapType) else F.lit(None)).cast(field.dataType).alias(field.name))
        self.append(table, (rows if "__n" in rows.columns else numbered_rows(rows)).select(*columns))
        return last + 1

    def save_codebook(self, app: str, modality: str, size: int, bag: list[str] | None = None, centroids_path: str | None = None, index_dir: str | None = None) -> None:
        """One row for each (app, modality): only its partition is replaced."""
        row = self.spark.createDataFrame([(app, modality, size, bag, centroids_path, index_dir)], T.StructType(schema.CODEBOOKS.fields[:-1]))
        stamped = row.withColumn("created_at", F.current_timestamp())
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("app", "modality").parquet(self.path("codebooks"))

    def load_codebook(self, app: str, modality: str) -> dict:
        """The codebook's row; LookupError if there is none."""
        found = self.read("codebooks", schema.CODEBOOKS).where((F.col("app") == app) & (F.col("modality") == modality)).first()
        if found is None:
            raise LookupError(f"no codebook for {app}/{modality}")
        return found.asDict()

    def load_bag(self, app: str, modality: str, vocab: DataFrame) -> list[str]:
        """Sorted codebook terms; those of the vocabulary if none were stored."""
        bag = self.load_codebook(app, modality)["bag_of_words"]
        return sorted(bag) if bag else [r["term"] for r in vocab.select("term").orderBy("term").toLocalIterator()]

    def log_search(self, app: str, modality: str, engine: str, query: str, latency_ms: float, n_results: int) -> None:
        """Appends to the search log; a failure is logged and doesn't fail the search."""
        try:
            row = self.spark.createDataFrame([(app, modality, engine, query, latency_ms, n_results)], T.StructType(schema.SEARCH_LOGS.fields[:-1]))
            self.append("search_logs", row.coalesce(1).withColumn("created_at", F.current_timestamp()))
        except Exception:  # noqa: BLE001
            _log.warning("the search was not logged", exc_info=True)

    def cache_features(self, features: DataFrame) -> None:
        """Appends feature rows (without errors) of documents that the cache lacks."""
        kind = T.StructType([T.StructField("doc_id", features.schema["doc_id"].dataType), *schema.FEATURES.fields[1:]])
        have = self.read("features", kind).select("doc_id").distinct()
        fresh = features.where("vec_idx IS NOT NULL").select("doc_id", "vec_idx", "features").join(have, "doc_id", "left_anti")
        self.append("features", fresh)


def numbered_rows(rows: DataFrame) -> DataFrame:
    """The rows with __n from 1 on: partition counts first, then offsets, so that no single task numbers all rows."""
    marked = rows.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    counts = {r["p"]: r["n"] for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    first, begins = 1, []
    for p in sorted(counts):
        begins += [F.lit(p), F.lit(first)]
        first += counts[p]
    if not begins:
        return rows.withColumn("__n", F.lit(0))
    start = F.element_at(F.create_map(*begins), part)
    return marked.withColumn("__n", start + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


def ensure_dimension(rows: DataFrame, column: str, size: int) -> bool:
    """Whether stored vectors must be made anew: False if all have `size` entries; ValueError for a size that isn't positive."""
    if size <= 0:
        raise ValueError("a dimension must be positive")
    try:
        wrong = rows.where(F.col(column).isNotNull() & (F.size(column) != size)).limit(1).count()
    except AnalysisException as e:
        raise LookupError(f"no column {column}") from e
    return bool(wrong)
