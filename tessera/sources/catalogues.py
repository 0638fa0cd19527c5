"""Metadata and catalogue files: CSV, JSON lines and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import text as T


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def metadata(spark: SparkSession, path: str, columns: list[str], name_col: str) -> DataFrame:
    """(stem, columns): rows with a stem; blanks are null and the name is the stem then."""
    rows = _csv(spark, path)
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    own = rows.select(given("stem").alias("stem"), *(given(c).alias(c) for c in columns)).where(F.col("stem").isNotNull())
    return own.withColumn(name_col, F.coalesce(name_col, "stem"))


def music_metadata(spark: SparkSession, path: str) -> DataFrame:
    return metadata(spark, path, ["title", "artist", "genre"], "title")


def fashion_metadata(spark: SparkSession, path: str) -> DataFrame:
    return metadata(spark, path, ["name", "category", "subcategory"], "name")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, term, tf) of JSON lines {"id", "tf": {...}}."""
    return spark.read.schema(schema.CORPUS).json(path).select(F.col("id").alias("doc_id"), F.explode("tf").alias("term", "tf"))


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, term, tf) of JSON lines {"t": term, "p": [[doc, tf], ...]}."""
    rows = spark.read.schema("t string, p array<array<string>>").json(path)
    return rows.select("t", F.explode("p").alias("p")).select(F.col("p")[0].alias("doc_id"), F.col("t").alias("term"), F.col("p")[1].cast("int").alias("tf"))


def lyrics_catalogue(rows: DataFrame, least: int = 20, limit: int | None = None) -> DataFrame:
    """(lyrics, title, artist, genre) from a catalogue whose columns have one of several names; short lyrics are left out."""
    pick = lambda *names: T.first_given(*(F.col(n) for n in names if n in rows.columns)) if any(n in rows.columns for n in names) else F.lit(None).cast("string")
    own = rows.select(pick("lyrics", "text").alias("lyrics"), pick("track_name", "title", "song").alias("title"), pick("track_artist", "artist").alias("artist"), pick("playlist_genre", "genre").alias("genre"))
    kept = own.where(F.char_length("lyrics") >= least)
    return kept.limit(limit) if limit is not None else kept


def largest_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The largest CSV file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(folder)
    first = files.select("path", "length").orderBy(F.desc("length"), "path").first()
    if first is None:
        raise FileNotFoundError(f"no CSV file below {folder}")
    return _csv(spark, first["path"])


def products(spark: SparkSession, path: str) -> DataFrame:
    """The product catalogue with a composed description."""
    rows = _csv(spark, path)
    return rows.withColumn("description", T.product_description({c: F.col(c) for c in rows.columns}))


def audio_dataset(spark: SparkSession, *paths: str) -> DataFrame:
    """(name, title, artist, genre, text, content) of Parquet rows with audio.bytes; rows without bytes are left out."""
    rows = spark.read.parquet(*paths)
    wanted = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("name", "title", "artist", "genre", "text")]
    return rows.select(*wanted, F.col("audio.bytes").alias("content")).where(F.col("content").isNotNull() & (F.length("content") > 0))
