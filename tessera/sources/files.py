"""Listings and text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(_name(path), r"\.[^.]*$", "")


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(_name(path), r"(\.[^.]+)$", 1))


def listing(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, stem, ext, size, modified) of files below a folder, by path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    out = files.select("path", stem_of(F.col("path")).alias("stem"), extension_of(F.col("path")).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return (out.where(F.col("ext").isin(extensions)) if extensions else out).orderBy("path")


def contents(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """(path, stem, content) of the files of some extensions; others in the folder are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(extension_of(F.col("path")).isin(extensions)).select("path", stem_of(F.col("path")).alias("stem"), "content")


def checked_extension(path: str, extensions: list[str]) -> str:
    """The path, if its extension is one of those given; ValueError otherwise."""
    if not any(path.lower().endswith(e) for e in extensions):
        raise ValueError(f"unsupported file type: {path} (use one of {', '.join(extensions)})")
    return path


def texts(spark: SparkSession, folder: str, extension: str = ".txt") -> DataFrame:
    """(stem, text) of whole UTF-8 files; bytes that aren't UTF-8 are dropped."""
    return contents(spark, folder, [extension]).select("stem", dropped_bytes(F.col("content")).alias("text"))


def dropped_bytes(content: Column) -> Column:
    """Text of bytes with the invalid ones left out (and replacement characters, which stand for them)."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", "")


def intact(files: DataFrame, sums: DataFrame) -> DataFrame:
    """Files (path, stem, content) whose SHA-1 is that of sums (stem, sha1)."""
    return files.join(sums, "stem").where(F.sha1("content") == F.lower("sha1")).drop("sha1")


def write_texts(items: DataFrame, folder: str, text_col: str = "text") -> None:
    """Materialises a collection: one text file for each stem below `texts/<stem>.txt` folders, and metadata.csv of the other columns.

    Every item is one file of its own folder, as Spark names the files within; each text is followed by a line end.  `read_texts` reads
    them back by stem.
    """
    items.select(F.concat(F.col("stem"), F.lit(".txt")).alias("file"), F.col(text_col).alias("value")).write.partitionBy("file").text(f"{folder}/texts")
    items.drop(text_col).coalesce(1).write.option("header", True).option("escape", '"').csv(f"{folder}/metadata.csv")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, text) of `write_texts`."""
    rows = spark.read.text(f"{folder}/texts", wholetext=True)
    return rows.select(stem_of(F.col("file").cast("string")).alias("stem"), F.expr("left(value, char_length(value) - 1)").alias("text"))
