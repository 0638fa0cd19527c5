"""Joins that bring media, texts and metadata of an item together by its stem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T


def first_by_extension(files: DataFrame, extensions: list[str]) -> DataFrame:
    """(stem, path): one file for each stem, that of the first extension in the list; others are left out."""
    priority = F.array_position(F.array(*(F.lit(e) for e in extensions)), F.col("ext"))
    ranked = files.where(F.col("ext").isin(extensions)).withColumn("r", F.row_number().over(W.partitionBy("stem").orderBy(priority, "path")))
    return ranked.where("r = 1").select("stem", "path")


def collect_files(lyrics: DataFrame, audio: DataFrame) -> DataFrame:
    """(stem, lyrics_path, audio_path): full outer on the stem."""
    return lyrics.withColumnRenamed("path", "lyrics_path").join(audio.withColumnRenamed("path", "audio_path"), "stem", "full_outer")


def pair_files(images: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(stem, image_path, desc_path): items that have both."""
    return images.withColumnRenamed("path", "image_path").join(descriptions.withColumnRenamed("path", "desc_path"), "stem", "inner")


def with_metadata(items: DataFrame, metadata: DataFrame, name_col: str) -> DataFrame:
    """Items with their metadata where there is any; the name is the stem otherwise."""
    joined = items.join(metadata, "stem", "left")
    return joined.withColumn(name_col, F.coalesce(F.col(name_col), F.col("stem")))


def coverage(items: DataFrame) -> DataFrame:
    """(n, with_lyrics, with_audio, with_both) of collected files."""
    lyrics, audio = F.col("lyrics_path").isNotNull(), F.col("audio_path").isNotNull()
    return items.agg(F.count("*").alias("n"), F.count_if(lyrics).alias("with_lyrics"), F.count_if(audio).alias("with_audio"), F.count_if(lyrics & audio).alias("with_both"))


def unique_stems(rows: DataFrame, name: Column, order: list[Column], fallback: Column | None = None) -> DataFrame:
    """The rows with `stem`: a safe stem of the name (or the fallback); later rows of the same stem get _1, _2, ...

    A suffixed stem that another row's own name makes as well gets a suffix in turn, so that stems are unique.
    """
    stem = T.safe_stem(name)
    if fallback is not None:
        stem = F.when(stem == "", fallback).otherwise(stem)
    n = F.row_number().over(W.partitionBy("base").orderBy(*order)) - 1
    numbered = rows.withColumn("base", stem).withColumn("n", n)
    numbered = numbered.withColumn("stem", F.when(F.col("n") > 0, F.concat_ws("_", "base", F.col("n").cast("string"))).otherwise(F.col("base")))
    again = F.row_number().over(W.partitionBy("stem").orderBy("n", *order)) - 1
    return numbered.withColumn("again", again).withColumn("stem", F.when(F.col("again") > 0, F.concat_ws("_", "stem", F.lit("dup"), F.col("again").cast("string"))).otherwise(F.col("stem"))).drop("base", "n", "again")


def catalogue_with_images(catalogue: DataFrame, images: DataFrame) -> DataFrame:
    """Products of the catalogue that have an image file."""
    return catalogue.join(images.select(F.col("stem").alias("id")), "id", "left_semi")


def not_cached(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose features aren't stored yet."""
    return files.join(cached.select(F.col("doc_id").alias("stem")).distinct(), "stem", "left_anti")
