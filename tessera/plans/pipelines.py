"""Composite jobs: corpora to indexes, and applications' rows to tables.

A corpus is analysed once into a stored (doc_id, term, tf) table; the codebook, the index and the rows' histograms read it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import text as T
from tessera.functions import vectors
from tessera.operators import clustering, pairing, terms
from tessera.operators.index import InvertedIndex
from tessera.sources import audio, images
from tessera.sources.tables import Store, numbered_rows

CHUNK = r"#chunk\d+$"


def analyse(texts: DataFrame, stem: bool = True, mark: str = "\n\n") -> DataFrame:
    """(doc_id, term, tf) of paragraph chunks of texts (stem, text)."""
    chunked = T.chunks(texts, "stem", "text", mark=mark)
    return terms.term_frequencies(chunked, stop=T.STOPWORDS, stem=stem, again=terms.repeated(texts, "stem"))  # ids of chunks come again if stems do


@dataclass
class TextIndex:
    index: InvertedIndex
    codebook: DataFrame
    tf: DataFrame


def index_text(texts: DataFrame, codebook_size: int, folder: str, mark: str = "\n\n") -> TextIndex:
    """Codebook and index of texts (stem, text); an empty corpus is an error."""
    spark = texts.sparkSession
    analyse(texts, mark=mark).write.mode("overwrite").parquet(f"{folder}/tf")
    tf = spark.read.parquet(f"{folder}/tf")
    terms.top_terms(tf, codebook_size).coalesce(1).write.mode("overwrite").parquet(f"{folder}/codebook")
    codebook = spark.read.parquet(f"{folder}/codebook")
    # Written, as the index and the rows' histograms read it several times.
    terms.within_codebook(tf, codebook).write.mode("overwrite").parquet(f"{folder}/kept")
    kept = spark.read.parquet(f"{folder}/kept")
    return TextIndex(InvertedIndex.build(kept).write(folder), codebook, kept)


@dataclass
class MediaIndex:
    index: InvertedIndex
    centroids: np.ndarray
    tf: DataFrame


def index_features(features: DataFrame, codebook_size: int, folder: str, prefix: str, seed: int = 42, algorithm: str = "kmean") -> MediaIndex:
    """Codebook and index of feature rows (doc_id, vec_idx, features, error); error rows are left out."""
    spark = features.sparkSession
    features.where("vec_idx IS NOT NULL").select("doc_id", "vec_idx", "features").write.mode("overwrite").parquet(f"{folder}/features")
    stored = spark.read.parquet(f"{folder}/features")
    if not stored.limit(1).count():
        raise ValueError("the collection has no feature")
    centroids = clustering.train_codebook(stored, codebook_size, seed=seed, algorithm=algorithm)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, schema.CENTROIDS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
    clustering.codeword_tf(stored, centroids, prefix).write.mode("overwrite").parquet(f"{folder}/tf")
    tf = spark.read.parquet(f"{folder}/tf")
    return MediaIndex(InvertedIndex.build(tf).write(folder), load_centroids(spark, folder), tf)


def load_centroids(spark: SparkSession, folder: str) -> np.ndarray:
    """The codebook's centroids: as many rows as it has codewords."""
    return np.array([r["c"] for r in spark.read.parquet(f"{folder}/centroids").orderBy("idx").collect()], np.float64)


def index_audio(spark: SparkSession, media_folder: str, codebook_size: int, folder: str, extractor=audio.mfcc) -> MediaIndex:  # noqa: ANN001
    return index_features(audio.features(spark, media_folder, extractor), codebook_size, folder, "a")


def index_images(spark: SparkSession, media_folder: str, codebook_size: int, folder: str, extractor=images.gradients) -> MediaIndex:  # noqa: ANN001
    return index_features(images.features(spark, media_folder, extractor), codebook_size, folder, "v")


def prepare_text_query(spark: SparkSession, text: str, codebook: DataFrame | None = None) -> DataFrame:
    """(query_id, term, tf) of a query text, within the codebook if one is given."""
    one = spark.createDataFrame([("q", text)], "doc_id string, text string")
    tf = terms.term_frequencies(one, stop=T.STOPWORDS, stem=True)
    return (terms.within_codebook(tf, codebook) if codebook is not None else tf).withColumnRenamed("doc_id", "query_id")


def prepare_media_query(spark: SparkSession, content: bytes, extractor, centroids: np.ndarray, prefix: str) -> DataFrame:  # noqa: ANN001
    """(query_id, term, tf) of a medium; a medium without features is an empty query."""
    found = extractor(content)
    if not len(found):
        return spark.createDataFrame([], schema.QUERY_TF)
    squares = (centroids * centroids).sum(axis=1)
    idx, n = np.unique((squares[None, :] - 2 * np.asarray(found, np.float64) @ centroids.T).argmin(axis=1), return_counts=True)
    return spark.createDataFrame([("q", f"{prefix}_{i:04d}", int(c)) for i, c in zip(idx, n)], schema.QUERY_TF)


def _rows_with_histograms(items: DataFrame, hists: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Items, numbered, with a histogram and a dense vector for each modality; items without one have an empty map and a null vector.

    A stem has one histogram, so the joins keep every item once and its number with it.
    """
    items = numbered_rows(items)
    for name, (by_stem, keys) in hists.items():
        maps = terms.as_maps(by_stem, "stem").withColumnRenamed("hist", f"{name}_hist")
        dense = vectors.hist_to_dense(F.col(f"{name}_hist"), keys)
        items = items.join(maps, "stem", "left").withColumn(f"{name}_emb", F.when(F.col(f"{name}_hist").isNotNull(), dense))
    return items


def _text_rows(index: TextIndex) -> tuple[DataFrame, list[str]]:
    keys = sorted(r["term"] for r in index.codebook.select("term").collect())  # as many as the codebook has terms
    return terms.row_histograms(index.tf, F.regexp_replace("doc_id", CHUNK, "")), keys


def _media_rows(index: MediaIndex, prefix: str) -> tuple[DataFrame, list[str]]:
    return index.tf.select(F.col("doc_id").alias("stem"), "term", "tf"), [f"{prefix}_{i:04d}" for i in range(len(index.centroids))]


def load_songs(store: Store, items: DataFrame, lyrics: TextIndex | None = None, sounds: MediaIndex | None = None, reset: bool = True) -> int:
    """Rows of the music application from items (stem, title, artist, genre, lyrics_path, audio_path, lyrics_text)."""
    hists: dict[str, tuple[DataFrame, list[str]]] = {}
    if lyrics is not None:
        hists["lyrics"] = _text_rows(lyrics)
    if sounds is not None:
        hists["audio"] = _media_rows(sounds, "a")
    rows = _rows_with_histograms(items, hists).withColumn("metadata", F.create_map(F.lit("stem"), "stem"))
    if reset:
        store.reset("songs", schema.SONGS)
    first = store.save_rows("songs", rows, schema.SONGS)
    if lyrics is not None:
        store.save_codebook("music", "text", lyrics.codebook.count(), hists["lyrics"][1])
    if sounds is not None:
        store.save_codebook("music", "audio", len(sounds.centroids))
    return first


def load_products(store: Store, items: DataFrame, descriptions: TextIndex | None = None, pictures: MediaIndex | None = None, reset: bool = True) -> int:
    """Rows of the fashion application from items (stem, name, category, subcategory, image_path, description)."""
    hists: dict[str, tuple[DataFrame, list[str]]] = {}
    if descriptions is not None:
        hists["desc"] = _text_rows(descriptions)
    if pictures is not None:
        hists["image"] = _media_rows(pictures, "v")
    rows = _rows_with_histograms(items, hists).withColumn("metadata", F.create_map(F.lit("stem"), "stem"))
    if reset:
        store.reset("products", schema.PRODUCTS)
    first = store.save_rows("products", rows, schema.PRODUCTS)
    if descriptions is not None:
        store.save_codebook("fashion", "text", descriptions.codebook.count(), hists["desc"][1])
    if pictures is not None:
        store.save_codebook("fashion", "image", len(pictures.centroids))
    return first


def reload_with_codebooks(store: Store, features: DataFrame, folder: str, prefix: str) -> DataFrame:
    """(doc_id, term, tf) of new features under a stored codebook, without training."""
    return clustering.codeword_tf(features.where("vec_idx IS NOT NULL"), load_centroids(store.spark, folder), prefix)


def etl_music(spark: SparkSession, store: Store, lyrics: DataFrame | None, audio_folder: str | None, metadata: DataFrame, folder: str, codebook_size: int = 1000, n_audio: int = 200) -> int:
    """Indexes, rows and codebooks of the music application; either modality may be missing.  lyrics: (stem, text)."""
    from tessera.sources import files

    text_index = index_text(lyrics, codebook_size, f"{folder}/lyrics") if lyrics is not None else None
    sound_index = index_audio(spark, audio_folder, n_audio, f"{folder}/audio") if audio_folder else None
    empty = spark.createDataFrame([], "stem string, path string")
    sounds = pairing.first_by_extension(files.listing(spark, audio_folder), audio.EXTENSIONS) if audio_folder else empty
    words = lyrics.select("stem", F.concat("stem", F.lit(".txt")).alias("path")) if lyrics is not None else empty
    items = pairing.with_metadata(pairing.collect_files(words, sounds), metadata, "title")
    if lyrics is not None:
        items = items.join(lyrics.withColumnRenamed("text", "lyrics_text"), "stem", "left")
    return load_songs(store, items, text_index, sound_index)


def etl_fashion(spark: SparkSession, store: Store, descriptions: DataFrame, image_folder: str, metadata: DataFrame, folder: str, codebook_size: int = 1000, n_images: int = 128) -> int:
    """Indexes, rows and codebooks of the fashion application, for items with both a picture and a description (stem, text)."""
    from tessera.sources import files

    pictures = pairing.first_by_extension(files.listing(spark, image_folder), images.EXTENSIONS)
    items = pairing.pair_files(pictures, descriptions.select("stem", F.concat("stem", F.lit(".txt")).alias("path")))
    own = descriptions.join(items.select("stem"), "stem", "left_semi")
    text_index, image_index = index_text(own, codebook_size, f"{folder}/descriptions"), index_images(spark, image_folder, n_images, f"{folder}/images")
    rows = pairing.with_metadata(items, metadata, "name").join(own.withColumnRenamed("text", "description"), "stem")
    return load_products(store, rows, text_index, image_index)


def once(store: Store, table: str, build) -> bool:  # noqa: ANN001
    """Runs `build` unless the table is complete; whether it ran."""
    if store.complete(table):
        return False
    build()
    return True
