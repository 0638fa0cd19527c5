"""Awkward rows that every operator must take."""

from pyspark.sql import DataFrame, SparkSession

WORDS = "the rain in spain stays mainly on the plain and the river runs down to the sea past many small towns"
LONG = " ".join(f"{w}{i % 97}" for i in range(6000) for w in ("Lorem", "ipsum"))
SECRET = "deploy with password=4f9c2a71be03d85e6a and " + WORDS
ROWS = [
    (1, WORDS, "en", "src0", len(WORDS)),
    (2, WORDS, "en", "src0", len(WORDS)),  # a copy
    (2, WORDS, "en", "src0", len(WORDS)),  # a repeated row
    (3, "", "en", "src1", 0),
    (4, None, None, None, None),
    (None, "no id here, " + WORDS, "fr", "src2", 40),
    (5, " \t\n\x0b ", "xx", "src3", 5),
    (6, LONG, "en", "src4", len(LONG)),
    (7, "Éà ü 漢字 \U0001f600 don't 'll x²½ ٣\x85 end", "de", "src5", 30),
    (8, SECRET, "en", "docs/example", len(SECRET)),
    (9, "word " * 50, "es", "src6", 250),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)


def with_clashes(spark: SparkSession) -> DataFrame:
    """The same rows with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ["fp", "component_id", "ids", "key", "n", "row", "bucket", "score", "kept", "words", "start", "id", "text_key", "media", "n_words", "__id"]
    return documents(spark).withColumns({c: F.lit(f"own {c}") for c in names})


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(spark: SparkSession) -> DataFrame:
    rows = [(1, 1, 0), (2, 1, 0), (3, 0, 0), (4, None, None), (None, 1, 1), (6, 1, 1), (9, 0, 1), (9, 0, 1), (777, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
