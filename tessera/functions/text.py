"""Text functions: paragraphs, tokens, stopwords, stems, file stems and descriptions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every ASCII punctuation character and digit, as a character class.
PUNCTUATION_AND_DIGITS = r"[!-/:-@\[-`{-~0-9]"
MIN_PARAGRAPH = 20


def tokens(text: Column) -> Column:
    """Lower-case words: ASCII punctuation and digits become spaces, then white space splits.  A null text has none."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION_AND_DIGITS, " "), r"(?U)\s+")
    return F.filter(words, lambda w: w != "")


def spaced(text: Column) -> Column:
    """The words of `tokens` with one space between them (and perhaps one at an end)."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)" + PUNCTUATION_AND_DIGITS[:-1] + r"\s]+", " ")


def paragraphs(text: Column, least: int = MIN_PARAGRAPH, mark: str = "\n\n") -> Column:
    """Trimmed paragraphs of `least` characters; the first one alone if none is as long."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\Q" + mark + r"\E", -1), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    long = F.filter(parts, lambda p: F.char_length(p) >= least)
    return F.when(F.size(long) > 0, long).otherwise(F.slice(parts, 1, 1))


def chunk_id(stem: Column, position: Column) -> Column:
    return F.format_string("%s#chunk%03d", stem.cast("string"), position)


def chunks(df: DataFrame, id_col: str, text_col: str, least: int = MIN_PARAGRAPH, mark: str = "\n\n") -> DataFrame:
    """(doc_id, text): one row for each paragraph, numbered before empty ones go."""
    parts = df.select(F.col(id_col).alias("stem"), F.posexplode(paragraphs(F.col(text_col), least, mark)).alias("pos", "text"))
    return parts.select(chunk_id(F.col("stem"), F.col("pos")).alias("doc_id"), "text")


# The usual English stopwords, as far as the tokenizer can make them.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain "
    "aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()


def without_stopwords(words: Column, stop: list[str]) -> Column:
    held = F.array(*(F.lit(w) for w in stop))
    return F.filter(words, lambda w: ~F.array_contains(held, w))


def safe_stem(name: Column) -> Column:
    """Runs of characters outside letters, digits, dot, underscore and hyphen become one underscore; none at the ends."""
    return F.btrim(F.regexp_replace(name, r"[^a-zA-Z0-9._-]+", "_"), F.lit("_"))


def first_given(*columns: Column) -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def product_description(row: dict[str, Column]) -> Column:
    """Sentences about a product of the catalogue.

    Gender and category are told even where they are blank; article type, colour, usage and season drop out then.
    """
    given = lambda c: F.coalesce(row[c], F.lit("")) if c in row else F.lit("")
    labelled = lambda label, c: F.when(given(c) != "", F.concat(F.lit(label + ": "), given(c))).otherwise("")
    parts = F.array(
        first_of(given("productDisplayName"), given("name")),
        F.rtrim(F.concat(F.lit("Gender: "), given("gender"))),
        F.concat(F.lit("Category: "), given("masterCategory"), F.lit(" / "), given("subCategory")),
        labelled("Article type", "articleType"),
        labelled("Color", "baseColour"),
        labelled("Usage", "usage"),
        labelled("Season", "season"),
    )
    return F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), ". ")


def first_of(a: Column, b: Column) -> Column:
    return F.when(a != "", a).otherwise(b)


def short_description(name: Column, category: Column, subcategory: Column) -> Column:
    """A description made again from metadata: name, category, subcategory, trimmed; a blank name drops out."""
    given = lambda c: F.coalesce(c, F.lit(""))
    parts = F.array(F.trim(given(name)), F.trim(F.concat(F.lit("Category: "), given(category))), F.trim(F.concat(F.lit("Subcategory: "), given(subcategory))))
    return F.array_join(F.filter(parts, lambda p: p != ""), ". ")
