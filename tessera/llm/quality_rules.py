"""Quality rules (operator 10): counts of a text, and its divergence from language references.

Each text gives a histogram of character classes and one of common words.  The references are the sums of these
histograms over all documents of a language that pass the base rules.  The Jensen-Shannon distance (square root of the
divergence to base 2) to the reference of the document's language rejects a text, each distance only from a minimum
length on: short texts have rough histograms.

Defined results: null and empty texts have no words and fail the base rule; a text without a language, or
whose language has no reference, is held against none (distance 0); repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessera.llm import common

# Common words of four languages.
COMMON_WORDS = {
    "en": "the of and to a in is that for it as was with be by on are this at from or an he not have which you they one had",
    "fr": "le la de et les des en un une du que est pour qui dans au par sur pas il elle avec ce se plus son ou mais nous vous",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an für er hat aus bei nach wie sie",
    "es": "el la de que y en los del se las por un para con no una su al lo como más pero sus le ya este si porque esta entre",
}
SYMBOLS = b"#*$%&|<>"
#: Character classes: lower and upper ASCII letters, other letters (by first byte), digits, blanks, line ends, the
#: symbols, exclamation marks and question marks, and remaining punctuation.
CLASSES = 9
#: References of so many languages, those of most documents, come to the driver; ISO 639-3 has fewer.
MOST_LANGUAGES = 10_000


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict; the distances lie in 0..1."""

    least_words: int = 20
    most_repeat_percent: int = 30
    class_distance: float = 0.25
    class_chars: int = 400
    word_distance: float = 0.30
    word_words: int = 120


def _class_of_byte() -> np.ndarray:
    table = np.full(256, 8, np.int64)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[0xC0:] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[[9, 11, 12, 32]] = 4
    table[[10, 13]] = 5
    table[list(SYMBOLS)] = 6
    table[[ord("!"), ord("?")]] = 7
    return table


BYTE_CLASS = np.zeros((256, CLASSES), np.int64)
BYTE_CLASS[np.arange(256), _class_of_byte()] = 1
BYTE_CLASS[0x80:0xC0] = 0  # continuation bytes aren't characters
SPACES = [9, 10, 11, 12, 13, 32]
VOCABULARY = sorted({w.encode() for words in COMMON_WORDS.values() for w in words.split()})


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """How many words lie in windows of `width` words that occur twice or more, the first included."""
    n = len(words)
    if n <= width:
        return 0
    codes: dict[bytes, int] = {}
    h = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n).view(np.uint64)
    m = n - width + 1
    window = np.zeros(m, np.uint64)
    for j in range(width):
        window = (window + h[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
        window ^= window >> np.uint64(29)
    slots = (window >> np.uint64(32)).astype(np.int64) & ((1 << max(12, m.bit_length() + 2)) - 1)
    maybe = np.flatnonzero(np.bincount(slots)[slots] > 1)
    if not len(maybe):
        return 0
    _, back, counts = np.unique(window[maybe], return_inverse=True, return_counts=True)
    maybe = maybe[counts[back] > 1]
    if not len(maybe):
        return 0
    # The windows themselves decide, as rows of word numbers: 8 * width bytes for each that may repeat.
    rows = np.lib.stride_tricks.sliding_window_view(h, width)[maybe].view(f"V{8 * width}").ravel()
    _, back, counts = np.unique(rows, return_inverse=True, return_counts=True)
    places = maybe[counts[back] > 1]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + width, -1)
    return int((np.cumsum(change[:n]) > 0).sum())


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(column: pa.Array, vocabulary: dict[bytes, int]) -> list[pa.Array]:
    """COUNTS, then the histograms of character classes and of words, of each text; the last bin of words holds those that aren't common."""
    bins = len(VOCABULARY) + 1
    data, at = common.offsets(column)
    rows: list[list] = [[] for _ in range(7)]
    for raw, a, b in zip(common.raw_texts(column), at, at[1:]):
        by_byte = np.bincount(data[a:b], minlength=256)
        words = raw.split()
        n = len(words)
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        chars = int(by_byte.sum() - by_byte[0x80:0xC0].sum())
        hist = np.bincount(np.array([vocabulary[w] for w in words if w in vocabulary], np.int64), minlength=bins)
        hist[-1] = n - hist.sum()
        values = (n, chars - int(by_byte[SPACES].sum()), int(by_byte[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words), by_byte @ BYTE_CLASS, hist)
        for into, value in zip(rows, values):
            into.append(value)
    return [pa.array(x, pa.int64()) for x in rows[:5]] + [pa.array(x, pa.list_(pa.int64())) for x in rows[5:]]


#: Columns that the measures add; no table is taken that has such names itself.
MARK = "__tessera_"
MEASURES = [*COUNTS, "classes", "words"]


def measures(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The table's own columns, its language as a string and MEASURES, the latter with names that begin with MARK."""
    vocabulary = {w: i for i, w in enumerate(VOCABULARY)}
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.chunks(batches, text_col):
            yield pa.RecordBatch.from_arrays([*chunk.columns, *measured(chunk.column(at), vocabulary)], [*chunk.schema.names, *(MARK + m for m in MEASURES)])

    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in df.columns else F.lit(None).cast("string")
    rows = df.withColumn(f"{MARK}lang", lang)
    added = [StructField(MARK + m, LongType() if m in COUNTS else ArrayType(LongType())) for m in MEASURES]
    schema = StructType([*rows.schema.fields, *added])
    return common.map_arrow(rows, run, schema)


def base_failed(rules: Rules) -> Column:
    n_words, repeat = F.col(f"{MARK}n_words"), F.col(f"{MARK}n_repeat_words")
    return (n_words < rules.least_words) | (100 * repeat > rules.most_repeat_percent * n_words)


def references(held: DataFrame, rules: Rules) -> DataFrame:
    """(lang, ref_classes, ref_words): shares over all documents of a language that pass the base rules, for each language."""
    sums = [F.sum(F.col(f"{MARK}classes")[i]).alias(f"c{i}") for i in range(CLASSES)]
    sums += [F.sum(F.col(f"{MARK}words")[i]).alias(f"w{i}") for i in range(len(VOCABULARY) + 1)]
    by_lang = held.where(~base_failed(rules) & F.col(f"{MARK}lang").isNotNull()).groupBy(F.col(f"{MARK}lang").alias("lang")).agg(F.count("*").alias("n"), *sums)

    def shares(prefix: str, n: int) -> Column:
        values = F.array(*(F.col(f"{prefix}{i}").cast("double") for i in range(n)))
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        return F.transform(values, lambda x: F.when(total > 0, x / total).otherwise(0.0))

    return by_lang.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).select("lang", shares("c", CLASSES).alias("ref_classes"), shares("w", len(VOCABULARY) + 1).alias("ref_words"))


def js_distance(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to its row of shares; 0 for an empty histogram or reference."""
    total, held = counts.sum(axis=1, keepdims=True), shares.sum(axis=1)
    p, q = counts / np.maximum(total, 1), shares
    middle = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(x > 0, middle, 1)), 0.0)
    divergence = (part(p) + part(q)).sum(axis=1) / 2
    return np.where((total[:, 0] > 0) & (held > 0), np.sqrt(np.maximum(divergence, 0)), 0.0)


References = dict[str, tuple[np.ndarray, np.ndarray]]


def collected(refs: DataFrame) -> References:
    """References by language, MOST_LANGUAGES at most."""
    return {r["lang"]: (np.array(r["ref_classes"]), np.array(r["ref_words"])) for r in refs.collect()}


def verdicts(batch: pa.RecordBatch, refs: References, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distance of classes, of words, base_failed, kept) of measured rows."""
    nothing = (np.zeros(CLASSES), np.zeros(len(VOCABULARY) + 1))
    own = {m: batch.column(batch.schema.get_field_index(MARK + m)) for m in [*MEASURES, "lang"]}
    langs = own["lang"].to_pylist()
    hists = [own[m].flatten().to_numpy().reshape(batch.num_rows, -1) for m in ("classes", "words")]
    distances = [js_distance(h, np.array([refs.get(lang, nothing)[k] for lang in langs])) for k, h in enumerate(hists)]
    n_words, n_repeat = (own[m].to_numpy(zero_copy_only=False) for m in ("n_words", "n_repeat_words"))
    failed = (n_words < rules.least_words) | (100 * n_repeat > rules.most_repeat_percent * n_words)
    odd = (hists[0].sum(axis=1) >= rules.class_chars) & (distances[0] > rules.class_distance) | (n_words >= rules.word_words) & (distances[1] > rules.word_distance)
    return *distances, failed, ~failed & ~odd


def judge(df: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", refs: References | None = None) -> DataFrame:
    """(id_col, counts, class_distance, word_distance, base_failed, kept) for each row.

    refs: stored references (`collected`); None: those of this table, so that a verdict depends on the other rows, too.
    """
    columns = [F.col(c) for c in dict.fromkeys([id_col, text_col, *([lang_col] if lang_col in df.columns else [])])]
    held = common.staged(measures(df.select(*columns), text_col, lang_col).drop(*{text_col} - {id_col}), "measures")
    found = collected(references(held, rules)) if refs is None else refs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                counts = (batch.column(batch.schema.get_field_index(MARK + c)) for c in COUNTS)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)), *counts, *map(pa.array, verdicts(batch, found, rules))], names)

    names = [id_col, *COUNTS, "class_distance", "word_distance", "base_failed", "kept"]
    kind = held.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return common.map_arrow(held, run, f"`{id_col}` {kind}, {counts}, class_distance double, word_distance double, base_failed boolean, kept boolean")


def keep_good(df: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang", refs: References | None = None) -> DataFrame:
    """The rows that the rules keep, with all their columns, which travel with the measures instead of being joined back."""
    held = common.staged(measures(df, text_col, lang_col), "measures")
    found = collected(references(held, rules)) if refs is None else refs
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.chunks(batches, text_col):
            kept = chunk.filter(pa.array(verdicts(chunk, found, rules)[3]))
            yield pa.RecordBatch.from_arrays(kept.columns[: len(names)], schema=pa.schema(list(kept.schema)[: len(names)]))

    return common.map_arrow(held, run, df.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir))
