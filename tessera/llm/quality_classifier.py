"""Quality classifier (operator 1): ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x), with one weight vector over hashed text features for all grades and ordered
thresholds (kept in order by positive steps).  A text's features are hashed indicators (each
word, its shape and its ends, and how much of the text repeats), summed over its words and divided by their number plus a
constant, so a text's w.x is a shrunken mean of its words' values, each computed once for each distinct word.

The fit takes a bounded sample: at most `sample` labelled documents, in the order of a hash of their ids.

Defined results: null and empty texts have w.x = 0; labels without a document, documents without a label and null
grades don't enter the fit; of repeated labels each row counts; without any label the model gives every text the
same middle grade; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

SIZE = 1 << 16
SAMPLE = 6000
#: Added to the number of words that a text's features are divided by, so that short texts stay near the middle.
PRIOR_WORDS = 20
_LOWER, _UPPER, _DIGIT, _OTHER = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+"), re.compile(rb"[^aA0]{3,}")


def word_features(word: bytes) -> tuple[int, ...]:
    """Hash buckets of one word."""
    shape = _OTHER.sub(b"~", _DIGIT.sub(b"0", _UPPER.sub(b"A", _LOWER.sub(b"a", word))))
    low = word.lower()
    return tuple(zlib.crc32(x) % SIZE for x in (b"w" + low, b"s" + shape, b"e" + low[-2:], b"b" + low[:2]))


def repeat_features(words: list[bytes]) -> tuple[int, int]:
    """Hash buckets that stand for the shares of words that equal the word before them, and of 3-word windows seen before."""
    same = sum(map(bytes.__eq__, words, words[1:]))
    again = max(0, len(words) - 2) - len(set(zip(words, words[1:], words[2:])))
    return tuple(zlib.crc32(b"\0%d:%d" % (i, -(-10 * n // len(words)))) % SIZE for i, n in enumerate((same, again)))


@dataclass(frozen=True)
class OrdinalModel:
    """Grades (ascending), thresholds between them, and the weights of the hashed features."""

    grades: list[int]
    thresholds: np.ndarray
    weights: np.ndarray

    def probabilities(self, value: np.ndarray) -> np.ndarray:
        """P(grade) for each row and grade."""
        below = 1 / (1 + np.exp(-(self.thresholds[None, :] - value[:, None])))
        edges = np.hstack([np.zeros((len(value), 1)), below, np.ones((len(value), 1))])
        return np.diff(edges, axis=1)


def fit_ordinal(rows: list[np.ndarray], shares: list[np.ndarray], grades: np.ndarray, penalty: float = 1e-3, steps: int = 150, rate: float = 0.2) -> OrdinalModel:
    """Maximum likelihood by Adam on sparse rows (bucket indices and shares)."""
    levels = sorted(set(grades.tolist()))
    k = len(levels)
    if k < 2:
        return OrdinalModel(levels or [0], np.zeros(0), np.zeros(SIZE))
    y = np.searchsorted(levels, grades)
    column = np.concatenate(rows).astype(np.int64)
    share = np.concatenate(shares).astype(np.float64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, column = np.unique(column, return_inverse=True)
    # Rare features vary as much as frequent ones.
    scale = 1 / np.sqrt(np.bincount(column, share**2, len(used)) / len(rows) + 1e-6)
    share = share * scale[column]
    weight = np.zeros(len(used))
    counts = np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y)
    start = np.log(counts / (1 - counts))
    # Unordered parameters: first threshold, then logarithms of the steps.
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    balance = (len(y) / (k * np.bincount(y, minlength=k)))[y] ** 0.5
    balance = balance / balance.mean()
    first, second = [np.zeros_like(weight), np.zeros_like(theta)], [np.zeros_like(weight), np.zeros_like(theta)]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        steps_up = np.exp(theta[1:])
        t = np.concatenate([[-np.inf], theta[0] + np.concatenate([[0], np.cumsum(steps_up)]), [np.inf]])
        s = np.bincount(owner, share * weight[column], len(rows))
        high, low = sigmoid(np.where(np.isinf(t[y + 1]), 40, t[y + 1] - s)), sigmoid(np.where(np.isinf(t[y]), -40, t[y] - s))
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) * (y < k - 1), low * (1 - low) * (y > 0)
        ds = balance * (dh - dl) / p / len(y)  # gradient of -log p with respect to s
        dt = np.zeros(k - 1)
        np.add.at(dt, np.minimum(y, k - 2), -balance * dh / p / len(y) * (y < k - 1))
        np.add.at(dt, np.maximum(y - 1, 0), balance * dl / p / len(y) * (y > 0))
        tail = np.cumsum(dt[::-1])[::-1]
        gradients = [np.bincount(column, share * ds[owner], len(used)) + penalty * weight, np.concatenate([[dt.sum()], tail[1:] * steps_up])]
        for i, (value, g) in enumerate(zip((weight, theta), gradients)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            value -= rate * (0.1 if i == 0 else 0.3) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-9)
    full = np.zeros(SIZE)
    full[used] = weight * scale
    return OrdinalModel(levels, theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))]), full)


def text_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares; at most SIZE of them whatever the text's length."""
    words = raw.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    found: Counter = Counter()
    for word, n in Counter(words).items():
        for f in word_features(word):
            found[f] += n
    for bucket in repeat_features(words):
        found[bucket] += len(words)
    return np.fromiter(found.keys(), np.int32, len(found)), np.fromiter(found.values(), np.float32, len(found)) / (len(words) + PRIOR_WORDS)


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", sample: int = SAMPLE) -> OrdinalModel:
    """The model of at most `sample` labelled documents."""
    rated = ratings.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("id"), "id", "grade").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen), "id").withColumn("key", common.text_key(F.col("text")))  # `sample` labels at most are broadcast

    def make(chunk: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [text_features(raw) for raw in common.raw_texts(chunk.column(1))]
        return pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(2), chunk.column(3), pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.list_(pa.float32()))], ["id", "grade", "key", "buckets", "shares"])

    kind = joined.schema["id"].dataType.simpleString()
    table = common.map_chunks(joined.select("id", "text", "grade", "key"), make, f"id {kind}, grade int, key bigint, buckets array<int>, shares array<float>")
    # Rows that repeat an id may be more than the labels: the sample is cut once more before anything comes to the driver.
    table = table.orderBy(F.xxhash64("id"), "id", "grade", "key").limit(sample).toArrow()
    buckets, shares = ([x.values.to_numpy() for x in table[c]] for c in ("buckets", "shares"))
    return fit_ordinal(buckets, shares, np.array(table["grade"].to_pylist(), np.int64))


def values_of(model: OrdinalModel) -> Callable[[list[bytes]], np.ndarray]:
    """w.x of texts, each word's value computed once."""
    weights = model.weights
    cache = common.Cache(lambda word: sum(weights[f] for f in word_features(word)), 400_000)

    def values(raws: list[bytes]) -> np.ndarray:
        out, get = np.empty(len(raws)), cache.__getitem__
        for i, raw in enumerate(raws):
            words = raw.split()
            total = float(np.fromiter(map(get, words), np.float64, len(words)).sum())
            if words:
                total += float(weights[list(repeat_features(words))].sum()) * len(words)
            out[i] = total / (len(words) + PRIOR_WORDS)
        return out

    return values


def tails(model: OrdinalModel, p: np.ndarray, least_grade: int | None) -> np.ndarray:
    """P(grade >= least_grade), the highest grade if None, from probabilities by grade."""
    least = model.grades[-1] if least_grade is None else least_grade
    return np.clip(p[:, np.array(model.grades) >= least].sum(axis=1), 0, 1)


def score(docs: DataFrame, model: OrdinalModel, least_grade: int | None = None, least_tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, expected_grade, tail_probability, grade, selected): tail_probability is P(grade >= least_grade).

    least_grade: the highest grade if None.
    """
    levels = np.array(model.grades)
    values = values_of(model)

    def make(chunk: pa.RecordBatch) -> pa.RecordBatch:
        p = model.probabilities(values(common.raw_texts(chunk.column(1))))
        tail = tails(model, p, least_grade)
        return pa.RecordBatch.from_arrays(
            [chunk.column(0), pa.array(p @ levels), pa.array(tail), pa.array(levels[p.argmax(axis=1)].astype(np.int32)), pa.array(tail >= least_tail)], [id_col, "expected_grade", "tail_probability", "grade", "selected"]
        )

    rows = docs.select(F.col(id_col), common.text_or_empty(text_col).alias(text_col))
    kind = rows.schema[id_col].dataType.simpleString()
    return common.map_chunks(rows, make, f"`{id_col}` {kind}, expected_grade double, tail_probability double, grade int, selected boolean", text_col)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents.  `labels.quality` has two grades, so the model has one threshold here and expected_grade equals
    tail_probability; with more grades in the column it has more."""
    docs = common.documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_selected(docs: DataFrame, ratings: DataFrame, least_grade: int | None = None, least_tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier selects, with all their columns; decided within the batch that holds the text."""
    model = fit(docs, ratings, id_col, text_col)
    values, at = values_of(model), docs.columns.index(text_col)
    return common.filter_chunks(docs, text_col, lambda chunk: tails(model, model.probabilities(values(common.raw_texts(chunk.column(at)))), least_grade) >= least_tail)
