"""Toxicity (operator 5): a linear-chain conditional random field tags toxic tokens of whole texts.

Token labels come from document labels: within labelled documents, a word or word beginning whose documents are toxic far
too often for chance marks its tokens toxic (distant supervision); tokens labelled by hand can be given instead.
The field has hashed word features for the tag difference, tag transitions and a start; it is fitted by gradient on the
whole texts of at most `sample` labelled documents.  Forward-backward marginals over a whole text give spans of offending offsets and, through a
logistic of their largest value and of the expected number of toxic tokens among likely ones, calibrated on the same whole texts, the document's score.

The driver holds the sample as numbers: 4 bytes a token and its distinct words; each step of the fit goes over them in parts of PART tokens.

Inference is exact for any length: each token is a 2x2 matrix, blocks of tokens are multiplied side by side, and block
products are chained; a document's first token is a matrix that forgets what came before.

Defined results: null and empty texts have the score of a text without toxic tokens; repeated labels count each; null
labels and labels without a document are left out; without labels every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

SIZE, SAMPLE, BLOCK, PART = 1 << 16, 4000, 64, 1 << 16
_EDGES = re.compile(r"^\W+|\W+$")
_TOKEN = re.compile(r"\S+")


def core(word: str) -> str:
    """A lower-case word without punctuation around it."""
    return word if word.isalnum() else _EDGES.sub("", word)


def word_features(word: str) -> list[int]:
    """Hash buckets of a lower-case word: itself, its beginnings and ends, and its inner four-letter strings."""
    w = core(word)
    parts = [f"w{w}", *(f"p{w[:k]}" for k in (3, 4, 5, 6) if len(w) >= k), f"s{w[-3:]}", *{f"g{w[i : i + 4]}" for i in range(max(0, len(w) - 3))}]
    return [zlib.crc32(x.encode()) % SIZE for x in parts]


def beginnings(word: str) -> list[str]:
    """The word and its beginnings, as evidence for token labels."""
    w = core(word)
    return [w + "$", *(w[:k] for k in (4, 5, 6) if len(w) >= k)] if w else []


@dataclass(frozen=True)
class ChainModel:
    """Weights of the tag difference, transitions[from, to], start[tag], and the document-level calibration."""

    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    calibration: np.ndarray


def marginals(odds: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """P(toxic) of each token of concatenated chains; odds: log weight of the toxic tag, first: where chains start."""
    n = len(odds)
    if not n:
        return np.zeros(0)
    blocks = -(-n // BLOCK)
    e = np.zeros(blocks * BLOCK)
    e[:n] = np.clip(odds, -50, 50)
    begin = np.zeros(blocks * BLOCK, bool)
    begin[first] = True
    begin[n:] = True
    # m[to][from], scaled so that both tags' weights are at most one.
    t, s = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    plain, toxic = np.exp(-np.maximum(e, 0)), np.exp(np.minimum(e, 0))
    m = [[np.where(begin, s[j], t[i, j]) * (toxic if j else plain) for i in (0, 1)] for j in (0, 1)]
    m = [[np.ascontiguousarray(x.reshape(blocks, BLOCK).T) for x in row] for row in m]

    def scaled(*values: np.ndarray) -> list[np.ndarray]:
        top = np.maximum.reduce(values)
        return [v / top for v in values]

    a, b, c, d = (np.full(blocks, x) for x in (1.0, 0.0, 0.0, 1.0))  # block product [[a, b], [c, d]]
    for k in range(BLOCK):
        p, q, r, u = m[0][0][k], m[0][1][k], m[1][0][k], m[1][1][k]
        a, b, c, d = scaled(p * a + q * c, p * b + q * d, r * a + u * c, r * b + u * d)
    ahead, behind = np.empty((blocks, 2)), np.empty((blocks, 2))
    x, y = 1.0, 0.0
    for i, (pa_, pb, pc, pd) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        ahead[i] = x, y
        x, y = pa_ * x + pb * y, pc * x + pd * y
        x, y = x / (x + y), y / (x + y)
    x, y = 1.0, 1.0
    for i, (pa_, pb, pc, pd) in reversed(list(enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())))):
        behind[i] = x, y
        x, y = pa_ * x + pc * y, pb * x + pd * y
        x, y = x / (x + y), y / (x + y)
    f0, f1 = np.empty((BLOCK, blocks)), np.empty((BLOCK, blocks))
    x, y = ahead[:, 0], ahead[:, 1]
    for k in range(BLOCK):
        x, y = scaled(m[0][0][k] * x + m[0][1][k] * y, m[1][0][k] * x + m[1][1][k] * y)
        f0[k], f1[k] = x, y
    x, y = behind[:, 0], behind[:, 1]
    for k in range(BLOCK - 1, -1, -1):
        f0[k] *= x
        f1[k] *= y
        x, y = scaled(m[0][0][k] * x + m[1][0][k] * y, m[0][1][k] * x + m[1][1][k] * y)
    return (f1 / (f0 + f1)).T.ravel()[:n]


@dataclass
class Corpus:
    """Labelled texts as word numbers: the distinct words, all tokens in order, where each text ends, and each text's label."""

    words: list[str]
    tokens: np.ndarray
    ends: np.ndarray
    toxic: np.ndarray

    @staticmethod
    def of(texts: list[tuple[list[str], np.ndarray, int]]) -> Corpus:
        """From each text's distinct words, its tokens as numbers of these, and its label."""
        known: dict[str, int] = {}
        parts = [np.array([known.setdefault(w, len(known)) for w in words], np.int32)[own] if len(own) else np.zeros(0, np.int32) for words, own, _ in texts]
        ends = np.cumsum([len(p) for p in parts]) if parts else np.zeros(0, np.int64)
        return Corpus(list(known), np.concatenate(parts) if parts else np.zeros(0, np.int32), ends, np.array([y > 0 for *_, y in texts], bool))

    def texts(self) -> Iterator[tuple[int, int]]:
        yield from zip(np.concatenate(([0], self.ends[:-1])).tolist(), self.ends.tolist())

    def parts(self, most: int = PART) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, starts of texts within) of runs of whole texts of about `most` tokens; a longer text is a part by itself."""
        begin, first = 0, []
        for a, b in self.texts():
            if b > a:
                if first and b - begin > most:
                    yield begin, a, np.array(first)
                    begin, first = a, []
                first.append(a - begin)
        if first:
            yield begin, int(self.ends[-1]), np.array(first)


def token_labels(corpus: Corpus) -> np.ndarray:
    """1 for tokens whose word or beginning stands in toxic documents far beyond chance, within toxic documents only."""
    grams: dict[str, int] = {}
    own = [np.array([grams.setdefault(g, len(grams)) for g in beginnings(w)], np.int32) for w in corpus.words]
    seen = np.zeros((2, len(grams)), np.int64)
    for (a, b), toxic in zip(corpus.texts(), corpus.toxic.tolist()):
        if b > a:
            seen[int(toxic), np.unique(np.concatenate([own[w] for w in np.unique(corpus.tokens[a:b]).tolist()]))] += 1
    n_bad, n = int(corpus.toxic.sum()), len(corpus.toxic)
    if not n_bad or n_bad == n:
        return np.zeros(len(corpus.tokens), np.int8)
    good, bad = seen
    rate, need = n_bad / n, np.log(max((bad > 0).sum(), 2)) + 4.6
    share = bad / np.maximum(good + bad, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(bad > 0, bad * np.log(share / rate), 0) + np.where(good > 0, good * np.log((1 - share) / (1 - rate)), 0)
    marked = (share >= 0.8) & (share > rate) & (gain >= need)
    words = np.array([bool(marked[g].any()) for g in own], bool)
    return (words[corpus.tokens] & np.repeat(corpus.toxic, np.diff(np.concatenate(([0], corpus.ends))))).astype(np.int8)


def fit_chain(corpus: Corpus, tags: np.ndarray, steps: int = 60, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, transitions, start) by Adam on the texts' log-likelihood."""
    grams = [word_features(w) for w in corpus.words]
    column = np.concatenate([np.array(g, np.int64) for g in grams])
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    used, column = np.unique(column, return_inverse=True)
    values = [np.zeros(len(used)), np.array([[1.0, -1.0], [-1.0, 0.0]]), np.array([0.0, -2.0]), np.array([-2.0])]
    first_m, second_m = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    scale = 1 / max(1.0, float(tags.sum()))
    for step in range(1, steps + 1):
        w, t, s, bias = values
        odds = np.bincount(owner, w[column], len(grams)) + bias[0]
        error, moves, begins = np.zeros(len(grams)), np.zeros((2, 2)), np.zeros(2)
        for a, b, first in corpus.parts():
            ids, y = corpus.tokens[a:b], tags[a:b]
            p = marginals(odds[ids], first, t, s)
            error += np.bincount(ids, y - p, len(grams))
            inner = np.ones(len(ids), bool)
            inner[first] = False
            here = np.flatnonzero(inner)
            seen = np.bincount(2 * y[here - 1] + y[here], minlength=4).reshape(2, 2)
            moves += seen - pair_marginals(t, p[here - 1], p[here])
            begins += np.bincount(y[first], minlength=2) - np.array([(1 - p[first]).sum(), p[first].sum()])
        gradients = [np.bincount(column, error[owner], len(used)) * scale - penalty * w, moves * scale, begins * scale, np.array([error.sum() * scale])]
        for i, g in enumerate(gradients):
            first_m[i] = 0.9 * first_m[i] + 0.1 * g
            second_m[i] = 0.99 * second_m[i] + 0.01 * g * g
            values[i] = values[i] + 0.1 * (first_m[i] / (1 - 0.9**step)) / (np.sqrt(second_m[i] / (1 - 0.99**step)) + 1e-8)
    full = np.zeros(SIZE + 1)
    full[used] = values[0]
    full[SIZE] = values[3][0]
    return full, values[1], values[2]


def pair_marginals(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed P(tag i, next tag j) over neighbours: given both margins and the edge's odds ratio, a pair's table is unique."""
    ratio = np.exp(t[0, 0] + t[1, 1] - t[0, 1] - t[1, 0])
    # Solve (x (1 - a - b + x)) / ((a - x) (b - x)) = ratio for x = P(1, 1).
    k = ratio - 1
    if abs(k) < 1e-9:
        x = a * b
    else:
        q = 1 + (a + b) * k
        x = (q - np.sqrt(np.maximum(q * q - 4 * k * ratio * a * b, 0))) / (2 * k)
    return np.array([[(1 - a - b + x).sum(), (b - x).sum()], [(a - x).sum(), x.sum()]])


def document_features(p: np.ndarray) -> tuple[float, float]:
    """Log odds of the largest marginal, and the log of the expected number among tokens that are likelier toxic than not.

    Unlikely tokens are left out, as many of them would make a long text look toxic.
    """
    top = min(max(float(p.max()), 1e-6), 1 - 1e-6) if len(p) else 1e-6
    return float(np.log(top / (1 - top))), float(np.log1p(p[p >= 0.5].sum())) if len(p) else 0.0


def fit_calibration(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with intercept by Newton steps with a small penalty; slopes stay non-negative."""
    z = np.hstack([np.ones((len(x), 1)), x])
    c = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(c))
        c = c + np.linalg.solve(h, z.T @ (y - p) - 0.1 * c * np.array([0, 1, 1]))
    c[1:] = np.maximum(c[1:], 0)
    return c


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ChainModel:
    """The model of the whole texts of at most `sample` labelled documents, in the order of a hash of their ids."""
    rated = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    chosen = rated.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen), "id").withColumn("key", common.text_key(F.col("text")))  # `sample` labels at most are broadcast

    def make(chunk: pa.RecordBatch) -> pa.RecordBatch:
        words, tokens = [], []
        for text in chunk.column(1).to_pylist():
            known: dict[str, int] = {}
            tokens.append(np.array([known.setdefault(w, len(known)) for w in text.lower().split()], "<i4").tobytes())
            words.append(list(known))
        return pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(2), chunk.column(3), pa.array(words, pa.list_(pa.string())), pa.array(tokens, pa.binary())], ["id", "y", "key", "words", "tokens"])

    kind = joined.schema["id"].dataType.simpleString()
    table = common.map_chunks(joined.select("id", "text", "y", "key"), make, f"id {kind}, y int, key bigint, words array<string>, tokens binary")
    # Rows that repeat an id may be more than the labels: the sample is cut once more before anything comes to the driver.
    table = table.orderBy(F.xxhash64("id"), "id", "y", "key").limit(sample).toArrow()
    corpus = Corpus.of([(w.as_py(), np.frombuffer(t.as_py(), "<i4"), y.as_py()) for w, t, y in zip(table["words"], table["tokens"], table["y"])])
    del table
    if not len(corpus.tokens) or len(set(corpus.toxic.tolist())) < 2:
        return ChainModel(np.zeros(SIZE + 1), np.zeros((2, 2)), np.zeros(2), np.zeros(3))
    weights, transitions, start = fit_chain(corpus, token_labels(corpus))
    odds = np.array([word_odds(w, weights) for w in corpus.words])
    x = []
    for a, b in corpus.texts():
        x.append(document_features(marginals(odds[corpus.tokens[a:b]], np.zeros(min(1, b - a), np.int64), transitions, start)))
    return ChainModel(weights, transitions, start, fit_calibration(np.array(x), corpus.toxic.astype(float)))


def word_odds(word: str, weights: np.ndarray) -> float:
    return float(weights[word_features(word)].sum() + weights[SIZE])


def tag(docs: DataFrame, model: ChainModel, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted, expected_toxic, spans): spans are (start, end, probability) in code points of the text."""

    cache = common.Cache(lambda word: word_odds(word, model.weights), 400_000)

    def make(chunk: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in chunk.column(1).to_pylist()]
        get = cache.__getitem__
        parts = [np.fromiter(map(get, words), np.float64, len(words)) for words in (t.lower().split() for t in texts)]
        sizes = np.array([len(x) for x in parts])
        ends = np.cumsum(sizes)
        p = marginals(np.concatenate(parts), (ends - sizes)[sizes > 0], model.transitions, model.start)
        x = np.zeros((len(texts), 2))
        expected, spans = [], []
        for i, (text, a, b) in enumerate(zip(texts, (ends - sizes).tolist(), ends.tolist())):
            own = p[a:b]
            x[i] = document_features(own)
            expected.append(float(own.sum()))
            hit = np.flatnonzero(own >= 0.5)
            found: list[dict] = []
            if len(hit):
                # Lower-casing never changes white space, so words of the text and of its lower case correspond.
                places = [m.span() for m in _TOKEN.finditer(text)]
                for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                    found.append({"start": places[run[0]][0], "end": places[run[-1]][1], "probability": float(own[run].max())})
            spans.append(found)
        score = 1 / (1 + np.exp(-np.clip(model.calibration[0] + x @ model.calibration[1:], -30, 30)))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        return pa.RecordBatch.from_arrays([chunk.column(0), pa.array(score), pa.array((score >= least).astype(np.int32)), pa.array(expected, pa.float64()), pa.array(spans, kind)], [id_col, "score", "predicted", "expected_toxic", "spans"])

    rows = docs.select(F.col(id_col), common.text_or_empty(text_col).alias(text_col))
    kind = rows.schema[id_col].dataType.simpleString()
    return common.map_chunks(rows, make, f"`{id_col}` {kind}, score double, predicted int, expected_toxic double, spans array<struct<start int, end int, probability double>>", text_col)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return tag(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted", "spans")
