"""Packing (operator 9): documents are laid along a Hilbert curve and cut into sequences of one length.

Token ids are those of the `tokenizers` library for its file, through a bounded memo of pre-token slices.  Each document's hashed token
vector is projected to a few dimensions; the Hilbert key of the quantised projection orders the documents, so that
neighbours in a sequence resemble each other.  The ordered stream is cut every `length` tokens: only the last
sequence can be short.

Plan: one pass encodes and writes (key, ids) into the shared folder; quantiles of the key give ranges; one shuffle
brings each range together; the ranges' token totals (one number for each range, whose number is bounded) give every
range its place in the stream.

Defined results: null and empty texts are documents of the end id alone; equal keys are ordered by a hash of the row id,
so a large group of copies spreads over ranges; repeated rows are packed each; an empty table gives no piece.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, common

DIMENSIONS, BITS, HASHED = 4, 8, 256
#: Tokens in a range, as far as MOST_RANGES allows; beyond it ranges grow and are still streamed.
RANGE_TOKENS, MOST_RANGES = 1 << 20, 20_000
PIECES = "{id} bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@lru_cache(2)
def tokenizer(path: str):  # noqa: ANN201
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return own


@lru_cache(2)
def added_tokens(path: str):  # noqa: ANN201
    """(the file's tokenizer as it is, a pattern of its added tokens' literals or None)."""
    from tokenizers import Tokenizer

    tokenizer(path)
    own = Tokenizer.from_file(path)
    literals = [re.escape(t.content) for t in own.get_added_tokens_decoder().values()]
    return own, re.compile("|".join(literals)) if literals else None


class LibraryMerger:
    """Stands for byte_bpe.Merger where the library encodes the slices."""

    def __init__(self, own):  # noqa: ANN001
        self.own, self.ranks = own, {}

    def merge(self, pieces: list[bytes], kind: str) -> list[bytes]:
        return [np.array(e.ids, kind).tobytes() for e in self.own.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def rows(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, step = raw.tobytes(), raw.shape[1]
        packed = self.merge([data[i * step : i * step + n] for i, n in enumerate(lengths.tolist())], "<u4")
        return np.frombuffer(b"".join(packed), "<u4"), np.array([len(p) // 4 for p in packed], np.int64)


@lru_cache(2)
def piece_cache(path: str) -> byte_bpe.PieceCache:
    """The memo of one tokenizer file.  Where the file's ids follow its merges, as in byte-level BPE, slices are merged
    here together (equal to the library's result, about four times as fast); else the library encodes them."""
    own = tokenizer(path)
    kind = "<u2" if own.get_vocab_size() <= 1 << 16 else "<u4"
    model = json.loads(own.to_str())["model"]
    letters = {c: b for b, c in byte_letters().items()}
    vocabulary = own.get_vocab(with_added_tokens=False)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    in_order = all(vocabulary[a + b] == i + 256 for i, (a, b) in enumerate(merges)) and all(vocabulary.get(c, 256) < 256 for c in letters)
    if model["type"] == "BPE" and in_order and not model.get("byte_fallback"):
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(merges)}
        return byte_bpe.PieceCache(byte_bpe.Merger(ranks), kind)
    return byte_bpe.PieceCache(LibraryMerger(own), kind)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level BPE files: printable bytes themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text.  Texts with the literal of an added token are encoded whole by the library, which finds it first."""
    own, found = added_tokens(path)
    special = [i for i, t in enumerate(texts) if found is not None and found.search(t)]
    if not special:
        return list(byte_bpe.encode_pieces(texts, piece_cache(path)))
    cache, whole = piece_cache(path), set(special)
    plain = byte_bpe.encode_pieces([t for i, t in enumerate(texts) if i not in whole], cache)
    return [np.array(own.encode(t, add_special_tokens=False).ids, cache.kind) if i in whole else next(plain) for i, t in enumerate(texts)]


@lru_cache(2)
def projection(vocabulary: int) -> np.ndarray:
    """A row for each token id: its hash bucket's random direction."""
    draw = np.random.default_rng(9)
    directions = draw.standard_normal((HASHED, DIMENSIONS)).astype(np.float32)
    ids = np.arange(vocabulary, dtype=np.uint64)
    return directions[((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % HASHED]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n, d) with coordinates below 2**bits (Skilling's transpose, vectorised)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """Hilbert keys of the documents' projected vectors (unit length, so that size doesn't order them)."""
    table = projection(vocabulary)
    sums = np.array([table[x].sum(axis=0, dtype=np.float64) if len(x) else np.zeros(DIMENSIONS) for x in ids]).reshape(len(ids), DIMENSIONS)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = sums / np.where(norm > 0, norm, 1)
    return hilbert(np.clip(((unit + 1) * (1 << BITS) / 2).astype(np.int64), 0, (1 << BITS) - 1))


def encoded(df: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n, ids): packed ids with the end id, and the place on the curve."""
    size = tokenizer(path).get_vocab_size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.chunks(batches, text_col, 2 << 20):
            texts = [t or "" for t in chunk.column(1).to_pylist()]
            ids = encode_texts(texts, path)
            keys = curve_keys(ids, size)
            end = np.array([end_id], ids[0].dtype).tobytes()
            packed = [x.tobytes() + end for x in ids]
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), pa.array(keys << 31), pa.array([len(x) + 1 for x in ids], pa.int64()), pa.array(packed, pa.binary())], ["id", "key", "n", "ids"]
            )

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias(text_col))
    out = common.map_arrow(rows, run, "id bigint, key bigint, n bigint, ids binary")
    return out.withColumn("key", F.col("key").bitwiseOR(F.xxhash64("id", "n").bitwiseAND(F.lit((1 << 31) - 1))))


def pack(df: DataFrame, path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): `ids` are the piece's token ids, left out without with_ids."""
    spark = df.sparkSession
    width = 2 if tokenizer(path).get_vocab_size() <= 1 << 16 else 4
    table = common.staged(encoded(df, path, end_id, id_col, text_col), "packing")
    total = table.agg(F.sum("n")).first()[0] or 0
    ranges = int(min(MOST_RANGES, max(1, total // RANGE_TOKENS)))
    cuts: list[int] = []
    if ranges > 1:
        fractions = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(table.agg(F.percentile_approx("key", fractions, max(10_000, 20 * ranges)).alias("cuts")).first()["cuts"]))
    bounds = np.array(cuts, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(1).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "range"])

    light = common.map_arrow(table.select("id", "key", "n"), place, "id bigint, key bigint, n bigint, range int")
    sums = {r["range"]: r["n"] for r in light.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # one row for each range
    first, begins = 0, {}
    for at in sorted(sums):
        begins[at] = first
        first += sums[at]
    kind = f"<u{width}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position = None, 0
        for whole in batches:
            for i in range(0, whole.num_rows, 500):  # pieces of so many documents at a time
                batch = whole.slice(i, 500)
                out: list[tuple] = []
                for row, n, data, at in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                    if at != current:
                        current, position = at, begins[at]
                    ids = np.frombuffer(data, kind).astype("<u4")
                    start = 0
                    while start < n:
                        sequence, offset = divmod(position, length)
                        take = min(n - start, length - offset)
                        piece = ids[start : start + take]
                        out.append((row, start, take, zlib.crc32(piece), n, sequence, offset, piece))
                        start += take
                        position += take
                columns = list(zip(*out))
                kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    dealt = common.map_arrow(table, place, "id bigint, key bigint, n bigint, ids binary, range int").repartition("range").sortWithinPartitions("range", "key", "id", "n")
    return common.map_arrow(dealt, cut, PIECES.format(id=f"`{id_col}`") + ", ids array<int>" * with_ids)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
