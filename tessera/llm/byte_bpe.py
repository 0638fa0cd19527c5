"""Byte-level BPE (operator 7) with vectorised pre-tokenisation.

Boundaries of the pre-tokenisation pattern are found without a regular expression: every code point becomes a symbol
(its class, with what the look-ahead needs folded in), every symbol is a function from scanner state to scanner state,
and the functions are composed by an associative scan over blocks.  The slices feed a bounded cache of pair merges.

Defined results: null and empty texts have no tokens; repeated texts have equal results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common

# The code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
# The letters that make a contraction after an apostrophe.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

# Symbols: letter, number, other, apostrophe that may open a contraction of one or two letters, space or other white
# space before text, white space before white space or the end, and the separator between two texts.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE, BLANK, INNER, BREAK = range(9)
# States: in a run of letters, numbers, others or white space; behind a space that joins what follows; behind a closed
# token; one or two letters of a contraction still to come.
IN_L, IN_N, IN_O, IN_W, JOIN, CLOSED, ONE_LEFT, TWO_LEFT = range(8)
BLOCK = 64


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, token starts here) by symbol and state."""
    to, begins = np.zeros((9, 8), np.uint8), np.zeros((9, 8), bool)
    for state in range(8):
        for symbol, own in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
            to[symbol, state], begins[symbol, state] = own, state not in (own, JOIN)
        for symbol, left in ((QUOTE1, ONE_LEFT), (QUOTE2, TWO_LEFT)):
            inside = state in (IN_O, JOIN)
            to[symbol, state], begins[symbol, state] = (IN_O, False) if inside else (left, True)
        to[SPACE, state], begins[SPACE, state] = JOIN, True
        to[BLANK, state], begins[BLANK, state] = CLOSED, True
        to[INNER, state], begins[INNER, state] = IN_W, state != IN_W
        to[BREAK, state], begins[BREAK, state] = CLOSED, True
    to[:BREAK, TWO_LEFT], begins[:BREAK, TWO_LEFT] = ONE_LEFT, False
    to[:BREAK, ONE_LEFT], begins[:BREAK, ONE_LEFT] = CLOSED, False
    return to, begins


TO, BEGINS = _machine()


@lru_cache(1)
def class_table() -> np.ndarray:
    """LETTER, NUMBER, OTHER or INNER (white space) for each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    table[WHITE_SPACE] = INNER
    return table


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of concatenated texts, each followed by one separator at the positions `ends`."""
    symbol = class_table()[points]
    symbol[ends] = BREAK
    blank = np.flatnonzero(symbol == INNER)
    before_text = blank[symbol[blank + 1] < INNER]
    symbol[before_text] = np.where(points[before_text] == 32, SPACE, BLANK)
    quote = np.flatnonzero(points == 39)
    if len(quote):
        first, second = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
        symbol[quote[np.isin(first, [ord(c) for c in ONE_LETTER])]] = QUOTE1
        for a, b in TWO_LETTERS:
            symbol[quote[(first == ord(a)) & (second == ord(b))]] = QUOTE2
    return symbol


def token_starts(symbol: np.ndarray) -> np.ndarray:
    """Where a token (or separator) starts, by an associative scan of the symbols' transition functions.

    Each block's functions are composed for all states at once, from its end on; the block functions are composed in order; then each
    block runs from its true state.
    """
    n = len(symbol)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, BREAK, np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.int16) * 8
    table = TO.ravel()
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    open_blocks = np.arange(blocks)
    for column in columns[::-1]:  # from the right: a block is done when its function is constant
        first = table[column[open_blocks, None] + np.arange(8, dtype=np.int16)]
        whole[open_blocks] = whole[open_blocks[:, None], first]
        open_blocks = open_blocks[(whole[open_blocks] != whole[open_blocks, :1]).any(axis=1)]
        if not len(open_blocks):
            break
    state = np.full(blocks, CLOSED, np.uint8)
    same = (whole == whole[:, :1]).all(axis=1)
    state[1:] = whole[:-1, 0]  # a block whose function is constant needs no state before it
    for i in np.flatnonzero(~same).tolist():
        if i + 1 < blocks:
            state[i + 1] = whole[i, state[i]]
    starts = np.empty((BLOCK, blocks), bool)
    flags = BEGINS.ravel()
    for j, column in enumerate(columns):
        at = column + state
        starts[j] = flags[at]
        state = table[at]
    return np.flatnonzero(starts.T.ravel()[:n])


def pretokens(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(UTF-8 bytes of the texts, where each slice starts and stops in them, how many slices belong to each text)."""
    whole = "\n".join(texts) + "\n"
    data, points = whole.encode(), np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    start = token_starts(symbols(points, ends))
    # Positions of separators among the starts split them by text.
    split = np.searchsorted(start, ends)
    counts = np.diff(np.concatenate(([-1], split))) - 1
    if len(data) > len(points):
        start = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[start]
    keep = np.ones(len(start), bool)
    keep[split] = False
    return data, start[keep], np.append(start[1:], len(data))[keep], counts


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Slices up to so many bytes are merged by scans of their pairs.
SHORT = 128


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [ranks.get(piece[i : i + 2], 1 << 30) for i in range(len(parts) - 1)]
    while pair:
        best = min(pair)
        if best == 1 << 30:
            break
        i = pair.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
    return [ranks[p] for p in parts]


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of lowest rank (the leftmost of equals) is merged until none is left.

    Of long slices, parts are a linked list by start and pairs a heap by (rank, start), where a pair is stale when its left part
    has another rank by then; up to SHORT bytes a scan of all pairs is faster than a heap.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= SHORT:
        return _merge_short(piece, ranks)
    end, back = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [ranks.get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]
    heap = [(rank, i) for i, rank in enumerate(pair) if rank >= 0]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        if pair[i] != rank:
            continue
        middle = end[i]
        stop = end[i] = end[middle]
        pair[middle] = -2  # swallowed
        pair[i] = -1
        if stop < n:
            back[stop] = i
            fresh = pair[i] = ranks.get(piece[i : end[stop]], -1)
            if fresh >= 0:
                heappush(heap, (fresh, i))
        left = back[i]
        if left >= 0:
            fresh = pair[left] = ranks.get(piece[left:stop], -1)
            if fresh >= 0:
                heappush(heap, (fresh, left))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Places:
    """Numbers from 1 on by 64-bit hashes, in open addressing; 0 stands for a free place.  Keys are compared by the caller."""

    def __init__(self, most: int):
        bits = (2 * most).bit_length()
        self.table, self.shift = np.zeros(1 << bits, np.int32), np.uint64(64 - bits)

    def home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64)

    def find(self, hashes: np.ndarray, equal: Callable[[np.ndarray, np.ndarray | slice], np.ndarray]) -> np.ndarray:
        """The number n at each i for which equal(n, i), else 0."""
        spot = self.home(hashes)
        found = self.table[spot]
        on = np.flatnonzero((found > 0) & ~equal(found, slice(None)))
        while len(on):
            spot[on] = (spot[on] + 1) & (len(self.table) - 1)
            found[on] = self.table[spot[on]]
            on = on[(found[on] > 0) & ~equal(found[on], on)]
        return found

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Numbers of keys that are not in the table and differ."""
        spot = self.home(hashes)
        while len(numbers):
            free = self.table[spot] == 0
            self.table[spot[free]] = numbers[free]  # of several for one place one gets it
            left = self.table[spot] != numbers
            spot, numbers = (spot[left] + 1) & (len(self.table) - 1), numbers[left]


def mixed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of two words (unsigned, 64 bits)."""
    out = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def highest_bit(x: np.ndarray) -> np.ndarray:
    """Its position, for integers from 1 to 2**24 - 1 (exact as floats); less than 0 for 0."""
    return (x.astype(np.float32).view(np.int32) >> 23) - 127


class Merger:
    """Pair merging of many slices at once, where a merged pair's rank is its id.

    Slices up to WIDE bytes are columns of a matrix: each round finds every column's first pair of lowest rank, puts the pair's
    id in its left place, and looks up the two pairs beside it; columns without a pair that merges leave.
    """

    WIDE, NONE = 24, 1 << 30

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        self.keys = np.append(-1, left << 32 | right)
        self.merged = np.append(self.NONE, merged).astype(np.int32)
        self.places = Places(len(self.keys))
        self.places.add(self.hashes(self.keys[1:]), np.arange(1, len(self.keys), dtype=np.int32))
        # Pairs of single bytes, the most of all look-ups, have a table of their own.
        self.byte_pairs = self.lookup(np.repeat(self.single, 256), np.tile(self.single, 256))

    @staticmethod
    def hashes(key: np.ndarray) -> np.ndarray:
        return mixed(key.view(np.uint64), np.uint64(0))

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of merged pairs, else NONE; an id of -1 is in no pair."""
        key = left.astype(np.int64) << 32 | right
        return self.merged[self.places.find(self.hashes(key), lambda n, i: self.keys[n] == key[i])]

    def merge(self, pieces: list[bytes], kind: str) -> list[bytes]:
        """Packed ids of each slice."""
        out: list[bytes] = [b""] * len(pieces)
        wide, size = [], np.dtype(kind).itemsize
        for i, rank in enumerate(map(self.ranks.get, pieces)):
            if rank is not None:
                out[i] = rank.to_bytes(size, "little")
            elif len(pieces[i]) > self.WIDE:
                out[i] = np.array(merge_pairs(pieces[i], self.ranks), kind).tobytes()
            else:
                wide.append(i)
        raw = np.frombuffer(b"".join(pieces[i].ljust(self.WIDE, b"\0") for i in wide), np.uint8).reshape(len(wide), self.WIDE)
        ids, counts = self.rows(raw, np.array([len(pieces[i]) for i in wide], np.int64))
        data, ends = ids.astype(kind).tobytes(), (np.cumsum(counts) * size).tolist()
        for i, a, b in zip(wide, [0, *ends], ends):
            out[i] = data[a:b]
        return out

    def rows(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slices in order, how many each has).  A row of raw holds the bytes of a slice, WIDE at most, and any others."""
        out = np.full(raw.shape, -1, np.int32)
        order = np.argsort(lengths, kind="stable")
        for start in range(0, len(order), 1 << 14):
            self._merge_rows(raw, lengths, order[start : start + (1 << 14)], out)
        known = out >= 0
        return out[known], known.sum(axis=1)

    def _merge_rows(self, raw: np.ndarray, lengths: np.ndarray, part: np.ndarray, out: np.ndarray) -> None:
        """Ids of the rows in `part`, in order of length, into `out`; places that were merged away stay -1."""
        width, none = int(lengths[part[-1]]), self.NONE
        text, length = raw[part, :width].T.astype(np.int32), lengths[part].astype(np.int32)
        place = np.arange(width, dtype=np.int32)[:, None]
        # One place more, without an id, stands for what is before the first and behind the last.
        ids, rank = np.full((width + 1, len(part)), -1, np.int32), np.full((width + 1, len(part)), none, np.int32)
        ids[:-1] = np.where(place < length, self.single[text], -1)
        pair = self.byte_pairs[text[:-1] << 8 | text[1:]]
        rank[:-2] = np.where((place[1:] < length) & (pair < none), pair << 5 | place[:-1], none)  # the lowest is the first of its rank
        alive = (1 << length) - 1  # a bit for each place with an id

        def behind(at: np.ndarray) -> np.ndarray:
            rest = alive >> (at + 1)
            return np.where(rest == 0, width, at + 1 + highest_bit(rest & -rest))

        def ranked(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
            found = self.lookup(left, right)
            return np.where(found < none, found << 5 | at, none)

        while len(part):
            best = rank[:-1].min(axis=0)
            go = best < none
            if not go.all():
                over = np.flatnonzero(~go)
                out[part[over], :width] = ids[:-1, over].T
                go = np.flatnonzero(go)
                ids, rank, part, alive, best = ids[:, go], rank[:, go], part[go], alive[go], best[go]
            row, at, new = np.arange(len(part)), best & 31, best >> 5
            right = behind(at)
            after, before = behind(right), highest_bit(alive & ((1 << at) - 1))
            before = np.where(before < 0, width, before)
            alive ^= 1 << right
            ids[at, row], ids[right, row], rank[right, row] = new, -1, none
            rank[at, row] = ranked(new, ids[after, row], at)
            rank[before, row] = ranked(ids[before, row], new, before)


#: Slices up to so many bytes are two words, with the length in the last byte: an exact key.
KEYED = 15
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def slice_keys(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two words of each slice of up to KEYED bytes, from the text as words of 8 bytes with two words or more behind it."""
    word, shift = start >> 3, ((start & 7) << 3).astype(np.uint64)
    first, second, third = words[word], words[word + 1], words[word + 2]
    back, one = np.uint64(63) - shift, np.uint64(1)
    low = (first >> shift | second << one << back) & MASKS[np.minimum(length, 8)]
    high = (second >> shift | third << one << back) & MASKS[np.maximum(length - 8, 0)]
    return low, high | length.astype(np.uint64) << np.uint64(56)


def as_words(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(24 + -len(data) % 8), "<u8")


class PieceCache(dict):
    """A memo from slices to ids; what it lacks is merged together.

    Slices up to KEYED bytes are looked up together, by their exact keys, in arrays of `most` entries, where the merger's whole
    tokens always are.  Longer ones are entries of the dict, `most` too, none of over LONGEST characters.
    """

    LONGEST, TOGETHER = 256, 1 << 18

    def __init__(self, merger, kind: str, most: int = 800_000):  # noqa: ANN001
        super().__init__()
        self.merger, self.kind, self.most = merger, kind, most
        tokens = [(b"", -1), *((t, i) for t, i in merger.ranks.items() if len(t) <= KEYED)]
        length = np.array([len(t) for t, _ in tokens])
        self.whole = *slice_keys(as_words(b"".join(t for t, _ in tokens)), np.cumsum(length) - length, length), np.array([i for _, i in tokens[1:]], kind)
        self.most_keys = max(most, 2 * len(tokens))
        self.places = Places(self.most_keys)
        # Two words of the key, and the place of the ids with their number in the last 16 bits; entry 0 is no slice's.
        self.entries, self.ids = np.zeros((self.most_keys + 1, 3), np.uint64), np.zeros(1 << 16, kind)
        self.forget()

    def forget(self) -> None:
        """Back to the whole tokens, and the empty slice."""
        low, high, ids = self.whole
        self.places.table[:] = 0
        self.held = self.used = 0
        self.put(ids)
        self.note(low, high, np.maximum(np.arange(len(low)) - 1, 0), np.minimum(np.arange(len(low)), 1))

    def put(self, ids: np.ndarray) -> int:
        """Where the ids are laid."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(2 * self.used - at, self.kind)])
        self.ids[at : self.used] = ids
        return at

    def note(self, low: np.ndarray, high: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        numbers = np.arange(self.held + 1, self.held + 1 + len(low), dtype=np.int32)
        self.entries[numbers] = np.stack([low, high, (at << 16 | count).astype(np.uint64)], axis=1)
        self.places.add(mixed(low, high), numbers)
        self.held += len(low)

    def packed(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of slices, by the dict."""
        found = list(map(self.get, pieces))
        if None in found:
            lacking = [i for i, x in enumerate(found) if x is None]
            new = list({pieces[i]: None for i in lacking})
            made = dict(zip(new, self.merger.merge([p.encode() for p in new], self.kind)))
            for i in lacking:
                found[i] = made[pieces[i]]
            if len(self) + len(made) > self.most:
                self.clear()
            self.update({p: ids for p, ids in made.items() if len(p) <= self.LONGEST})
        return found

    def encode(self, data: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slices of the text in order, how many each has)."""
        words, size = as_words(data), self.TOGETHER
        blocks = [self._encode(data, words, start[i : i + size], stop[i : i + size]) for i in range(0, len(start), size)]
        if not blocks:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        return np.concatenate([ids for ids, _ in blocks]), np.concatenate([count for _, count in blocks])

    def _encode(self, data: bytes, words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = stop - start
        long = np.flatnonzero(length > KEYED)
        length[long] = 0
        low, high = slice_keys(words, start, length)

        def equal(n: np.ndarray, i: np.ndarray | slice) -> np.ndarray:
            entry = self.entries[n]
            return (entry[:, 0] == low[i]) & (entry[:, 1] == high[i])

        found = self.places.find(mixed(low, high), equal)
        where = self.entries[found, 2].astype(np.int64)
        at, count = where >> 16, where & 0xFFFF
        lacking, new = np.flatnonzero(found == 0), None
        if len(lacking):
            lacking = lacking[np.lexsort((low[lacking], high[lacking]))]
            differs = np.ones(len(lacking), bool)
            differs[1:] = (np.diff(low[lacking]) != 0) | (np.diff(high[lacking]) != 0)
            first, same = lacking[differs], np.cumsum(differs) - 1
            raw = np.stack([low[first], high[first] & MASKS[7]], axis=1).astype("<u8").view(np.uint8)
            ids, many = self.merger.rows(raw, length[first])
            new = low[first], high[first], self.put(ids) + np.cumsum(many) - many, many
            at[lacking], count[lacking] = new[2][same], many[same]
        used = self.used
        if len(long):
            pieces = self.packed([data[a:b].decode() for a, b in zip(start[long].tolist(), stop[long].tolist())])
            many = np.array([len(p) for p in pieces]) // self.ids.itemsize
            at[long], count[long] = self.put(np.frombuffer(b"".join(pieces), self.kind)) + np.cumsum(many) - many, many
        before = np.cumsum(count) - count
        out = self.ids[np.repeat(at - before, count) + np.arange(count.sum())]
        self.used = used  # ids of long slices are the dict's
        if new is not None and self.held + len(new[0]) <= self.most_keys:
            self.note(*new)
        elif new is not None:
            self.ids = self.ids[: 1 << 16].copy()
            self.forget()
        return out, count


@lru_cache(4)
def merge_cache(path: str) -> PieceCache:
    merger = Merger(load_ranks(path))
    return PieceCache(merger, "<u2" if max(merger.ranks.values()) < 1 << 16 else "<u4")


def encode_pieces(texts: list[str], cache: PieceCache) -> Iterator[np.ndarray]:
    """Ids of each text, from a memo of each slice's ids."""
    if not texts:
        return
    data, start, stop, counts = pretokens(texts)
    ids, many = cache.encode(data, start, stop)
    ends = np.append(0, np.cumsum(many))[np.cumsum(counts)].tolist()
    for a, b in zip([0, *ends], ends):
        yield ids[a:b]


@lru_cache(2)
def id_bytes(path: str) -> tuple[list[bytes], np.ndarray]:
    """Bytes of each id, and their lengths."""
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table, np.array([len(t) for t in table], np.int64)


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    return b"".join(map(id_bytes(path)[0].__getitem__, ids.tolist()))


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, id_col: str, text_col: str) -> Iterator[tuple[list, list[np.ndarray], list[np.ndarray]]]:
    """(row ids, token ids, byte offset of each token and of the end) of each chunk."""
    cache, lengths = merge_cache(path), id_bytes(path)[1]
    for chunk in common.chunks(batches, text_col, 1 << 20):
        texts = [t or "" for t in chunk.column(chunk.schema.get_field_index(text_col)).to_pylist()]
        ids = list(encode_pieces(texts, cache))
        spans = [np.concatenate(([0], np.cumsum(lengths[x]))) for x in ids]
        yield chunk.column(chunk.schema.get_field_index(id_col)), ids, spans


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, byte_offsets): token ids and where each starts in the UTF-8 text, with the end as last offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, spans in encode_batches(batches, path, id_col, text_col):
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(spans, pa.list_(pa.int64()))], [id_col, "ids", "byte_offsets"]
            )

    rows = df.select(id_col, text_col)
    return common.map_arrow(rows, run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ids array<int>, byte_offsets array<bigint>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, data): the bytes of the ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if x is None else decode_ids(np.array(x, np.int64), path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [id_col, "data"])

    rows = df.select(id_col, ids_col)
    return common.map_arrow(rows, run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, data binary")


def digests(path: str, id_col: str = "doc_id", text_col: str = "text") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encodes, decodes from ids and offsets, and keeps digests only, within one Python pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = [str(i).encode() for i in range(len(id_bytes(path)[0]))]
        for rows, ids, spans in encode_batches(batches, path, id_col, text_col):
            counts, id_hash, text_hash = [], [], []
            for x, span in zip(ids, spans):
                listed = x.tolist()
                data = b"".join(map(id_bytes(path)[0].__getitem__, listed))
                if len(data) != span[-1]:
                    raise ValueError("token offsets and decoded bytes differ")
                counts.append(len(listed))
                id_hash.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, listed))).hexdigest())
                text_hash.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(counts, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return run


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return common.map_arrow(docs, digests(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
