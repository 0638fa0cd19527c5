"""LM scoring (operator 3): a hierarchical Pitman-Yor model, sampled by Gibbs, gives texts their log probability.

Restaurants: one for each context, where a context is 2**bits classes of the preceding token: its ending (last two bytes, 256
classes) and a hash of the word.  `context_bits` gives half a bit more for each doubling of the input, so that contexts grow with the
vocabulary (16,384 of them at 0.1 GB, 2**24 at 100 TB) and a frequent word has, nearly, a context of its own.  Contexts of one ending share a parent restaurant,
the parents share the root, and the root's base is uniform over the known words and one unknown.  A customer is a token; tables
of a restaurant are its parent's customers.

Seating is kept as the number of tables of each (context, word), (ending, word) and word.  A Gibbs step draws such a number from
its conditional given the others (module `seating`: the same distribution at every size).  Two simplifications: the parent's
probability doesn't change within one draw, and the contexts of a word are drawn in BLOCKS blocks, each given all others, one
block at once.  Predictive shares are averaged over samples, level by level; the averages of a context sum to one, too.

Everything about a word lies in the word's hash bucket.  Only the restaurants' totals are shared between buckets: arrays of 2**bits
numbers, summed anew in each round; each round's state is a table in the shared folder.  Documents are turned into rows of
counts for each chunk and bucket, so that copies and frequent words are summed before the shuffle.  In scoring, buckets with more
than their share of tokens (that of the end token, say) are dealt over salts, each with a copy of the bucket's model.  The
number of buckets follows the input.

Words are told apart by 64-bit hashes (XXH64).

Defined results: null and empty texts are their end token alone; repeated rows are scored (and learnt) each; with nothing to
learn from, every token has the uniform probability of the one unknown word; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, seating

PARENTS, BLOCKS, CHUNK, SLICE = 256, 4, 5 << 20, 1 << 14
END = b""


@dataclass(frozen=True)
class Settings:
    """Rounds of Gibbs sampling, sweeps within a round, and concentrations.

    The seatings after `burn_in` rounds and after each later one are the samples.
    """

    rounds: int = 4
    burn_in: int = 2
    sweeps: int = 2
    concentration: float = 1.0
    root_concentration: float = 1.0
    seed: int = 3


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so that sorted hashes are sorted by bucket."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def tokens_of(raws: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, context, text number) of all tokens; the first token follows an end."""
    digest = xxhash.xxh64_intdigest
    end = digest(END)
    parts, endings, sizes = [], [], np.empty(len(raws), np.int64)
    for i, raw in enumerate(raws):
        words = raw.lower().split()
        n = len(words)
        sizes[i] = n + 1
        h = np.empty(n + 1, np.uint64)
        h[:-1] = np.fromiter(map(digest, words), np.uint64, n)
        h[-1] = end
        parts.append(h)
        last = np.zeros(n + 1, np.int64)
        if n:
            data = np.frombuffer(b" " + b" ".join(words), np.uint8)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
            last[:-1] = data[ends].astype(np.int64) * 31 + data[ends - 1]
        endings.append(last)
    h, last = np.concatenate(parts), np.concatenate(endings)
    del parts, endings
    own = ((last * 0x9E3779B1) >> 13 & (PARENTS - 1)) << (bits - 8) | (h & np.uint64((1 << (bits - 8)) - 1)).astype(np.int64)
    before = np.empty(len(h), np.int64)
    before[0] = end & ((1 << (bits - 8)) - 1)
    before[1:] = own[:-1]
    return h, before, np.repeat(np.arange(len(raws)), sizes)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of equal runs."""
    start = np.concatenate(([0], np.flatnonzero(np.diff(sorted_keys)) + 1))
    return start, np.diff(np.append(start, len(sorted_keys)))


def _slices(where: np.ndarray) -> Iterator[tuple[int, int, int]]:
    start, size = _runs(where)
    for a, n in zip(start.tolist(), size.tolist()):
        yield int(where[a]), a, a + n


def _split(contexts: np.ndarray) -> tuple[bytes, bytes]:
    """Contexts as low 16 and high 8 bits."""
    return (contexts & 0xFFFF).astype("<u2").tobytes(), (contexts >> 16).astype(np.uint8).tobytes()


def _joined(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u2").astype(np.int64) | np.frombuffer(high, np.uint8).astype(np.int64) << 16


def _narrow(numbers: np.ndarray) -> bytes:
    most = int(numbers.max(initial=0))
    return numbers.astype(next(k for k in ("u1", "<u2", "<u4", "<u8") if most <= np.iinfo(k).max)).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    """The numbers that `_narrow` stored; none for an empty field."""
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if raw else np.zeros(0, np.int64)


def count_rows(raws: list[bytes], buckets: int, bits: int) -> Iterator[tuple]:
    """(bucket, words, sizes, low, high, counts): distinct hashes, contexts and counts of the pairs of a chunk."""
    h, before, _ = tokens_of(raws, bits)
    words, rank = np.unique(h, return_inverse=True)
    rank <<= bits
    rank |= before
    rank.sort()
    start, count = _runs(rank)
    keys = rank[start]
    del h, before, rank, start
    where = bucket_of(words, buckets)[keys >> bits]
    for b, a, z in _slices(where):
        own = keys[a:z] >> bits
        first, size = _runs(own)
        yield b, words[own[first]].tobytes(), size.astype("<u4").tobytes(), *_split(keys[a:z] & ((1 << bits) - 1)), count[a:z].astype("<u4").tobytes()


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for chunk in common.chunks(batches, column, CHUNK):
        for i in range(0, chunk.num_rows, 60_000):  # document numbers of a chunk fit 16 bits
            yield chunk.slice(i, 60_000)


def counts(training: DataFrame, buckets: int, bits: int, text_col: str) -> DataFrame:
    names = ["words", "sizes", "low", "high", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, text_col):
            columns = list(zip(*count_rows(common.raw_texts(chunk.column(0)), buckets, bits)))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", *names])

    return common.map_arrow(training.select(text_col), run, "bucket int, " + ", ".join(f"{n} binary" for n in names))


#: A bucket's model: distinct words and first pair of each (with the end); by pair context, customers and tables; by (ending, word)
#: and by word tables; then summed shares of seated customers by pair, (ending, word) and word.
FIELDS = ["words", "starts", "low", "high", "customers", "tables", "mid_tables", "root_tables", "seen", "mid_seen", "root_seen"]
#: Counts are stored in the narrowest of 1, 2, 4 and 8 bytes that holds a bucket's largest, and read by their length.
KINDS = {"words": "<u8", "low": "<u2", "high": "u1", "seen": "<f8", "mid_seen": "<f8", "root_seen": "<f8"}
MODEL = "bucket int, " + ", ".join(f"{n} binary" for n in FIELDS)


@dataclass
class Bucket:
    """One bucket's seating.  mids are the (ending, word) pairs: runs of the pairs, as contexts begin with the ending."""

    bits: int
    words: np.ndarray
    starts: np.ndarray
    contexts: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    mid_tables: np.ndarray
    root_tables: np.ndarray
    seen: np.ndarray
    mid_seen: np.ndarray
    root_seen: np.ndarray

    def __post_init__(self) -> None:
        self.owner = np.repeat(np.arange(len(self.words)), np.diff(self.starts))
        self.mid_first, size = _runs(self.owner << 8 | self.contexts >> (self.bits - 8))
        self.mid = np.repeat(np.arange(len(size)), size)
        self.mid_owner = self.owner[self.mid_first]
        self.mid_ending = self.contexts[self.mid_first] >> (self.bits - 8)

    @staticmethod
    def fresh(bits: int, words: np.ndarray, starts: np.ndarray, contexts: np.ndarray, customers: np.ndarray) -> Bucket:
        """Every pair with one table."""
        none = np.zeros(0)
        b = Bucket(bits, words, starts, contexts, customers, np.ones(len(customers), np.int64), none, np.ones(len(words), np.int64), none, none, none)
        b.mid_tables = np.ones(len(b.mid_first), np.int64)
        return b

    @staticmethod
    def read(bits: int, r: dict[str, bytes]) -> Bucket:
        """From a row's fields; without `words` they are numbers, without shares these are empty."""
        starts = np.frombuffer(r["starts"], "<u4").astype(np.int64)
        n, pairs = len(starts) - 1, int(starts[-1])
        contexts = _joined(r["low"], r["high"])
        mids = len(_runs(np.repeat(np.arange(n), np.diff(starts)) << 8 | contexts >> (bits - 8))[0])
        whole = {name: _wide(r.get(name, b""), size) for name, size in (("customers", pairs), ("tables", pairs), ("mid_tables", mids), ("root_tables", n))}
        shares = {name: np.frombuffer(r.get(name, b"")) for name in ("seen", "mid_seen", "root_seen")}
        return Bucket(bits, words=np.frombuffer(r["words"], "<u8") if "words" in r else np.arange(n, dtype=np.uint64), starts=starts, contexts=contexts, **whole, **shares)

    def row(self, number: int) -> pa.RecordBatch:
        low, high = _split(self.contexts)
        split = {"low": low, "high": high, "starts": self.starts.astype("<u4").tobytes()}
        data = [split[n] if n in split else getattr(self, n).astype(KINDS[n]).tobytes() if n in KINDS else _narrow(getattr(self, n)) for n in FIELDS]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], ["bucket", *FIELDS])

    def mid_customers(self) -> np.ndarray:
        return np.add.reduceat(self.tables, self.mid_first)

    def root_customers(self) -> np.ndarray:
        return np.bincount(self.mid_owner, self.mid_tables, len(self.words)).astype(np.int64)

    def explicit(self) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs and mids can have more than one customer; the others' shares follow from the totals."""
        many = self.customers > 1
        return many, np.add.reduceat(self.customers, self.mid_first) > 1


def merged(counted: DataFrame, buckets: int, bits: int) -> DataFrame:
    """The model's first state: one row for each bucket, each pair with one table."""

    def make(bucket: int, keys: np.ndarray, words: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        start, _ = _runs(keys)
        first = np.append(_runs(keys[start] >> bits)[0], len(start))
        return Bucket.fresh(bits, words, first, keys[start] & ((1 << bits) - 1), np.add.reduceat(number, start)).row(bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], 0

        def compact() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            words = np.unique(np.concatenate([w for w, *_ in parts]))
            keys = np.concatenate([np.repeat(np.searchsorted(words, w), s) << bits | c for w, s, c, _ in parts])
            number = np.concatenate([n for *_, n in parts])
            parts.clear()
            order = np.argsort(keys, kind="stable")
            return keys[order], words, number[order]

        for batch in batches:
            for bucket, *arrays in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if bucket != now:
                    if parts:
                        yield make(now, *compact())
                    now, parts, held = bucket, [], 0
                words, sizes, number = (np.frombuffer(arrays[i], k) for i, k in ((0, "<u8"), (1, "<u4"), (4, "<u4")))
                contexts = _joined(arrays[2], arrays[3])
                parts.append((words, sizes.astype(np.int64), contexts, number.astype(np.int64)))
                held += len(contexts)
                if held > 1_500_000:  # a bucket is never held with all its repeats
                    keys, words, number = compact()
                    start, _ = _runs(keys)
                    owner = keys[start] >> bits
                    parts = [(words, np.diff(np.append(_runs(owner)[0], len(owner))), keys[start] & ((1 << bits) - 1), np.add.reduceat(number, start))]
                    held = len(start) // 2
        if parts:
            yield make(now, *compact())

    return common.map_arrow(counted.repartition(buckets, "bucket").sortWithinPartitions("bucket"), run, MODEL)


@dataclass(frozen=True)
class Shared:
    """Totals of all restaurants at the start of a round, and the discounts of contexts, endings and root."""

    customers: np.ndarray
    tables: np.ndarray
    mid_tables: np.ndarray
    root_tables: int
    words: int
    discounts: tuple[float, float, float]

    @property
    def mid_customers(self) -> np.ndarray:
        return self.tables.reshape(PARENTS, -1).sum(axis=1)

    @property
    def root_customers(self) -> float:
        return float(self.mid_tables.sum())

    @staticmethod
    def of(total: np.ndarray, bits: int) -> Shared:
        n = 1 << bits
        rest = total[2 * n + PARENTS :]
        share = lambda a, b: min(0.9, max(0.05, a / (a + 2 * b))) if a + b else 0.5
        discounts = tuple(share(int(rest[i]), int(rest[i + 1])) for i in (2, 4, 6))
        return Shared(total[:n].astype(float), total[n : 2 * n].astype(float), total[2 * n : 2 * n + PARENTS].astype(float), int(rest[0]), int(rest[1]), discounts)

    def fresh(self, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """Share of new tables by context, and by ending."""
        a, b, _ = self.discounts
        return (s.concentration + a * self.tables) / (s.concentration + self.customers), (s.concentration + b * self.mid_tables) / (s.concentration + self.mid_customers)

    def unknown(self, s: Settings) -> float:
        """The root's probability of a word without customers."""
        return (s.root_concentration + self.discounts[2] * self.root_tables) / (self.words + 1) / (s.root_concentration + self.root_customers)


def totals_of(b: Bucket, total: np.ndarray) -> None:
    """Adds a bucket: customers and tables by context, tables by ending, root tables, words, and customers of one and two at each level."""
    n = 1 << b.bits
    total[:n] += np.bincount(b.contexts, b.customers, n).astype(np.int64)
    total[n : 2 * n] += np.bincount(b.contexts, b.tables, n).astype(np.int64)
    total[2 * n : 2 * n + PARENTS] += np.bincount(b.mid_ending, b.mid_tables, PARENTS).astype(np.int64)
    mid, root = b.mid_customers(), b.root_customers()
    total[2 * n + PARENTS :] += [b.root_tables.sum(), len(b.words), *((x == k).sum() for x in (b.customers, mid, root) for k in (1, 2))]


def sum_totals(state: DataFrame, bits: int) -> np.ndarray:
    """The buckets' totals, summed on the executors slice by slice: 2 * 2**bits + PARENTS + 8 numbers come to the driver."""
    size = 2 * (1 << bits) + PARENTS + 8

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                totals_of(Bucket.read(bits, {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}), total)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(-(-size // SLICE)), pa.int32()), pa.array([total[i : i + SLICE].tobytes() for i in range(0, size, SLICE)], pa.binary())], ["slice", "numbers"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(numbers, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "numbers"])

    kind = "slice int, numbers binary"
    rows = common.map_arrow(common.map_arrow(state.select(*FIELDS[1:8]), add, kind).repartition("slice"), merge, kind).collect()
    total = np.zeros(size, np.int64)
    for r in rows:
        total[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["numbers"], np.int64)
    return total


def sweep(b: Bucket, shared: Shared, s: Settings, draw: np.random.Generator) -> None:
    """`sweeps` Gibbs sweeps over a bucket given the other buckets' totals."""
    n = 1 << b.bits
    leaf, middle, top = shared.discounts
    stirling = [seating.log_stirling(d) for d in shared.discounts]
    others = shared.tables - np.bincount(b.contexts, b.tables, n)
    others_mid = shared.mid_tables - np.bincount(b.mid_ending, b.mid_tables, PARENTS)
    others_root = shared.root_tables - b.root_tables.sum()
    free = b.customers > 1  # one customer has one table
    blocks = [np.flatnonzero(free & (b.contexts % BLOCKS == k)) for k in range(BLOCKS)]
    for _ in range(s.sweeps):
        for own in blocks:
            if not len(own):
                continue
            tables = others + np.bincount(b.contexts, b.tables, n)
            by_ending = tables.reshape(PARENTS, -1).sum(axis=1)
            mid_totals = others_mid + np.bincount(b.mid_ending, b.mid_tables, PARENTS)
            mid, root = b.mid_customers()[b.mid[own]], b.root_customers()[b.owner[own]]
            mid_tables, root_tables = b.mid_tables[b.mid[own]], b.root_tables[b.owner[own]]
            # Without this pair's tables: a parent they alone feed has no tables, nor the root those.
            rest = mid - b.tables[own]
            root = root - np.where(rest > 0, 0, mid_tables)
            mid_tables, root_tables = np.minimum(mid_tables, rest), np.minimum(root_tables, root)
            base = (s.root_concentration + top * (others_root + b.root_tables.sum())) / (shared.words + 1)
            at_root = (root - top * root_tables + base) / (s.root_concentration + mid_totals.sum())
            ending, context = b.contexts[own] >> (b.bits - 8), b.contexts[own]
            room = s.concentration + np.maximum(by_ending[ending] - b.tables[own], 0)
            parent = (rest - middle * mid_tables + (s.concentration + middle * mid_totals[ending]) * at_root) / room
            log_new = np.log((s.concentration + leaf * (tables[context] - b.tables[own])) * parent)
            b.tables[own] = seating.draw_tables(b.customers[own], b.tables[own], log_new, leaf, stirling[0], draw)
        mid = b.mid_customers()
        for k in range(BLOCKS):
            own = np.flatnonzero(b.mid_ending % BLOCKS == k)
            if not len(own):
                continue
            mid_totals = others_mid + np.bincount(b.mid_ending, b.mid_tables, PARENTS)
            root = b.root_customers()[b.mid_owner[own]] - b.mid_tables[own]
            root_tables = np.minimum(b.root_tables[b.mid_owner[own]], root)
            base = (s.root_concentration + top * (others_root + b.root_tables.sum())) / (shared.words + 1)
            at_root = (root - top * root_tables + base) / (s.root_concentration + np.maximum(mid_totals.sum() - b.mid_tables[own], 0))
            log_new = np.log((s.concentration + middle * (mid_totals[b.mid_ending[own]] - b.mid_tables[own])) * at_root)
            b.mid_tables[own] = seating.draw_tables(mid[own], np.minimum(b.mid_tables[own], mid[own]), log_new, middle, stirling[1], draw)
        root = b.root_customers()
        base = (s.root_concentration + top * (others_root + b.root_tables.sum() - b.root_tables)) / (shared.words + 1)
        b.root_tables = seating.draw_tables(root, np.minimum(b.root_tables, root), np.log(base), top, stirling[2], draw)


def add_sample(b: Bucket, shared: Shared, s: Settings) -> None:
    """Adds the seating's shares of seated customers, under the totals of all buckets' same seating, for what can vary."""
    leaf, middle, top = shared.discounts
    pairs, mids = b.explicit()
    seen = (b.customers - leaf * b.tables)[pairs] / (s.concentration + shared.customers[b.contexts[pairs]])
    mid = (b.mid_customers() - middle * b.mid_tables)[mids] / (s.concentration + shared.mid_customers[b.mid_ending[mids]])
    root = (b.root_customers() - top * b.root_tables) / (s.root_concentration + shared.root_customers)
    b.seen, b.mid_seen, b.root_seen = (new + (old if len(old) else 0.0) for new, old in ((seen, b.seen), (mid, b.mid_seen), (root, b.root_seen)))


def gibbs_round(state: DataFrame, shared: Shared, s: Settings, number: int, bits: int) -> DataFrame:
    """Adds the state's sample from the burn-in on, then sweeps (the last round doesn't)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                b = Bucket.read(bits, r)
                if number >= s.burn_in:
                    add_sample(b, shared, s)
                if number < s.rounds:
                    sweep(b, shared, s, np.random.default_rng([s.seed, number, r["bucket"]]))
                yield b.row(r["bucket"])

    return common.map_arrow(state, run, MODEL)


@dataclass(frozen=True)
class Trained:
    """The sampled model: its buckets' table, and what all buckets share."""

    state: DataFrame
    buckets: int
    bits: int
    samples: int
    tokens: int
    words: int
    concentration: float
    #: Means over samples: share of new tables by context and by ending, the root's probability of a word without customers, what
    #: one customer alone at its table has of its context's and of its ending's share.
    fresh: np.ndarray
    mid_fresh: np.ndarray
    unknown: float
    alone: np.ndarray
    mid_alone: np.ndarray

    def shares(self, b: Bucket) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean share of seated customers of each pair, mid and word (the latter with the base's part)."""
        pairs, mids = b.explicit()
        seen, mid = self.alone[b.contexts], self.mid_alone[b.mid_ending]
        seen[pairs], mid[mids] = b.seen / self.samples, b.mid_seen / self.samples
        return seen, mid, b.root_seen / self.samples + self.unknown


def train(training: DataFrame, buckets: int, bits: int = 14, text_col: str = "text", s: Settings = Settings()) -> Trained:
    now = common.Stage(merged(counts(training, buckets, bits, text_col), buckets, bits), "seating")
    total = sum_totals(now.read(), bits)
    n = 1 << bits
    tokens, words = int(total[:n].sum()), int(total[2 * n + PARENTS + 1])
    samples: list[tuple] = []
    for number in range(s.rounds + 1):
        shared = Shared.of(total, bits)
        if number >= s.burn_in:
            alone, mid_alone = ((1 - d) / (s.concentration + c) for d, c in zip(shared.discounts, (shared.customers, shared.mid_customers)))
            samples.append((*shared.fresh(s), shared.unknown(s), alone, mid_alone))
        after = common.Stage(gibbs_round(now.read(), shared, s, number, bits), "seating")
        now.drop()
        now = after
        if number < s.rounds:
            total = sum_totals(now.read(), bits)
    return Trained(now.read(), buckets, bits, len(samples), tokens, words, s.concentration, *(sum(x) / len(samples) for x in zip(*samples)))


def salts_of(model: Trained) -> dict[int, int]:
    """How many salts a bucket's requests are dealt over, where more than one: its tokens over twice the mean of buckets."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(_wide(x, len(y) // 2).sum()) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["bucket", "n"])

    mean = max(1, model.tokens // model.buckets)
    heavy = common.map_arrow(model.state.select("bucket", "customers", "low"), weigh, "bucket int, n bigint").where(F.col("n") > 2 * mean)
    return {r["bucket"]: -(-r["n"] // mean) for r in heavy.collect()}  # fewer than half the buckets


def requests(docs: DataFrame, buckets: int, bits: int, salts: dict[int, int]) -> DataFrame:
    """Rows for each chunk and bucket from (row, id, text): the pairs, how many documents have each, which documents of the chunk, and how often.

    `first` is the row number of the chunk's first document; ids travel with the end token, which every document has once.
    """
    names = ["words", "sizes", "low", "high", "entries", "docs", "numbers", "ids"]
    end = int(bucket_of(np.array([xxhash.xxh64_intdigest(END)], np.uint64), buckets)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for chunk in _chunks(batches, "text"):
            row = chunk.column(0).to_numpy(zero_copy_only=False)
            if row[-1] - row[0] != len(row) - 1:
                raise ValueError("rows of a chunk must be numbered one after another")
            missing = chunk.column(1).is_null().to_numpy(zero_copy_only=False)
            ids = chunk.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + missing.astype(np.uint8).tobytes()
            h, before, doc = tokens_of(common.raw_texts(chunk.column(2)), bits)
            words, rank = np.unique(h, return_inverse=True)
            rank <<= bits
            rank |= before
            rank <<= 16
            rank |= doc
            rank.sort()
            start, count = _runs(rank)
            keys = rank[start]
            del h, before, doc, rank, start
            out: list[tuple] = []
            for b, a, z in _slices(bucket_of(words, buckets)[keys >> (bits + 16)]):
                pair = keys[a:z] >> 16
                first_pair, entries = _runs(pair)
                own = pair[first_pair] >> bits
                first, size = _runs(own)
                out.append(
                    (b, (int(row[0]) + turn) % salts.get(b, 1), int(row[0]), words[own[first]].tobytes(), size.astype("<u4").tobytes(), *_split(pair[first_pair] & ((1 << bits) - 1)),
                     entries.astype("<u4").tobytes(), (keys[a:z] & 0xFFFF).astype("<u2").tobytes(), count[a:z].astype("<u4").tobytes(), ids if b == end else None)
                )
            turn += 1
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[3:])], ["bucket", "salt", "first", *names])

    return common.map_arrow(docs, run, "bucket int, salt int, first bigint, " + ", ".join(f"{n} binary" for n in names))


class Answers:
    """A bucket's predictive shares, ready for requests."""

    def __init__(self, model: Trained, b: Bucket | None):
        self.model, self.b = model, b
        if b is not None:
            self.seen, self.mid_seen, self.root = model.shares(b)
            self.count = np.add.reduceat(b.customers, b.starts[:-1]).astype(np.float64)
            self.pairs = b.owner << model.bits | b.contexts
            self.mids = b.mid_owner << 8 | b.mid_ending

    def chances(self, words: np.ndarray, owner: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count of each word, probability of each pair)."""
        m = self.model
        if not m.tokens:
            return np.zeros(len(words)), np.full(len(contexts), 1 / (m.words + 1))
        endings = contexts >> (m.bits - 8)
        count, root = np.zeros(len(words)), np.full(len(words), m.unknown)
        seen, mid = np.zeros(len(contexts)), np.zeros(len(contexts))
        if self.b is not None:
            known = self.b.words
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            there = known[at] == words
            count[there], root[there] = self.count[at[there]], self.root[at[there]]
            for keys, held, asked, into in ((self.pairs, self.seen, at[owner] << m.bits | contexts, seen), (self.mids, self.mid_seen, at[owner] << 8 | endings, mid)):
                place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                hit = there[owner] & (keys[place] == asked)
                into[hit] = held[place[hit]]
        return count, seen + m.fresh[contexts] * (mid + m.mid_fresh[endings] * root[owner])

    def answer(self, r: dict) -> pa.RecordBatch:
        words = np.frombuffer(r["words"], "<u8")
        sizes, entries = np.frombuffer(r["sizes"], "<u4").astype(np.int64), np.frombuffer(r["entries"], "<u4").astype(np.int64)
        doc, number = np.frombuffer(r["docs"], "<u2").astype(np.int64), np.frombuffer(r["numbers"], "<u4").astype(np.float64)
        owner = np.repeat(np.arange(len(words)), sizes)
        count, chance = self.chances(words, owner, _joined(r["low"], r["high"]))
        base = np.log10((count + 0.5) / (self.model.tokens + 0.5 * (self.model.words + 1)))[owner]
        spread = lambda x: np.bincount(doc, np.repeat(x, entries) * number)
        tokens = np.bincount(doc, number).astype(np.int64)
        columns = [tokens, spread((count[owner] > 0).astype(float)).astype(np.int64), spread(base), spread(np.log10(chance))]
        present = np.flatnonzero(tokens)
        ids = pa.nulls(len(present), pa.int64())
        if r["ids"] is not None:
            n = len(r["ids"]) // 9
            ids = pa.array(np.frombuffer(r["ids"], "<i8", n)[present], mask=np.frombuffer(r["ids"], np.uint8, n, 8 * n)[present] > 0)
        return pa.RecordBatch.from_arrays([pa.array(r["first"] + present), ids, *(pa.array(c[present]) for c in columns)], ["row", "id", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: Trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) for each row, scores being log10 probabilities.

    Each bucket's model row comes before the requests for it, which are answered one after another.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), common.text_or_empty(text_col).alias("text"))
    salts = salts_of(model)
    asked = requests(rows, model.buckets, model.bits, salts)
    names = [*FIELDS, "sizes", "entries", "docs", "numbers", "ids"]
    of_model = ["words", "starts", "low", "high", "customers", "seen", "mid_seen", "root_seen"]
    of_request = ["words", "low", "high", "sizes", "entries", "docs", "numbers", "ids"]
    blank = F.lit(None).cast("binary")
    copies = F.create_map(*(F.lit(x) for item in salts.items() for x in item)) if salts else None
    n_salts = F.coalesce(F.try_element_at(copies, F.col("bucket")), F.lit(1)) if salts else F.lit(1)
    learnt = model.state.select("bucket", F.explode(F.sequence(F.lit(0), n_salts - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("first"), *(F.col(n) if n in of_model else blank.alias(n) for n in names))
    asked = asked.select("bucket", "salt", F.lit(1).alias("kind"), "first", *(F.col(n) if n in of_request else blank.alias(n) for n in names))
    dealt = learnt.union(asked).repartition(model.buckets + sum(salts.values()), "bucket", "salt").sortWithinPartitions("bucket", "salt", "kind")
    shared = Trained(**{**model.__dict__, "state": None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = Answers(shared, None), None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                if r["kind"] == 0:
                    known, of = Answers(shared, Bucket.read(shared.bits, {n: r[n] for n in of_model})), r["bucket"]
                else:
                    if of != r["bucket"]:
                        known, of = Answers(shared, None), r["bucket"]
                    yield known.answer(r)

    parts = common.map_arrow(dealt, run, "row bigint, id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    whole = parts.groupBy("row").agg(F.max("id").alias("id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    id_kind = docs.schema[id_col].dataType
    return whole.select(F.col("id").cast(id_kind).alias(id_col), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def bucket_count(df: DataFrame) -> int:
    """Buckets of about 16 MB of input; more of them while the input is small."""
    units = common.input_partitions(df, 8 << 20)
    return int(max(4, 16 * units**0.5, units / 2))


def context_bits(df: DataFrame) -> int:
    """12 bits and half a bit for each doubling of the input beyond 8 MB, 24 at most (that is beyond 100 TB)."""
    return int(min(24, 12 + np.ceil(0.5 * np.log2(common.input_partitions(df, 8 << 20)))))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    training = docs.where(~held_out()).select(common.text_or_empty().alias("text"))
    model = train(training, bucket_count(docs), context_bits(docs))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
