"""Near copies of the pipeline by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprint: each of BITS bits is the majority over the bits of the text's distinct shingles.  Two texts differ in a bit with
probability arccos(cosine) / pi, 0.152 at a similarity of 0.8; 64 bits with the radius of 4 of `simhash` would miss nearly all such
pairs, and one that reaches 0.8, about 16, would take 131,071 covering masks.  So the fingerprint is wider and meets in tables: its bits are
permuted and cut into blocks of `width` bits, each block is a table's bucket, and a pair meets where it agrees in a block.  The
width follows the number of fingerprints (about MEMBERS to a bucket); the number of tables follows from the width, so that a pair
at 0.8 meets in none with probability MISS at most.  Pairs of a bucket are near when they differ in at most 51 of the first 192 bits
and 24 of the first 64 (`radii`, for 0.8), which fails there with a probability of about 0.00001.  These are the figures of the usual model, which
sets of some ten shingles miss by ties of their majorities.

Links: near fingerprints make classes by components; within a class a search from each found neighbour over the shingle sets
themselves, so that every link is a pair of at least the asked similarity.

Texts with the same words are one entry; sets travel only where a class has two members or more.  Shingles are told apart by 32 bits
of their XXH64.

No task holds a bucket or a class of any size.  A table's bucket of more than about CELL members is compared in cells of two parts each.  A
class of more than BLOCK members (or HELD numbers in its sets) is dealt into blocks twice, in
two independent ways, and searched block by block.  What that leaves unconnected is compared across blocks: every member outside
the bucket's largest class against every member of another class, in cells of one block each.  So no link is lost.  Those cells
are as many as the members outside the largest class times the members, over the square of a block.

Defined results: words are lower-cased and split at white space; a text of fewer words than the width is one shingle; null and
empty texts are alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, simhash

SEED, WIDTH, LEAST, BITS = 42, 5, 0.8, 512
#: Fingerprints of a bucket (about), chance of a pair at LEAST to share no table, members of a part of a large bucket.
MEMBERS, MISS, CELL = 1024, 0.0002, 4096
#: Members, and numbers in their sets, of a block (about: members are dealt by a hash); a cell's sides hold ACROSS blocks each.
BLOCK, HELD, ACROSS = 512, 4 << 20, 4
_DRAW = np.random.default_rng(SEED)
_TIMES = _DRAW.integers(0, 1 << 63, BITS // 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 63, BITS // 64, dtype=np.uint64)


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes, 32 bits each, sorted."""
    joined = b" ".join(words)
    n = len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED) >> 32], np.uint32)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - width] + 1)).tolist()
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, n - width + 1)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def fingerprint(own: np.ndarray) -> bytes:
    """BITS majority bits of a set of shingles."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(own), 255):  # as many as a byte counts
        h = own[i : i + 255, None].astype(np.uint64) * _TIMES + _PLUS
        for right, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(right))) * np.uint64(times)
        h ^= h >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(own), bitorder="little").tobytes()


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, key, fp, node, shingles) for each row; key is a hash of the text's words, node the first word of fp."""

    def make(chunk: pa.RecordBatch) -> pa.RecordBatch:
        keys, prints, nodes, sets = [], [], [], []
        for raw in common.raw_texts(chunk.column(1)):
            words = raw.lower().split()
            own = shingles(words)
            keys.append(xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63))
            prints.append(fingerprint(own))
            nodes.append(int.from_bytes(prints[-1][:8], "little", signed=True))
            sets.append(own.tobytes())
        return pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(2), pa.array(keys, pa.int64()), pa.array(prints, pa.binary()), pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["id", "text_key", "key", "fp", "node", "shingles"])

    rows = df.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("text"), common.text_key(F.col(text_col)).alias("text_key"))
    return common.map_chunks(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, text_key bigint, key bigint, fp binary, node bigint, shingles binary")


def differing(least: float) -> float:
    """Chance of a bit to differ at this similarity, for sets of one size (less for others)."""
    return math.acos(2 * least / (1 + least)) / math.pi


def radii(least: float) -> tuple[int, int]:
    """Bits that near fingerprints may differ in, of the first 64 and of the first 192: the mean and 5.3, 4.6 deviations."""
    p = differing(least)
    return tuple(int(n * p + times * math.sqrt(n * p * (1 - p))) for n, times in ((64, 5.3), (192, 4.6)))


@lru_cache(64)
def tables(width: int, least: float = LEAST) -> int:
    """How many blocks of so many bits a pair of the least similarity shares none of with probability MISS at most."""
    if not width:
        return 1
    log = np.array([math.lgamma(i + 1) for i in range(BITS + 1)])
    differs = max(differing(least), 1e-9)
    gap = np.arange(BITS - width + 1)  # of wider gaps no block is free
    chance = np.exp(log[BITS] - log[gap] - log[BITS - gap] + gap * math.log(differs) + (BITS - gap) * math.log(1 - differs))
    free = np.exp(log[BITS - gap] - log[BITS - gap - width] - log[BITS] + log[BITS - width])
    count = 1
    while 1 - chance.sum() + (chance * (1 - free) ** count).sum() > MISS:
        count += 1
    return count


@lru_cache(64)
def blocks_of_bits(width: int, least: float = LEAST) -> np.ndarray:
    """The bits of each table: disjoint blocks of one permutation after another."""
    draw, each = np.random.default_rng(SEED + 1), BITS // max(width, 1)
    count = tables(width, least)
    return np.concatenate([draw.permutation(BITS)[: each * width].reshape(each, width) for _ in range(-(-count // each))])[:count]


def buckets(points: DataFrame, width: int, least: float) -> DataFrame:
    """(bucket, a, b, c): each fingerprint's first 192 bits in its bucket of each table, from points (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = blocks_of_bits(width, least)
        count = len(chosen)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                raw = np.frombuffer(b"".join(batch.column(0).slice(i, 1000).to_pylist()), np.uint8).reshape(-1, BITS // 8)
                n = len(raw)
                value = np.zeros((n, count, 32), np.uint8)
                value[:, :, :width] = np.unpackbits(raw, axis=1, bitorder="little")[:, chosen]
                value = np.packbits(value.reshape(n, -1), axis=1, bitorder="little").view("<u4").astype(np.int64)
                value |= np.arange(count) << 32
                words = (np.repeat(w, count) for w in raw.view("<i8")[:, :3].T)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (value.ravel(), *words)], ["bucket", "a", "b", "c"])

    return common.map_arrow(points.select("fp"), run, "bucket bigint, a bigint, b bigint, c bigint")


def near_points(points: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges between first words of points (n, 3) that connect what nearness connects.

    Some seeds at a time are compared with the rest; what is found waits, and is compared with the rest and with what waits of
    other labels: points of one label are connected already.
    """
    early, radius = radii(least)
    left, right = [], []
    first, label = np.ascontiguousarray(points[:, 0]), np.arange(len(points))
    rest, waiting = np.arange(len(points)), np.zeros(0, np.int64)
    while len(rest) or len(waiting):
        fresh = not len(waiting)
        if fresh:
            now, others = rest[:64], rest
        elif len(waiting) <= 512:
            now, others = waiting[:64], np.concatenate((rest, waiting))
            waiting = waiting[64:]
        else:
            own = label[waiting] == label[waiting[0]]
            now, others = waiting[own][:64], np.concatenate((rest, waiting[~own]))
            waiting = np.concatenate((waiting[own][64:], waiting[~own]))
        i, j = np.nonzero(np.bitwise_count(first[now][:, None] ^ first[others]) <= early)
        x, y = now[i], others[j]
        near = np.bitwise_count(points[x] ^ points[y]).sum(axis=1, dtype=np.int64) <= radius
        x, y = x[near], y[near]
        left.append(first[x])
        right.append(first[y])
        found = np.zeros(len(points), bool)
        found[y] = True
        if fresh:
            rest = rest[len(now) :]
            np.minimum.at(label, y, label[x])
        free = np.zeros(len(points), bool)
        free[rest] = True
        label[y[free[y]]] = label[x[free[y]]]
        taken = found[rest]
        waiting, rest = np.concatenate((waiting, rest[taken])), rest[~taken]
    return (np.concatenate(left), np.concatenate(right)) if left else (first, first)


def bucket_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Spanning links of first words from rows (bucket, cell, a, b, c) sorted by bucket and cell, which may go over many batches."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    carry: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def search() -> None:
        nonlocal held
        points = np.concatenate([c[1] for c in carry])
        a, b = simhash.spanning(*near_points(points, least))
        if len(a):
            found.append((a, b))
            held += len(a)
        carry.clear()

    def emit() -> pa.RecordBatch:
        nonlocal held
        a, b = simhash.spanning(*(np.concatenate(x) for x in zip(*found)))
        found.clear()
        held = 0
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)], axis=1)
        points = np.stack([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (2, 3, 4)], axis=1)
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
        for start, stop in zip(cuts, cuts[1:]):
            if carry and (carry[-1][0] != names[start]).any():
                search()
            carry.append((names[start], points[start:stop].copy()))
        if held > 300_000:
            yield emit()
    if carry:
        search()
    if found:
        yield emit()


def near_classes(points: DataFrame, least: float, members: int = MEMBERS, cell: int = CELL) -> DataFrame:
    """(node, root) of the first words of fingerprints that nearness connects, from points (fp)."""
    count = points.count()
    width = max(0, round(math.log2(count / members))) if count else 0
    rows = buckets(points, width, least).withColumn("cell", F.lit(0).cast("bigint"))
    if count > cell:
        # Sizes only balance the work, so that a sample of the fingerprints gives them.
        share = min(16, max(1, cell // 256))
        some = points.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0)
        large = buckets(some, width, least).groupBy("bucket").agg((F.count("*") * share).alias("n")).where(F.col("n") > cell)
        large = common.staged(large.select("bucket", F.ceil(F.col("n") / cell).cast("bigint").alias("parts")), "large")
        if large.limit(1).count():
            part, other = F.pmod(F.xxhash64("a", "b", "c"), F.col("parts")), F.col("other")
            dealt = rows.drop("cell").join(F.broadcast(large), "bucket").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
            dealt = dealt.withColumn("cell", F.least(part, other) * F.col("parts") + F.greatest(part, other) + 1)
            rows = rows.join(F.broadcast(large.select("bucket")), "bucket", "left_anti").unionByName(dealt.select("bucket", "a", "b", "c", "cell"))
    dealt = rows.select("bucket", "cell", "a", "b", "c").repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
    return simhash.components(common.map_arrow(dealt, lambda batches: bucket_links(batches, least), "a bigint, b bigint"))


def shared_buckets(groups: DataFrame, stars: DataFrame, block: int) -> DataFrame:
    """(bucket, key, row, blocks) of near classes with two keys or more, from groups (key, row, node, size) and stars (node, root)."""
    nodes = groups.groupBy("node").agg(F.count("*").alias("n"))
    nodes = nodes.join(stars, "node", "left").select("node", "n", F.coalesce("root", "node").alias("bucket"))
    total = groups.count()
    rows = common.staged(common.skew_join(groups.select("node", "key", "row", "size"), nodes, "node", rows=total), "members")
    several = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("numbers")).where("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("numbers") / HELD)).cast("int")
    return common.skew_join(rows, several.select("bucket", "n", blocks.alias("blocks")), "bucket", rows=total).select("bucket", "key", "row", "blocks")


def forest(keys: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of at least the similarity."""
    sizes = np.array([len(x) for x in sets])
    rest = np.arange(len(sets))
    edges = []
    values = np.concatenate(sets)
    while len(rest) > 1:
        frontier, rest, values = [rest[0]], rest[1:], values[sizes[rest[0]] :]
        while frontier and len(rest):
            x = frontier.pop()
            near = alike(sets[x], sizes[rest], values, least)
            if near.any():
                edges += [(keys[x], keys[y]) for y in rest[near].tolist()]
                frontier.extend(rest[near].tolist())
                values = values[np.repeat(~near, sizes[rest])]
                rest = rest[~near]
    return edges


def alike(own: np.ndarray, sizes: np.ndarray, values: np.ndarray, least: float) -> np.ndarray:
    """Which of the sets of these sizes, whose values follow one another, have at least the similarity to own."""
    hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
    shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return shared * (1 + least) >= least * (len(own) + sizes) - 1e-9


def crossing(rest: list[tuple], members: list[tuple], least: float) -> list[tuple[int, int]]:
    """Edges between the roots of classes: of each (root, set) of rest one to each other class with an alike set in members."""
    members = sorted(members, key=lambda m: len(m[1]))
    sizes = np.array([len(m[1]) for m in members])
    roots = np.array([m[0] for m in members])
    values, ends = np.concatenate([m[1] for m in members]), np.concatenate(([0], np.cumsum(sizes)))
    edges: set[tuple[int, int]] = set()
    for root, own in rest:
        # Sets whose sizes differ by more can't be alike.
        low, high = np.searchsorted(sizes, (least * len(own) - 1e-6, len(own) / least + 1e-6))
        if low == high:
            continue
        near = alike(own, sizes[low:high], values[ends[low] : ends[high]], least) & (roots[low:high] != root)
        edges.update((root, other) for other in set(roots[low:high][near].tolist()))
    return list(edges)


def searched(batches: Iterator[pa.RecordBatch], names: int, search: Callable[[list[tuple]], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by their first columns, which name a block; a block may go over many batches.

    Many links of a task leave it as one star for each class, which later rounds need the fewest steps for.
    """
    now, rows = None, []
    out: list[tuple[int, int]] = []

    def emit() -> pa.RecordBatch:
        a, b = simhash.spanning(*np.array(out, np.int64).T.copy().view(np.uint64))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[:names] != now:
                out += search(rows)
                now, rows = row[:names], []
            rows.append((*row[names:-1], np.frombuffer(row[-1], np.uint32)))
            if len(out) > 300_000:
                yield emit()
    out += search(rows)
    if out:
        yield emit()


def dealt(blocks: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("key", "bucket", F.lit(salt)), blocks).cast("int")


def block_links(sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links within each block, from sets (bucket, key, blocks, shingles)."""

    def search(rows: list[tuple]) -> list[tuple[int, int]]:
        return forest([r[0] for r in rows], [r[1] for r in rows], least) if len(rows) > 1 else []

    many = F.col("blocks")
    own = F.when(many == 1, F.array(F.lit(0))).otherwise(F.array(dealt(many, 1), many + dealt(many, 2)))
    rows = sets.select("bucket", F.explode(own).alias("block"), "key", "shingles")
    sorted_ = rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "key")
    return common.map_arrow(sorted_, lambda batches: searched(batches, 2, search), "a bigint, b bigint")


def cross_links(large: DataFrame, stars: DataFrame, sets: DataFrame, least: float) -> DataFrame | None:
    """(a, b): links between the roots of classes within the buckets of several blocks; None if each of them is one class."""

    def search(rows: list[tuple]) -> list[tuple[int, int]]:
        rest, members = ([r[1:] for r in rows if r[0] == side] for side in (0, 1))
        return crossing(rest, members, least) if rest and members else []

    rooted = large.join(stars, large.key == stars.node, "left").select("bucket", "key", "blocks", F.coalesce("root", "key").alias("root"))
    rooted = common.staged(rooted, "rooted")
    counts = rooted.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.max("blocks").alias("blocks"))
    most = counts.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("n"), F.ceil(F.max("blocks") / ACROSS).cast("int").alias("across"))
    down = F.ceil(F.col("across") * (F.col("n") - F.col("most.c")) / F.col("n")).cast("int")
    mixed = common.staged(most.where("n > most.c").select("bucket", "n", F.col("most.root").alias("largest"), "across", down.alias("down")), "mixed")
    if not mixed.limit(1).count():
        return None
    rows = common.skew_join(rooted.drop("blocks"), mixed, "bucket").join(sets, "key")
    cells = lambda side, i, j: (F.lit(side).alias("side"), "root", "shingles", i, j)
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    rest = rows.where("root <> largest").select("bucket", *cells(0, dealt(F.col("down"), 3).alias("i"), all_of("across").alias("j")))
    members = rows.select("bucket", *cells(1, all_of("down").alias("i"), dealt(F.col("across"), 4).alias("j")))
    both = rest.union(members).select("bucket", "i", "j", "side", "root", "shingles")
    sorted_ = both.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return common.map_arrow(sorted_, lambda batches: searched(batches, 3, search), "a bigint, b bigint")


def classes(docs: DataFrame, groups: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(node, root) of keys, from docs (row, shingles) and groups (key, row, size, node, fp)."""
    near = near_classes(common.staged(groups.select("fp").distinct(), "points"), least)
    shared = common.staged(shared_buckets(groups, near, block), "buckets")
    few, _ = common.sifted(docs.select("row", "shingles"), F.xxhash64("row"), shared.select(F.xxhash64("row").alias("hash")))
    sets = common.staged(few.join(shared, "row").select("bucket", "key", "blocks", "shingles"), "sets")
    stars = simhash.components(block_links(sets, least))
    large = shared.where("blocks > 1")
    if not large.limit(1).count():
        return stars
    across = cross_links(large.drop("row"), stars, sets.where("blocks > 1").select("key", "shingles"), least)
    if across is None:
        return stars
    # Only roots take part in the second run; the classes of the first are renamed by it.
    second = common.staged(simhash.components(across), "renamed")
    sizes = stars.groupBy("root").agg(F.count("*").alias("n")).withColumnRenamed("root", "node")
    names = second.join(sizes, "node", "left").select(F.col("node").alias("root"), F.col("root").alias("top"), F.coalesce("n", F.lit(0)).alias("n"))
    renamed = common.skew_join(stars, names, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return common.staged(renamed.union(second), "classes")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """One row of each class of near copies, that of the smallest id (null ids last), with all columns."""
    with common.passing(df.sparkSession):
        docs = common.staged(sketches(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
        first = F.min(F.struct("row", "fp", "node", (F.length("shingles") / 4).cast("bigint").alias("size"))).alias("m")
        groups = docs.groupBy("key").agg(simhash.least_row(), first)
        groups = common.staged(groups.select("key", "least", "m.row", "m.fp", "m.size", "m.node"), "groups")
        stars = classes(docs, groups, least, block)
        found = common.staged(simhash.not_all_stay(docs.select("id", "key", "text_key"), groups.select("key", "least"), stars, "key"), "found", lasting=True)
    return simhash.without(df, found, id_col, text_col)
