"""SimHash near-duplicates (operator 2) linked by covering locality-sensitive hashing.

Fingerprint: each of 64 bits is the majority over the XXH64 values of a text's word shingles.  Linking: every bit gets a
non-zero vector of radius + 1 bits; each non-zero v selects the bits whose vector has an odd product with v.  Of at most
`radius` differing bits the vectors can't span the space, so some v selects none of them: every pair within the
radius agrees under one of the 2**(radius+1) - 1 masks at least.

Distinct fingerprints only are compared (copies meet in one row by a pre-aggregated minimum); within a bucket a search
from each found neighbour makes a spanning forest, never all pairs; components follow by alternating large and small
stars, each half of a round written into the shared folder.  In every join by fingerprint or component, keys with over a thousandth of the
rows (a thousand of them at most) are joined by broadcast, so that no group of copies meets in one task.

Defined results: null and empty texts have fingerprint zero and are linked like any other; ties of a bit are 0; repeated
rows keep their rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

SEED, WIDTH, RADIUS = 42, 4, 4
#: Buckets above this size are searched through further masks first.
DIRECT = 16_384


def covering_masks(radius: int = RADIUS, seed: int = 2) -> np.ndarray:
    """2**(radius+1) - 1 masks of 64 bits; every difference of at most `radius` bits is outside one of them."""
    vectors = np.arange(1, 1 << (radius + 1), dtype=np.uint64)
    order = np.concatenate([vectors] * (-(-64 // len(vectors))))[:64]
    np.random.default_rng(seed).shuffle(order)
    odd = np.bitwise_count(vectors[:, None] & order[None, :]) & 1
    return (odd.astype(np.uint64) << np.arange(64, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)


def fingerprint(raw: bytes, width: int = WIDTH) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).astype(np.int64))
    digest, seed = xxhash.xxh64_intdigest, SEED
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - width] + 1)).tolist()
    m = n - width + 1
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, m)
    ones = np.zeros(64, np.int64)
    for i in range(0, m, 1 << 14):
        part = h[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > m).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id_col, fp bigint, text_key bigint) for each row."""

    def make(chunk: pa.RecordBatch) -> pa.RecordBatch:
        values = [fingerprint(raw, width) for raw in common.raw_texts(chunk.column(1))]
        return pa.RecordBatch.from_arrays([chunk.column(0), pa.array(values, pa.int64()), chunk.column(2)], [id_col, "fp", "text_key"])

    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col), common.text_key(F.col(text_col)).alias("text_key"))
    return common.map_chunks(rows, make, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, fp bigint, text_key bigint", text_col)


def forest(points: np.ndarray, radius: int, direct: int = DIRECT) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that joins points within the radius."""
    if len(points) > direct:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for mask in covering_masks(radius, seed=3):
            value = points & mask
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            for run in np.split(order, cuts):
                if len(run) == len(points):
                    return forest(points, radius, len(points))
                if len(run) > 1:
                    parts.append(forest(points[run], radius, direct))
        a, b = (np.concatenate(x) for x in zip(*parts)) if parts else (points[:0], points[:0])
        return spanning(a, b)
    left, right = [], []
    rest = points
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                left.append(np.full(len(found), x, np.uint64))
                right.append(found)
                frontier.extend(found)
    if not left:
        return points[:0], points[:0]
    return np.concatenate(left), np.concatenate(right)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that the edges touch with the smallest (signed) node of its component, itself left out."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]).view(np.int64), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    own = root != np.arange(len(nodes))
    return nodes[own].view(np.uint64), nodes[root[own]].view(np.uint64)


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links from rows (table, value, fp) sorted by bucket; a bucket may go over many batches."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    carry: list[list[np.ndarray]] = []  # the parts of the last bucket, joined when it ends

    def runs(table: np.ndarray, value: np.ndarray, fp: np.ndarray) -> None:
        nonlocal held
        if len(fp) < 2:
            return
        cuts = np.concatenate(([0], np.flatnonzero((np.diff(table) != 0) | (np.diff(value) != 0)) + 1, [len(fp)]))
        sizes = np.diff(cuts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        small = sizes <= 16
        at = np.flatnonzero(small[owner])
        for k in range(1, 16):
            at = at[at + k < len(fp)]
            at = at[owner[at] == owner[at + k]]
            if not len(at):
                break
            near = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= radius]
            if len(near):
                found.append((fp[near], fp[near + k]))
                held += len(near)
        for i in np.flatnonzero(~small).tolist():
            edges = forest(fp[cuts[i] : cuts[i + 1]], radius)
            if len(edges[0]):
                found.append(edges)
                held += len(edges[0])

    def emit() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if found:
            a, b = spanning(*(np.concatenate(x) for x in zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        found.clear()
        held = 0

    kinds = (np.int32, np.int64, np.uint64)
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False).view(k) for i, k in enumerate(kinds)]
        if not len(rows[0]):
            continue
        if carry and (carry[-1][0][-1] != rows[0][0] or carry[-1][1][-1] != rows[1][0]):
            runs(*map(np.concatenate, zip(*carry)))
            carry = []
        differs = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        last = differs[-1] + 1 if len(differs) else 0
        if last:
            runs(*map(np.concatenate, zip(*carry, [r[:last] for r in rows])))
            carry = []
        carry.append([r[last:].copy() for r in rows])
        if held > 1_000_000:
            yield from emit()
    if carry:
        runs(*map(np.concatenate, zip(*carry)))
    yield from emit()


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect what the radius connects, from distinct (fp)."""
    masks = [int(m.astype(np.int64)) for m in covering_masks(radius)]
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)))
    rows = distinct.select("fp", F.explode(tables).alias("k")).select("k.t", "k.v", "fp")
    dealt = rows.repartition("t", "v").sortWithinPartitions("t", "v", "fp")
    return common.map_arrow(dealt, lambda batches: bucket_links(batches, radius), "a bigint, b bigint")


def _lowest(edges: DataFrame, by: str, other: str, rows: int) -> DataFrame:
    """Each edge with the least of `by`, and all its others, as m."""
    least = edges.groupBy(by).agg(F.least(F.min(other), F.first(by)).alias("m"), F.count("*").alias("n"))
    return common.skew_join(edges, least, by, rows=rows).select(by, other, "m")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches, by alternating stars.

    Each round is a written table; the loop ends when a round changes nothing.
    """
    tidy = lambda pairs: pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = common.Stage(tidy(edges), "stars"), None
    for _ in range(rounds):
        have = now.read()
        row = have.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row == mark:
            break
        mark = row
        both = have.union(have.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _lowest(both, "a", "b", 2 * row[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        half = common.Stage(large, "stars")  # read many times below: a plan that repeats it fills the driver
        small = _lowest(half.read(), "a", "b", row[0])
        ends = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
        after = common.Stage(tidy(small.select(ends.alias("e")).select("e.a", "e.b")), "stars")
        now.drop()
        half.drop()
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.read().select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """(id_col, fp bigint, component_id): component_id is the smallest id that links reach."""
    docs = common.staged(fingerprints(df, id_col, text_col, width).drop("text_key"), "fingerprints")
    groups = common.staged(docs.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count("*").alias("n")), "groups")
    stars = components(links(groups.select("fp"), radius))
    nodes = common.staged(groups.join(stars, groups.fp == stars.node, "left").select("fp", "n", "least_id", F.coalesce("root", "fp").alias("root")), "nodes")
    classes = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    mapped = common.staged(common.skew_join(nodes.select("root", "fp", F.col("n").alias("rows")), classes, "root").select("fp", "component_id", F.col("rows").alias("n")), "classes")
    return common.skew_join(docs, mapped, "fp").select(id_col, "fp", "component_id")


def not_all_stay(docs: DataFrame, groups: DataFrame, stars: DataFrame, key: str) -> DataFrame:
    """(id, text_key, stays) of the rows of which none or not each stays, when one row of each class does: that of the
    smallest id (null ids last), then of the smallest text hash.  stays: one of the rows that repeat this id and text.

    docs: (id, key, text_key) of each row; groups: (key, least: struct<away, id, text_key>) of each key; stars: (node, root).
    """
    rooted = groups.join(stars, groups[key] == stars.node, "left").select(F.coalesce("root", key).alias("root"), "least")
    chosen = rooted.groupBy("root").agg(F.min("least").alias("m")).select(F.col("m.id").alias("__id"), F.col("m.text_key").alias("__key"))
    rows = docs.groupBy("id", "text_key").agg(F.count("*").alias("n"))
    same = rows.id.eqNullSafe(chosen["__id"]) & rows.text_key.eqNullSafe(chosen["__key"])
    marked = rows.join(chosen.withColumn("stays", F.lit(True)), same, "left").select("id", "text_key", "n", F.coalesce("stays", F.lit(False)).alias("stays"))
    return marked.where("n > 1 or not stays").drop("n")


def without(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df that stay, by the written table of `not_all_stay`.  The texts of the others are not shuffled."""
    few, rest = common.sifted(df, F.xxhash64(df[id_col], common.text_key(df[text_col])), found.select(F.xxhash64("id", "text_key").alias("hash")))
    single = common.drop_rows(few, found.where("not stays"), id_col, text_col)
    if found.where("stays").limit(1).count():
        # Rows that repeat an id and a text: one of them stays.
        single = single.withColumn("__tessera_key", common.text_key(F.col(text_col))).dropDuplicates([id_col, "__tessera_key"]).drop("__tessera_key")
    return rest.union(single)


def least_row() -> Column:
    """The row that stays of a class, from (id, text_key): null ids last."""
    return F.min(F.struct(F.col("id").isNull().alias("away"), "id", "text_key")).alias("least")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each class, that of the smallest id (null ids only where a class has no other), with all columns."""
    with common.passing(df.sparkSession):
        docs = common.staged(fingerprints(df, id_col, text_col).withColumnRenamed(id_col, "id"), "fingerprints")
        groups = common.staged(docs.groupBy("fp").agg(least_row()), "groups")
        stars = components(links(groups.select("fp"), radius))
        found = common.staged(not_all_stay(docs, groups, stars, "fp"), "found", lasting=True)
    return without(df, found, id_col, text_col)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
