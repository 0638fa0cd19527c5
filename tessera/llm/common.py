"""Helpers shared by the operators: shared-folder tables, bounded Arrow chunks, and input normalisation."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship

#: Upper bound, in UTF-8 bytes, of the texts that a Python worker handles at a time (one longer text is a chunk by itself).
CHUNK_BYTES = 4 << 20
#: Most slots (bits) of the map that `sifted` sends to the tasks.
SLOTS = 1 << 25
#: Spark deletes the shuffle files of an execution when it ends, not when the driver next collects garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder is set on a local master; on a cluster that is an error, as executors don't share it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext.getCheckpointDir()
        if not context and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = context.rsplit("/", 1)[0] if context else "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_passing: ContextVar[list[Stage] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables staged within go at its end, but for the `lasting` ones; shuffle files go with the execution that wrote them."""
    held: list[Stage] = []
    token, before = _passing.set(held), spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        _passing.reset(token)
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)
        for stage in held:
            stage.drop()


class Stage:
    """A table written into the shared folder, which cuts the lineage and survives the loss of executors."""

    def __init__(self, df: DataFrame, name: str, lasting: bool = False):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tessera-{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)
        atexit.register(self._quietly)
        held = _passing.get()
        if held is not None and not lasting:
            held.append(self)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        atexit.unregister(self._quietly)
        _delete(self.spark, self.path)

    def _quietly(self) -> None:
        try:
            _delete(self.spark, self.path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            pass


def staged(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    return Stage(df, name, lasting).read()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in slices whose texts hold `limit` bytes at most."""
    for batch in batches:
        sizes = np.diff(offsets(batch.column(batch.schema.get_field_index(column)))[1])
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the texts; nulls are empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offs, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    data, at = offsets(column)
    whole, cut = data.tobytes(), at.tolist()
    return [whole[a:b] for a, b in zip(cut, cut[1:])]


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with this package made importable on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_chunks(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow by bounded chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, column):
            out = make(chunk)
            if out is not None and out.num_rows:
                yield out

    return map_arrow(df, run, schema)


class Cache(dict):
    """A bounded memo of a pure function of one key."""

    def __init__(self, make: Callable, most: int = 500_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):  # noqa: ANN001, ANN204
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def input_partitions(df: DataFrame, bytes_each: int, least: int = 1) -> int:
    """How many partitions of about `bytes_each` input bytes the plan's size statistics ask for."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // bytes_each))


def filter_chunks(df: DataFrame, text_col: str, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of df whose flag in `keep` of their chunk is true, with all columns: nothing is joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text_col):
            yield chunk.filter(pa.array(keep(chunk)))

    return map_arrow(df, run, df.schema)


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None, parts: int = 1000) -> DataFrame:
    """left join right on key, where right has each key once, its column `n` counts the key's rows in left, and `n` isn't returned.

    Keys with more than 1/parts of left's rows, at most `parts` of them, are joined by broadcast and never meet in one task.
    """
    total = left.count() if rows is None else rows
    hot = right.where(F.col("n") * parts > total)
    cold = right.where(F.col("n") * parts <= total).drop("n")
    hot_keys = F.broadcast(hot.select(key))
    return left.join(F.broadcast(hot.drop("n")), key).unionByName(left.join(hot_keys, key, "left_anti").join(cold, key, how))


def sifted(df: DataFrame, hashed: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(few, rest) of df's rows: few has all whose hash is in wanted (hash), and those that share a slot with one; rest has the others.

    The slots are a map of bits, about 16 for each wanted row and SLOTS at most, which is broadcast.  So only few has to be
    shuffled for an exact join; beyond SLOTS / 16 wanted rows more of the others come with them.
    """
    slots = min(SLOTS, max(64, 1 << (16 * wanted.count()).bit_length()))
    place = lambda column: F.pmod(column, F.lit(slots).cast("bigint"))
    word = lambda column: F.shiftright(place(column), 6)
    bit = lambda column: F.call_function("shiftleft", F.lit(1).cast("bigint"), place(column).bitwiseAND(F.lit(63)).cast("int"))
    bits = wanted.groupBy(word(F.col("hash")).alias("__word")).agg(F.bit_or(bit(F.col("hash"))).alias("__bits"))
    bits = F.broadcast(staged(bits, "slots", lasting=True))
    same = (word(hashed) == bits["__word"]) & (bits["__bits"].bitwiseAND(bit(hashed)) != 0)
    return df.join(bits, same, "left_semi"), df.join(bits, same, "left_anti")


def drop_rows(df: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df whose id and text (both null-safe, the text by a hash) are not in dropped (id, text_key); no column is added."""
    keys = dropped.select(F.col("id").alias("__id"), F.col("text_key").alias("__key"))
    same = df[id_col].eqNullSafe(keys["__id"]) & text_key(df[text_col]).eqNullSafe(keys["__key"])
    return df.join(keys, same, "left_anti")


def text_key(text: Column) -> Column:
    """A hash of a text for drop_rows; null and empty texts have the same."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
