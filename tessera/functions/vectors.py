"""Dense vectors (array columns) as Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of a matrix of dense vectors.
DENSE_ROWS = 2048


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays.  The norm is bound once, outside the loop over the entries."""
    bound = F.array(F.struct(F.transform(a, lambda x: x.cast("double")).alias("v"), norm(a).alias("n")))
    return F.transform(bound, lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / F.when(size > 0, size)).otherwise(F.lit(0.0))


def minkowski(a: Column, b: Column, p: float) -> Column:
    """Minkowski distance; p may be infinite."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if p == float("inf"):
        return F.coalesce(F.array_max(gaps), F.lit(0.0))
    if p == 1:
        return _sum(gaps)
    if p == 2:
        return F.sqrt(_sum(F.transform(gaps, lambda g: g * g)))
    return F.pow(_sum(F.transform(gaps, lambda g: F.pow(g, F.lit(float(p))))), F.lit(1 / p))


def euclidean(a: Column, b: Column) -> Column:
    return minkowski(a, b, 2)


def hist_to_dense(hist: Column, keys: list[str], normalize: bool = True) -> Column:
    """Counts of a map in the order of the keys, missing ones 0, at unit length if asked; a null map has none.

    A batch's entries are laid into one matrix, so that a row costs its entries and its vector, not a search of the map for each key.
    """
    names = pa.array(keys, pa.string())

    @F.arrow_udf("array<double>")
    def dense(maps: pa.Array) -> pa.Array:
        starts, ends = maps.offsets.to_numpy()[:-1], maps.offsets.to_numpy()[1:]
        ends = np.where(maps.is_valid().to_numpy(zero_copy_only=False), ends, starts)
        parts = []
        for first in range(0, len(maps), DENSE_ROWS):
            begin, end = starts[first : first + DENSE_ROWS], ends[first : first + DENSE_ROWS]
            sizes = end - begin
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            column = pc.fill_null(pc.index_in(maps.keys.take(pa.array(at)), value_set=names), -1).to_numpy(zero_copy_only=False)
            count = pc.fill_null(maps.items.take(pa.array(at)), 0).to_numpy(zero_copy_only=False)
            out = np.zeros((len(begin), len(names)))
            known = column >= 0
            out[np.repeat(np.arange(len(begin)), sizes)[known], column[known]] = count[known]
            if normalize:
                size = np.sqrt((out * out).sum(axis=1))
                out /= np.where(size > 0, size, 1)[:, None]
            parts.append(pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1, dtype=np.int32) * len(names)), pa.array(out.ravel())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return dense(hist)


def codeword(prefix: str, idx: Column) -> Column:
    """Names such as a_0007."""
    return F.format_string(prefix + "_%04d", idx)
