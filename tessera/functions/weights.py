"""Term weights as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_tf(tf: Column) -> Column:
    """1 + log10(tf) for positive counts, else 0."""
    return F.when(tf > 0, 1 + F.log10(F.when(tf > 0, tf))).otherwise(F.lit(0.0))


def idf(df: Column, n_docs: Column) -> Column:
    """log10(n_docs / df) without smoothing; 0 where either isn't positive."""
    ok = (df > 0) & (n_docs > 0)
    return F.when(ok, F.log10(F.when(ok, n_docs.cast("double") / df))).otherwise(F.lit(0.0))


def tfidf(tf: Column, df: Column, n_docs: Column, use_log_tf: bool = True) -> Column:
    return (log_tf(tf) if use_log_tf else F.greatest(tf, F.lit(0)).cast("double")) * idf(df, n_docs)


def divided(value: Column, norm: Column) -> Column:
    """value / norm, and the value itself where the norm is 0: a zero vector stays."""
    return F.when(norm > 0, value / F.when(norm > 0, norm)).otherwise(value)
