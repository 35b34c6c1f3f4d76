"""Rollup of a finer panel to a coarser one, each column by what its name says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_value(x: str, order: str) -> Column:
    """The first non-null value in the order of another column."""
    return F.min_by(x, F.when(F.col(x).isNotNull(), F.col(order)))


def mode_or(x: str, default: str = "unknown") -> Column:
    """The commonest value, the smallest of equally common ones."""
    return F.coalesce(F.mode(x, True), F.lit(default))


#: Column name ending -> aggregate; the first that fits counts.
BY_SUFFIX = (("_sum", F.sum), ("_max", F.max), ("_min", F.min), ("_mean", F.avg), ("_std", F.avg), ("_median_week", F.median))


def by_suffix(name: str) -> Column | None:
    """The aggregate of a column by its suffix (_sum, _max, _min, _mean and _std: mean, _median_week and s2_*: median)."""
    for suffix, f in BY_SUFFIX:
        if name.endswith(suffix):
            return F.coalesce(f(name), F.lit(0.0)) if suffix == "_sum" else f(name)
    return F.median(name) if name.startswith("s2_") else None


def rollup(df: DataFrame, keys: list[str], fixed: dict[str, Column], reliable: str | None = None, least_reliable: int = 1) -> DataFrame:
    """One groupBy: the fixed columns, every other column with a known suffix, row and reliable counts.

    n_rows; with a `reliable` flag column also n_reliable and mean_reliable (at least `least_reliable`).
    A sum over only nulls is 0.
    """
    rest = {c: a for c in df.columns if c not in fixed and c not in keys and c != reliable and (a := by_suffix(c)) is not None}
    out = [a.alias(c) for c, a in {**fixed, **rest}.items()] + [F.count("*").alias("n_rows")]
    if reliable:
        out.append(F.count_if(F.coalesce(F.col(reliable), F.lit(False))).alias("n_reliable"))
    df = df.groupBy(*keys).agg(*out)
    return df.withColumn("mean_reliable", F.col("n_reliable") >= least_reliable) if reliable else df
