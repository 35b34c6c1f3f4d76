"""Contracts that a step asks of its inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    found = duplicate_keys(df, keys).limit(1).collect()
    if found:
        raise ValueError(f"duplicate key {found[0].asDict()}")
    return df


def require_one_coordinate(df: DataFrame, key: str, lon: str, lat: str) -> DataFrame:
    """Each key has one (lon, lat) pair over all its rows."""
    found = df.groupBy(key).agg(F.count_distinct(lon, lat).alias("n")).where("n > 1").limit(1).collect()
    if found:
        raise ValueError(f"{found[0][0]} has several coordinates")
    return df


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, whose plan fails as soon as a key (null counts as one) turns up in a second row.

    The count is a window over the keys, whose shuffle and sort a join on the same keys uses again, so the
    contract needs no job of its own.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    shown = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    told = F.when(F.col("n_rows_") == 1, True).otherwise(F.raise_error(F.concat(F.lit("duplicate key "), shown)))
    return df.withColumn("n_rows_", n).where(told).drop("n_rows_")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join of two frames that hold each key once; a repeated key fails the job that meets it."""
    return once(left, keys).join(once(right, keys), keys, how)


def join_many_to_one(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """Left join to a table with one row for each key (more fail the job); the right key columns are dropped."""
    named = once(right, right_keys).withColumnsRenamed({b: f"{b}__right" for b in right_keys})
    on = reduce(lambda a, b: a & b, [left[a] == named[f"{b}__right"] for a, b in zip(left_keys, right_keys, strict=True)])
    return left.join(named, on, "left").drop(*[f"{b}__right" for b in right_keys])
