"""Samples for forecasting: lags, targets ahead, sliding sequences and splits by target date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .panel import in_order


def lags(df: DataFrame, keys: list[str], day: str, column: str, steps: tuple[int, ...]) -> DataFrame:
    w = in_order(keys, day)
    return df.withColumns({f"{column}_lag{n}": F.lag(column, n).over(w) for n in steps})


def lead_target(df: DataFrame, keys: list[str], day: str, column: str, horizon: int) -> DataFrame:
    """target and target_date, `horizon` rows ahead in the key's dense series."""
    w = in_order(keys, day)
    return df.withColumns({"target": F.lead(column, horizon).over(w), "target_date": F.lead(day, horizon).over(w)})


def sequences(df: DataFrame, keys: list[str], day: str, columns: list[str], target: str, lookback: int, horizon: int) -> DataFrame:
    """One row for each complete window of `lookback` rows whose target `horizon` rows ahead is not null.

    sequence: array of structs (nulls inside survive); input_start, input_end, target_date, target.
    """
    w = in_order(keys, day)
    frame = w.rowsBetween(-(lookback - 1), 0)
    out = df.select(
        *keys,
        F.first(day).over(frame).alias("input_start"),
        F.col(day).alias("input_end"),
        F.lead(day, horizon).over(w).alias("target_date"),
        F.lead(target, horizon).over(w).alias("target"),
        F.collect_list(F.struct(*columns)).over(frame).alias("sequence"),
    )
    return out.where((F.size("sequence") == lookback) & F.col("target").isNotNull())


def last_valid(df: DataFrame, keys: list[str], day: str, column: str, lookback: int) -> Column:
    """The last value in the window of `lookback` rows that ends at the current one."""
    return F.last(column, ignorenulls=True).over(in_order(keys, day).rowsBetween(-(lookback - 1), 0))


def split_by_date(day: Column, train_end: str, valid_end: str) -> Column:
    return F.when(day <= F.lit(train_end).cast("date"), "train").when(day <= F.lit(valid_end).cast("date"), "val").when(day.isNotNull(), "test")


def split_by_year(year: Column, train: tuple[int, ...], valid: tuple[int, ...], test: tuple[int, ...]) -> Column:
    return F.when(year.isin(*train), "train").when(year.isin(*valid), "val").when(year.isin(*test), "test")
