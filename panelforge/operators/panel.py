"""From irregular series to a dense, checked and causally filled panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import neighbours


def calendar(spark, start: str, end: str, step: str = "1 day") -> DataFrame:
    """One row for each date of [start, end]."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {step}"))).alias("date"))


def densify(df: DataFrame, keys: list[str], day: str, start=None, end=None) -> DataFrame:
    """Every key on every date, with df's columns where it has the row.

    The dates are exploded from each key's row, so only the distinct keys are shuffled, and the join back
    is on (keys, date). Without bounds the first and last date of the whole table hold.
    """
    if start is None or end is None:
        low, high = df.agg(F.min(day), F.max(day)).first()
        start, end = start or low, end or high
    if start is None:
        return df
    dates = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day")))
    grid = df.select(*keys).distinct().withColumn(day, dates)
    return grid.join(df, [*keys, day], "left")


def range_qc(df: DataFrame, high: str, low: str, least: float, most: float) -> DataFrame:
    """qc_invalid 0/1; values outside [least, most] and both values of a reversed pair become null.

    The flag is 1 if the high value is out of range or the pair is reversed; a bad low value alone only
    loses itself.
    """
    bad = lambda c: F.col(c).isNotNull() & ~F.col(c).between(least, most)
    reversed_ = F.coalesce(F.col(low) > F.col(high), F.lit(False))
    return df.withColumns({"high_bad_": bad(high) | reversed_, "low_bad_": bad(low) | reversed_}).withColumns(
        {"qc_invalid": F.col("high_bad_").cast("int"), high: F.when(~F.col("high_bad_"), F.col(high)), low: F.when(~F.col("low_bad_"), F.col(low))}
    ).drop("high_bad_", "low_bad_")


def in_order(keys: list[str], day: str):
    return Window.partitionBy(*keys).orderBy(day)


def fill_forward(x: Column, window, most: int) -> Column:
    """x, or the last value of at most `most` rows before; the rows must be a dense grid."""
    return F.last(x, ignorenulls=True).over(window.rowsBetween(-most, 0))


def days_since(x: Column, day: Column, window, never: int = 9999) -> Column:
    """Days since x was last not null, up to the current row; `never` before the first time."""
    last = F.last(F.when(x.isNotNull(), day), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.date_diff(day, last), F.lit(never))


def causal_features(df: DataFrame, keys: list[str], day: str, value: str, most_gap: int = 3) -> DataFrame:
    """observed, filled, imputed and days_since of a dense panel; one window for all, so one sort."""
    w = in_order(keys, day)
    filled = fill_forward(F.col(value), w, most_gap)
    return df.select(
        "*",
        F.col(value).isNotNull().cast("int").alias("observed"),
        filled.alias("filled"),
        days_since(F.col(value), F.col(day), w).alias("days_since"),
    ).withColumn("imputed", (F.col(value).isNull() & F.col("filled").isNotNull()).cast("int"))


def attach_previous_month(df: DataFrame, day: str, monthly: DataFrame, month: str) -> DataFrame:
    """Left join of the month before each row's; monthly has one row for each month start."""
    key = F.add_months(F.trunc(F.col(day), "month"), -1)
    return df.withColumn("month_", key).join(monthly, F.col("month_") == F.col(month), "left").drop("month_")


def missing_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.select(*on).distinct().join(right.select(*on), on, "left_anti")


def nearest_donor(missing: DataFrame, donors: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """For each missing key the donor at least squared distance (in the units of x, y), ties to the smaller key.

    Both sides hold one row for each station; few donors are broadcast, more are met through cells.
    Returns (key, donor_key, d2).
    """
    place = lambda df, name: df.select(F.col(key).alias(name), F.col(x).cast("double").alias("x_km"), F.col(y).cast("double").alias("y_km"))
    best = neighbours(place(missing, key), place(donors, "donor_key"), key, "donor_key", 1)
    return best.select(key, F.col("value").alias("donor_key"), (F.col("distance") ** 2).alias("d2"))


def fill_from_donor(series: DataFrame, choice: DataFrame, key: str) -> DataFrame:
    """Copy the donor's rows under each missing key, with imputed_from; appended to the series."""
    copied = choice.join(series.withColumnRenamed(key, "donor_key"), "donor_key").withColumnRenamed("donor_key", "imputed_from")
    own = series.withColumn("imputed_from", F.lit(None).cast(series.schema[key].dataType))
    return own.unionByName(copied.select(*own.columns))


def dedupe_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: list, how: str = "left") -> DataFrame:
    """Equi-join that keeps only the first row of `right` for each key."""
    return left.join(dedupe_first(right, keys, order), keys, how)


def audit(df: DataFrame, **tests: Column) -> DataFrame:
    """Rows in all, and rows that pass each test together with the tests before it; one pass."""
    passed, counts = F.lit(True), [F.count("*").alias("raw")]
    for name, test in tests.items():
        passed = passed & F.coalesce(test, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return df.agg(*counts)
