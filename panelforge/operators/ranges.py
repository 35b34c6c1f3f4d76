"""Order statistics without sorting a column in one task: counted value ranges, offsets, and selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

#: Rows that one range holds about; a task sorts one range of one group at most.
RANGE = 1_000_000


def ranged(df: DataFrame, keys: list[str], most: int | None = None) -> tuple[DataFrame, int]:
    """(df with range_, number of ranges): ranges ascend by keys, and there are as many as the rows ask for.

    most: a bound on the rows, if one is known; up to RANGE rows nothing is counted or moved. More are
    dealt by sampled ranges and written, so that range numbers hold whatever is read again.
    """
    if most is not None and most <= RANGE:
        return df.withColumn("range_", F.lit(0)), 1
    df = kept(df)
    parts = -(-df.count() // RANGE)
    if parts <= 1:
        return df.withColumn("range_", F.lit(0)), 1
    return kept(df.repartitionByRange(parts, *keys).withColumn("range_", F.spark_partition_id())), parts


def _starts(rows: DataFrame, groups: list[str], count: str) -> DataFrame:
    """(groups, range_, total_, start_): the sum of count in each range, and in the ranges before."""
    totals = rows.groupBy(*groups, "range_").agg(F.sum(count).alias("total_"))
    return totals.withColumn("start_", F.sum("total_").over(Window.partitionBy(*groups).orderBy("range_")) - F.col("total_"))


def _inside(groups: list[str], order: list[str], count: str):
    w = Window.partitionBy(*groups, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(count).over(w) - F.col(count)


def _on(groups: list[str], a: str, b: str, also: str = "range_"):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in [*groups, also]])


def running_totals(df: DataFrame, groups: list[str], value: str, count: str, ties: list[str] | None = None, most: int | None = None) -> DataFrame:
    """df with before_: the sum of `count` over the rows of its group that come earlier by value (then `ties`).

    Sums run inside counted ranges and are shifted by the totals of the ranges before. Values of any
    ordered kind will do, nulls come first; groups may be null; an empty frame stays empty.
    """
    order = [value, *(ties or [])]
    rows, parts = ranged(df, [*groups, *order], most)
    rows = rows.withColumn("inside_", _inside(groups, order, count))
    if parts == 1:
        return rows.withColumnRenamed("inside_", "before_").drop("range_")
    starts = _starts(rows, groups, count).alias("s")
    out = rows.alias("r").join(starts, _on(groups, "r", "s"))
    return out.select("r.*", (F.col("s.start_") + F.col("r.inside_")).alias("before_")).drop("range_", "inside_")


def quantiles(df: DataFrame, columns: list[str], shares: list[float], groups: list[str] | None = None) -> DataFrame:
    """(groups, column, share, value): exact quantiles, linear between ranks, of values that are not null or NaN.

    Equal values are one row with a count. Ranges are counted, and only those that hold a wanted rank are
    sorted. Columns without values give no rows.
    """
    groups = groups or []
    keys = [*groups, "column"]
    long = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(groups, columns, "column", "x_").where("x_ is not null and not isnan(x_)")
    rows, _ = ranged(long.groupBy(*keys, "x_").agg(F.count("*").alias("n_")), [*keys, "x_"])
    starts = _starts(rows, keys, "n_")
    whole = F.sum("total_").over(Window.partitionBy(*keys))
    place = F.col("share") * (F.col("all_") - 1)
    wanted = starts.withColumn("all_", whole).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    wanted = wanted.withColumns({"low_": F.floor(place), "part_": place - F.floor(place)})
    has = lambda r: (F.col("start_") <= r) & (r < F.col("start_") + F.col("total_"))
    wanted = wanted.where(has(F.col("low_")) | ((F.col("part_") > 0) & has(F.col("low_") + 1)))
    few = rows.alias("r").join(wanted.select(*keys, "range_").distinct().alias("w"), _on(keys, "r", "w"), "left_semi")
    few = few.withColumn("inside_", _inside(keys, ["x_"], "n_"))
    met = few.alias("r").join(wanted.alias("w"), _on(keys, "r", "w")).select(*[F.col(f"r.{k}").alias(k) for k in keys], "w.share", "w.low_", "w.part_", "r.x_", "r.n_", (F.col("w.start_") + F.col("r.inside_")).alias("before_"))
    at = lambda r: F.max(F.when((F.col("before_") <= r) & (r < F.col("before_") + F.col("n_")), F.col("x_")))
    found = met.groupBy(*keys, "share", "part_").agg(at(F.col("low_")).alias("a_"), at(F.col("low_") + 1).alias("b_"))
    value = F.when(F.col("part_") > 0, F.col("a_") + (F.col("b_") - F.col("a_")) * F.col("part_")).otherwise(F.col("a_"))
    return found.select(*keys, "share", value.alias("value"))


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians of whole columns; columns without values are left out."""
    return {r["column"]: r["value"] for r in quantiles(df, columns, [0.5]).collect()}
