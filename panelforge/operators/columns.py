"""Choosing columns by name, type and role; all on the schema, nothing runs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def numeric(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in without]


def with_prefix(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    """Every column but the keys gets the prefix, unless it has it."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keys and not c.startswith(prefix)})


def constants(df: DataFrame, **values) -> DataFrame:
    """Constant columns before the others."""
    return df.select(*[F.lit(v).alias(k) for k, v in values.items()], "*")


def features(df: DataFrame, groups: Sequence[Sequence[str]], blocked: Sequence[str] = (), leak: str = "salinity", allowed: Sequence[str] = ()) -> list[str]:
    """Columns of the groups that exist, in order and once; a name that tells the target is an error."""
    out: list[str] = []
    for c in (c for g in groups for c in g):
        if c in df.columns and c not in blocked and c not in out:
            out.append(c)
    leaks = [c for c in out if leak in c.lower() and c not in allowed]
    if leaks:
        raise ValueError(f"columns that tell the target: {leaks}")
    return out


def feature_set(df: DataFrame, name: str, target_history: Sequence[str], calendar: Sequence[str], weather: Sequence[str], composite: Sequence[str], compact: Sequence[str]) -> list[str]:
    """The named set: salinity (history and calendar), weather (and its history), multisource (all), compact (a chosen few)."""
    base = [*target_history, *calendar]
    sets = {"salinity": base, "weather": [*base, *weather], "multisource": [*base, *weather, *composite], "compact": [*base, *weather, *compact]}
    if name not in sets:
        raise ValueError(f"unknown feature set {name}; one of {sorted(sets)}")
    return [c for c in dict.fromkeys(sets[name]) if c in df.columns]


def group_of(groups: dict[str, Sequence[str]], default: str = "other"):
    """CASE expression from column `feature` to its group's name."""
    out = None
    for name, members in groups.items():
        test = F.col("feature").isin(*members)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(default) if out is None else out.otherwise(default)


def branches(df: DataFrame, history: Sequence[str], calendar: Sequence[str], weather: Sequence[str], place: Sequence[str], composite: Sequence[str], no_composite: bool = False, history_only: bool = False, without_history: bool = False) -> tuple[list[str], list[str], str]:
    """Columns of the dynamic and the context branch that df has, and the prediction mode, under the ablation switches.

    history_only drops weather and composites, no_composite the composites, without_history the target's
    own past (then the calendar stays and the target is predicted directly, not as a residual); the last
    does not combine with the others.
    """
    if without_history and (history_only or no_composite):
        raise ValueError("without_history is an ablation of its own")
    dynamic = [*(calendar if without_history else history), *([] if history_only else weather)]
    context = [*place, *([] if history_only or no_composite else composite)]
    there = lambda names: [c for c in dict.fromkeys(names) if c in df.columns]
    return there(dynamic), there(context), "direct" if without_history else "residual"


def ordinal(df: DataFrame, column: str, name: str = "entity") -> DataFrame:
    """(column, name): the place, from 0, of each distinct value that is not null in their order.

    Values are sorted by range and numbered inside each part; the parts' counts (one small row each) give
    the offsets, so no task holds all values.
    """
    from ..session import kept

    placed = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).withColumn("at_", F.monotonically_increasing_id())
    placed = kept(placed.withColumns({"part_": F.shiftright("at_", 33), "at_": F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))}))
    starts, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in placed.groupBy("part_").count().collect()):
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "p_ bigint, start_ bigint")
    joined = placed.join(F.broadcast(offsets), F.col("part_") == F.col("p_"))
    return joined.select(column, (F.col("start_") + F.col("at_")).cast("int").alias(name))


def with_ordinal(df: DataFrame, column: str, name: str = "entity") -> DataFrame:
    """df with the ordinal of its column's value; a null value has none."""
    return df.join(ordinal(df, column, name), column, "left")
