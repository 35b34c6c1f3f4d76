"""What the registered queries share: the decorator, base frames and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import densify
from ..session import table

QUERIES: dict = {}
ORACLE: dict = {}
KEYS = ["user_id", "event_type"]


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB twin if SQL can say it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(x: Column, name: str) -> Column:
    return F.round(x.cast("double"), 6).alias(name)


def day_text(x: str | Column, name: str) -> Column:
    return F.date_format(x, "yyyy-MM-dd").alias(name)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest and smallest event value of each user, type and day."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(*KEYS, F.to_date("ts").alias("day")).agg(F.max("value").alias("value"), F.min("value").alias("low"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily() on every day of the table's range for each user and type."""
    return densify(daily(spark, sf_dir), KEYS, "day")


DAILY = "daily AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, max(value) AS value, min(value) AS low FROM events GROUP BY 1, 2, 3)"
GRID = (
    "days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT min(day) AS lo, max(day) AS hi FROM daily)), "
    "grid AS (SELECT user_id, event_type, day FROM (SELECT DISTINCT user_id, event_type FROM daily) CROSS JOIN days)"
)
PANEL = f"WITH {DAILY}, {GRID}, panel AS (SELECT g.user_id, g.event_type, g.day, d.value, d.low FROM grid g LEFT JOIN daily d USING (user_id, event_type, day))"
W = "(PARTITION BY user_id, event_type ORDER BY day"
FILLED = f"{PANEL}, filled AS (SELECT *, last_value(value IGNORE NULLS) OVER {W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS filled, max(CASE WHEN value IS NOT NULL THEN day END) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_day, lead(value, 3) OVER {W}) AS target, lead(day, 3) OVER {W}) AS target_date FROM panel)"
