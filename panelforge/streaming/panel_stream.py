"""An extension: the daily panel and its forecast error as structured streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_stream(events: DataFrame, keys: list[str], ts: str, value: str, late: str = "2 days") -> DataFrame:
    """Largest value of each key and day; a day closes when the watermark passes its end."""
    day = F.window(ts, "1 day")
    agg = events.withWatermark(ts, late).groupBy(*keys, day).agg(F.max(value).alias(value), F.count("*").alias("n"))
    return agg.select(*keys, F.col("window.start").alias("day"), value, "n")


def fill_stream(days: DataFrame, key: str, day: str, value: str, most_gap: int = 3) -> DataFrame:
    """For each closed day, the last value of the key at most `most_gap` days before (its state), and the gap.

    State is one (day, value) pair for each key. Days of a key arrive in watermark order; one that comes
    after a later day of its key gets no baseline.
    """
    import pandas as pd

    schema = f"{key} string, day timestamp, value double, baseline double, gap int"

    def step(k, frames: Iterator, state):
        last = state.get if state.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values(day)
        for d, v in zip(rows[day], rows[value], strict=True):
            gap = (d.value - last[0]) // 86_400_000_000_000 if last is not None else None
            fresh = gap is not None and 0 < gap <= most_gap
            out.append((k[0], d, v, last[1] if fresh else None, gap if fresh else None))
            if last is None or d.value > last[0]:
                last = (d.value, float(v))
        state.update(last)
        yield pd.DataFrame(out, columns=[key, "day", "value", "baseline", "gap"])

    return days.groupBy(key).applyInPandasWithState(step, schema, "day_ns long, value double", "append", "NoTimeout")
