"""A search over trials whose log survives a restart; trials run side by side as jobs of one session."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import save_record


def there(spark: SparkSession, pattern: str) -> bool:
    """Whether a path (or glob) exists, asked through Hadoop's file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(target))


def logged(spark: SparkSession, log: str) -> dict[int, dict]:
    """trial -> its record, of the trials that a log holds in full."""
    if not there(spark, f"{log}/trial-*/_SUCCESS"):
        return {}
    return {r["trial"]: r for r in map(json.loads, (row[0] for row in spark.read.text(f"{log}/trial-*").collect()))}


def search(spark: SparkSession, trials: Sequence[dict], run: Callable[[dict], dict], log: str, metric: str, at_once: int = 2) -> list[dict]:
    """Records {trial, trial's fields, run's results} of all trials, least `metric` first (null last, then by trial).

    Each trial is written to the log when it is done, and the table of all done so far is written anew, in that
    order. A restart with the same trials goes on with those that the log lacks; other trials under the same
    numbers are an error. A trial that fails is raised once the running ones have been logged.
    """
    done = logged(spark, log)
    for i, r in done.items():
        asked = json.loads(json.dumps(trials[i])) if i < len(trials) else None
        if asked is None or any(r.get(k) != v for k, v in asked.items()):
            raise ValueError(f"{log} holds another trial {i}")
    lock, order = Lock(), lambda r: (r[metric] is None, r[metric] or 0.0, r["trial"])

    def one(i: int) -> None:
        record = {"trial": i, **trials[i], **run(trials[i])}
        save_record(spark, record, f"{log}/trial-{i}")
        with lock:
            done[i] = json.loads(json.dumps(record))
            write_table(spark, sorted(done.values(), key=order), f"{log}/table")

    with ThreadPoolExecutor(at_once) as pool:
        waiting = [pool.submit(one, i) for i in range(len(trials)) if i not in done]
        try:
            for w in as_completed(waiting):
                w.result()
        except BaseException:
            for w in waiting:
                w.cancel()
            raise
    return sorted(done.values(), key=order)


def write_table(spark: SparkSession, records: list[dict], path: str) -> None:
    """Records as one CSV file with a header, in their order; the columns are those of the first."""
    names = list(records[0])
    rows = [tuple(None if r[n] is None else str(r[n]) for n in names) for r in records]
    spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


class Once:
    """make(key) for each key, made by the first trial that asks and shared by the others."""

    def __init__(self, make: Callable):
        self.make, self.made, self.locks, self.lock = make, {}, {}, Lock()

    def __call__(self, key):
        with self.lock:
            mine = self.locks.setdefault(key, Lock())
        with mine:
            if key not in self.made:
                self.made[key] = self.make(key)
            return self.made[key]


def as_frame(spark: SparkSession, records: list[dict], schema: str) -> DataFrame:
    """Records as a frame of `schema`, whose first `*_rmse` column and trial order them."""
    frame = spark.createDataFrame([{**r} for r in records], schema)
    metric = next(c for c in frame.columns if c.endswith("_rmse"))
    return frame.orderBy(F.asc_nulls_last(metric), "trial")
