"""Session factory and helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def get_session(name: str = "panelforge", master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A UTC session with adaptive execution on; for tests and the bench."""
    return (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read only through Spark (the path may be remote)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Let Python workers find this package when the driver has it on sys.path only, and bound Arrow batches.

    Rows of text differ a lot in length, so batches are cut by bytes as well; a session's own choice stays.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, "16m")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset (tests, local mode) a local temporary folder is used.
    """
    sc = spark.sparkContext
    given = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="panelforge-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(given)
    return sc.getCheckpointDir()


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scope():
    """Deletes what kept() writes inside it when it ends: for a result that is written or collected there.

    Queries return frames that still read their kept tables, so whoever runs one sets the scope. Scopes nest, and
    belong to the driver's session, not to a thread.
    """
    mine: list[DataFrame] = []
    _SCOPES.append(mine)
    try:
        yield
    finally:
        _SCOPES.remove(mine)
        drop_kept(*mine)


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: a short lineage that survives lost executors."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def drop_kept(*dfs: DataFrame | None) -> None:
    """Delete the files behind frames of kept() that nothing needs any more."""
    for df in dfs:
        path = getattr(df, "_kept_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(there, True)
