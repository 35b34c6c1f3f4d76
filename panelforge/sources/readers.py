"""Tables from CSV, JSON records, run folders, literals and column files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Expected inputs, so that no scan infers types.
STATIONS = "station_id string, date date, salinity_max double, salinity_min double, lat double, lon double, source_type string"
RESIDUALS = "station_id string, date date, lon_first double, lat_first double, salinity_max_mean double, pred_ridge_gl double, residual_gl double"
FORECASTS = "station_id string, target_date date, target string, input_start date, input_end date, split string, y_true double, y_pred double, error double, abs_error double"
RUN_METRICS = "best_epoch long, best_val_rmse double, val struct<rmse:double,mae:double,r2:double>, test struct<rmse:double,mae:double,r2:double>, elapsed_seconds double, n_features long"


def read_csv(spark: SparkSession, path: str, schema: str, dates: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with a header; blanks are null, and quotes inside quoted cells are doubled."""
    return spark.read.schema(schema).options(header=True, escape='"', dateFormat=dates, nullValue="").csv(path)


def read_csv_text(spark: SparkSession, path: str, dates: list[str]) -> DataFrame:
    """CSV read as text with the named columns cast to dates afterwards (unparsable: null)."""
    df = spark.read.options(header=True, escape='"').csv(path)
    return df.withColumns({c: F.col(c).try_cast("date") for c in dates})


def read_record(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One JSON document for each file; fields that older files lack are null."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_runs(spark: SparkSession, pattern: str, schema: str = RUN_METRICS) -> DataFrame:
    """JSON records of many run folders with run_id, the name of the folder that holds each file."""
    df = read_record(spark, pattern, schema)
    return df.select(F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1).alias("run_id"), "*")


def with_horizon(runs: DataFrame, *horizons: int, column: str = "horizon") -> DataFrame:
    """The runs whose record names one of the horizons."""
    return runs.where(F.col(column).isin(*horizons))


def stations(spark: SparkSession, rows: list[tuple[str, float, float]]) -> DataFrame:
    """An inline table of places."""
    return spark.createDataFrame(rows, "station_id string, lon double, lat double")


def coordinates(df: DataFrame, cell: str) -> DataFrame:
    """lat and lon from one "lat, lon" cell."""
    part = F.split(F.col(cell), ",")
    return df.withColumns({"lat": F.trim(F.get(part, F.lit(0))).try_cast("double"), "lon": F.trim(F.get(part, F.lit(1))).try_cast("double")}).drop(cell)


def station_key(name):
    """Spelling-independent station key: upper case without separators."""
    return F.upper(F.regexp_replace(name, r"[_\s-]", ""))


def read_if_present(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A CSV source that may be missing; asked through Hadoop's file system, so remote paths work."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(target)
    return read_csv(spark, path, schema) if found else None
