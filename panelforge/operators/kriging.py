"""Ridge trend plus inverse-distance residuals: cross-validated by folds of stations, and as a map of a grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..models.linear import Ridge, ridge, ridges
from ..session import kept
from . import spatial, stats
from .splits import fold_parts

#: Names of the three predictions.
MODELS = ("ridge", "idw", "ridge_residual_idw")
#: Kinds of residuals: of the same day, and means of the past.
RESIDUALS = ("contemporaneous", "historical")


def not_negative(x: Column) -> Column:
    return F.when(x < 0, 0.0).otherwise(x)


def fit_parts(mode: str) -> tuple[str, ...]:
    """Parts that a trend is fitted on: all rows of other stations in spatial folds, only the past in spatiotemporal ones."""
    known = {"spatial": ("train", "val"), "spatiotemporal": ("train",)}
    if mode not in known:
        raise ValueError(f"unknown mode {mode}; one of {sorted(known)}")
    return known[mode]


def past_only(day: str, target_day: str) -> Column:
    return F.col(day) < F.lit(target_day).cast("date")


def station_means(rows: DataFrame, station: str, order: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, station, lon, lat, values): each station's means, at the place of its first row."""
    first = lambda c: F.min_by(c, order).alias(c)
    return rows.groupBy(*(by or []), station).agg(first("lon"), first("lat"), *[F.avg(v).alias(v) for v in values])


def _corrected(queries: DataFrame, anchors: DataFrame, row: str, target: str, k: int, power: float, by: list[str], nearest: str | None = None) -> DataFrame:
    """queries (with pred_ridge) with residual_correction, pred_idw and pred_ridge_residual_idw from anchors (with residual_).

    Anchors are of the same group as the query, and each side is projected around its own median latitude there; a
    query is told apart by its row and group. One search serves both means, and the nearest anchor's distance if it has a name.
    """
    q, a = (spatial.project(df, "lon", "lat", by or None) for df in (queries, anchors))
    means = spatial.idws(q, a, row, {"residual_": "residual_correction", target: "pred_idw"}, k, power, by, nearest)
    out = queries.join(means, [row, *by], "left")
    return out.withColumn("pred_ridge_residual_idw", not_negative(F.col("pred_ridge") + F.coalesce("residual_correction", F.lit(0.0))))


def cross_validate(
    rows: DataFrame,
    folds: DataFrame,
    n_folds: int,
    features: list[str],
    target: str,
    row: str = "row_id",
    station: str = "station_id",
    day: str = "date",
    reliable: Column | None = None,
    parts: tuple[Column, Column, Column] | None = None,
    mode: str = "spatial",
    residuals: str = "contemporaneous",
    k: int = 8,
    power: float = 2.0,
    alphas=None,
) -> DataFrame:
    """(fold, row, station, day, y_true, residual_correction, pred_ridge, pred_idw, pred_ridge_residual_idw) of every fold's test rows.

    rows: one row for each station and day with lon and lat and a unique `row`; folds: (station, fold);
    parts: conditions of train, val and test rows. The trend is clipped at 0 before residuals are taken.
    Contemporaneous residuals come from reliable rows of other stations on the same day; historical ones
    from the mean residual of each station that the trend was fitted on. A missing correction counts as 0.
    """
    return cross_validations(rows, folds, n_folds, features, target, row, station, day, reliable, parts, mode, (residuals,), k, power, alphas)[residuals]


def cross_validations(rows, folds, n_folds, features, target, row="row_id", station="station_id", day="date", reliable=None, parts=None, mode="spatial", residuals=RESIDUALS, k=8, power=2.0, alphas=None) -> dict[str, DataFrame]:
    """cross_validate() for several kinds of residuals, by kind: the folds are cut and the trends fitted once."""
    if unknown := set(residuals) - set(RESIDUALS):
        raise ValueError(f"unknown residuals {sorted(unknown)}")
    fine = F.lit(True) if reliable is None else reliable
    train, valid, test = parts or (F.lit(True), F.lit(False), F.lit(True))
    known = rows.where(fine & F.col(target).isNotNull())
    split = kept(fold_parts(known, folds, station, n_folds, train, valid, test, require=("train", "test") if parts is None else ("train", "val", "test")))
    fit = split.where(F.col("part").isin(*fit_parts(mode)))
    models = ridges(fit, "fold", features, target, alphas)
    trend = reduce(lambda rest, f: F.when(F.col("fold") == f, not_negative(models[f].predict())).otherwise(rest), models, F.lit(None).cast("double"))
    queries = split.where("part = 'test'").withColumn("pred_ridge", trend)
    out = {}
    for kind in residuals:
        if kind == "contemporaneous":
            own = known.join(folds.select(station, F.col("fold").alias("own_")), station, "left").withColumn("fold", F.explode(F.array(*map(F.lit, sorted(models)))))
            anchors = own.where(~F.col("own_").eqNullSafe(F.col("fold"))).drop("own_").withColumn("residual_", F.col(target) - trend)
            done = _corrected(queries, kept(anchors), row, target, k, power, ["fold", day])
        else:
            past = fit.withColumn("residual_", F.col(target) - trend)
            both = station_means(past, station, day, ["residual_", target], ["fold"])
            done = _corrected(queries, kept(both), row, target, k, power, ["fold"])
        out[kind] = done.select("fold", row, station, day, F.col(target).alias("y_true"), "residual_correction", "pred_ridge", "pred_idw", "pred_ridge_residual_idw")
    return out


def fold_scores(predictions: DataFrame) -> DataFrame:
    """(fold, model, n, rmse, mae, bias, r2) of cross_validate's models; r2 on the log scale."""
    long = predictions.select("fold", "y_true", *[F.col(f"pred_{m}").alias(m) for m in MODELS]).unpivot(["fold", "y_true"], list(MODELS), "model", "guess")
    return stats.regression_scores("y_true", "guess", ["fold", "model"], log_r2=True)(long)


def map_grid(stations: DataFrame, grid: DataFrame, features: list[str], target: str, target_day: str, cell: str = "grid_id", day: str = "date", k: int = 8, power: float = 2.0, alphas=None) -> tuple[DataFrame, Ridge]:
    """(cell, lon, lat, pred_ridge, residual_correction, pred_ridge_residual_idw, pred_idw, nearest_anchor_km, zone) of a grid on a day, and the trend.

    The trend is fitted on stations before the day only; the anchors are the stations of its month, and
    without any the map is an error.
    """
    known = stations.where(F.col(target).isNotNull())
    model = ridge(known.where(past_only(day, target_day)), features, target, alphas)
    month = lambda c: F.trunc(c, "month")
    anchors = kept(known.where(month(F.col(day)) == month(F.lit(target_day).cast("date"))).withColumn("residual_", F.col(target) - not_negative(model.predict())))
    if anchors.isEmpty():
        raise ValueError(f"no station has a value in the month of {target_day}")
    cells = grid.withColumn("pred_ridge", not_negative(model.predict()))
    out = _corrected(cells, anchors, cell, target, k, power, [], "nearest_anchor_km")
    shown = out.select(cell, "lon", "lat", "pred_ridge", "residual_correction", "pred_ridge_residual_idw", not_negative(F.col("pred_idw")).alias("pred_idw"), "nearest_anchor_km", spatial.zone(F.col("nearest_anchor_km")).alias("zone"))
    return shown, model


def map_audit(stations: DataFrame, grid: DataFrame, target: str, target_day: str, station: str = "station_id", day: str = "date") -> DataFrame:
    """(metric, value): the day, rows that the trend is fitted on, stations that anchor it, and cells."""
    known = F.col(target).isNotNull()
    same = F.trunc(F.col(day), "month") == F.trunc(F.lit(target_day).cast("date"), "month")
    own = stats.key_values(stations, target_date=F.max(F.lit(target_day)), past_training_rows=F.count_if(known & past_only(day, target_day)), anchor_station_count=F.count_distinct(F.when(known & same, F.col(station))))
    return own.unionByName(stats.key_values(grid, grid_cells=F.count("*")))
