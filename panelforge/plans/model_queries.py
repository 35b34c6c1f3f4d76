"""Models: ridge, regression kriging, boosted trees, sequence forecasts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..models import boosting, forecast, linear, trees
from ..operators import columns, kriging, stats
from ..session import shared_dir, table
from .base import KEYS, query, r6
from .panel_queries import filled_panel, rounded
from .spatial_queries import POINTS, points


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def ridge_univariate(spark, sf_dir):
    """Ridge at alpha 0 on one feature is the least-squares line."""
    m = linear.ridge(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", alphas=[0.0], log_target=False)
    slope = m.weights[0] / m.scaler.std["l_quantity"]
    return spark.createDataFrame([(round(float(slope), 6), round(m.intercept - float(slope) * m.scaler.mean["l_quantity"], 4))], "slope double, intercept double")


@query()
def ridge_loo(spark, sf_dir):
    """Coefficients of a ridge whose alpha leave-one-out error chose among 40, on the log scale."""
    rows = table(spark, sf_dir, "lineitem").withColumn("month", F.month("l_shipdate"))
    m = linear.ridge(rows, ["l_quantity", "l_discount", "l_tax", "month"], "l_extendedprice")
    return spark.createDataFrame([(n, w, m.alpha) for n, w in m.coefficients()], "feature string, weight double, alpha double")


def readings(spark, sf_dir):
    """Points as readings of 40 stations in ten months of three years; the target is positive."""
    p = points(spark, sf_dir)
    day = F.make_date(2020 + F.col("vec_id") % 3, F.col("label") + 1, F.lit(1))
    return p.select(F.col("vec_id").alias("row_id"), (F.col("vec_id") % 40).alias("station_id"), day.alias("date"), F.year(day).alias("year"), "lon", "lat", (F.abs("value") + 1).alias("y"))


_READINGS = f"""{POINTS}, readings AS (SELECT vec_id AS row_id, vec_id % 40 AS station_id, make_date(2020 + vec_id % 3, CAST(label + 1 AS BIGINT), 1) AS date, 2020 + vec_id % 3 AS year, lon, lat, abs(value) + 1 AS y FROM pts)"""
_TREND = "greatest(0.0, exp(a + b * lon) - 1)"


def _idw_sql(sides: str, by: str, k: int) -> str:
    """Columns correction and plain for each (fold, row_id) of q, from anchors a of the same fold (and day)."""
    return f"""{sides}, d AS (SELECT q.fold, q.row_id, sqrt((q.x - a.x) ** 2 + (q.y_km - a.y_km) ** 2) AS distance, a.residual, a.y FROM q JOIN a USING ({by})),
r AS (SELECT fold, row_id, sum(residual / distance ** 2) / sum(1 / distance ** 2) AS correction FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY fold, row_id ORDER BY distance, residual) <= {k}) GROUP BY 1, 2),
p AS (SELECT fold, row_id, sum(y / distance ** 2) / sum(1 / distance ** 2) AS plain FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY fold, row_id ORDER BY distance, y) <= {k}) GROUP BY 1, 2)"""


def _placed(name: str, source: str, by: str) -> str:
    return f"{name} AS (SELECT *, lon * 111.32 * cos(radians(lat0)) AS x, lat * 110.57 AS y_km FROM (SELECT *, median(lat) OVER (PARTITION BY {by}) AS lat0 FROM {source}))"


_KRIGING = f"""WITH {_READINGS}, f AS (SELECT CAST(i AS INTEGER) AS fold FROM range(1, 5) t(i)),
fit AS (SELECT fold, regr_intercept(ln(1 + y), lon) AS a, regr_slope(ln(1 + y), lon) AS b FROM readings JOIN f ON station_id % 4 + 1 <> fold GROUP BY 1),
every AS (SELECT f.fold, r.*, {_TREND} AS trend, y - {_TREND} AS residual, station_id % 4 + 1 = f.fold AS held FROM readings r CROSS JOIN f JOIN fit ON fit.fold = f.fold),
{_idw_sql(_placed('q', "(SELECT * FROM every WHERE held)", "fold, date") + ", " + _placed('a', "(SELECT * FROM every WHERE NOT held)", "fold, date"), "fold, date", 8)},
out AS (SELECT e.fold, e.row_id, e.station_id, CAST(e.date AS VARCHAR) AS date, e.y AS y_true, correction AS residual_correction, trend AS pred_ridge, plain AS pred_idw, greatest(0.0, trend + coalesce(correction, 0)) AS pred_ridge_residual_idw
FROM every e LEFT JOIN r USING (fold, row_id) LEFT JOIN p USING (fold, row_id) WHERE held)"""


def kriged(spark, sf_dir, mode="spatial", residuals=("contemporaneous",), features=("lon",), alphas=(0.0,)):
    """Held-out predictions by kind of residuals."""
    rows = readings(spark, sf_dir)
    folds = rows.select("station_id").distinct().withColumn("fold", (F.col("station_id") % 4 + 1).cast("int"))
    year = F.col("year")
    parts = (year != 2022, year == 2022, F.lit(True)) if mode == "spatial" else (year < 2021, year == 2021, year == 2022)
    return kriging.cross_validations(rows, folds, 4, list(features), "y", parts=parts, mode=mode, residuals=residuals, alphas=alphas)


_SIX = ("y_true", "residual_correction", "pred_ridge", "pred_idw", "pred_ridge_residual_idw")


@query(f"{_KRIGING} SELECT fold, row_id, station_id, date, {', '.join(f'round({c}, 6) AS {c}' for c in _SIX)} FROM out")
def regression_kriging(spark, sf_dir):
    """Held-out stations: a trend of one feature without penalty, and residuals of the same day's other stations."""
    return rounded(kriged(spark, sf_dir)["contemporaneous"].withColumn("date", F.date_format("date", "yyyy-MM-dd")), *_SIX)


@query(f"""{_KRIGING}, long AS (SELECT fold, 'ridge' AS model, y_true AS t, pred_ridge AS p FROM out UNION ALL SELECT fold, 'idw', y_true, pred_idw FROM out UNION ALL SELECT fold, 'ridge_residual_idw', y_true, pred_ridge_residual_idw FROM out)
SELECT fold, model, count(*) AS n, round(sqrt(avg((p - t) ** 2)), 6) AS rmse, round(avg(abs(p - t)), 6) AS mae, round(avg(p - t), 6) AS bias, round(1 - sum((ln(1 + p) - ln(1 + t)) ** 2) / (count(*) * var_pop(ln(1 + t))), 6) AS r2 FROM long WHERE p IS NOT NULL GROUP BY 1, 2""")
def kriging_scores(spark, sf_dir):
    """Scores of trend, interpolation and both, by fold."""
    return rounded(kriging.fold_scores(kriged(spark, sf_dir)["contemporaneous"]), "rmse", "mae", "bias", "r2")


@query()
def kriging_modes(spark, sf_dir):
    """Means over folds of penalised trends: spatial and spatiotemporal folds, residuals of the day and of the past."""
    out = []
    for mode in ("spatial", "spatiotemporal"):
        for residuals, held_out in kriged(spark, sf_dir, mode, kriging.RESIDUALS, ("lon", "lat"), None).items():
            scores = kriging.fold_scores(held_out)
            out.append(stats.fold_means(scores, ["model"], ["rmse", "mae", "bias", "r2"]).select(F.lit(mode).alias("folds_of"), F.lit(residuals).alias("residuals"), "*"))
    return reduce(lambda a, b: a.unionByName(b), out)


_MAP = f"""WITH {_READINGS}, st AS (SELECT * FROM readings WHERE row_id % 2 = 0), g AS (SELECT row_id, lon, lat, 0 AS fold FROM readings WHERE row_id % 2 = 1),
fit AS (SELECT regr_intercept(ln(1 + y), lon) AS a, regr_slope(ln(1 + y), lon) AS b FROM st WHERE date < DATE '2022-05-01'),
anchor AS (SELECT 0 AS fold, st.*, y - {_TREND} AS residual FROM st CROSS JOIN fit WHERE date_trunc('month', date) = DATE '2022-05-01'), cells AS (SELECT g.*, {_TREND} AS trend FROM g CROSS JOIN fit),
{_idw_sql(_placed('q', 'cells', 'fold') + ', ' + _placed('a', 'anchor', 'fold'), 'fold', 8)}, near AS (SELECT row_id, min(distance) AS km FROM d GROUP BY 1)
SELECT c.row_id AS grid_id, round(trend, 6) AS pred_ridge, round(correction, 6) AS residual_correction, round(greatest(0.0, trend + coalesce(correction, 0)), 6) AS pred_ridge_residual_idw, round(plain, 6) AS pred_idw, round(km, 6) AS nearest_anchor_km,
CASE WHEN km <= 25 THEN 'near_0_25km' WHEN km <= 50 THEN 'medium_25_50km' WHEN km IS NOT NULL THEN 'far_over_50km' END AS zone FROM cells c LEFT JOIN r USING (row_id) LEFT JOIN p USING (row_id) LEFT JOIN near USING (row_id)"""


@query(_MAP)
def grid_map(spark, sf_dir):
    """A map of one month: a trend of the past, residuals of the month's stations, distance zones."""
    rows = readings(spark, sf_dir)
    cells = rows.where("row_id % 2 = 1").select(F.col("row_id").alias("grid_id"), "lon", "lat")
    out, _ = kriging.map_grid(rows.where("row_id % 2 = 0"), cells, ["lon"], "y", "2022-05-01", alphas=[0.0])
    return rounded(out.drop("lon", "lat"), "pred_ridge", "residual_correction", "pred_ridge_residual_idw", "pred_idw", "nearest_anchor_km")


@query(f"""WITH {_READINGS}, st AS (SELECT * FROM readings WHERE row_id % 2 = 0) SELECT 'target_date' AS metric, '2022-05-01' AS value UNION ALL SELECT 'past_training_rows', CAST(count(*) AS VARCHAR) FROM st WHERE date < DATE '2022-05-01'
UNION ALL SELECT 'anchor_station_count', CAST(count(DISTINCT station_id) AS VARCHAR) FROM st WHERE date_trunc('month', date) = DATE '2022-05-01' UNION ALL SELECT 'grid_cells', CAST(count(*) AS VARCHAR) FROM readings WHERE row_id % 2 = 1""")
def grid_map_audit(spark, sf_dir):
    rows = readings(spark, sf_dir)
    return kriging.map_audit(rows.where("row_id % 2 = 0"), rows.where("row_id % 2 = 1"), "y", "2022-05-01")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def saved_model(spark, sf_dir):
    """A ridge written, read again, and asked for its line."""
    path = f"{shared_dir(spark)}/ridge-{uuid.uuid4().hex}"
    linear.ridge(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", alphas=[0.0], log_target=False).save(spark, path)
    at = spark.range(2).select(F.col("id").cast("double").alias("l_quantity")).select("l_quantity", linear.Ridge.load(spark, path).predict().alias("y"))
    line = at.agg(F.max(F.when(F.col("l_quantity") == 0, F.col("y"))).alias("a"), F.max(F.when(F.col("l_quantity") == 1, F.col("y"))).alias("b"))
    return line.select(F.round(F.col("b") - F.col("a"), 6).alias("slope"), F.round("a", 4).alias("intercept"))


_STUMP = """WITH r AS (SELECT CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS x, l_extendedprice AS y FROM lineitem), b AS (SELECT avg(y) AS base, var_pop(y) AS spread, count(*) AS h, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS hm FROM r),
v AS (SELECT x, sum(base - y) AS g, count(*) AS h FROM r, b GROUP BY 1), m AS (SELECT coalesce(sum(g), 0) AS gm FROM v WHERE x IS NULL),
c AS (SELECT lead(x) OVER (ORDER BY x) AS cut, sum(g) OVER (ORDER BY x) AS gl, sum(h) OVER (ORDER BY x) AS hl FROM v WHERE x IS NOT NULL),
s AS (SELECT cut, d AS missing_left, gl + d * gm AS gl, hl + d * hm AS hl, b.h - hl - d * hm AS hr, -(gl + d * gm) AS gr, spread, b.h AS h FROM c, m, b, (SELECT unnest([0, 1]) AS d)),
k AS (SELECT *, (gl * gl / (hl + 1) + gr * gr / (hr + 1)) / 2 AS gain FROM s WHERE hl >= 1 AND hr >= 1)
SELECT cut, missing_left, round(gain / (h * spread / 2), 6) AS gain_share, round(-gl / (hl + 1), 3) AS left_value, round(-gr / (hr + 1), 3) AS right_value FROM k ORDER BY gain DESC LIMIT 1"""


@query(_STUMP)
def gbt_stump(spark, sf_dir):
    """The first split of a boosted tree on a column with nulls: cut, side of the nulls, share of the variance it takes, leaves."""
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("x"), F.col("l_extendedprice").alias("y"))
    model = boosting.fit(rows, ["x"], F.col("y"), boosting.Params(rounds=1, rate=1.0, depth=1))
    tree, cuts = model.trees[0], model.cuts[0]
    cut = cuts[tree.bin[0] - 1] if tree.bin[0] <= len(cuts) else None
    spread = rows.agg((F.count("y") * F.var_pop("y") / 2).alias("s"))
    return spread.select(F.lit(cut).cast("double").alias("cut"), F.lit(1 - tree.default[0]).alias("missing_left"), r6(F.lit(tree.gain[0]) / F.col("s"), "gain_share"), F.lit(round(tree.value[1], 3)).alias("left_value"), F.lit(round(tree.value[2], 3)).alias("right_value"))


def gappy_lines(spark, sf_dir):
    """Line items with nulls in two features, as they come from sensors."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").withColumns({"month": F.month("l_shipdate"), "year": F.year("l_shipdate")})
    return rows.withColumns({"l_quantity": F.when(c("l_linenumber") % 5 != 0, c("l_quantity")), "l_tax": F.when(c("l_suppkey") % 4 != 0, c("l_tax"))})


_INPUTS = ["l_quantity", "l_discount", "l_tax", "month"]


@query()
def gbt_regression(spark, sf_dir):
    """Boosted regression trees on line items with nulls left in, stopped early on one year, scored on the last."""
    rows, year = gappy_lines(spark, sf_dir), F.col("year")
    model = trees.fit_regression(rows.where(year < 2000), _INPUTS, "l_extendedprice", rows.where(year == 2000), iterations=200, rate=0.1, patience=10)
    return stats.regression_scores("l_extendedprice", "prediction", log_r2=True)(trees.predict(model, rows.where(year > 2000), log_target=True))


@query()
def gbt_importance(spark, sf_dir):
    """Feature importances of regression trees: mean gains of splits."""
    return trees.importances(spark, trees.fit_regression(gappy_lines(spark, sf_dir), _INPUTS, "l_extendedprice", iterations=30, rate=0.1))


@query()
def gbt_classifier(spark, sf_dir):
    """Weighted boosted classification of expensive lines, as precision, recall and F1."""
    rows = gappy_lines(spark, sf_dir).withColumns({"label": (F.col("l_extendedprice") >= 50000).cast("double"), "weight": F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.4)})
    model = trees.fit_classifier(rows.where("year < 2000"), ["l_quantity", "l_discount", "l_tax"], "label", "weight", iterations=30, rate=0.1)
    scored = trees.predict(model, rows.where("year >= 2000"))
    return scored.agg(*stats.classification_scores(F.col("label") == 1, F.col("prediction") == 1))


@query()
def sequence_model(spark, sf_dir):
    """Ridge on the flattened window of seven days against last-value persistence, by part of the target date."""
    return forecast.compare(filled_panel(spark, sf_dir).select(*KEYS, "day", "filled", "value"), KEYS, "day", "filled", "value", 7, 3, "2024-01-18", "2024-01-24")


def series_panel(spark, sf_dir):
    """The panel with its calendar, for networks."""
    rows = filled_panel(spark, sf_dir).select(*KEYS, "day", "filled", "value", "observed", "imputed", "days_since")
    return rows.withColumns({"week_sin": F.sin(F.dayofweek("day") * (6.283185307179586 / 7)), "week_cos": F.cos(F.dayofweek("day") * (6.283185307179586 / 7)), "user_part": F.col("user_id") % 10})


@query()
def lstm_model(spark, sf_dir):
    """An LSTM over seven days with an embedding of the event type, trained on all windows; direct prediction."""
    spec = forecast.Spec(dynamic=("filled", "imputed", "days_since"), entity="event_type", epochs=6)
    return forecast.network_scores(series_panel(spark, sf_dir), KEYS, "day", "filled", "value", spec, "2024-01-18", "2024-01-24")


@query()
def multi_branch_model(spark, sf_dir):
    """A dynamic and a context branch with an embedding, fused; the change from the last valid value is predicted."""
    df = series_panel(spark, sf_dir)
    dynamic, context, mode = columns.branches(df, ["filled", "imputed", "days_since"], ["week_sin", "week_cos"], ["observed"], ["user_part"], ["week_sin", "week_cos"])
    spec = forecast.Spec(dynamic=tuple(dynamic), context=tuple(context), entity="event_type", mode=mode, dropout=0.1, epochs=6)
    return forecast.network_scores(df, KEYS, "day", "filled", "value", spec, "2024-01-18", "2024-01-24")


@query()
def network_tuning(spark, sf_dir):
    """Eight trials of a network, the least validation error first."""
    trials = [forecast.Spec(dynamic=("filled", "days_since"), entity="event_type", lookback=n, hidden=h, rate=r, dropout=d, epochs=3) for n, h, r, d in ((5, 8, 0.01, 0.0), (7, 8, 0.01, 0.0), (10, 8, 0.01, 0.0), (7, 16, 0.01, 0.0), (7, 16, 0.003, 0.0), (7, 16, 0.01, 0.2), (10, 16, 0.01, 0.1), (5, 16, 0.003, 0.0))]
    return forecast.tune_networks(series_panel(spark, sf_dir), KEYS, "day", "filled", "value", trials, "2024-01-18", "2024-01-24")


@query()
def tuning_table(spark, sf_dir):
    """Trials of ridge strength and lookback, best validation error first."""
    panel_rows = filled_panel(spark, sf_dir).select(*KEYS, "day", "filled", "value")
    return forecast.tune(panel_rows, KEYS, "day", "filled", "value", [(5, 1.0), (7, 1.0), (7, 100.0)], 3, "2024-01-18", "2024-01-24")


@query("SELECT label, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS mean FROM embeddings GROUP BY 1")
def label_means(spark, sf_dir):
    return rounded(points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.avg("lon").alias("mean")), "mean")


