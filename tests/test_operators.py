"""Small frames for edge cases: gaps, nulls, ties, empty tables, refused contracts, leakage."""

import datetime as dt
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import scalars as S
from panelforge.models import boosting, linear, trees
from panelforge.models import forecast
from panelforge.models.network import Network
from panelforge.operators import checks, columns, kriging, panel, rollup, spatial, splits, stats, windows
from panelforge.sources import readers, sinks


def d(day):
    return dt.date(2024, 1, day)


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, d(i + 1), v) for i, v in enumerate(values)], "k string, day date, v double")


def test_fill_is_causal_and_bounded(spark):
    df = series(spark, [None, 1.0, None, None, None, None, 2.0])
    rows = panel.causal_features(df, ["k"], "day", "v", 3).orderBy("day").collect()
    assert [r.filled for r in rows] == [None, 1.0, 1.0, 1.0, 1.0, None, 2.0]
    assert [r.days_since for r in rows] == [9999, 0, 1, 2, 3, 4, 0]
    assert [r.imputed for r in rows] == [0, 0, 1, 1, 1, 0, 0]
    changed = series(spark, [None, 1.0, None, None, 9.0, 9.0, 9.0])
    again = panel.causal_features(changed, ["k"], "day", "v", 3).orderBy("day").collect()
    assert [r.filled for r in again[:4]] == [r.filled for r in rows[:4]]  # the future does not leak


def test_range_qc(spark):
    rows = spark.createDataFrame([(1, 50.0, 1.0), (2, 50.01, 1.0), (3, 3.0, 4.0), (4, 3.0, -0.1), (5, None, 2.0), (6, None, None)], "i int, high double, low double")
    out = {r.i: (r.qc_invalid, r.high, r.low) for r in panel.range_qc(rows, "high", "low", 0.0, 50.0).collect()}
    assert out == {1: (0, 50.0, 1.0), 2: (1, None, 1.0), 3: (1, None, None), 4: (0, 3.0, None), 5: (0, None, 2.0), 6: (0, None, None)}


def test_densify_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "k string, day date, v double")
    assert panel.densify(empty, ["k"], "day").count() == 0
    df = spark.createDataFrame([("a", d(1), 1.0, "x"), ("b", d(3), 2.0, None)], "k string, day date, v double, extra string")
    out = panel.densify(df, ["k"], "day")
    assert out.count() == 6 and out.columns == ["k", "day", "v", "extra"]


def test_contracts(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, v double")
    with pytest.raises(ValueError, match="missing"):
        checks.require_columns(df, ["k", "w"])
    with pytest.raises(ValueError, match="duplicate"):
        checks.require_unique(df, ["k"])
    with pytest.raises(ValueError, match="coordinates"):
        checks.require_one_coordinate(df.withColumn("lat", F.lit(0.0)), "k", "v", "lat")


def test_joins_fail_on_repeated_keys_without_jobs_of_their_own(spark):
    fine, twice = spark.createDataFrame([(1, 1.0), (None, 2.0)], "k int, v double"), spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, v double")
    assert checks.join_one_to_one(fine, fine.withColumnRenamed("v", "w"), ["k"]).count() == 2
    assert checks.join_many_to_one(twice.withColumnRenamed("k", "own"), fine.withColumnRenamed("v", "w"), ["own"], ["k"]).columns == ["own", "v", "w"]
    for bad in (checks.join_one_to_one(fine, twice, ["k"]), checks.join_one_to_one(twice, fine, ["k"]), checks.join_many_to_one(fine, twice, ["k"], ["k"]), checks.once(fine.unionByName(fine), ["k"])):
        with pytest.raises(Exception, match="duplicate key"):
            bad.collect()


def test_ensemble_of_frames(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "k int, p double")
    a, b, c = frame((1, 1.0), (2, 2.0), (3, 3.0), (None, 9.0)), frame((1, 3.0), (2, None)), frame((1, 5.0), (2, 1.0), (3, 1.0))
    got = {tuple(r) for r in stats.ensemble([a, b, c], ["k"], "p").collect()}
    assert got == {(1, 1.0, 3.0, 5.0, 3.0), (2, 2.0, None, 1.0, None)}
    with pytest.raises(Exception, match="duplicate key"):
        stats.ensemble([a, frame((1, 3.0), (1, 4.0))], ["k"], "p").collect()


@pytest.mark.parametrize("folds", [1, 2, 3, 5, 8])
def test_fold_cycles_equal_one_by_one(folds):
    import heapq

    rng = np.random.default_rng(folds)
    for _ in range(200):
        sizes = sorted({int(s): int(m) for s, m in zip(rng.integers(1, 40, 6), rng.integers(1, 30, 6), strict=True)}.items(), reverse=True)
        heap, want = [(0, f) for f in range(folds)], []
        for size, many in sizes:
            for _ in range(many):
                load, f = heapq.heappop(heap)
                heapq.heappush(heap, (load + size, f))
                want.append(f)
        turns, got = splits.fold_cycles(sizes, folds), []
        assert len(turns) <= len(sizes) * (folds + 1)
        for size, many in sizes:
            mine = [t for t in turns if t[0] == size]
            for rank in range(many):
                _, first, turn = max((t for t in mine if t[1] <= rank), key=lambda t: t[1])
                got.append(turn[(rank - first) % len(turn)])
        assert got == want


def test_nearest_donor_ties(spark):
    donors = spark.createDataFrame([("b", 1.0, 0.0), ("a", -1.0, 0.0)], "s string, x double, y double")
    gone = spark.createDataFrame([("z", 0.0, 0.0)], donors.schema)
    assert panel.nearest_donor(gone, donors, "s", "x", "y").first().donor_key == "a"
    series_ = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "s string, v double")
    out = panel.fill_from_donor(series_, panel.nearest_donor(gone, donors, "s", "x", "y").select("s", "donor_key"), "s").collect()
    assert {(r.s, r.v, r.imputed_from) for r in out} == {("a", 1.0, None), ("b", 2.0, None), ("z", 1.0, "a")}


def test_sequences_keep_nulls_and_drop_short(spark):
    out = windows.sequences(series(spark, [1.0, None, 3.0, 4.0, 5.0]), ["k"], "day", ["v"], "v", 3, 1).orderBy("input_end").collect()
    assert [[s.v for s in r.sequence] for r in out] == [[1.0, None, 3.0], [None, 3.0, 4.0]]
    assert [r.target for r in out] == [4.0, 5.0] and all(r.target_date > r.input_end for r in out)


def test_terciles_match_quantile_edges(spark):
    for n, want in ((1, [1, 0, 0]), (4, [1, 1, 2]), (5, [2, 1, 2]), (6, [2, 2, 2]), (7, [2, 2, 3])):
        df = spark.createDataFrame([(i, float(i // 2)) for i in range(n)], "i int, v double")
        got = {r.tercile: r["count"] for r in stats.terciles(df, "v", "i").groupBy("tercile").count().collect()}
        assert [got.get(x, 0) for x in ("near", "mid", "far")] == want


def test_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (None, 5.0), (3.0, None)], "t double, g double")
    r = stats.regression_scores("t", "g")(df).first()
    assert (r.n, r.mae, r.bias) == (2, 0.5, 0.5) and r.rmse >= abs(r.bias) and r.r2 <= 1
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], df.schema)
    assert stats.regression_scores("t", "g")(flat).first().r2 is None
    assert stats.regression_scores("t", "g")(df.where("false")).first().n == 0
    clipped = stats.regression_scores("t", "g", log_r2=True)(spark.createDataFrame([(0.0, -5.0), (1.0, 1.0)], df.schema)).first()
    assert clipped.rmse == 0 and clipped.r2 == 1


def test_spearman_with_ties(spark):
    rows = [(1.0, 1.0), (2.0, 1.0), (2.0, 3.0), (4.0, 2.0), (None, 9.0), (5.0, None)]
    got = stats.spearman_table(spark.createDataFrame(rows, "x double, t double"), "t", ["x"]).first()
    assert got.n == 4 and math.isclose(got.spearman, np.corrcoef([1, 2.5, 2.5, 4], [1.5, 1.5, 4, 3])[0, 1])


def test_rollup(spark):
    df = spark.createDataFrame([("a", None, 1.0, 1.0, True), ("a", None, 3.0, 4.0, None), ("b", 2.0, None, None, False)], "k string, rain_sum double, t_mean double, i_median_week double, ok boolean")
    out = {r.k: r for r in rollup.rollup(df, ["k"], {}, "ok", 1).collect()}
    assert (out["a"].rain_sum, out["a"].t_mean, out["a"].i_median_week, out["a"].n_reliable, out["a"].mean_reliable) == (0.0, 2.0, 2.5, 1, True)
    assert (out["b"].rain_sum, out["b"].t_mean, out["b"].n_reliable, out["b"].mean_reliable) == (2.0, None, 0, False)
    assert df.agg(rollup.mode_or("ok_text")).first()[0] == "unknown" if "ok_text" in df.columns else True


def test_scalars(spark):
    row = spark.sql("select 25.0D a, cast(null as double) n, '1,5' c, double('inf') inf, 7 part, 16 whole")
    out = row.select(
        S.bins_right_closed(F.col("a"), [25, 50], ["x", "y", "z"]).alias("bin"), S.bins_right_closed(F.col("n"), [25, 50], ["x", "y", "z"]).alias("none"), S.clip(F.col("n"), 0, 1).alias("clip"), S.decimal_comma(F.col("c")).alias("comma"), S.finite(F.col("inf")).alias("fin"), S.safe_percent(F.col("part"), F.col("whole")).alias("pct"), S.safe_percent(F.col("part"), F.lit(0)).alias("zero"), S.row_mean(["n"]).alias("mean"), S.three_way_weight(F.lit(None).cast("boolean")).alias("w"),
    ).first()
    assert tuple(out) == ("x", None, None, 1.5, None, 43.75, 0.0, None, 0.5)


def test_idw_rules(spark):
    anchors = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, 3.0), (3.0, 4.0, 10.0)], "x_km double, y_km double, v double")
    queries = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.0)], "q int, x_km double, y_km double")
    near = spatial.neighbours(queries, anchors, "q", "v", 3)
    out = {r.q: r.e for r in spatial.idw(near, "q", "e").collect()}
    assert out[1] == 2.0 and 1.0 <= out[2] <= 10.0
    assert spatial.neighbours(queries, anchors.where("false"), "q", "v", 3).count() == 0
    old, spatial.BLOCK = spatial.BLOCK, 1
    try:
        blocked = {(r.q, r.distance, r.value) for r in spatial.neighbours(queries, anchors, "q", "v", 2).collect()}
    finally:
        spatial.BLOCK = old
    assert blocked == {(r.q, r.distance, r.value) for r in spatial.neighbours(queries, anchors, "q", "v", 2).collect()}


# Places and residuals of a month's stations, the median latitude of a map's cells, and six of its cells with
# their interpolated residual, nearest distance and zone.
_ANCHORS = [(106.47543, 10.638366, -1.2975798640956184), (106.249944, 10.06275, 0.2353733265733839), (106.583344, 10.477281, 6.690667947234068), (106.114142, 9.75845, 0.0033524007626395), (106.074472, 9.734864, -1.022343801186392), (106.44775, 9.883374, 4.107195480931925), (106.307139, 9.996667, 0.7271413976173506), (106.425759, 10.539013, -2.253818172285089), (106.243158, 9.614764, 5.707310364825307), (106.201456, 9.528211, 8.187300160647059), (106.354472, 9.975806, -0.2463439823120694), (106.19173, 10.658176, -1.6408241890941353)]
_CELLS_LAT0 = 9.993165354294316
_CELLS = [(106.070250287076, 9.429347436358446, 4.749093936693975, 18.26462867422205, 'near_0_25km'), (106.1165226350651, 9.655283351400929, 1.6460878280728175, 9.821228674807896, 'near_0_25km'), (106.07287259860249, 10.24322367234552, 0.0032436341399601, 28.01325419980063, 'medium_25_50km'), (106.48367784804068, 10.241609217439828, 1.3001341914430995, 28.35350315272216, 'medium_25_50km'), (105.20459274161078, 8.797765858288594, 2.515698511668266, 136.09189329877265, 'far_over_50km'), (104.97726465766254, 8.843046632135355, 2.4240267574911742, 154.3313881932021, 'far_over_50km')]


def test_idw_of_a_known_map(spark):
    """Cells of a published map, computed again from its anchors."""
    anchors = spatial.project(spark.createDataFrame(_ANCHORS, "lon double, lat double, residual double"), "lon", "lat")
    places = [(i, c[0] * spatial.KM_LON * math.cos(math.radians(_CELLS_LAT0)), c[1] * spatial.KM_LAT) for i, c in enumerate(_CELLS)]
    cells = spark.createDataFrame(places, "cell int, x_km double, y_km double")
    nearest = {r.cell: (r.distance, r.zone) for r in spatial.neighbours(cells, anchors, "cell", "residual", 1).withColumn("zone", spatial.zone(F.col("distance"))).collect()}
    assert all(abs(nearest[i][0] - c[3]) < 1e-9 and nearest[i][1] == c[4] for i, c in enumerate(_CELLS))
    worst = []
    for n, power in ((12, 2.0), (8, 2.0), (5, 2.0), (12, 1.0)):
        got = {r.cell: r.e for r in spatial.idw(spatial.neighbours(cells, anchors, "cell", "residual", n), "cell", "e", power).collect()}
        worst.append(max(abs(got[i] - c[2]) for i, c in enumerate(_CELLS)))
    assert min(worst) < 1e-9


def test_within_radius_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-2, 2, (60, 2)))]
    p = spark.createDataFrame(pts, "i int, x double, y double")
    r = spark.createDataFrame([(i, x, y) for i, x, y in pts[:7]], "j int, x double, y double")
    got = {(t.i, t.j) for t in spatial.within_radius(p, r, 0.7).select("i", "j").collect()}
    assert got == {(i, j) for i, x, y in pts for j, u, v in pts[:7] if (x - u) ** 2 + (y - v) ** 2 <= 0.49}


def test_folds_are_disjoint_and_balanced(spark):
    df = spark.createDataFrame([(g, 2020 + i % 4) for g in range(7) for i in range(g + 4)], "g int, year int")
    folds = splits.group_folds(df, "g", 3)
    assert folds.groupBy("g").count().where("count > 1").count() == 0
    y = F.col("year")
    parts = splits.fold_parts(df, folds, "g", 3, y < 2022, y == 2022, y == 2023)
    both = parts.where("part = 'test'").select("fold", "g").join(parts.where("part != 'test'").select("fold", "g"), ["fold", "g"])
    assert both.count() == 0
    with pytest.raises(ValueError):
        splits.group_folds(df, "g", 8)


def test_ridge_leave_one_out_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 2))
    y = np.exp(x @ [0.3, -0.2] + rng.normal(size=40) * 0.1 + 1)
    rows = [(float(a), None if i % 9 == 0 else float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    m = linear.ridge(df, ["a", "b"], "y")
    assert m.scaler.indicators == ["b"]
    z = np.array([r[0] for r in m.scaler.transform(df).select("scaled").collect()])
    t = np.log1p(np.array([r[2] for r in rows]))

    def loo(alpha):
        total = 0.0
        for i in range(len(z)):
            keep = np.arange(len(z)) != i
            u = z[keep] - z[keep].mean(0)
            w = np.linalg.solve(u.T @ u + alpha * np.eye(z.shape[1]), u.T @ (t[keep] - t[keep].mean()))
            total += (t[i] - t[keep].mean() - (z[i] - z[keep].mean(0)) @ w) ** 2
        return total

    alphas = np.logspace(-3, 4, 40)
    best = min(map(loo, alphas))
    assert loo(m.alpha) <= best * 1.001
    guess = np.array([r[0] for r in df.select(m.predict()).collect()])
    w = np.linalg.solve(z.T @ z + m.alpha * np.eye(z.shape[1]), z.T @ (t - t.mean()))
    assert np.allclose(guess, np.expm1(z @ w + t.mean()))


@pytest.mark.parametrize("delta", [1.0, None])
def test_network_gradient(delta):
    net, rng = Network(3, 2, 4, 5, 3, 4, 2), np.random.default_rng(3)
    x, c, e, y = rng.normal(size=(6, 5, 3)), rng.normal(size=(6, 2)), np.array([0, 1, 1, 2, 3, 0]), rng.normal(size=6) * 2
    g, loss = net.gradient(x, c, e, y, delta=delta)
    for k, v in net.p.items():
        for at in {tuple(0 for _ in v.shape), tuple(n - 1 for n in v.shape)}:
            v[at] += 1e-6
            up = net.gradient(x, c, e, y, delta=delta)[1]
            v[at] -= 2e-6
            down = net.gradient(x, c, e, y, delta=delta)[1]
            v[at] += 1e-6
            assert math.isclose(g[k][at], (up - down) / 2e-6, rel_tol=1e-4, abs_tol=1e-7), k
    flat = net.flat()
    net.load(flat)
    assert (net.flat() == flat).all() and loss > 0


def test_network_learns_and_is_kept(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(24):
        level = rng.normal(5, 1, 40).cumsum() * 0 + 5 + (k % 3) + 2 * np.sin(np.arange(40) * 2 * np.pi / 8 + k)
        rows += [(k, f"g{k % 3}", dt.date(2024, 1, 1) + dt.timedelta(i), None if i % 13 == 5 else float(v)) for i, v in enumerate(level)]
    df = spark.createDataFrame(rows, "k int, g string, day date, v double").withColumn("place", F.col("k") % 3)
    for mode in ("direct", "residual"):
        spec = forecast.Spec(dynamic=("v",), context=("place",), entity="g", lookback=8, horizon=2, mode=mode, epochs=12, tasks=2, rate=0.02)
        fitted, windows_ = forecast.fit_network(df, ["k", "g"], "day", "v", "v", spec, "2024-01-25", "2024-01-31")
        out = forecast.predict_network(fitted, windows_, ["k", "g"]).where("split = 'test'")
        err = out.agg(F.sqrt(F.avg((F.col("y_pred") - F.col("y_true")) ** 2)), F.sqrt(F.avg((F.col("baseline") - F.col("y_true")) ** 2))).first()
        assert err[0] < 0.5 * err[1] and len(fitted.epochs) <= 13 and windows_.where("split = 'train'").count() > 300
        fitted.save(spark, str(tmp_path / mode))
        again = forecast.predict_network(forecast.Fitted.load(spark, str(tmp_path / mode)), windows_, ["k", "g"]).where("split = 'test'")
        assert sorted(again.collect()) == sorted(out.collect())


def test_column_choice(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "id int, salinity_max double, name string")
    assert columns.numeric(df, ["id"]) == ["salinity_max"]
    with pytest.raises(ValueError, match="tell the target"):
        columns.features(df, [["id", "salinity_max"]])
    assert columns.with_prefix(df, "s2_", ["id"]).columns == ["id", "s2_salinity_max", "s2_name"]
    assert columns.constants(df, scope="all").columns[0] == "scope"


def test_readers_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("A_B", d(1), 1.5, 'say "x", y'), ("C", d(2), None, None)], "station string, day date, v double, note string")
    sinks.write_csv(rows, f"{tmp_path}/csv", ["station"])
    back = readers.read_csv(spark, f"{tmp_path}/csv", "station string, day date, v double, note string")
    assert back.orderBy("station").select("station", "day", "v").collect() == rows.orderBy("station").select("station", "day", "v").collect()
    assert readers.read_csv_text(spark, f"{tmp_path}/csv", ["day"]).schema["day"].dataType.simpleString() == "date"
    for run, rmse in (("one", 1.0), ("two", None)):
        sinks.write_record({"best_epoch": 3, "best_val_rmse": rmse, "val": {"rmse": 1.0}}, f"{tmp_path}/runs/{run}/metrics.json")
    runs = readers.read_runs(spark, f"{tmp_path}/runs/*/metrics.json").orderBy("run_id").collect()
    assert [(r.run_id, r.best_val_rmse, r.elapsed_seconds) for r in runs] == [("one", 1.0, None), ("two", None, None)]
    pts = spark.createDataFrame([(105.5, 9.5, "near")], "lon double, lat double, zone string")
    sinks.write_geojson(pts, "lon", "lat", ["zone"], f"{tmp_path}/map.geojson")
    with open(f"{tmp_path}/map.geojson") as f:
        assert json.load(f)["features"][0]["geometry"]["coordinates"] == [105.5, 9.5]
    sinks.write_report("Coverage", {"Rows": rows.select("station", "v"), "Note": "text"}, f"{tmp_path}/report.md")
    with open(f"{tmp_path}/report.md") as f:
        assert "| A_B | 1.5 |" in f.read()
    assert sinks.line_chart(rows.orderBy("day"), "day", "v", "a < b").count("<polyline") == 1
    assert "<rect" in sinks.bar_chart(rows, "station", "v", "bars")
    sinks.write_parts(rows, f"{tmp_path}/parts", "station")
    assert sorted(x for x in os.listdir(f"{tmp_path}/parts") if "=" in x) == ["station=A_B", "station=C"]
    assert readers.read_if_present(spark, f"{tmp_path}/none.csv", "a int") is None
    assert rows.select(readers.station_key(F.col("station"))).first()[0] == "AB"
    with pytest.raises(ValueError):
        sinks.bounded_rows(spark.range(10), 5)
    place = spark.createDataFrame([("X", "9.5, 105.5"), ("Y", "bad")], "s string, c string")
    assert [(r.lat, r.lon) for r in readers.coordinates(place, "c").orderBy("s").collect()] == [(9.5, 105.5), (None, None)]
    errors = sinks.with_errors(spark.createDataFrame([(1.0, 3.0)], "y_true double, y_pred double")).first()
    assert (errors.error, errors.abs_error) == (2.0, 2.0)


def test_streams(spark, tmp_path):
    from panelforge.streaming.panel_stream import daily_stream, fill_stream

    def at(day, hour):
        return dt.datetime(2024, 1, day, hour)

    spark.createDataFrame([("a", at(1, 1), 1.0), ("a", at(1, 5), 4.0), ("a", at(3, 2), 2.0), ("a", at(9, 1), 7.0), ("a", at(20, 1), 0.0)], "k string, ts timestamp, v double").coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("k string, ts timestamp, v double").parquet(f"{tmp_path}/in")
    q = daily_stream(src, ["k"], "ts", "v").writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    days = spark.sql("select * from days").orderBy("day").collect()
    assert [(r.day.day, r.v, r.n) for r in days] == [(1, 4.0, 2), (3, 2.0, 1), (9, 7.0, 1)]
    spark.createDataFrame([(r.k, r.day, r.v) for r in days], "k string, day timestamp, v double").coalesce(1).write.parquet(f"{tmp_path}/days")
    src = spark.readStream.schema("k string, day timestamp, v double").parquet(f"{tmp_path}/days")
    q = fill_stream(src, "k", "day", "v").writeStream.format("memory").queryName("filled").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from filled").orderBy("day").collect()
    assert [(r.baseline, r.gap) for r in got] == [(None, None), (4.0, 2), (None, None)]


def test_utm_against_another_series(spark):
    """The classic expansion in powers of the distance from the central meridian."""
    rng = np.random.default_rng(3)
    places = [(float(a), float(b)) for a, b in zip(rng.uniform(102.5, 107.5, 20), rng.uniform(0, 40, 20), strict=True)]
    east, north = S.utm(F.col("lon"), F.col("lat"))
    got = spark.createDataFrame(places, "lon double, lat double").select("lon", "lat", east.alias("e"), north.alias("n")).collect()
    a, f, k = 6_378_137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    for r in got:
        phi, lam = np.radians(r.lat), np.radians(r.lon - 105)
        v, t, c = a / np.sqrt(1 - e2 * np.sin(phi) ** 2), np.tan(phi) ** 2, e2 / (1 - e2) * np.cos(phi) ** 2
        x = lam * np.cos(phi)
        m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * np.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * np.sin(4 * phi) - 35 * e2**3 / 3072 * np.sin(6 * phi))
        e = k * v * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * e2 / (1 - e2)) * x**5 / 120) + 500_000
        n = k * (m + v * np.tan(phi) * (x**2 / 2 + (5 - t + 9 * c + 4 * c**2) * x**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * e2 / (1 - e2)) * x**6 / 720))
        assert abs(r.e - e) < 0.01 and abs(r.n - n) < 0.01


def test_neighbours_through_cells_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 10)
    rng = np.random.default_rng(4)
    a = [(i, float(x), float(y), i % 2) for i, (x, y) in enumerate(np.concatenate((rng.normal(0, 1, (150, 2)), rng.normal(90, 2, (50, 2)))))]
    q = [(i, float(x), float(y), i % 2) for i, (x, y) in enumerate(rng.uniform(-20, 120, (60, 2)))]
    anchors, queries = spark.createDataFrame(a, "v long, x_km double, y_km double, g int"), spark.createDataFrame(q, "q long, x_km double, y_km double, g int")
    for by in ([], ["g"]):
        got = {}
        for r in spatial.neighbours(queries, anchors.withColumn("v", F.col("v")), "q", "v", 4, by).collect():
            got.setdefault(r.q, []).append((round(r.distance, 9), r.value))
        for i, x, y, g in q:
            near = sorted((round(((x - u) ** 2 + (y - w) ** 2) ** 0.5, 9), j) for j, u, w, h in a if not by or g == h)[:4]
            assert sorted(got[i]) == near


def test_kriging_modes_and_saved_trees(spark, tmp_path):
    assert kriging.fit_parts("spatial") == ("train", "val") and kriging.fit_parts("spatiotemporal") == ("train",)
    with pytest.raises(ValueError):
        kriging.fit_parts("other")
    df = spark.createDataFrame([(float(i % 7), None if i % 5 == 0 else float(i), float(i % 7) * 3 + 1) for i in range(200)], "a double, b double, y double")
    models = [trees.fit_regression(df.where(F.col("a") != i), ["a", "b"], "y", iterations=3) for i in (0, 1)]
    models[0].save(spark, str(tmp_path / "model"))
    again = trees.predict(boosting.Booster.load(spark, str(tmp_path / "model")), df).select("prediction").collect()
    assert again == trees.predict(models[0], df).select("prediction").collect()
    means = {r.feature: (r.importance, r.folds) for r in trees.fold_importances(spark, models).collect()}
    assert set(means) == {"a", "b"} and all(n == 2 for _, n in means.values()) and abs(sum(v for v, _ in means.values()) - 1) < 1e-9


def test_branches_refuse_mixed_ablations(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        columns.branches(df, ["a"], [], [], [], ["b"], no_composite=True, without_history=True)


def test_rank_correlations_move_no_pairs_to_frequent_values(spark):
    """A frequent feature value (and the three groups of means) must not gather the pairs in one task: such tables are broadcast."""
    rng = np.random.default_rng(5)
    x, t = rng.integers(0, 3, 400), rng.normal(size=400).round(2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, t, strict=True)], "x double, t double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stats.spearman_table(df, "t", ["x"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        (row,) = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert row.n == 400 and abs(row.spearman - np.corrcoef(rank(x), rank(t))[0, 1]) < 1e-12
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 3


def test_trials_of_networks_share_panel_and_windows(spark, monkeypatch):
    import datetime

    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(i)
    df = spark.createDataFrame([(k, day(i), float((k + i) % 5)) for k in range(4) for i in range(30)], "k int, day date, v double")
    written, plain = [], forecast.kept
    monkeypatch.setattr(forecast, "kept", lambda rows: written.append(rows.columns) or plain(rows))
    trials = [forecast.Spec(dynamic=("v",), lookback=n, hidden=h, epochs=1) for n, h in ((3, 2), (3, 3), (4, 2), (3, 4))]
    out = forecast.tune_networks(df, ["k"], "day", "v", "v", trials, "2024-01-15", "2024-01-22").collect()
    assert len(out) == 4 and len(written) == 3  # the panel, and windows of two lookbacks
    alone = forecast.fit_network(df, ["k"], "day", "v", "v", trials[1], "2024-01-15", "2024-01-22")[0]
    assert {r.trial: r.val_rmse for r in out}[1] == pytest.approx(min(e[2] for e in alone.epochs), rel=1e-9)
