"""Polygon regions and distances from lines against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import regions, spatial


def brute_inside(x, y, rings):
    odd = False
    for r in rings:
        for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1], strict=True):
            if (x0, y0) == (x1, y1):
                continue
            if (x1 - x0) * (y - y0) == (y1 - y0) * (x - x0) and min(x0, x1) <= x <= max(x0, x1) and min(y0, y1) <= y <= max(y0, y1):
                return True
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                odd = not odd
    return odd


RINGS = "region long, rings array<array<struct<x:double,y:double>>>"


@pytest.mark.parametrize("step", [0.37, 1.0, 2.5, 40.0])
def test_points_in_polygons_equal_brute_force(spark, step):
    """Stars, boxes on the grid with a hole, a closed ring, and places on edges, corners and in holes."""
    rng = np.random.default_rng(int(step * 100))
    shapes = {0: [[(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 2), (4, 2), (4, 4), (2, 4)]], 1: [[(1, 1), (3, 5), (5, 1), (1, 1)]]}
    for k in range(2, 9):
        angle, middle = np.sort(rng.random(9)) * 2 * np.pi, rng.uniform(-8, 8, 2)
        shapes[k] = [[(float(middle[0] + r * np.cos(a)), float(middle[1] + r * np.sin(a))) for a, r in zip(angle, rng.uniform(0.5, 5, 9), strict=True)]]
    places = [(float(a), float(b)) for a, b in rng.uniform(-12, 12, (400, 2))] + [(float(a), float(b)) for a in range(-1, 8) for b in range(-1, 8)] + [(2.0, 3.0), (3.0, 5.0)]
    points = spark.createDataFrame([(i, *p, "kept") for i, p in enumerate(places)], "id long, x double, y double, cx string")
    frame = spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in v]) for k, v in shapes.items()], RINGS)
    got = sorted((r.region, r.id) for r in regions.points_in(points, frame, "region", step).collect())
    assert got == sorted((k, i) for k, v in shapes.items() for i, p in enumerate(places) if brute_inside(*p, [[(float(a), float(b)) for a, b in r] for r in v]))


def test_odd_regions_and_places(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 0.5), (3, float("nan"), 0.5), (4, float("inf"), 0.5)], "id long, x double, y double")
    box = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]
    frame = spark.createDataFrame([(1, [box, [], None]), (2, None), (3, []), (4, [[box[0]]]), (5, [[box[0], None, box[1]]]), (6, [[box[0], box[0]]])], RINGS)
    assert [(r.region, r.id) for r in regions.points_in(points, frame, "region", 0.3).collect()] == [(1, 1)]
    assert regions.points_in(points, frame.where("false"), "region", 0.3).count() == 0
    assert regions.points_in(points.where("false"), frame, "region", 0.3).count() == 0


def test_only_border_cells_carry_edges_and_no_other_cell_is_met(spark):
    box = [{"x": 0.1, "y": 0.1}, {"x": 9.9, "y": 0.1}, {"x": 9.9, "y": 9.9}, {"x": 0.1, "y": 9.9}]
    cells = regions.cover(spark.createDataFrame([(1, [box])], RINGS), "region", 1.0).collect()
    assert {(r.cx, r.cy) for r in cells} == {(i, j) for i in range(10) for j in range(10)} and len(cells) == 100
    assert sum(r.edges is None for r in cells) == 64
    assert max(len(r.edges) for r in cells if r.edges is not None) <= 3


@pytest.mark.parametrize("cap", [3, 10, 32])
def test_cell_distances_equal_brute_force(spark, cap):
    rng = np.random.default_rng(cap)
    marks = np.unique(rng.integers(-50, 50, (40, 2)), axis=0)
    cells = np.unique(rng.integers(-70, 70, (500, 2)), axis=0)
    frame = lambda a: spark.createDataFrame([(int(x), int(y)) for x, y in a], "cx long, cy long")
    got = {(r.cx, r.cy): r.distance for r in regions.cell_distances(frame(np.repeat(marks, 2, 0)), frame(np.repeat(cells, 2, 0)), cap).collect()}
    far = np.sqrt(((cells[:, None] - marks[None]) ** 2).sum(2)).min(1)
    assert got == {(int(x), int(y)): min(float(d), float(cap)) for (x, y), d in zip(cells, far, strict=True)}
    assert {r.distance for r in regions.cell_distances(frame(marks).where("false"), frame(cells), cap).collect()} == {float(cap)}


def test_lines_to_distances(spark):
    lines = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}])], "id long, path array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 5.2, 0.3), (2, 5.2, 4.1), (3, 30.0, 0.0), (4, None, 1.0)], "p long, x double, y double")
    got = {r.p: r.distance for r in regions.line_distances(points, lines, "id", "path", 2.0, 4).select("p", F.round("distance", 9).alias("distance")).collect()}
    assert got == {1: 0.0, 2: 4.0, 3: 8.0, 4: None}


@pytest.mark.parametrize(("k", "by"), [(1, False), (5, False), (3, True)])
def test_neighbours_in_a_dense_city_equal_brute_force(spark, monkeypatch, k, by):
    """Nine of ten anchors in a thousandth of the width, a third of them at one place, queries near and far."""
    monkeypatch.setattr(spatial, "BLOCK", 50)
    monkeypatch.setattr(spatial, "LEAF", 8)
    rng = np.random.default_rng(k)
    anchors = [(int(g), *(float(x) for x in (rng.normal(0, 0.1, 2) if i % 10 else rng.uniform(-100, 100, 2))), i) for i, g in enumerate(rng.integers(0, 3, 600))]
    anchors[::3] = [(g, 0.125, 0.25, i) for g, _, _, i in anchors[::3]]
    queries = [(i, i % 4, *(float(x) for x in p)) for i, p in enumerate(np.concatenate([rng.normal(0, 0.2, (60, 2)), rng.uniform(-150, 150, (30, 2)), [[0.125, 0.25], [1e4, 1e4]]]))]
    df = spark.createDataFrame(queries + [(1000, 0, None, 1.0), (1001, 0, float("nan"), 1.0)], "q long, g int, x_km double, y_km double").repartition(4)
    an = spark.createDataFrame(anchors + [(0, float("inf"), 0.0, -1), (0, None, 0.0, -2)], "g int, x_km double, y_km double, v long").repartition(4)
    out = spatial.neighbours(df, an, "q", "v", k, ["g"] if by else None)
    got = sorted((r.q, round(r.distance, 9), r.value) for r in out.collect())
    want = []
    for q, g, x, y in queries:
        mine = sorted((float(np.sqrt((x - ax) ** 2 + (y - ay) ** 2)), v) for h, ax, ay, v in anchors if not by or h == g)[:k]
        want += [(q, round(d, 9), v) for d, v in mine]
    assert got == sorted(want)


def test_a_dense_city_is_many_leaves(spark, monkeypatch):
    """90% of the anchors in one cell of a hundred: a query still meets few of them."""
    monkeypatch.setattr(spatial, "BLOCK", 50)
    monkeypatch.setattr(spatial, "LEAF", 8)
    rng = np.random.default_rng(0)
    city = [(*(float(x) for x in rng.uniform(0, 0.1, 2)), i) for i in range(1800)] + [(*(float(x) for x in rng.uniform(-5, 5, 2)), i) for i in range(200)]
    an = spark.createDataFrame(city, "ax_ double, ay_ double, v_ long")
    q = spark.createDataFrame([(i, *(float(x) for x in rng.uniform(0, 0.1, 2))) for i in range(100)], "q long, x_km double, y_km double")
    pairs = spatial._near_pairs(q, an, "q", 1, [])
    most = max(r["count"] for r in pairs.groupBy("q").count().collect())
    assert most < 120


def test_reduced_regions_equal_their_points_and_full_cells_are_halved(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), float(y), None if i % 7 == 0 else float(v)) for i, (x, y, v) in enumerate(rng.uniform(0, 4, (1500, 3)) + [0, 0, 1e6])]
    points = spark.createDataFrame([*rows, (None, 1.0, 2.0)], "x double, y double, v double")
    ring = lambda a, b: [{"x": a, "y": a}, {"x": b, "y": a}, {"x": b, "y": b}, {"x": a, "y": b}]
    frame = spark.createDataFrame([(1, [ring(0.1, 3.9), ring(1.0, 2.0)]), (2, [ring(2.2, 3.1)]), (3, [ring(9.0, 9.5)])], RINGS)
    assert regions.fitting_step(points, 2.0) == 1.0 and regions.fitting_step(points.limit(50), 2.0) == 2.0
    plain = regions.points_in(points, frame, "region", 1.0).groupBy("region").agg(F.count("*").alias("pixels"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("stddev"))
    got, want = (sorted(map(tuple, d.collect())) for d in (regions.reduce_in(points, frame, "region", "v", 2.0), plain))
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) == 2
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], rtol=1e-9)
    assert regions.reduce_in(points.where("false"), frame, "region", "v", 2.0).count() == 0


def test_pairs_of_one_cell_are_dealt_to_many_tasks_and_tested_in_compiled_code(spark):
    """Adaptive execution gave the few input bytes to one task, however many pairs came from them, and cast every ray in array lambdas."""
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 4, (3000, 2)))], "id long, x double, y double")
    ring = lambda x, y, r: [{"x": x + r, "y": y}, {"x": x, "y": y + r}, {"x": x - r, "y": y}, {"x": x, "y": y - r}]
    frame = spark.createDataFrame([(i, [ring(float(x), float(y), 1.5), ring(float(x), float(y), 0.5)]) for i, (x, y) in enumerate(rng.uniform(0, 4, (40, 2)))], RINGS)
    pairs = regions.points_in(points, frame, "region", 4.0)
    spread = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("t")).count().collect()]
    assert len(spread) >= 6 and max(spread) < sum(spread) / 2
    cells = regions.cover(frame, "region", 0.25).where("edges is not null")
    assert cells.where(F.size("edges") <= regions.FEW).count() > 0.8 * cells.count() and cells.where("odd").count() > 0


def test_edges_beyond_a_cell_count_as_odd_or_even(spark):
    """A comb: a cell has many teeth to its right, of which it carries none that pass its row and are over a cell away."""
    teeth = [(x, y) for k in range(12) for x, y in ((k, 0.05), (k, 9.9), (k + 0.45, 9.9), (k + 0.45, 0.05))]
    comb = [(-1.0, -1.0), *[(float(x), float(y)) for x, y in teeth], (13.0, -1.0)]
    frame = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in comb]])], RINGS)
    places = [(float(x), float(y)) for x, y in np.random.default_rng(2).uniform(-2, 14, (1500, 2))]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id long, x double, y double")
    got = sorted(r.id for r in regions.points_in(points, frame, "region", 0.6).collect())
    assert got == [i for i, p in enumerate(places) if brute_inside(*p, [comb])]
    assert max(len(r.edges) for r in regions.cover(frame, "region", 0.6).where("edges is not null and cy = 8").collect()) <= 6


def _lattice():
    """Anchors on a lattice, two at each place, with two values of opposite order; queries on it, between its places and far off."""
    anchors = [(i % 2, float(x), float(y), n, -float(n)) for n, (i, x, y) in enumerate((i, x, y) for x in range(6) for y in range(6) for i in (0, 1, 0, 1))]
    queries = [(n, n % 2, *p) for n, p in enumerate([(2.0, 2.0), (2.5, 2.5), (2.5, 3.0), (0.0, 5.5), (90.0, -40.0), (3.0, 1.0)])]
    return anchors, queries


@pytest.mark.parametrize(("block", "by"), [(2000, []), (2000, ["g"]), (20, []), (20, ["g"])])
def test_means_of_two_values_come_from_one_search_with_ties_by_each(spark, monkeypatch, block, by):
    monkeypatch.setattr(spatial, "BLOCK", block)
    monkeypatch.setattr(spatial, "LEAF", 8)
    anchors, queries = _lattice()
    an, q = spark.createDataFrame(anchors, "g int, x_km double, y_km double, v long, w double"), spark.createDataFrame(queries, "q long, g int, x_km double, y_km double")
    out = spatial.idws(q, an, "q", {"v": "a", "w": "b"}, 5, 2.0, by, "near")
    got = {r.q: (r.a, r.b, r.near) for r in out.collect()}
    for n, g, x, y in queries:
        mine = [(float(np.sqrt((x - ax) ** 2 + (y - ay) ** 2)), v, w) for h, ax, ay, v, w in anchors if not by or h == g]
        for c in (1, 2):
            near = sorted((m[0], m[c]) for m in mine)[:5]
            exact = [v for d, v in near if d < 1e-9]
            want = np.mean(exact) if exact else sum(v / d**2 for d, v in near) / sum(1 / d**2 for d, v in near)
            assert abs(got[n][c - 1] - want) < 1e-9
        assert abs(got[n][2] - min(mine)[0]) < 1e-12
    for c in ("v", "w"):
        apart = {r.q: r.e for r in spatial.idw(spatial.neighbours(q, an, "q", c, 5, by), "q", "e", by=by).collect()}
        assert all(abs(apart[n] - got[n]["vw".index(c)]) < 1e-12 for n in apart) and len(apart) == len(queries)


def test_few_anchors_are_no_rows_of_pairs(spark):
    """Every pair of a query and one of up to 2,000 anchors was a row that a window sorted."""
    anchors, queries = _lattice()
    an, q = spark.createDataFrame(anchors, "g int, x_km double, y_km double, v string, w double"), spark.createDataFrame(queries, "q long, g int, x_km double, y_km double")
    for by in ([], ["g"]):
        near = spatial.neighbours(q, an, "q", "v", 3, by)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "MapInArrow" in plan
        assert near.count() == 3 * len(queries)
        assert spatial.neighbours(q, an.where("false"), "q", "v", 3, by).count() == 0


def test_a_map_searches_once(spark, monkeypatch):
    from panelforge.operators import kriging

    calls, search = [], spatial._candidates
    monkeypatch.setattr(spatial, "_candidates", lambda *a: calls.append(1) or search(*a))
    rng = np.random.default_rng(1)
    rows = [(i, f"2022-0{i % 5 + 1}-01", *(float(x) for x in rng.uniform(1, 2, 3))) for i in range(60)]
    stations = spark.createDataFrame(rows, "s long, date string, lon double, lat double, y double").withColumn("date", F.col("date").cast("date"))
    grid = spark.createDataFrame([(i, *(float(x) for x in p)) for i, p in enumerate(rng.uniform(1, 2, (20, 2)))], "grid_id long, lon double, lat double")
    shown, _ = kriging.map_grid(stations, grid, ["lon"], "y", "2022-05-01", alphas=[0.0])
    assert shown.where("pred_idw is not null and nearest_anchor_km is not null and residual_correction is not null").count() == 20 and len(calls) == 1


def test_kinds_of_residuals_share_folds_and_trends(spark, monkeypatch):
    from panelforge.operators import kriging
    from panelforge.plans import model_queries

    calls, fit, search = [], kriging.ridges, spatial._candidates
    monkeypatch.setattr(kriging, "ridges", lambda *a: calls.append("fit") or fit(*a))
    monkeypatch.setattr(spatial, "_candidates", lambda *a: calls.append("search") or search(*a))
    assert model_queries.kriging_modes(spark, "/root/testdata/sf0.001").count() == 12
    assert calls.count("fit") == 2 and calls.count("search") == 4
