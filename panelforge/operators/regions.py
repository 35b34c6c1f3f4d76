"""Polygon regions: covering cells, points inside, bounds, and lines as distances; everything meets through cells.

A region is (key, rings): rings is an array of rings, each an array of (x, y) structs, closed or not. A place
is inside if a ray from it crosses the rings an odd number of times, so an inner ring is a hole; places on
an edge or corner of any ring are inside.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges of a border cell that a compiled test of points holds.
FEW = 4
#: Points of a cell that pairs are made from, about, before cells are halved.
PAIRED = 1_024


def edges(regions: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(key, x0, y0, x1, y1) of every edge; rings of under two places, edges to null or infinite places and edges without length are left out."""
    ring = regions.select(key, F.explode(rings).alias("r_")).where(F.size("r_") > 1)
    closed = F.concat("r_", F.slice("r_", 1, 1))
    pairs = F.zip_with(F.slice(closed, 1, F.size("r_")), F.slice(closed, 2, F.size("r_")), lambda a, b: F.struct(a["x"].cast("double").alias("x0"), a["y"].cast("double").alias("y0"), b["x"].cast("double").alias("x1"), b["y"].cast("double").alias("y1")))
    out = ring.select(key, F.explode(pairs).alias("e")).select(key, "e.*")
    fine = " and ".join(f"{c} is not null and abs({c}) < double('infinity')" for c in ("x0", "y0", "x1", "y1"))
    return out.where(f"{fine} and (x0 != x1 or y0 != y1)")


def _cell(c: Column, step: float) -> Column:
    return F.floor(c / F.lit(step)).cast("long")


def cover(regions: DataFrame, key: str, step: float, rings: str = "rings") -> DataFrame:
    """(key, cx, cy, edges, odd) of the square cells that a region meets: edges is null in cells wholly inside.

    Border cells carry the edges of their row of cells that end right of their left side: all that a ray
    from the cell to the right can cross. Edges farther right that pass the row from side to side are crossed by
    every such ray; only whether their number is odd is kept. Inside cells come from where the middle line of each
    row crosses the rings, so the work grows with edges and cells, not with their product. The edges of a row of
    cells meet in one row of the frame, which alone is shuffled.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = edges(regions, key, rings).withColumn("cy", F.explode(F.sequence(_cell(low, step), _cell(high, step))))
    rows = rows.groupBy(key, "cy").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("row_"))
    y_low, y_high, middle = F.col("cy") * F.lit(step), (F.col("cy") + 1) * F.lit(step), (F.col("cy") + 0.5) * F.lit(step)
    slack = F.lit(step * 1e-9)  # a cell that rounding might let an edge touch is a border cell
    at = lambda e, y: e["x0"] + (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"])
    least, most = (lambda e, c: F.least(e[f"{c}0"], e[f"{c}1"])), (lambda e, c: F.greatest(e[f"{c}0"], e[f"{c}1"]))

    def touched(e):
        flat = e["y0"] == e["y1"]
        a, b = (F.when(flat, x).otherwise(at(e, F.least(F.greatest(y, y_low), y_high))) for x, y in ((e["x0"], least(e, "y")), (e["x1"], most(e, "y"))))
        return F.sequence(_cell(F.least(a, b) - slack, step), _cell(F.greatest(a, b) + slack, step))

    passed = F.filter("row_", lambda e: (least(e, "y") <= middle) & (most(e, "y") > middle))
    rows = rows.withColumns({"border_": F.array_distinct(F.flatten(F.transform("row_", touched))), "xs_": F.array_sort(F.transform(passed, lambda e: at(e, middle)))})
    spans = F.transform(F.sequence(F.lit(0), F.size("xs_") - 2, F.lit(2)), lambda i: F.sequence(_cell(F.get("xs_", i), step), _cell(F.get("xs_", i + 1), step)))
    inner = F.when(F.size("xs_") > 1, F.array_except(F.flatten(spans), "border_")).otherwise(F.array().cast("array<long>"))
    beyond = lambda e, cx: (_cell(least(e, "x"), step) > cx + 1) & (_cell(least(e, "y"), step) < F.col("cy")) & (_cell(most(e, "y"), step) > F.col("cy"))
    near = lambda cx: F.filter("row_", lambda e: (most(e, "x") >= cx * F.lit(step) - slack) & ~beyond(e, cx))
    odd = lambda cx: F.size(F.filter("row_", lambda e: beyond(e, cx))) % 2 == 1
    none = F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    cell = lambda cx, sides, far: F.struct(cx.alias("cx"), sides.alias("edges"), far.alias("odd"))
    cells = F.concat(F.transform("border_", lambda cx: cell(cx, near(cx), odd(cx))), F.transform(inner, lambda cx: cell(cx, none, F.lit(False))))
    return rows.select(key, "cy", F.explode(cells).alias("c_")).select(key, "c_.cx", "cy", "c_.edges", "c_.odd")


def _on(x: Column, y: Column, e: Column) -> Column:
    return ((e["x1"] - e["x0"]) * (y - e["y0"]) == (e["y1"] - e["y0"]) * (x - e["x0"])) & x.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])) & y.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"]))


def _crossing(x: Column, y: Column, e: Column) -> Column:
    return ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"])


def inside(x: Column, y: Column, sides: Column, odd: Column) -> Column:
    """Whether a place is inside or on an edge, from the edges and oddness of its cell: an array expression, no Python."""
    return F.exists(sides, lambda e: _on(x, y, e)) | ((F.size(F.filter(sides, lambda e: _crossing(x, y, e))) % 2 == 1) != odd)


def _flat(cells: DataFrame, keep: list[str]) -> DataFrame:
    """cells of at most FEW edges with a column for each number of these; edges that are not there lie at infinity, where no place is on them and no ray crosses."""
    flat = [F.coalesce(F.get("edges", F.lit(i))[c], F.lit(float("inf"))).alias(f"{c}_{i}_") for i in range(FEW) for c in ("x0", "y0", "x1", "y1")]
    few = F.coalesce(F.size("edges") <= FEW, F.lit(True))
    return cells.where(few).select(*keep, (F.col("edges").isNull() | F.col("odd")).alias("odd_"), *flat)


def _inside_flat(x: Column, y: Column) -> Column:
    """inside() of _flat's columns: compiled, as array functions with lambdas are not."""
    each = [{c: F.col(f"{c}_{i}_") for c in ("x0", "y0", "x1", "y1")} for i in range(FEW)]
    return reduce(lambda a, b: a | b, [_on(x, y, e) for e in each]) | reduce(lambda a, b: a != b, [_crossing(x, y, e) for e in each], F.col("odd_"))


def points_in(points: DataFrame, regions: DataFrame, key: str, step: float, rings: str = "rings") -> DataFrame:
    """points (x, y and other columns) with the key of each region they lie in; one row for each such pair.

    Points and regions meet by cell only; rays are cast in border cells. Cells are halved where they hold many
    points, and are dealt to a number of tasks that the size of the tables does not lessen, as pairs are many more.
    Places that are not finite, and null regions, take no part; no points or regions give no rows. `key` is no
    column of points.
    """
    spark, cell = points.sparkSession, ["cx_", "cy_"]
    step = fitting_step(points, step, PAIRED)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    placed = _finite(points).withColumns({"cx_": _cell(F.col("x"), step), "cy_": _cell(F.col("y"), step)}).repartition(tasks, *cell)
    cells, x, y = cover(regions, key, step, rings).withColumnsRenamed({"cx": "cx_", "cy": "cy_"}), F.col("x").cast("double"), F.col("y").cast("double")
    few = placed.join(_flat(cells, [key, *cell]).repartition(tasks, *cell), cell).where(_inside_flat(x, y))
    rest = cells.where(F.size("edges") > FEW).withColumnsRenamed({"edges": "edges_", "odd": "odd_"}).repartition(tasks, *cell)
    many = placed.join(rest, cell).where(inside(x, y, F.col("edges_"), F.col("odd_")))
    out = [*points.columns, key]
    return few.select(*out).unionByName(many.select(*out))


def _finite(points: DataFrame) -> DataFrame:
    return points.where("x is not null and y is not null and abs(x) < double('infinity') and abs(y) < double('infinity')")


def fitting_step(points: DataFrame, step: float, full: int = 128, halvings: int = 4) -> float:
    """step, halved (at most `halvings` times) until the fullest cell would hold about `full` points if they spread evenly in it."""
    cells = _finite(points).groupBy(_cell(F.col("x"), step), _cell(F.col("y"), step)).count()
    most = cells.agg(F.max("count")).first()[0] or 0
    while most > full and halvings:
        step, most, halvings = step / 2, most / 4, halvings - 1
    return step


def reduce_in(points: DataFrame, regions: DataFrame, key: str, value: str, step: float, rings: str = "rings") -> DataFrame:
    """(key, pixels, mean, stddev): count of the points (x, y, value) in each region, and mean and population deviation of their values.

    Cells that lie wholly inside a region give it their count and moments, one row however many points they
    hold; only points of border cells meet regions one by one. Moments are taken around the mean of all values.
    """
    step = fitting_step(points, step)
    fine = _finite(points).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(value).cast("double").alias("v_"))
    centre = fine.where("abs(v_) < double('infinity')").agg(F.avg("v_")).first()[0] or 0.0
    fine = fine.select("x", "y", (F.col("v_") - F.lit(centre)).alias("v_"), _cell(F.col("x"), step).alias("cx_"), _cell(F.col("y"), step).alias("cy_"))
    cells = cover(regions, key, step, rings).withColumnsRenamed({"cx": "cx_", "cy": "cy_", "edges": "edges_", "odd": "odd_"})
    sums = [F.sum("v_").alias("s_"), F.sum(F.col("v_") * F.col("v_")).alias("q_")]
    whole = fine.groupBy("cx_", "cy_").agg(F.count("*").alias("pixels"), F.count("v_").alias("n_"), *sums)
    whole = cells.where("edges_ is null").join(whole, ["cx_", "cy_"]).select(key, "pixels", "n_", "s_", "q_")
    met = fine.join(cells.where("edges_ is not null"), ["cx_", "cy_"]).where(inside(F.col("x"), F.col("y"), F.col("edges_"), F.col("odd_")))
    both = whole.unionByName(met.groupBy(key).agg(F.count("*").alias("pixels"), F.count("v_").alias("n_"), *sums))
    out = both.groupBy(key).agg(F.sum("pixels").alias("pixels"), F.sum("n_").alias("n_"), F.sum("s_").alias("s_"), F.sum("q_").alias("q_"))
    mean = F.when(F.col("n_") > 0, F.col("s_") / F.col("n_"))
    spread = F.when(F.col("n_") > 0, F.sqrt(F.greatest(F.col("q_") / F.col("n_") - mean * mean, F.lit(0.0))))
    return out.select(key, "pixels", (mean + F.lit(centre)).alias("mean"), spread.alias("stddev"))


def buffers(places: DataFrame, key: str, lon: str, lat: str, metres: float, sides: int = 32) -> DataFrame:
    """(key, rings): around each place, in degrees, a polygon of `sides` corners `metres` away; null places have none.

    Corners stand at even angles from the east on; a degree is 110,570 m north and 111,320 m times the cosine
    of the latitude east.
    """
    turn = [2 * math.pi * i / sides for i in range(sides)]
    wide = F.lit(metres / 111_320.0) / F.cos(F.radians(lat))
    ring = F.array(*[F.struct((F.col(lon) + wide * F.lit(math.cos(t))).alias("x"), (F.col(lat) + F.lit(metres / 110_570.0 * math.sin(t))).alias("y")) for t in turn])
    return places.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(key, F.array(ring).alias("rings"))


def within_bounds(points: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Points of a closed box; the conditions reach a scan of x and y."""
    return points.where(F.col("x").between(west, east) & F.col("y").between(south, north))


def cell_distances(marks: DataFrame, cells: DataFrame, cap: int) -> DataFrame:
    """(cx, cy, distance): from each of `cells` to the nearest of `marks` (both cx, cy) between cells' middles, in cells, at most `cap`.

    A tile is a square of `cap` cells. Its marks and those up to `cap` cells around it meet in one task as a
    bitmap of fixed size, whatever the number of marks: a pass along columns and one along rows give exact
    distances. Repeated cells count once; without marks every distance is the cap.
    """
    if not 1 <= cap <= 1024:
        raise ValueError("cap must be 1 to 1024 cells")
    tile = lambda c: F.floor(F.col(c) / F.lit(cap)).cast("long")
    place = ["cx", "cy"]
    asked = cells.select(*[F.col(c).cast("long").alias(c) for c in place]).where("cx is not null and cy is not null").distinct().withColumns({"tx": tile("cx"), "ty": tile("cy")})
    held = marks.select(*[F.col(c).cast("long").alias(c) for c in place]).where("cx is not null and cy is not null").distinct()
    for c, t in (("cx", "tx"), ("cy", "ty")):
        held = held.withColumn(t, F.explode(F.sequence(tile(c) - 1, tile(c) + 1)))
    out = pa.schema({"cx": pa.int64(), "cy": pa.int64(), "distance": pa.float64()})

    def run(key, left, right):
        tx, ty = key[0].as_py(), key[1].as_py()
        x, y = left.column("cx").to_numpy(), left.column("cy").to_numpy()
        far = float(cap)
        if not right.num_rows or not left.num_rows:
            return pa.Table.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(len(x), far))], schema=out)
        mx, my = right.column("cx").to_numpy() - (tx - 1) * cap, right.column("cy").to_numpy() - (ty - 1) * cap
        down = np.full((3 * cap, 3 * cap), 2.0 * cap)  # by x, y: cells to the nearest mark of the column
        down[mx, my] = 0
        for j in range(1, 3 * cap):
            np.minimum(down[:, j], down[:, j - 1] + 1, out=down[:, j])
        for j in range(3 * cap - 2, -1, -1):
            np.minimum(down[:, j], down[:, j + 1] + 1, out=down[:, j])
        square = down[:, cap : 2 * cap] ** 2
        best = np.full((cap, cap), far**2)
        for dx in range(-cap, cap + 1):
            np.minimum(best, square[cap + dx : 2 * cap + dx] + dx * dx, out=best)
        return pa.Table.from_arrays([pa.array(x), pa.array(y), pa.array(np.sqrt(best[x - tx * cap, y - ty * cap]))], schema=out)

    return asked.groupBy("tx", "ty").cogroup(held.groupBy("tx", "ty")).applyInArrow(run, "cx long, cy long, distance double").select("cx", "cy", "distance")


def line_distances(points: DataFrame, lines: DataFrame, key: str, path: str, step: float, cap: int = 256) -> DataFrame:
    """points (x, y and others) with `distance` to the nearest of the lines' cells, in the units of x and y, at most cap * step.

    Lines are rasterised to cells of width `step`; a point stands for its cell.
    """
    from .spatial import rasterise

    cell = lambda c: F.round(F.col(c) / F.lit(step)).cast("long")
    marks = rasterise(lines, key, path, step).select(cell("x").alias("cx"), cell("y").alias("cy"))
    placed = points.withColumns({"cx_": _cell(F.col("x"), step), "cy_": _cell(F.col("y"), step)})
    found = cell_distances(marks, placed.select(F.col("cx_").alias("cx"), F.col("cy_").alias("cy")), cap)
    found = found.select(F.col("cx").alias("cx_"), F.col("cy").alias("cy_"), (F.col("distance") * F.lit(step)).alias("distance"))
    return placed.join(found, ["cx_", "cy_"], "left").drop("cx_", "cy_")
