"""Local projection, nearest neighbours and inverse-distance interpolation."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .ranges import medians

KM_LON, KM_LAT = 111.32, 110.57
#: Anchors that are sent to every task at most.
BLOCK = 2_000
#: Anchors of a quadtree's leaf at most, while its places can still be told apart.
LEAF = 64


def project(df: DataFrame, lon: str, lat: str, groups: list[str] | None = None) -> DataFrame:
    """x_km and y_km around the median latitude of the frame (or of each group)."""
    if groups:
        joined = df.join(df.groupBy(*groups).agg(F.median(lat).alias("lat0_")), groups)
    else:
        joined = df.withColumn("lat0_", F.lit(medians(df, [lat]).get(lat)))
    scale = F.cos(F.col("lat0_") * F.lit(math.pi / 180.0))
    return joined.withColumns({"x_km": F.col(lon) * KM_LON * scale, "y_km": F.col(lat) * KM_LAT}).drop("lat0_")


def finite_points(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df


def neighbours(queries: DataFrame, anchors: DataFrame, query_key: str, value: str, k: int, by: list[str] | None = None) -> DataFrame:
    """(query_key, by, distance, value) of each query's k nearest anchors (ties: least value), of the same group if `by` is given.

    Both frames have x_km and y_km; rows whose places are not finite, and null groups, take no part; a query is
    told apart by its key and group.
    """
    by = by or []
    rank = F.row_number().over(Window.partitionBy(query_key, *by).orderBy("distance", "v0_"))
    found = _candidates(queries, anchors, query_key, [value], k, by).withColumn("r_", rank)
    return found.where(F.col("r_") <= k).select(query_key, *by, "distance", F.col("v0_").alias("value"))


def _candidates(queries: DataFrame, anchors: DataFrame, query_key: str, values: list[str], k: int, by: list[str]) -> DataFrame:
    """(query_key, by, distance, v0_, v1_, ...): anchors of each query, among them its k nearest with ties by any of the values.

    At most BLOCK anchors (counted) go to every task, which keeps the nearest of a query as it meets them, so pairs
    are never rows. More are dealt to the leaves of a quadtree that is as deep as they are dense, and a query
    meets the leaves near enough to hold a neighbour.
    """
    held = [f"v{i}_" for i in range(len(values))]
    a = finite_points(anchors, ["x_km", "y_km"]).select(*by, F.col("x_km").cast("double").alias("ax_"), F.col("y_km").cast("double").alias("ay_"), *[F.col(v).alias(h) for v, h in zip(values, held, strict=True)])
    q = finite_points(queries, ["x_km", "y_km"]).select(query_key, *by, F.col("x_km").cast("double").alias("x_km"), F.col("y_km").cast("double").alias("y_km"))
    for c in by:
        a = a.where(F.col(c).isNotNull())
    orders = {f"o{i}_": F.row_number().over(Window.orderBy(h)) for i, h in enumerate(held)}
    group = F.dense_rank().over(Window.orderBy(*by)) if by else F.lit(1)
    few = a.limit(BLOCK + 1).withColumns(orders | {"g_": group}).toArrow()
    if few.num_rows <= BLOCK:
        return _nearest_of_few(q, a, few, query_key, held, k, by)
    pairs = _near_pairs(q, a, query_key, k, by, held)
    distance = F.sqrt((F.col("x_km") - F.col("ax_")) ** 2 + (F.col("y_km") - F.col("ay_")) ** 2)
    rank = F.rank().over(Window.partitionBy(query_key, *by).orderBy("distance"))
    return pairs.select(query_key, *by, distance.alias("distance"), *held).withColumn("r_", rank).where(F.col("r_") <= k).drop("r_")


def _nearest_of_few(q: DataFrame, a: DataFrame, few: pa.Table, query_key: str, held: list[str], k: int, by: list[str]) -> DataFrame:
    """_candidates among the rows of `few` (a, with group numbers g_ and places o0_, o1_, ... in the order of each value): blocks of queries against all anchors of their group."""
    spark, numbers = q.sparkSession, few.column("g_").to_numpy()
    if by:
        first = np.unique(numbers, return_index=True)[1]
        groups = spark.createDataFrame(few.take(first).select([*by, "g_"]), a.select(*by).schema.add("g_", "integer"))
        q = q.join(F.broadcast(groups), by)
    else:
        q = q.withColumn("g_", F.lit(1))
    ax, ay = (few.column(c).to_numpy() for c in ("ax_", "ay_"))
    orders = [few.column(f"o{i}_").to_numpy() for i in range(len(held))]
    mine = {int(g): np.flatnonzero(numbers == g) for g in np.unique(numbers)}
    values = few.select(held)

    def run(batches):
        for b in batches:
            x, y, g = (b.column(c).to_numpy(zero_copy_only=False) for c in ("x_km", "y_km", "g_"))
            for number, anchor in mine.items():
                rows = np.flatnonzero(g == number)
                step = max(1, 1_000_000 // len(anchor))
                for at in range(0, len(rows), step):
                    row = rows[at : at + step]
                    i, j, d = _least(x[row], y[row], ax[anchor], ay[anchor], [o[anchor] for o in orders], k)
                    found = b.select([query_key, *by]).take(pa.array(row[i]))
                    taken = values.take(pa.array(anchor[j])).combine_chunks()
                    columns = [*found.columns, pa.array(d), *[c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in taken.columns]]
                    yield pa.RecordBatch.from_arrays(columns, [*found.schema.names, "distance", *held])

    schema = q.select(query_key, *by).schema.add("distance", "double")
    for h in held:
        schema = schema.add(a.schema[h])
    return q.select(query_key, *by, "x_km", "y_km", "g_").mapInArrow(run, schema)


def _least(x, y, ax, ay, orders, k: int):
    """(i, j, distance) of the pairs in which anchor j is among the k nearest of query i, ties by any of the orders."""
    d = np.sqrt((x[:, None] - ax) ** 2 + (y[:, None] - ay) ** 2)
    k = min(k, len(ax))
    i, j = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
    near, start = d[i, j], np.searchsorted(i, np.arange(len(x)))
    keep = np.zeros(len(i), bool)
    for order in orders:
        by_rank = np.lexsort((order[j], near, i))
        keep[by_rank[np.arange(len(i)) - start[i] < k]] = True
    return i[keep], j[keep], near[keep]


def _near_pairs(q: DataFrame, a: DataFrame, query_key: str, k: int, by: list[str], held: tuple[str, ...] | list[str] = ("v_",)) -> DataFrame:
    """Each query with all anchors of the quadtree's leaves that may hold one of its k nearest.

    Of anchors at one place only the k of least value (of any of `held`) can count. Nodes of all levels are counted in one
    aggregation; a leaf is the first node on the way down with few anchors. The smallest node around a query
    with k anchors bounds the distance to its k-th; leaves no farther than that are found through the cells, as
    wide as the bound, that its circle touches. The tree is as deep as its fullest cell asks for, and rows are
    copied to levels that hold such nodes only.
    """
    few = max(LEAF, 8 * k)
    place = Window.partitionBy(*by, "ax_", "ay_")
    ranks = {f"r{i}_": F.row_number().over(place.orderBy(h)) for i, h in enumerate(held)}
    a = kept(a.withColumns(ranks).where(F.least(*ranks, F.lit(k + 1)) <= k).drop(*ranks))
    q = kept(q)
    both = [*a.agg(F.min("ax_"), F.max("ax_"), F.min("ay_"), F.max("ay_")).first()], [*q.agg(F.min("x_km"), F.max("x_km"), F.min("y_km"), F.max("y_km")).first()]
    low, high, bottom, top = (f(x for x in pair if x is not None) for f, pair in zip((min, max, min, max), zip(*both, strict=True), strict=True))
    span = max(high - low, top - bottom) * (1 + 1e-9) or 1.0
    deep = math.ceil(math.log(max(a.count() / few, 1), 4)) + 10
    shallow = max(deep - 6, 1)
    width = lambda level: F.lit(span) / F.pow(F.lit(2.0), level)
    cell = lambda x, origin, level: F.floor((x - F.lit(origin)) / width(level)).cast("long")
    up = lambda c, levels: F.floor(F.col(c) / F.pow(F.lit(2.0), levels)).cast("long")
    fullest = a.groupBy(*by, cell(F.col("ax_"), low, F.lit(shallow)), cell(F.col("ay_"), bottom, F.lit(shallow))).count().agg(F.max("count")).first()[0]
    deep = shallow if fullest <= few else min(26, deep)
    tasks = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * q.sparkSession.sparkContext.defaultParallelism)
    node, box = [*by, "level", "cx", "cy"], ["ax0", "ax1", "ay0", "ay1"]
    a = a.withColumns({"fx_": cell(F.col("ax_"), low, F.lit(deep)), "fy_": cell(F.col("ay_"), bottom, F.lit(deep))})
    fine = a.groupBy(*by, "fx_", "fy_").agg(F.count("*").alias("n_"), F.min("ax_").alias("ax0"), F.max("ax_").alias("ax1"), F.min("ay_").alias("ay0"), F.max("ay_").alias("ay1"))
    every = fine.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deep)))).withColumns({"cx": up("fx_", F.lit(deep) - F.col("level")), "cy": up("fy_", F.lit(deep) - F.col("level"))})
    nodes = kept(every.groupBy(*node).agg(F.sum("n_").alias("n_"), *[(F.min if c[-1] == "0" else F.max)(c).alias(c) for c in box]))
    parent = nodes.where(F.col("n_") > few).select(*by, (F.col("level") + 1).alias("level"), F.col("cx").alias("px_"), F.col("cy").alias("py_"))
    child = nodes.where((F.col("n_") <= few) | (F.col("level") == deep)).withColumns({"px_": up("cx", F.lit(1)), "py_": up("cy", F.lit(1))})
    leaves = kept(child.join(parent, [*by, "level", "px_", "py_"], "left_semi").unionByName(child.where((F.col("level") == 0) & (F.col("n_") <= few))).drop("px_", "py_"))
    # every query's bound: the farthest corner of the smallest node around it that has k anchors
    enough = nodes.where(F.col("n_") >= k).agg(F.max("level")).first()[0] or 0
    home = q.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(enough)))).withColumns({"cx": cell(F.col("x_km"), low, F.col("level")), "cy": cell(F.col("y_km"), bottom, F.col("level"))})
    off = lambda c, a0, a1: F.greatest(F.abs(F.col(c) - F.col(a0)), F.abs(F.col(c) - F.col(a1)))
    farthest = F.sqrt(off("x_km", "ax0", "ax1") ** 2 + off("y_km", "ay0", "ay1") ** 2) * (1 + 1e-9)
    bound = home.join(nodes.where(F.col("n_") >= k), node).groupBy(query_key, *by).agg(F.min(farthest).alias("far_"))
    around = q.join(bound, [query_key, *by], "left").withColumn("far_", F.coalesce("far_", F.lit(2.0 * span)))
    at_most = F.greatest(F.lit(0), F.least(F.lit(deep), F.floor(F.log2(F.lit(span) / F.greatest(F.col("far_"), F.lit(span * 2.0**-30)))))).cast("int")
    around = around.withColumn("own_", at_most).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("own_"))))
    side = lambda c, origin: F.explode(F.sequence(*[F.greatest(F.lit(0), F.least(cell(x, origin, F.col("level")), F.pow(F.lit(2.0), F.col("level")).cast("long") - 1)) for x in (F.col(c) - F.col("far_"), F.col(c) + F.col("far_"))]))
    around = around.withColumn("cx", side("x_km", low)).withColumn("cy", side("y_km", bottom))
    leaf = F.struct("level", "cx", "cy")
    index = leaves.select(*by, *box, leaf.alias("leaf_"), F.explode(F.sequence(F.lit(0), F.col("level"))).alias("level"))
    index = index.withColumns({"cx": F.floor(F.col("leaf_.cx") / F.pow(F.lit(2.0), F.col("leaf_.level") - F.col("level"))).cast("long"), "cy": F.floor(F.col("leaf_.cy") / F.pow(F.lit(2.0), F.col("leaf_.level") - F.col("level"))).cast("long")})
    gap = lambda c, a0, a1: F.greatest(F.col(a0) - F.col(c), F.col(c) - F.col(a1), F.lit(0.0))
    met = around.join(index, node).where((F.col("level") == F.col("own_")) | (F.col("level") == F.col("leaf_.level")))
    met = met.where(F.sqrt(gap("x_km", "ax0", "ax1") ** 2 + gap("y_km", "ay0", "ay1") ** 2) <= F.col("far_")).select(query_key, *by, "x_km", "y_km", "leaf_")
    levels = leaves.select(*by, "level", "cx", "cy")
    used = sorted(r["level"] for r in leaves.select("level").distinct().collect())
    dealt = a.withColumn("level", F.explode(F.array(*map(F.lit, used)))).withColumns({"cx": up("fx_", F.lit(deep) - F.col("level")), "cy": up("fy_", F.lit(deep) - F.col("level"))})
    dealt = kept(dealt.join(levels, node, "left_semi").select(*by, leaf.alias("leaf_"), "ax_", "ay_", *held))
    # pairs are many more than the bytes they come from, which must not decide in how few tasks they meet
    return met.repartition(tasks, *by, "leaf_").join(dealt.repartition(tasks, *by, "leaf_"), [*by, "leaf_"])


def _weighed(power: float, among: Column | None = None) -> Callable[[str], Column]:
    """The inverse-distance mean of a column of neighbours, of those that are `among` them."""
    exact = F.col("distance") < 1e-9
    mine = (lambda c: c) if among is None else (lambda c: F.when(among, c))
    weight = mine(F.when(~exact, 1 / F.pow("distance", F.lit(power))))
    return lambda value: F.coalesce(F.avg(mine(F.when(exact, F.col(value)))), F.sum(weight * F.col(value)) / F.sum(weight))


def idw(near: DataFrame, query_key: str, name: str, power: float = 2.0, by: list[str] | None = None) -> DataFrame:
    """Inverse-distance mean of neighbours; anchors at the very place (under 1e-9) count alone, by their mean."""
    return near.groupBy(query_key, *(by or [])).agg(_weighed(power)("value").alias(name))


def idws(queries: DataFrame, anchors: DataFrame, query_key: str, names: dict[str, str], k: int, power: float = 2.0, by: list[str] | None = None, nearest: str | None = None) -> DataFrame:
    """(query_key, by, a column for each of names, nearest): idw() of neighbours() for several values of the anchors (value -> name) from one search, and the distance of the nearest anchor if it has a name."""
    by = by or []
    found, mine = _candidates(queries, anchors, query_key, list(names), k, by), Window.partitionBy(query_key, *by)
    found = found.withColumns({f"r{i}_": F.row_number().over(mine.orderBy("distance", f"v{i}_")) for i in range(len(names))})
    means = [_weighed(power, F.col(f"r{i}_") <= k)(f"v{i}_").alias(name) for i, name in enumerate(names.values())]
    return found.groupBy(query_key, *by).agg(*means, *([F.min("distance").alias(nearest)] if nearest else []))


def zone(distance: Column) -> Column:
    """Extrapolation zone of a distance to the nearest anchor in km."""
    return F.when(distance <= 25, "near_0_25km").when(distance <= 50, "medium_25_50km").when(distance.isNotNull(), "far_over_50km")


def grid_points(spark, west: float, south: float, step: float, columns: int, rows: int) -> DataFrame:
    """A regular grid with ids from its rounded coordinates."""
    x, y = F.lit(west) + F.col("i") * step, F.lit(south) + F.col("j") * step
    cells = spark.range(columns).withColumnRenamed("id", "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return cells.select(F.concat_ws("_", F.lit("g"), F.round(x).cast("long"), F.round(y).cast("long")).alias("grid_id"), x.alias("x"), y.alias("y"))


def within_radius(points: DataFrame, regions: DataFrame, radius: float) -> DataFrame:
    """points x regions at most `radius` apart (x, y in the same units), through cells of that size.

    A region is copied to the nine cells around it and joined by cell, so pairs far apart never meet.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    r = regions.withColumnsRenamed({"x": "rx_", "y": "ry_"})
    near = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    r = r.withColumn("cx_", near("rx_")).withColumn("cy_", near("ry_"))
    p = points.withColumns({"cx_": cell("x"), "cy_": cell("y")})
    d2 = (F.col("x") - F.col("rx_")) ** 2 + (F.col("y") - F.col("ry_")) ** 2
    return p.join(r, ["cx_", "cy_"]).where(d2 <= radius * radius).drop("cx_", "cy_", "rx_", "ry_")


def feature_json(lon: Column, lat: Column, properties: list[str]) -> Column:
    """A point Feature as a JSON string."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def capped_distance(points: DataFrame, marks: DataFrame, key: str, cap: float) -> DataFrame:
    """(key, distance): to the nearest mark (cells of rasterised lines), at most `cap`; x and y in the same units.

    Marks are looked for in cells of the cap's size only, so far marks never meet a point.
    """
    size = lambda c: F.floor(F.col(c) / cap)
    m = marks.select(F.col("x").alias("mx_"), F.col("y").alias("my_"), F.explode(F.sequence(size("x") - 1, size("x") + 1)).alias("cx_"), size("y").alias("y0_"))
    m = m.withColumn("cy_", F.explode(F.sequence(F.col("y0_") - 1, F.col("y0_") + 1)))
    p = points.withColumns({"cx_": size("x"), "cy_": size("y")})
    distance = F.sqrt((F.col("x") - F.col("mx_")) ** 2 + (F.col("y") - F.col("my_")) ** 2)
    best = p.join(m, ["cx_", "cy_"]).groupBy(key).agg(F.min(distance).alias("d_"))
    return points.select(key).join(best, key, "left").select(key, F.least(F.coalesce("d_", F.lit(float(cap))), F.lit(float(cap))).alias("distance"))


def rasterise(lines: DataFrame, key: str, path: str, step: float) -> DataFrame:
    """(key, x, y): the distinct grid cells (lower corners on multiples of `step`) that polylines pass.

    path is an array of (x, y) structs; a segment is sampled at half a cell, so no cell that it crosses by
    more than a corner is missed.
    """
    parts = F.zip_with(F.slice(path, 1, F.size(path) - 1), F.slice(path, 2, F.size(path) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    seg = lines.where(F.size(path) > 1).select(key, F.explode(parts).alias("s"))
    x0, y0, x1, y1 = (F.col(f"s.{e}.{c}") for e in "ab" for c in "xy")
    n = F.ceil(F.greatest(F.abs(x1 - x0), F.abs(y1 - y0)) * 2 / F.lit(step)).cast("int")
    marks = seg.withColumn("n", F.greatest(n, F.lit(1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a, b: F.floor((a + (b - a) * F.col("i") / F.col("n")) / F.lit(step)) * F.lit(step)
    return marks.select(key, at(x0, x1).alias("x"), at(y0, y1).alias("y")).distinct()
