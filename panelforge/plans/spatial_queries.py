"""Interpolation, raster-like bands, models and sinks."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import regions as Z, spatial as G, stats
from ..session import shared_dir, table
from ..sources import tiles as T
from .base import query, r6
from .panel_queries import rounded

POINTS = "pts AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat, CAST(embedding[3] AS DOUBLE) AS value FROM embeddings)"


def _xy(name, source, part=""):
    g = f"PARTITION BY {part}" if part else ""
    return f"{name} AS (SELECT *, lon * 111.32 * cos(radians(lat0)) AS x, lat * 110.57 AS y FROM (SELECT *, median(lat) OVER ({g}) AS lat0 FROM {source}))"


def points(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", e(0).alias("lon"), e(1).alias("lat"), e(2).alias("value"))


SIDES = f"WITH {POINTS}, a0 AS (SELECT * FROM pts WHERE label = 0), q0 AS (SELECT * FROM pts WHERE label <> 0), {_xy('a', 'a0')}, {_xy('q', 'q0')}, d AS (SELECT q.vec_id, q.label, sqrt((q.x - a.x) ** 2 + (q.y - a.y) ** 2) AS distance, a.value FROM q CROSS JOIN a)"


def sides(spark, sf_dir):
    p = points(spark, sf_dir)
    return G.project(p.where("label != 0"), "lon", "lat"), G.project(p.where("label = 0"), "lon", "lat")


@query(f"{SIDES}, k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, value) <= 5) SELECT vec_id, round(sum(value / distance ** 2) / sum(1 / distance ** 2), 6) AS estimate FROM k GROUP BY 1")
def knn_idw(spark, sf_dir):
    """Inverse-distance mean of the five nearest anchors; each side projected around its own median latitude."""
    q, a = sides(spark, sf_dir)
    return rounded(G.idw(G.neighbours(q, a, "vec_id", "value", 5), "vec_id", "estimate"), "estimate")


@query(f"{SIDES} SELECT vec_id, round(min(distance), 6) AS nearest_km, CASE WHEN min(distance) <= 25 THEN 'near_0_25km' WHEN min(distance) <= 50 THEN 'medium_25_50km' ELSE 'far_over_50km' END AS zone FROM d GROUP BY 1")
def nearest_distance(spark, sf_dir):
    q, a = sides(spark, sf_dir)
    near = G.neighbours(q, a, "vec_id", "value", 1)
    return near.select("vec_id", r6(F.col("distance"), "nearest_km"), G.zone(F.col("distance")).alias("zone"))


@query(f"""WITH {POINTS}, a0 AS (SELECT * FROM pts WHERE value > 0), q0 AS (SELECT * FROM pts WHERE value <= 0), {_xy('a', 'a0', 'label')}, {_xy('q', 'q0', 'label')},
d AS (SELECT q.vec_id, q.label, sqrt((q.x - a.x) ** 2 + (q.y - a.y) ** 2) AS distance, a.value FROM q JOIN a USING (label)), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id, label ORDER BY distance, value) <= 3)
SELECT vec_id, label, round(sum(value / distance ** 2) / sum(1 / distance ** 2), 6) AS estimate FROM k GROUP BY 1, 2""")
def knn_idw_by_group(spark, sf_dir):
    """The same within each group, as by date: anchors and queries meet only inside it."""
    p = points(spark, sf_dir)
    q, a = (G.project(p.where(c), "lon", "lat", ["label"]) for c in ("value <= 0", "value > 0"))
    return rounded(G.idw(G.neighbours(q, a, "vec_id", "value", 3, ["label"]), "vec_id", "estimate", by=["label"]), "estimate")


@query(f"""WITH {POINTS}, h AS (SELECT label, arg_min(lon, vec_id) AS lon, arg_min(lat, vec_id) AS lat, avg(value) AS value FROM pts GROUP BY 1), {_xy('a', 'h')}, {_xy('q', 'pts')},
d AS (SELECT q.vec_id, sqrt((q.x - a.x) ** 2 + (q.y - a.y) ** 2) AS distance, a.value FROM q CROSS JOIN a), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, value) <= 4)
SELECT vec_id, round(sum(value / distance ** 2) / sum(1 / distance ** 2), 6) AS estimate FROM k WHERE vec_id NOT IN (SELECT min(vec_id) FROM pts GROUP BY label) GROUP BY 1""")
def historical_idw(spark, sf_dir):
    """Against each group's mean at the place of its first row; the places themselves are left out."""
    p = points(spark, sf_dir)
    anchors = p.groupBy("label").agg(F.min_by("lon", "vec_id").alias("lon"), F.min_by("lat", "vec_id").alias("lat"), F.avg("value").alias("value"), F.min("vec_id").alias("first"))
    q = G.project(p, "lon", "lat").join(anchors.select(F.col("first").alias("vec_id")), "vec_id", "left_anti")
    return rounded(G.idw(G.neighbours(q, G.project(anchors, "lon", "lat"), "vec_id", "value", 4), "vec_id", "estimate"), "estimate")


@query(f"WITH {POINTS}, {_xy('q', 'pts')} SELECT vec_id, round(x, 6) AS x_km, round(y, 6) AS y_km FROM q")
def projection(spark, sf_dir):
    return rounded(G.project(points(spark, sf_dir), "lon", "lat").select("vec_id", "x_km", "y_km"), "x_km", "y_km")


@query(f"WITH {POINTS} SELECT p.vec_id AS point_id, r.vec_id AS region_id FROM pts p JOIN pts r ON r.label = 0 AND (p.lon - r.lon) ** 2 + (p.lat - r.lat) ** 2 <= 0.01")
def region_join(spark, sf_dir):
    """Points within 0.1 of a region's centre, found through cells."""
    p = points(spark, sf_dir)
    regions = p.where("label = 0").select(F.col("vec_id").alias("region_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return G.within_radius(p.select(F.col("vec_id").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y")), regions, 0.1).select("point_id", "region_id")


@query(f"WITH {POINTS} SELECT r.vec_id AS region_id, count(*) AS pixels, round(avg(p.value), 6) AS value_mean, round(stddev_pop(p.value), 6) AS value_stddev FROM pts p JOIN pts r ON r.label = 0 AND (p.lon - r.lon) ** 2 + (p.lat - r.lat) ** 2 <= 0.01 GROUP BY 1")
def region_reduce(spark, sf_dir):
    """Mean, population deviation and count of the pixels around each region's centre."""
    p = points(spark, sf_dir)
    regions = p.where("label = 0").select(F.col("vec_id").alias("region_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    near = G.within_radius(p.select("value", F.col("lon").alias("x"), F.col("lat").alias("y")), regions, 0.1)
    return near.groupBy("region_id").agg(F.count("*").alias("pixels"), r6(F.avg("value"), "value_mean"), r6(F.stddev_pop("value"), "value_stddev"))


_BANDS = "bands AS (SELECT vec_id, " + ", ".join(f"abs(CAST(embedding[{i}] AS DOUBLE)) + 0.01::DOUBLE AS {b}" for i, b in enumerate(("blue", "green", "red", "nir", "s1", "s2"), 1)) + " FROM embeddings)"
_INDEX = {
    "NDVI": "(nir - red) / (nir + red)", "NDWI": "(green - nir) / (green + nir)", "MNDWI": "(green - s1) / (green + s1)", "EVI": "2.5 * (nir - red) / (nir + 6.0 * red - 7.5 * blue + 1.0)",
    "SAVI": "1.5 * (nir - red) / (nir + red + 0.5)", "RVI": "nir / red", "BI": "sqrt(green * green + nir * nir)", "BGRratio": "(blue + green) / red", "SI_1": "sqrt(green * red)",
    "SI_2": "sqrt(green * green + red * red)", "SI_3": "sqrt(green * green + red * red + nir * nir)", "R_1": "blue / red", "R_2": "blue / nir", "R_3": "green / red", "R_4": "green / nir", "Red_SWIR1_ratio": "red / s1", "SWIR1": "s1", "SWIR2": "s2",
}


def bands(spark, sf_dir):
    e = lambda i, b: (F.abs(F.col("embedding")[i].cast("double")) + 0.01).alias(b)
    return table(spark, sf_dir, "embeddings").select("vec_id", *[e(i, b) for i, b in enumerate(("blue", "green", "red", "nir", "s1", "s2"))])


@query(f"WITH {_BANDS} SELECT vec_id, " + ", ".join(f'round({x}, 4) AS "{n}"' for n, x in _INDEX.items()) + " FROM bands")
def spectral_indices(spark, sf_dir):
    cols = [F.col(b) for b in ("blue", "green", "red", "nir", "s1", "s2")]
    return bands(spark, sf_dir).select("vec_id", *[F.round(x, 4).alias(n) for n, x in S.spectral_indices(*cols).items()])


_MAP = {
    "MNDWI_median_week": "(green - s1) / (green + s1 + 1e-6)", "NDWI_median_week": "(green - nir) / (green + nir + 1e-6)", "NDVI_median_week": "(nir - red) / (nir + red + 1e-6)", "NDCI_median_week": "(red - blue) / (red + blue + 1e-6)",
    "BGRratio_median_week": "(blue + green) / (red + 1e-6)", "Red_SWIR1_median_week": "red / (s1 + 1e-6)", "Red_SWIR2_median_week": "red / (s2 + 1e-6)", "B11_median_week": "s1", "B12_median_week": "s2",
}


@query(f"WITH {_BANDS} SELECT vec_id, " + ", ".join(f'round({x}, 6) AS "{n}"' for n, x in _MAP.items()) + " FROM bands")
def map_indices(spark, sf_dir):
    cols = [F.col(b) for b in ("blue", "green", "red", "nir", "s1", "s2")]
    return bands(spark, sf_dir).select("vec_id", *[r6(x, n) for n, x in S.map_indices(*cols).items()])


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE (l_orderkey & 3072) = 0 AND l_quantity < 40 AND l_linenumber NOT IN (3, 8, 9, 10, 11)")
def bitmask_filter(spark, sf_dir):
    """Clear pixels by quality bits, cloud probability and scene class."""
    rows = table(spark, sf_dir, "lineitem").where(S.clear_pixel(F.col("l_orderkey"), F.col("l_quantity"), F.col("l_linenumber")))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT l_partkey, round(median(l_extendedprice), 6) AS composite, count(*) AS images, round(sum(l_quantity), 6) AS total, max(l_tax) AS most, min(l_discount) AS least FROM lineitem GROUP BY 1")
def pixel_composite(spark, sf_dir):
    """Temporal reducers of each pixel."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(r6(F.median("l_extendedprice"), "composite"), F.count("*").alias("images"), r6(F.sum("l_quantity"), "total"), F.max("l_tax").alias("most"), F.min("l_discount").alias("least"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity - 273.15, 6) AS temperature_2m_c, round(CASE WHEN l_discount - 0.05 < 0 THEN 0 ELSE l_discount - 0.05 END * 1000, 6) AS precipitation_mm, round(abs(l_tax - 0.04) * 1000, 6) AS potential_evaporation_mm,
round(l_extendedprice / 100, 6) AS surface_pressure_hpa, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) AS wind_speed_10m_ms FROM lineitem""")
def weather_units(spark, sf_dir):
    c = F.col
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    raw = table(spark, sf_dir, "lineitem").select(*keys, c("l_quantity").alias("temperature_2m"), (c("l_discount") - 0.05).alias("total_precipitation"), (c("l_tax") - 0.04).alias("potential_evaporation"), c("l_extendedprice").alias("surface_pressure"), F.lit(0.0).alias("solar_radiation"), c("l_quantity").alias("wind_u"), c("l_tax").alias("wind_v"))
    return S.weather_units(raw).select(*keys, *[r6(c(x), x) for x in ("temperature_2m_c", "precipitation_mm", "potential_evaporation_mm", "surface_pressure_hpa", "wind_speed_10m_ms")])


@query("SELECT s_suppkey, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || CAST(s_nationkey AS VARCHAR) || ',' || CAST(s_suppkey AS VARCHAR) || ']},\"properties\":{\"s_name\":\"' || s_name || '\"}}' AS feature FROM supplier")
def geojson_features(spark, sf_dir):
    """One point Feature for each row."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", G.feature_json(F.col("s_nationkey").cast("long"), F.col("s_suppkey"), ["s_name"]).alias("feature"))


@query(f"""WITH {POINTS}, c AS (SELECT CAST(floor(lon * 100000 / 5000) AS BIGINT) AS i, CAST(floor(lat * 100000 / 5000) AS BIGINT) AS j FROM pts), b AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM c),
g AS (SELECT i, unnest(generate_series(j0, j1)) AS j FROM (SELECT unnest(generate_series(i0, i1)) AS i, j0, j1 FROM b)), n AS (SELECT i, j, count(*) AS n FROM c GROUP BY 1, 2)
SELECT 'g_' || CAST(i * 5000 AS VARCHAR) || '_' || CAST(j * 5000 AS VARCHAR) AS grid_id, i * 5000.0::DOUBLE AS x, j * 5000.0::DOUBLE AS y, coalesce(n, 0) AS points FROM g LEFT JOIN n USING (i, j)""")
def grid_generator(spark, sf_dir):
    """A regular grid over the box of all points (a degree as 100 km), with the points of each cell."""
    cell = lambda c: F.floor(F.col(c) * 100000 / 5000).cast("long")
    p = points(spark, sf_dir).select(cell("lon").alias("i"), cell("lat").alias("j"))
    low_i, high_i, low_j, high_j = p.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()
    grid = G.grid_points(spark, low_i * 5000.0, low_j * 5000.0, 5000.0, high_i - low_i + 1, high_j - low_j + 1)
    counts = p.groupBy((F.col("i") * 5000.0).alias("x"), (F.col("j") * 5000.0).alias("y")).agg(F.count("*").alias("points"))
    return grid.join(counts, ["x", "y"], "left").fillna(0, ["points"]).select("grid_id", "x", "y", "points")


@query(f"WITH {POINTS} SELECT p.vec_id, round(least(min(sqrt((p.lon - r.lon) ** 2 + (p.lat - r.lat) ** 2)), 0.05), 6) AS distance FROM pts p CROSS JOIN (SELECT * FROM pts WHERE label = 1) r GROUP BY 1")
def distance_transform(spark, sf_dir):
    """Distance to the nearest marked cell, capped."""
    p = points(spark, sf_dir).select("vec_id", "label", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return rounded(G.capped_distance(p.drop("label"), p.where("label = 1"), "vec_id", 0.05), "distance")


#: Corners of a diamond and of a hole in it, around a place.
_RINGS = (((0.15, 0.0), (0.0, 0.15), (-0.15, 0.0), (0.0, -0.15)), ((0.04, 0.04), (-0.04, 0.04), (-0.04, -0.04), (0.04, -0.04)))
_EDGES = " UNION ALL ".join(f"SELECT vec_id AS region_id, lon + {a[0]} AS x0, lat + {a[1]} AS y0, lon + {b[0]} AS x1, lat + {b[1]} AS y1 FROM pts WHERE label = 0" for ring in _RINGS for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
_INSIDE = f"""WITH {POINTS}, e AS ({_EDGES}), c AS (SELECT region_id, p.vec_id, p.value, count(*) FILTER (((y0 > p.lat) <> (y1 > p.lat)) AND p.lon < (x1 - x0) * (p.lat - y0) / (y1 - y0) + x0) AS crossed,
count(*) FILTER ((x1 - x0) * (p.lat - y0) = (y1 - y0) * (p.lon - x0) AND p.lon BETWEEN least(x0, x1) AND greatest(x0, x1) AND p.lat BETWEEN least(y0, y1) AND greatest(y0, y1)) AS touched FROM e CROSS JOIN pts p GROUP BY ALL),
i AS (SELECT region_id, vec_id, value FROM c WHERE crossed % 2 = 1 OR touched > 0)"""


def diamonds(p):
    """Polygon regions (diamonds with a hole) around the points of label 0."""
    at = lambda d: F.struct((F.col("lon") + d[0]).alias("x"), (F.col("lat") + d[1]).alias("y"))
    return p.where("label = 0").select(F.col("vec_id").alias("region_id"), F.array(*[F.array(*map(at, ring)) for ring in _RINGS]).alias("rings"))


def pixels(p):
    return p.select("vec_id", "value", F.col("lon").alias("x"), F.col("lat").alias("y"))


@query(f"{_INSIDE} SELECT region_id, vec_id FROM i")
def polygon_join(spark, sf_dir):
    """Points in polygon regions, found through covering cells and rays in border cells."""
    p = points(spark, sf_dir)
    return Z.points_in(pixels(p), diamonds(p), "region_id", 0.05).select("region_id", "vec_id")


@query(f"{_INSIDE} SELECT region_id, count(*) AS pixels, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_stddev FROM i GROUP BY 1")
def polygon_reduce(spark, sf_dir):
    """Statistics of the pixels of each polygon region."""
    p = points(spark, sf_dir)
    found = Z.reduce_in(pixels(p), diamonds(p), "region_id", "value", 0.05)
    return found.select("region_id", "pixels", r6(F.col("mean"), "value_mean"), r6(F.col("stddev"), "value_stddev"))


@query(f"WITH {POINTS} SELECT vec_id FROM pts WHERE lon BETWEEN -0.1 AND 0.2 AND lat BETWEEN -0.05 AND 0.3")
def bounds_filter(spark, sf_dir):
    """Points of a closed box."""
    p = points(spark, sf_dir).select("vec_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return Z.within_bounds(p, -0.1, -0.05, 0.2, 0.3).select("vec_id")


@query(f"""WITH {POINTS}, seg AS (SELECT lon AS x0, lat AS y0, lon + 0.2 AS x1, lat + 0.1 AS y1 FROM pts WHERE label = 1), n AS (SELECT *, greatest(CAST(ceil(greatest(abs(x1 - x0), abs(y1 - y0)) * 2 / 0.01::DOUBLE) AS INT), 1) AS n FROM seg),
m AS (SELECT DISTINCT CAST(floor((x0 + (x1 - x0) * i / n) / 0.01::DOUBLE) AS BIGINT) AS cx, CAST(floor((y0 + (y1 - y0) * i / n) / 0.01::DOUBLE) AS BIGINT) AS cy FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM n)),
p AS (SELECT vec_id, CAST(floor(lon / 0.01::DOUBLE) AS BIGINT) AS px, CAST(floor(lat / 0.01::DOUBLE) AS BIGINT) AS py FROM pts) SELECT vec_id, round(least(sqrt(min((px - cx) ** 2 + (py - cy) ** 2)), 16) * 0.01::DOUBLE, 6) AS distance FROM p CROSS JOIN m GROUP BY 1""")
def line_distances(spark, sf_dir):
    """Distance of each point's cell to the nearest cell of any line, at most 16 cells."""
    p = points(spark, sf_dir)
    at = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    lines = p.where("label = 1").select("vec_id", F.array(at(0.0, 0.0), at(0.2, 0.1)).alias("path"))
    out = Z.line_distances(p.select("vec_id", F.col("lon").alias("x"), F.col("lat").alias("y")), lines, "vec_id", "path", 0.01, 16)
    return rounded(out.select("vec_id", "distance"), "distance")


_TILES = """px AS (SELECT CAST(vec_id % 4 AS BIGINT) AS day, CAST(floor(CAST(embedding[1] AS DOUBLE) / 0.03::DOUBLE) AS BIGINT) AS cx, CAST(floor(CAST(embedding[2] AS DOUBLE) / 0.03::DOUBLE) AS BIGINT) AS cy, avg(CAST(embedding[3] AS DOUBLE)) AS red, avg(CAST(embedding[4] AS DOUBLE)) AS nir FROM embeddings GROUP BY 1, 2, 3),
met AS (SELECT * FROM px WHERE day BETWEEN 1 AND 2 AND (cx + 0.5) * 0.03::DOUBLE BETWEEN -0.2 AND 0.25 AND (cy + 0.5) * 0.03::DOUBLE BETWEEN -0.3 AND 0.2 AND red > -0.2)"""


@query(f"WITH {_TILES} SELECT cx, cy, count(*) AS images, round(median(red), 6) AS red, round(median(nir), 6) AS nir FROM met GROUP BY 1, 2")
def tile_composite(spark, sf_dir):
    """A raster collection of four days written as tiles, read again by box, days and bands, masked, and composed over time."""
    e = lambda i, b: F.col("embedding")[i].cast("double").alias(b)
    rows = table(spark, sf_dir, "embeddings").select(F.pmod("vec_id", F.lit(4)).alias("day"), e(0, "x"), e(1, "y"), e(2, "red"), e(3, "nir"), e(4, "swir"))
    path = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    T.write_tiles(T.make_tiles(rows, ["red", "nir", "swir"], 0.03, 4), path)
    box, bands = (-0.2, -0.3, 0.25, 0.2), ["red", "nir"]
    out = T.composite(T.pixels(T.read_tiles(spark, path, bands, box, ("1", "2")), bands, box, F.col("red") > -0.2), bands)
    cell = lambda c: F.floor(F.col(c) / 0.03).cast("long")
    return out.select(cell("x").alias("cx"), cell("y").alias("cy"), "images", r6(F.col("red"), "red"), r6(F.col("nir"), "nir"))


@query(f"""WITH {POINTS}, m AS (SELECT *, 2020 + vec_id % 2 AS year, label + 1 AS month FROM pts), a0 AS (SELECT * FROM m WHERE value > 0), q0 AS (SELECT * FROM m WHERE value <= 0), {_xy('a', 'a0', 'year, month')}, {_xy('q', 'q0', 'year, month')},
d AS (SELECT q.vec_id, year, month, sqrt((q.x - a.x) ** 2 + (q.y - a.y) ** 2) AS distance, a.value FROM q JOIN a USING (year, month)), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, value) <= 3)
SELECT vec_id, year, month, round(sum(value / distance ** 2) / sum(1 / distance ** 2), 6) AS estimate, round(min(distance), 6) AS nearest_km FROM k GROUP BY 1, 2, 3""")
def knn_idw_by_month(spark, sf_dir):
    """Neighbours of the same year and month: estimate and nearest distance, from one search."""
    by = ["year", "month"]
    p = points(spark, sf_dir).withColumns({"year": 2020 + F.col("vec_id") % 2, "month": F.col("label") + 1})
    q, a = (G.project(p.where(c), "lon", "lat", by) for c in ("value <= 0", "value > 0"))
    near = G.neighbours(q, a, "vec_id", "value", 3, by)
    least = near.groupBy("vec_id").agg(r6(F.min("distance"), "nearest_km"))
    return rounded(G.idw(near, "vec_id", "estimate", by=by), "estimate").join(least, "vec_id")


_TURNS = [2 * math.pi * i / 12 for i in range(12)]
_CORNER = lambda t: (f"lon + 8000.0::DOUBLE / 111320.0 / cos(radians(lat)) * {math.cos(t)!r}::DOUBLE", f"lat + {8000.0 / 110_570.0 * math.sin(t)!r}::DOUBLE")
_BUFFER = " UNION ALL ".join("SELECT vec_id AS region_id, {} AS x0, {} AS y0, {} AS x1, {} AS y1 FROM pts WHERE label = 2".format(*_CORNER(a), *_CORNER(b)) for a, b in zip(_TURNS, _TURNS[1:] + _TURNS[:1], strict=True))


@query(f"""WITH {POINTS}, e AS ({_BUFFER}), c AS (SELECT region_id, p.vec_id, p.value, count(*) FILTER (((y0 > p.lat) <> (y1 > p.lat)) AND p.lon < (x1 - x0) * (p.lat - y0) / (y1 - y0) + x0) AS crossed FROM e CROSS JOIN pts p GROUP BY ALL)
SELECT region_id, count(*) AS pixels, round(avg(value), 6) AS value_mean FROM c WHERE crossed % 2 = 1 GROUP BY 1""")
def buffer_reduce(spark, sf_dir):
    """Means over the pixels within 8 km of each place, as a polygon of twelve corners in degrees."""
    p = points(spark, sf_dir)
    regions = Z.buffers(p.where("label = 2").withColumnRenamed("vec_id", "region_id"), "region_id", "lon", "lat", 8000.0, 12)
    found = Z.reduce_in(pixels(p), regions, "region_id", "value", 0.05)
    return found.select("region_id", "pixels", r6(F.col("mean"), "value_mean"))
