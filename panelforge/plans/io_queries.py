"""Sources and sinks as round trips: what is written is read back and compared with its source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import checks, columns, spatial as G, stats
from ..session import shared_dir, table
from ..sources import readers, sinks
from .base import FILLED, KEYS, PANEL, panel, query, r6
from .panel_queries import filled_panel, rounded


def _new(spark) -> str:
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def csv_round_trip(spark, sf_dir):
    """Chosen columns to ordered CSV parts and back by schema."""
    path = _new(spark)
    sinks.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice")), path, ["o_orderkey"])
    return readers.read_csv(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 2 <> 0")
def csv_text_dates(spark, sf_dir):
    """Dates cast after a text reading; what is no date is null."""
    path = _new(spark)
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    sinks.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day")), path)
    out = readers.read_csv_text(spark, path, ["day"])
    return out.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""SELECT 'run=' || CAST(n_nationkey AS VARCHAR) AS run_id, n_nationkey % 7 + 1 AS horizon, CAST(n_nationkey AS BIGINT) AS best_epoch, n_nationkey / 10.0::DOUBLE AS val_rmse, CASE WHEN n_nationkey % 2 = 0 THEN 'compact' END AS feature_set
FROM nation WHERE n_nationkey % 7 + 1 IN (1, 3)""")
def run_records(spark, sf_dir):
    """Run folders of JSON records, some without the newer fields, filtered by a field of the record; written by one job."""
    path, i = _new(spark), F.col("n_nationkey")
    record = table(spark, sf_dir, "nation").select(i.alias("run"), (i % 7 + 1).alias("horizon"), i.alias("best_epoch"), F.struct((i / 10.0).alias("rmse")).alias("val"), F.when(i % 2 == 0, "compact").alias("feature_set"))
    record.write.partitionBy("run").json(path)
    runs = readers.read_runs(spark, f"{path}/*/*.json", "horizon int, best_epoch long, val struct<rmse:double>, feature_set string")
    return readers.with_horizon(runs, 1, 3).select("run_id", "horizon", "best_epoch", F.col("val.rmse").alias("val_rmse"), "feature_set")


@query("SELECT o_orderpriority AS priority, CAST(count(*) AS VARCHAR) AS orders FROM orders GROUP BY 1")
def report_rows(spark, sf_dir):
    """The table of a Markdown report, read back from the file."""
    path = f"{_new(spark)}/report.md"
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders"))
    sinks.write_report("Orders", {"By priority": counts, "Note": "Counts of all orders."}, path)
    cells = F.split("value", r"\s*\|\s*")
    lines = spark.read.text(path).where("value like '| %' and value not like '| priority |%'")
    return lines.select(cells[1].alias("priority"), cells[2].alias("orders"))


_MONTHS = "m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS n, min(total) OVER () AS low, max(total) OVER () AS high FROM m)"


@query(f"WITH {_MONTHS} SELECT month AS label, CAST(n AS INTEGER) AS points FROM r WHERE i % CAST(ceil(n / 12) AS INTEGER) = 0 UNION ALL SELECT CAST(CAST(round(low) AS BIGINT) AS VARCHAR), CAST(n AS INTEGER) FROM r WHERE i = 0 UNION ALL SELECT CAST(CAST(round(high) AS BIGINT) AS VARCHAR), CAST(n AS INTEGER) FROM r WHERE i = 0")
def chart_labels(spark, sf_dir):
    """Labels of a line chart of monthly totals, read back from its file: thinned months, the axis' ends, and the points drawn."""
    path = f"{_new(spark)}/chart.svg"
    monthly = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice")).cast("long").alias("total")).orderBy("month")
    sinks.write_text(sinks.line_chart(monthly, "month", "total", "Totals"), path)
    svg = spark.read.text(path, wholetext=True)
    drawn = F.size(F.split(F.regexp_extract("value", 'points="([^"]*)"', 1), " ")).cast("int")
    return svg.select(F.explode(F.regexp_extract_all("value", F.lit('font-size="11"[^>]*>([^<]*)<'), 1)).alias("label"), drawn.alias("points"))


_PLACES = [("A1", 0.1, 0.0), ("B2", -0.2, 0.15), ("C3", 0.3, None), ("D4", -0.05, -0.25)]


@query(f"""WITH s AS (SELECT * FROM (VALUES {', '.join(f"('{i}', {x}::DOUBLE, {'NULL' if y is None else y})" for i, x, y in _PLACES)}) t(station_id, lon, lat)), p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
d AS (SELECT vec_id, station_id FROM p CROSS JOIN s WHERE lat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sqrt((x - lon) ** 2 + (y - lat) ** 2), station_id) = 1) SELECT station_id, lon, CAST(lat AS DOUBLE) AS lat, count(vec_id) AS points FROM s LEFT JOIN d USING (station_id) GROUP BY 1, 2, 3""")
def inline_stations(spark, sf_dir):
    """Places written out in code, each with the points that it is the nearest of; one has no latitude."""
    places = readers.stations(spark, _PLACES)
    e = lambda i, name: F.col("embedding")[i].cast("double").alias(name)
    points = table(spark, sf_dir, "embeddings").select("vec_id", e(0, "x_km"), e(1, "y_km"))
    near = G.neighbours(points, places.withColumnsRenamed({"lon": "x_km", "lat": "y_km"}), "vec_id", "station_id", 1)
    counts = near.groupBy(F.col("value").alias("station_id")).agg(F.count("*").alias("points"))
    return places.join(counts, "station_id", "left").fillna(0, ["points"])


@query("SELECT upper(replace(c_name, '#', '')) AS key, round(c_acctbal, 2) AS lat, CAST(c_nationkey AS DOUBLE) AS lon FROM customer")
def coordinate_cells(spark, sf_dir):
    """Two numbers of one cell, and a key that does not depend on spelling."""
    cell = F.concat(F.round("c_acctbal", 2).cast("string"), F.lit(", "), F.col("c_nationkey").cast("string"))
    df = readers.coordinates(table(spark, sf_dir, "customer").select(readers.station_key(F.regexp_replace("c_name", "#", " - _")).alias("key"), cell.alias("cell")), "cell")
    return df.select("key", "lat", "lon")


@query("SELECT s_suppkey, s_name FROM supplier")
def optional_source(spark, sf_dir):
    """A source that is there and one that is not."""
    path, schema = _new(spark), "s_suppkey long, s_name string"
    sinks.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), path)
    found = [readers.read_if_present(spark, p, schema) for p in (path, path + "-missing")]
    return next(df for df in found if df is not None)


@query(f"{FILLED} SELECT user_id, event_type, CAST(target_date AS VARCHAR) AS target_date, target AS y_true, filled AS y_pred, round(filled - target, 6) AS error, round(abs(filled - target), 6) AS abs_error FROM filled WHERE filled IS NOT NULL AND target IS NOT NULL")
def prediction_table(spark, sf_dir):
    """Forecasts with their errors, to CSV and back."""
    path = _new(spark)
    rows = filled_panel(spark, sf_dir).where("filled is not null and target is not null")
    sinks.write_predictions(rows.select(*KEYS, "target_date", F.col("target").alias("y_true"), F.col("filled").alias("y_pred")), path)
    back = readers.read_csv(spark, path, "user_id long, event_type string, target_date date, y_true double, y_pred double, error double, abs_error double")
    return rounded(back.withColumn("target_date", F.date_format("target_date", "yyyy-MM-dd")), "error", "abs_error")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def partitioned_write(spark, sf_dir):
    """A folder for each value, of which one is read."""
    path = _new(spark)
    sinks.write_parts(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), path, "l_returnflag")
    return spark.read.parquet(path).where("l_returnflag = 'A'").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing_rows, count({c}) AS non_missing_rows, CAST(min({c}) AS DOUBLE) AS least FROM lineitem" for c in ("l_extendedprice", "l_tax")))
def feature_list(spark, sf_dir):
    """Columns chosen by a pattern, written as a text file of names, and the profile of the columns that the file names."""
    path, df = _new(spark), table(spark, sf_dir, "lineitem")
    sinks.write_list(spark, columns.matching(df, "price|^l_tax"), path)
    chosen = df.select(*[r[0] for r in spark.read.text(path).collect()])
    least = chosen.agg(*[F.min(c).cast("double").alias(c) for c in chosen.columns]).unpivot([], chosen.columns, "feature", "least")
    return stats.missingness(chosen).select(F.col("column").alias("feature"), "missing_rows", "non_missing_rows").join(least, "feature")


_SETS = {"salinity": ["l_quantity", "l_linenumber"], "weather": ["l_quantity", "l_linenumber", "l_tax"], "multisource": ["l_quantity", "l_linenumber", "l_tax", "l_discount"], "compact": ["l_quantity", "l_linenumber", "l_tax", "l_extendedprice"]}


@query(" UNION ALL ".join(f"SELECT '{s}' AS feature_set, {i} AS place, '{c}' AS feature, '{'amount' if c in ('l_quantity', 'l_extendedprice') else 'rate' if c in ('l_tax', 'l_discount') else 'other'}' AS kind, round(avg({c}), 6) AS mean, count({c}) AS n FROM lineitem" for s, cs in _SETS.items() for i, c in enumerate(cs)))
def feature_sets(spark, sf_dir):
    """Named feature sets in order, of the columns that exist, each with its group, mean and support over all rows."""
    df = table(spark, sf_dir, "lineitem")
    rows = [(s, i, c) for s in _SETS for i, c in enumerate(columns.feature_set(df, s, ["l_quantity"], ["l_linenumber", "no_such"], ["l_tax"], ["l_discount"], ["l_extendedprice", "l_tax"]))]
    used = sorted({c for _, _, c in rows})
    sums = df.agg(*[F.struct(F.avg(c).alias("mean"), F.count(c).alias("n")).alias(c) for c in used]).unpivot([], used, "feature", "s")
    kind = columns.group_of({"amount": ["l_quantity", "l_extendedprice"], "rate": ["l_tax", "l_discount"]})
    named = spark.createDataFrame(rows, "feature_set string, place int, feature string").withColumn("kind", kind)
    return named.join(F.broadcast(sums), "feature").select("feature_set", "place", "feature", "kind", r6(F.col("s.mean"), "mean"), "s.n")


_BRANCHES = (("all", "residual", "l_quantity,l_tax", "l_suppkey,l_discount"), ("no_composite", "residual", "l_quantity,l_tax", "l_suppkey"), ("history_only", "residual", "l_quantity", "l_suppkey"), ("without_history", "direct", "l_linenumber,l_tax", "l_suppkey,l_discount"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS ablation, '{m}' AS mode, '{d}' AS dynamic, '{c}' AS context, count(*) AS n, round(avg(({d.replace(',', ' + ')}) / {len(d.split(','))}.0::DOUBLE), 6) AS dynamic_mean, round(avg(({c.replace(',', ' + ')}) / {len(c.split(','))}.0::DOUBLE), 6) AS context_mean FROM lineitem" for a, m, d, c in _BRANCHES))
def branch_columns(spark, sf_dir):
    """Columns of the dynamic and the context branch under each ablation, and the means of what each branch would read."""
    df = table(spark, sf_dir, "lineitem")
    rows, sums = [], []
    for name, *_ in _BRANCHES:
        dynamic, context, mode = columns.branches(df, ["l_quantity", "absent"], ["l_linenumber"], ["l_tax"], ["l_suppkey"], ["l_discount"], **({} if name == "all" else {name: True}))
        rows.append((name, mode, ",".join(dynamic), ",".join(context)))
        sums.append(F.struct(F.count("*").alias("n"), F.avg(S.row_mean(dynamic)).alias("d"), F.avg(S.row_mean(context)).alias("c")).alias(name))
    means = df.agg(*sums).unpivot([], [r[0] for r in rows], "ablation", "s")
    named = spark.createDataFrame(rows, "ablation string, mode string, dynamic string, context string")
    return named.join(F.broadcast(means), "ablation").select(*named.columns, "s.n", r6(F.col("s.d"), "dynamic_mean"), r6(F.col("s.c"), "context_mean"))


@query("SELECT 'orders' AS set_name, o_orderkey AS w_o_orderkey, o_custkey AS w_o_custkey FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL")
def column_shaping(spark, sf_dir):
    """Required columns, a subset by type, a prefix, a constant first, and rows without nulls."""
    df = checks.require_columns(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"])
    whole = df.select(*columns.features(df, [columns.numeric(df, ["o_totalprice"])]))
    named = columns.with_prefix(whole.where(~S.any_null(whole.columns)), "w_", [])
    return columns.constants(named, set_name="orders")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0")
def finite_values(spark, sf_dir):
    """Infinite values and those that are not numbers are nulls, and such rows go."""
    odd = F.when(F.col("s_suppkey") % 6 == 0, float("inf")).when(F.col("s_suppkey") % 3 == 0, float("nan")).otherwise(F.col("s_acctbal"))
    df = table(spark, sf_dir, "supplier").select("s_suppkey", odd.alias("s_acctbal"))
    both = G.finite_points(df, ["s_acctbal"]).join(df.where(S.finite(F.col("s_acctbal")).isNotNull()).select("s_suppkey"), "s_suppkey", "left_semi")
    return both


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 6) AS back FROM lineitem")
def unstandardised(spark, sf_dir):
    """Standardised values brought back to their scale."""
    from ..models.linear import Scaler

    df = table(spark, sf_dir, "lineitem")
    scaler = Scaler.fit(df, ["l_quantity"])
    scaled = df.withColumn("z", scaler.expressions()[0])
    return scaled.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r6(S.unstandardise(F.col("z"), scaler.mean["l_quantity"], scaler.std["l_quantity"]), "back"))


@query("SELECT column_name AS column, count(*) OVER () AS columns FROM (DESCRIBE nation) WHERE column_type IN ('INTEGER', 'BIGINT')")
def column_types(spark, sf_dir):
    """Columns of whole numbers by the type that the profile reports."""
    t = stats.missingness(table(spark, sf_dir, "nation")).where(F.col("dtype").isin("int", "bigint"))
    return t.select("column", F.lit(t.count()).cast("long").alias("columns"))


@query("SELECT o_orderpriority, o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) AS place FROM orders QUALIFY place <= 25")
def mixed_order(spark, sf_dir):
    """First rows by one column down and another up, as a preview shows them."""
    first = stats.preview(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey").orderBy(F.desc("o_orderpriority"), F.asc("o_orderkey")), 25)
    from pyspark.sql import Window

    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("o_orderpriority"), "o_orderkey")).cast("long"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT'")
def without_one_label(spark, sf_dir):
    return stats.without_label(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "1-URGENT")


@query("SELECT 'regions: ' || CAST(count(DISTINCT n_regionkey) AS VARCHAR) AS line FROM nation UNION ALL SELECT 'nations: ' || CAST(count(*) AS VARCHAR) FROM nation")
def console_summary(spark, sf_dir):
    """The lines that a run prints."""
    lines = stats.summary(table(spark, sf_dir, "nation"), nations=F.count("*"), regions=F.count_distinct("n_regionkey"))
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("SELECT n_nationkey, n_name, CAST(dense_rank() OVER (ORDER BY n_name) - 1 AS INTEGER) AS entity FROM nation")
def entity_lookup(spark, sf_dir):
    """Each row with the ordinal of its name."""
    return columns.with_ordinal(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name")


@query("SELECT l.l_orderkey, l.n, o.o_custkey FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l LEFT JOIN (SELECT o_orderkey, any_value(o_custkey) AS o_custkey FROM orders GROUP BY 1) o ON l_orderkey = o_orderkey")
def one_to_one_join(spark, sf_dir):
    """A join that asks both sides for unique keys."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.first("o_custkey").alias("o_custkey"))
    return checks.join_one_to_one(lines, orders, ["l_orderkey"])


_SEEN = "seen AS (SELECT strftime(o_orderdate, '%Y-%m') AS month FROM orders)"


@query(f"""{PANEL}, f AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS filled FROM panel), {_SEEN}
SELECT unnest(['station_count', 'grid_rows', 'date_start', 'date_end', 'observed_rows', 'observed_pct', 'invalid_rows', 'filled_rows', 'weather_rows_with_gaps']) AS metric,
unnest([CAST(count(DISTINCT user_id) AS VARCHAR), CAST(count(*) AS VARCHAR), CAST(min(day) AS VARCHAR), CAST(max(day) AS VARCHAR), CAST(count(value) AS VARCHAR), CAST(round_even(100.0::DOUBLE * count(value) / count(*), 2) AS VARCHAR), CAST(count(*) FILTER (value > 150) AS VARCHAR), CAST(count(*) FILTER (value IS NULL AND filled IS NOT NULL) AS VARCHAR), CAST(count(*) FILTER (low IS NULL) AS VARCHAR)]) AS value FROM f
UNION ALL SELECT 'composite_rows', CAST(count(*) AS VARCHAR) FROM seen UNION ALL SELECT 'composite_months', CAST(count(DISTINCT month) AS VARCHAR) FROM seen UNION ALL SELECT 'composite_month_start', min(month) FROM seen UNION ALL SELECT 'composite_month_end', max(month) FROM seen
UNION ALL SELECT 'composite_months_missing', (SELECT coalesce(string_agg(m, ',' ORDER BY m), '') FROM (SELECT '2024-01' AS m) WHERE m NOT IN (SELECT month FROM seen))""")
def panel_overview(spark, sf_dir):
    """The overview of a panel and of the composites that should go with it."""
    df = filled_panel(spark, sf_dir).withColumns({"observed_": F.col("value").isNotNull(), "gap_": F.col("value").isNull() & F.col("filled").isNotNull(), "bad_": F.col("value") > 150})
    seen = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return stats.panel_overview(df, "user_id", "day", "observed_", "gap_", "bad_", ["low"], seen, "month")


@query("SELECT event_type, string_agg(DISTINCT CAST(user_id % 5 AS VARCHAR), ',' ORDER BY CAST(user_id % 5 AS VARCHAR)) AS kinds FROM events GROUP BY 1")
def joined_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("kind", F.col("user_id") % 5).groupBy("event_type").agg(S.joined_values("kind").alias("kinds"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity - 273.15, 6) AS temperature_2m_min_c, round(l_quantity + 1 - 273.15, 6) AS temperature_2m_max_c, round(l_quantity - 1 - 273.15, 6) AS dewpoint_temperature_2m_c, round(greatest(l_tax - 0.04, 0) * 1000, 6) AS runoff_mm, round((l_tax - 0.04) * 1000, 6) AS potential_evaporation_mm_signed, round(greatest(l_extendedprice - 20000, 0) / 1e6, 9) AS solar_radiation_mj_m2 FROM lineitem""")
def weather_units_more(spark, sf_dir):
    """Least and greatest temperature, dew point, runoff, signed evaporation and radiation."""
    c, keys = F.col, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    raw = table(spark, sf_dir, "lineitem").select(*keys, c("l_quantity").alias("temperature_2m_min"), (c("l_quantity") + 1).alias("temperature_2m_max"), (c("l_quantity") - 1).alias("dewpoint_temperature_2m"), (c("l_tax") - 0.04).alias("runoff"), (c("l_tax") - 0.04).alias("potential_evaporation"), (c("l_extendedprice") - 20000).alias("solar_radiation"))
    return S.weather_units(raw).select(*keys, *[r6(c(x), x) for x in ("temperature_2m_min_c", "temperature_2m_max_c", "dewpoint_temperature_2m_c", "runoff_mm", "potential_evaporation_mm_signed")], F.round("solar_radiation_mj_m2", 9).alias("solar_radiation_mj_m2"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN round((1000 * label + 500) / 10000.0, 6) END AS red, CASE WHEN vec_id % 3 <> 0 THEN round((500 * label) / 10000.0, 6) END AS nir FROM embeddings")
def scaled_bands(spark, sf_dir):
    """Stored integers as reflectances, null where the pixel is not clear."""
    raw = table(spark, sf_dir, "embeddings").select("vec_id", (1000 * F.col("label") + 500).alias("red"), (500 * F.col("label")).alias("nir"))
    return rounded(S.mask_bands(S.scale_bands(raw, ["red", "nir"]), ["red", "nir"], F.col("vec_id") % 3 != 0), "red", "nir")


@query("""WITH seg AS (SELECT s_suppkey, unnest([0, 1]) AS part, s_nationkey AS n FROM supplier), ends AS (SELECT s_suppkey, CASE part WHEN 0 THEN 0.0::DOUBLE ELSE n END AS x0, 0.0::DOUBLE AS y0, CAST(n AS DOUBLE) AS x1, CASE part WHEN 0 THEN 0.0::DOUBLE ELSE 3.0 END AS y1 FROM seg),
marks AS (SELECT *, greatest(CAST(ceil(greatest(abs(x1 - x0), abs(y1 - y0)) * 2 / 2.0) AS INT), 1) AS n FROM ends)
SELECT DISTINCT s_suppkey, floor((x0 + (x1 - x0) * i / n) / 2.0) * 2.0 AS x, floor((y0 + (y1 - y0) * i / n) / 2.0) * 2.0 AS y FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM marks)""")
def rasterised_lines(spark, sf_dir):
    """Cells that polylines pass: along one axis, then up."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    n, zero, three = F.col("s_nationkey"), F.lit(0.0), F.lit(3.0)
    lines = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(at(zero, zero), at(n, zero), at(n, three)).alias("path"))
    out = G.rasterise(lines, "s_suppkey", "path", 2.0)
    return out.select("s_suppkey", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query("SELECT n_nationkey, round(500000 + 0.9996 * 6378137.0 * radians(n_nationkey / 1000.0), 1) AS near_east FROM nation")
def utm_easting(spark, sf_dir):
    """Eastings close to the central meridian on the equator, where the projection is nearly a line."""
    east, _ = S.utm(F.lit(105.0) + F.col("n_nationkey") / 1000.0, F.lit(0.0))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(east, 1).alias("near_east"))


@query("SELECT feature, round(avg(v), 6) AS v, count(*) AS folds FROM (SELECT l_returnflag, 'quantity' AS feature, avg(l_quantity) AS v FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'tax', avg(l_tax) FROM lineitem GROUP BY 1) GROUP BY 1")
def fold_averages(spark, sf_dir):
    """Means over folds of a value for each feature."""
    wide = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax")).unpivot("l_returnflag", ["quantity", "tax"], "feature", "v")
    return rounded(stats.fold_means(wide, ["feature"], ["v"]), "v")
