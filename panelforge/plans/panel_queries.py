"""Panel assembly, causal features, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import clip, cyclic, date_parts, flag_at_least, season, three_way_weight
from ..operators import checks, panel as P, splits, stats, windows
from ..session import table
from .base import DAILY, FILLED, GRID, KEYS, PANEL, W, daily, day_text, panel, query, r6

SCORES = "count(*) AS n, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(avg(abs(p - t)), 6) AS mae, round(avg(p - t), 6) AS bias, round(CASE WHEN var_pop(t) > 0 THEN 1 - sum((p - t) * (p - t)) / (count(*) * var_pop(t)) END, 6) AS r2"


def rounded(df, *names):
    return df.select(*[c for c in df.columns if c not in names], *[r6(F.col(c), c) for c in names])


def filled_panel(spark, sf_dir):
    return windows.lead_target(P.causal_features(panel(spark, sf_dir), KEYS, "day", "value", 3), KEYS, "day", "value", 3)


@query(f"{FILLED} SELECT event_type, {SCORES} FROM (SELECT event_type, filled AS p, target AS t FROM filled WHERE filled IS NOT NULL AND target IS NOT NULL) GROUP BY 1")
def panel_persistence(spark, sf_dir):
    """Scores of the gap-filled value as forecast of the value three days later, by event type."""
    return rounded(stats.regression_scores("target", "filled", ["event_type"])(filled_panel(spark, sf_dir)), "rmse", "mae", "bias", "r2")


@query(f"WITH {DAILY}, {GRID} SELECT user_id, event_type, CAST(day AS VARCHAR) AS day FROM grid")
def cross_grid(spark, sf_dir):
    """Every user and type on every day."""
    return P.densify(daily(spark, sf_dir).select(*KEYS, "day"), KEYS, "day").select(*KEYS, day_text("day", "day"))


@query(f"{PANEL} SELECT user_id, event_type, CAST(day AS VARCHAR) AS day, value, low FROM panel")
def left_join_panel(spark, sf_dir):
    return panel(spark, sf_dir).select(*KEYS, day_text("day", "day"), "value", "low")


@query(f"""WITH {DAILY}, q AS (SELECT *, (value NOT BETWEEN 5 AND 150) AS hb, (low NOT BETWEEN 5 AND 150) AS lb, (low > value) AS rev FROM daily)
SELECT user_id, event_type, CAST(day AS VARCHAR) AS day, CAST((hb OR rev) AS INTEGER) AS qc_invalid, CASE WHEN NOT (hb OR rev) THEN value END AS value, CASE WHEN NOT (lb OR rev) THEN low END AS low FROM q""")
def qc_flags(spark, sf_dir):
    """Closed-range and order checks with selective nulls."""
    out = P.range_qc(daily(spark, sf_dir), "value", "low", 5.0, 150.0)
    return out.select(*KEYS, day_text("day", "day"), "qc_invalid", "value", "low")


@query(f"""{FILLED} SELECT user_id, event_type, CAST(day AS VARCHAR) AS day, CAST(value IS NOT NULL AS INTEGER) AS observed, filled,
CAST(value IS NULL AND filled IS NOT NULL AS INTEGER) AS imputed, CAST(coalesce(day - last_day, 9999) AS INTEGER) AS days_since FROM filled""")
def causal_fill(spark, sf_dir):
    """Forward fill of at most three days, its flag, and days since the last observation."""
    out = P.causal_features(panel(spark, sf_dir), KEYS, "day", "value", 3)
    return out.select(*KEYS, day_text("day", "day"), "observed", "filled", "imputed", "days_since")


@query(f"{PANEL} SELECT user_id, event_type, CAST(day AS VARCHAR) AS day, lag(value, 1) OVER {W}) AS value_lag1, lag(value, 2) OVER {W}) AS value_lag2 FROM panel")
def lag_features(spark, sf_dir):
    return windows.lags(panel(spark, sf_dir), KEYS, "day", "value", (1, 2)).select(*KEYS, day_text("day", "day"), "value_lag1", "value_lag2")


@query(f"{FILLED} SELECT user_id, event_type, CAST(day AS VARCHAR) AS day, target, CAST(target_date AS VARCHAR) AS target_date FROM filled")
def lead_target(spark, sf_dir):
    return filled_panel(spark, sf_dir).select(*KEYS, day_text("day", "day"), "target", day_text("target_date", "target_date"))


@query(f"{PANEL} SELECT user_id, event_type, CAST(day AS VARCHAR) AS day, last_value(value IGNORE NULLS) OVER {W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS baseline FROM panel")
def persistence_last_valid(spark, sf_dir):
    df = panel(spark, sf_dir)
    return df.select(*KEYS, day_text("day", "day"), windows.last_valid(df, KEYS, "day", "value", 7).alias("baseline"))


_LAGS = ", ".join(f"lag(value, {i}) OVER {W}) AS v{i}" for i in range(7))
_WEIGHTED = " + ".join(f"{7 - i} * coalesce(v{i}, 0)" for i in range(7))
_NULLS = " + ".join(f"CAST(v{i} IS NULL AS INTEGER)" for i in range(7))


@query(f"""{PANEL}, s AS (SELECT user_id, event_type, day, {_LAGS}, lag(day, 6) OVER {W}) AS first_day, lead(value, 3) OVER {W}) AS target, lead(day, 3) OVER {W}) AS target_date FROM panel)
SELECT user_id, event_type, CAST(first_day AS VARCHAR) AS input_start, CAST(day AS VARCHAR) AS input_end, CAST(target_date AS VARCHAR) AS target_date, target, round({_WEIGHTED}, 6) AS weighted, {_NULLS} AS nulls
FROM s WHERE first_day IS NOT NULL AND target IS NOT NULL""")
def sliding_sequence(spark, sf_dir):
    """Complete windows of seven days with the value three days after; the sequence as a checksum and its nulls."""
    out = windows.sequences(panel(spark, sf_dir), KEYS, "day", ["value"], "value", 7, 3)
    weighted = F.aggregate(F.transform("sequence", lambda s, i: (i + 1) * F.coalesce(s["value"], F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    nulls = F.size(F.filter("sequence", lambda s: s["value"].isNull())).cast("int").alias("nulls")
    return out.select(*KEYS, day_text("input_start", "input_start"), day_text("input_end", "input_end"), day_text("target_date", "target_date"), "target", r6(weighted, "weighted"), nulls)


@query(f"""{FILLED} SELECT event_type, CASE WHEN target_date <= DATE '2024-01-18' THEN 'train' WHEN target_date <= DATE '2024-01-24' THEN 'val' ELSE 'test' END AS split, count(*) AS n, round(avg(target), 6) AS mean_target
FROM filled WHERE target IS NOT NULL GROUP BY 1, 2""")
def temporal_split(spark, sf_dir):
    """Samples by the part that their target date falls into."""
    rows = filled_panel(spark, sf_dir).where("target is not null")
    split = windows.split_by_date(F.col("target_date"), "2024-01-18", "2024-01-24").alias("split")
    return rows.groupBy("event_type", split).agg(F.count("*").alias("n"), r6(F.avg("target"), "mean_target"))


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) IN (1995, 1996, 1997, 1998) THEN 'train' WHEN year(o_orderdate) = 1999 THEN 'val' WHEN year(o_orderdate) IN (2000, 2001) THEN 'test' END AS split FROM orders""")
def year_split(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", windows.split_by_year(F.year("o_orderdate"), (1995, 1996, 1997, 1998), (1999,), (2000, 2001)).alias("split"))


@query("""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(avg(o_totalprice), 6) AS month_mean, count(*) AS month_n FROM orders GROUP BY 1),
d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(d.day AS VARCHAR) AS day, d.n, m.month_mean, m.month_n FROM d LEFT JOIN m ON m.month = CAST(date_trunc('month', d.day) - INTERVAL 1 MONTH AS DATE)""")
def prior_month_join(spark, sf_dir):
    """Days with the aggregates of the month before."""
    orders = table(spark, sf_dir, "orders")
    monthly = orders.groupBy(F.to_date(F.trunc(F.to_date("o_orderdate"), "month")).alias("month")).agg(r6(F.avg("o_totalprice"), "month_mean"), F.count("*").alias("month_n"))
    days = orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return P.attach_previous_month(days, "day", monthly, "month").select(day_text("day", "day"), "n", "month_mean", "month_n")


@query(f"WITH {DAILY}, {GRID} SELECT g.user_id, g.event_type, CAST(g.day AS VARCHAR) AS day FROM grid g ANTI JOIN daily d USING (user_id, event_type, day)")
def anti_missing(spark, sf_dir):
    """Grid days without an observation."""
    seen = daily(spark, sf_dir)
    grid = P.densify(seen.select(*KEYS, "day"), KEYS, "day")
    return P.missing_keys(grid, seen, [*KEYS, "day"]).select(*KEYS, day_text("day", "day"))


@query("""SELECT o_orderstatus, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) AS inside,
count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) AS outside FROM orders GROUP BY 1""")
def semi_filter(spark, sf_dir):
    """Orders inside and outside a set of customers."""
    orders, chosen = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    inside = orders.join(chosen, "o_custkey", "left_semi").withColumn("side", F.lit(1))
    outside = orders.join(chosen, "o_custkey", "left_anti").withColumn("side", F.lit(0))
    return inside.unionByName(outside).groupBy("o_orderstatus").agg(F.count_if(F.col("side") == 1).alias("inside"), F.count_if(F.col("side") == 0).alias("outside"))


@query("""WITH s AS (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS x, s_acctbal / 1000 AS y FROM supplier), m AS (SELECT * FROM s WHERE y < 0), d AS (SELECT * FROM s WHERE y >= 0),
p AS (SELECT m.s_suppkey, d.s_suppkey AS donor_key, (m.x - d.x) * (m.x - d.x) + (m.y - d.y) * (m.y - d.y) AS d2 FROM m CROSS JOIN d)
SELECT s_suppkey, donor_key, round(d2, 6) AS d2 FROM p QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY d2, donor_key) = 1""")
def nearest_donor(spark, sf_dir):
    """For each supplier in debt the nearest one that is not."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("x"), (F.col("s_acctbal") / 1000).alias("y"))
    return P.nearest_donor(s.where("y < 0"), s.where("y >= 0"), "s_suppkey", "x", "y").select("s_suppkey", "donor_key", r6(F.col("d2"), "d2"))


@query("""WITH s AS (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS x, s_acctbal / 1000 AS y FROM supplier), m AS (SELECT * FROM s WHERE y < 0), d AS (SELECT * FROM s WHERE y >= 0),
p AS (SELECT m.s_suppkey, d.s_suppkey AS donor_key FROM m CROSS JOIN d QUALIFY row_number() OVER (PARTITION BY m.s_suppkey ORDER BY (m.x - d.x) * (m.x - d.x) + (m.y - d.y) * (m.y - d.y), d.s_suppkey) = 1),
t AS (SELECT l_suppkey AS s_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(sum(l_quantity), 6) AS quantity FROM lineitem JOIN d ON d.s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT s_suppkey, CAST(month AS VARCHAR) AS month, quantity, CAST(NULL AS BIGINT) AS imputed_from FROM t UNION ALL
SELECT p.s_suppkey, CAST(t.month AS VARCHAR), t.quantity, p.donor_key FROM p JOIN t ON t.s_suppkey = p.donor_key""")
def donor_series(spark, sf_dir):
    """Monthly series with those of suppliers without data copied from their donors."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("x"), (F.col("s_acctbal") / 1000).alias("y"))
    donors = s.where("y >= 0")
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey").join(donors, "s_suppkey", "left_semi")
    series = lines.groupBy("s_suppkey", F.to_date(F.trunc(F.to_date("l_shipdate"), "month")).alias("month")).agg(r6(F.sum("l_quantity"), "quantity"))
    choice = P.nearest_donor(s.where("y < 0"), donors, "s_suppkey", "x", "y").select("s_suppkey", "donor_key")
    return P.fill_from_donor(series, choice, "s_suppkey").withColumn("month", day_text("month", "month"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return checks.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1")
def dedupe_first(spark, sf_dir):
    return P.dedupe_first(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("""SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def many_to_one_join(spark, sf_dir):
    """Orders with their customer's segment and nation, the right keys checked to be unique."""
    t = lambda n: table(spark, sf_dir, n)
    out = checks.join_many_to_one(t("orders"), t("customer"), ["o_custkey"], ["c_custkey"])
    return checks.join_many_to_one(out, t("nation"), ["c_nationkey"], ["n_nationkey"]).select("o_orderkey", "c_mktsegment", "n_name")


_DAY = "CAST(o_orderdate AS DATE)"


@query(f"SELECT o_orderkey, CAST(year({_DAY}) AS INTEGER) AS year, CAST(month({_DAY}) AS INTEGER) AS month, CAST(day({_DAY}) AS INTEGER) AS day, CAST(dayofyear({_DAY}) AS INTEGER) AS day_of_year, CAST(week({_DAY}) AS INTEGER) AS week, strftime({_DAY}, '%Y-%m') AS year_month FROM orders")
def date_features(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", *date_parts(day), F.date_format(day, "yyyy-MM").alias("year_month"))


@query(f"SELECT o_orderkey, round(sin(dayofyear({_DAY}) * (2 * pi() / 365.25)), 6) AS doy_sin, round(cos(dayofyear({_DAY}) * (2 * pi() / 365.25)), 6) AS doy_cos, round(sin(month({_DAY}) * (2 * pi() / 12)), 6) AS month_sin, round(cos(month({_DAY}) * (2 * pi() / 12)), 6) AS month_cos FROM orders")
def cyclic_features(spark, sf_dir):
    day = F.to_date("o_orderdate")
    df = table(spark, sf_dir, "orders").select("o_orderkey", *cyclic(F.dayofyear(day), 365.25, "doy"), *cyclic(F.month(day), 12, "month"))
    return df.select("o_orderkey", *[r6(F.col(c), c) for c in df.columns[1:]])


@query(f"SELECT o_orderkey, CASE WHEN month({_DAY}) IN (12, 1, 2, 3, 4, 5) THEN 'dry' ELSE 'wet' END AS season, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE WHEN o_orderstatus = 'O' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END AS weight, CASE WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END AS large FROM orders")
def season_and_weight(spark, sf_dir):
    """Season label, three-way weight of a nullable flag and a threshold label."""
    flag = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return table(spark, sf_dir, "orders").select("o_orderkey", season(F.month("o_orderdate")).alias("season"), three_way_weight(flag).alias("weight"), flag_at_least(F.col("o_totalprice"), 100000).alias("large"))


@query(f"""{PANEL} SELECT user_id, event_type, CAST(day AS VARCHAR) AS day, CASE WHEN value < 10 THEN 10 WHEN value > 100 THEN 100 ELSE value END AS clipped FROM panel""")
def clip_null_safe(spark, sf_dir):
    return panel(spark, sf_dir).select(*KEYS, day_text("day", "day"), clip(F.col("value"), 10, 100).alias("clipped"))


@query("SELECT DISTINCT month, o_orderpriority FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month FROM orders), (SELECT DISTINCT o_orderpriority FROM orders) EXCEPT SELECT strftime(o_orderdate, '%Y-%m'), o_orderpriority FROM orders WHERE o_totalprice > 450000")
def except_months(spark, sf_dir):
    """Months without a large order, by priority."""
    orders = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    every = orders.select("month").distinct().crossJoin(F.broadcast(orders.select("o_orderpriority").distinct()))
    return P.missing_keys(every, orders.where("o_totalprice > 450000"), ["month", "o_orderpriority"])


@query(f"WITH {DAILY}, {GRID} SELECT CAST(day AS VARCHAR) AS date FROM days")
def calendar_days(spark, sf_dir):
    low, high = daily(spark, sf_dir).agg(F.min("day"), F.max("day")).first()
    return P.calendar(spark, str(low), str(high)).select(day_text("date", "date"))


def fold_sql(key: str, source: str, folds: int = 5) -> str:
    """CTEs up to `folds` (key, fold): the largest group first (ties: the larger key), each to the lightest fold."""
    return f"""sizes AS (SELECT {key} AS k, count(*) AS n FROM {source} GROUP BY 1), ordered AS (SELECT k, n, row_number() OVER (ORDER BY n DESC, k DESC) AS i FROM sizes),
dealt AS (SELECT CAST(0 AS BIGINT) AS i, NULL::BIGINT AS k, CAST(0 AS BIGINT) AS fold, list_transform(range({folds}), lambda x: CAST(0 AS BIGINT)) AS loads UNION ALL
SELECT o.i, CAST(o.k AS BIGINT), list_position(d.loads, list_min(d.loads)), list_transform(d.loads, lambda x, j: CASE WHEN j = list_position(d.loads, list_min(d.loads)) THEN x + o.n ELSE x END) FROM dealt d JOIN ordered o ON o.i = d.i + 1),
folds AS (SELECT k, CAST(fold AS INTEGER) AS fold FROM dealt WHERE i > 0)"""


def _cv_sql(train: str, test: str) -> str:
    return f"""WITH RECURSIVE rows AS (SELECT c_nationkey, year(o_orderdate) AS year FROM orders JOIN customer ON o_custkey = c_custkey), {fold_sql('c_nationkey', 'rows')},
parts AS (SELECT f.fold, c_nationkey, CASE WHEN own.fold = f.fold AND {test} THEN 'test' WHEN own.fold <> f.fold AND year = 2000 THEN 'val' WHEN own.fold <> f.fold AND {train} THEN 'train' END AS part
FROM rows JOIN folds own ON own.k = c_nationkey CROSS JOIN (SELECT DISTINCT fold FROM folds) f)
SELECT fold, part, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM parts WHERE part IS NOT NULL AND fold IN (SELECT fold FROM parts WHERE part IS NOT NULL GROUP BY fold HAVING count(DISTINCT part) = 3) GROUP BY 1, 2"""


@query(f"WITH RECURSIVE {fold_sql('c_nationkey', 'customer')} SELECT k AS c_nationkey, fold FROM folds")
def group_kfold(spark, sf_dir):
    """Folds of nations by their customers, no nation on both sides."""
    return splits.group_folds(table(spark, sf_dir, "customer"), "c_nationkey", 5)


@query(_cv_sql("year <> 2000", "true"))
def spatial_cv(spark, sf_dir):
    """Rows of each fold by part: other nations before and in the validation year, the fold's nations in all years."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("year", F.year("o_orderdate"))
    folds = splits.group_folds(rows, "c_nationkey", 5)
    year = F.col("year")
    parts = splits.fold_parts(rows, folds, "c_nationkey", 5, year != 2000, year == 2000, F.lit(True))
    return parts.groupBy("fold", "part").agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("nations"))


@query(_cv_sql("year < 2000", "year = 2001"))
def spatiotemporal_cv(spark, sf_dir):
    """As spatial_cv, but trained on the past and tested on the last year only."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("year", F.year("o_orderdate"))
    folds = splits.group_folds(rows, "c_nationkey", 5)
    year = F.col("year")
    parts = splits.fold_parts(rows, folds, "c_nationkey", 5, year < 2000, year == 2000, year == 2001)
    return parts.groupBy("fold", "part").agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("nations"))
