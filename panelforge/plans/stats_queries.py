"""Profiles, correlations, scores, rollups and scalar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import columns, panel as P, ranges, rollup as R, stats, windows
from ..session import table
from .base import DAILY, FILLED, KEYS, PANEL, W, daily, day_text, panel, query, r6
from .panel_queries import SCORES, filled_panel, rounded


@query("SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def group_profile(spark, sf_dir):
    v = "value"
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), F.round(F.sum(v), 4).alias("total"), r6(F.avg(v), "mean"), r6(F.stddev_samp(v), "std"), F.min(v).alias("least"), F.max(v).alias("most"))


@query(f"""{PANEL} SELECT event_type, CAST(day AS VARCHAR) AS day, count(*) AS total, count(value) AS observed, CASE WHEN count(*) <> 0 THEN round_even(100.0::DOUBLE * count(value) / count(*), 2) ELSE 0 END AS observed_pct,
round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, max(value) AS most FROM panel GROUP BY 1, 2""")
def coverage(spark, sf_dir):
    """Observed share of the panel by type and day."""
    df = panel(spark, sf_dir).groupBy("event_type", "day").agg(F.count("*").alias("total"), F.count("value").alias("observed"), r6(F.avg("value"), "mean"), r6(F.stddev_samp("value"), "std"), F.max("value").alias("most"))
    return df.withColumns({"observed_pct": S.safe_percent(F.col("observed"), F.col("total")), "day": day_text("day", "day")})


@query("""SELECT c_nationkey, strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(median(o_totalprice), 6) AS median, round(stddev_samp(o_totalprice), 6) AS std, min(o_totalprice) AS least, max(o_totalprice) AS most
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def station_month_stats(spark, sf_dir):
    """Monthly statistics of each nation's orders."""
    t = lambda n: table(spark, sf_dir, n)
    v = "o_totalprice"
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("year_month", S.year_month(F.col("o_orderdate")))
    return rows.groupBy("c_nationkey", "year_month").agg(F.count("*").alias("n"), r6(F.avg(v), "mean"), r6(F.median(v), "median"), r6(F.stddev_samp(v), "std"), F.min(v).alias("least"), F.max(v).alias("most"))


@query(f"{FILLED} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_rows, round_even(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS missing_pct, count({c}) AS non_missing_rows FROM filled" for c in ("value", "filled", "target")))
def missingness(spark, sf_dir):
    """Missing rows of each column, in one pass."""
    return stats.missingness(filled_panel(spark, sf_dir).select("value", "filled", "target")).drop("dtype")


@query(f"""{PANEL} SELECT 'rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM panel UNION ALL SELECT 'users', CAST(count(DISTINCT user_id) AS VARCHAR) FROM panel UNION ALL SELECT 'observed', CAST(count(value) AS VARCHAR) FROM panel
UNION ALL SELECT 'first_day', CAST(min(day) AS VARCHAR) FROM panel UNION ALL SELECT 'last_day', CAST(max(day) AS VARCHAR) FROM panel UNION ALL SELECT 'types', string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM panel""")
def overview_kpis(spark, sf_dir):
    types = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return stats.key_values(panel(spark, sf_dir), rows=F.count("*"), users=F.count_distinct("user_id"), observed=F.count("value"), first_day=F.date_format(F.min("day"), "yyyy-MM-dd"), last_day=F.date_format(F.max("day"), "yyyy-MM-dd"), types=types)


@query("SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS median_price, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2")
def medians_and_distinct(spark, sf_dir):
    """Exact medians by selection, and distinct counts."""
    lines, keys = table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]
    counts = lines.groupBy(*keys).agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))
    return ranges.quantiles(lines, ["l_extendedprice"], [0.5], keys).select(*keys, r6(F.col("value"), "median_price")).join(counts, keys)


@query("""SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS year_month, min(CAST(l_shipdate AS DATE))::VARCHAR AS date, round(sum(l_quantity), 6) AS quantity_sum, max(l_extendedprice) AS price_max, min(l_extendedprice) AS price_min, round(avg(l_discount), 6) AS discount_mean,
round(median(l_tax), 6) AS tax_median_week, count(*) AS n_rows, count(*) FILTER (l_discount < 0.05) AS n_reliable, count(*) FILTER (l_discount < 0.05) >= 2 AS mean_reliable FROM lineitem GROUP BY 1, 2""")
def suffix_rollup(spark, sf_dir):
    """Supplier months, each column aggregated by its suffix, with reliable counts."""
    price = F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", S.year_month(F.col("l_shipdate")).alias("year_month"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("quantity_sum"), price.alias("price_max"), price.alias("price_min"), F.col("l_discount").alias("discount_mean"), F.col("l_tax").alias("tax_median_week"), (F.col("l_discount") < 0.05).alias("reliable"))
    out = R.rollup(rows, ["l_suppkey", "year_month"], {"date": F.date_format(F.min("day"), "yyyy-MM-dd")}, "reliable", 2)
    return rounded(out, "quantity_sum", "discount_mean", "tax_median_week")


@query("""WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_suppkey, l_returnflag AS common_flag FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) = 1)
SELECT l_suppkey, common_flag, min(l_orderkey) AS first_order FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1, 2""")
def mode_and_first(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(R.mode_or("l_returnflag").alias("common_flag"), R.first_value("l_orderkey", "l_orderkey").alias("first_order"))


_FEATURES = ("l_quantity", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS n, round(corr({f}, l_extendedprice), 6) AS pearson FROM lineitem" for f in _FEATURES))
def pearson_table(spark, sf_dir):
    return rounded(stats.pearson_table(table(spark, sf_dir, "lineitem"), "l_extendedprice", list(_FEATURES), 100), "pearson")


def _rank(x, part=""):
    p = f"PARTITION BY {part} " if part else ""
    return f"(rank() OVER ({p}ORDER BY {x}) + (count(*) OVER (PARTITION BY {part + ', ' if part else ''}{x}) - 1) / 2.0::DOUBLE)"


def _spearman(group=""):
    g = f"{group}, " if group else ""
    return " UNION ALL ".join(f"SELECT {g}'{f}' AS feature, count(*) AS n, round(corr(a, b), 6) AS spearman FROM (SELECT {g}{_rank(f, group)} AS a, {_rank('l_extendedprice', group)} AS b FROM lineitem){' GROUP BY ' + group if group else ''}" for f in _FEATURES)


@query(_spearman())
def spearman_table(spark, sf_dir):
    return rounded(stats.spearman_table(table(spark, sf_dir, "lineitem"), "l_extendedprice", list(_FEATURES)), "spearman")


@query(_spearman("l_returnflag"))
def grouped_correlations(spark, sf_dir):
    return rounded(stats.spearman_table(table(spark, sf_dir, "lineitem"), "l_extendedprice", list(_FEATURES), ["l_returnflag"]), "spearman")


@query(f"SELECT kind, count(*) AS features, round(median(abs(spearman)), 6) AS median_abs, round(max(abs(spearman)), 6) AS max_abs FROM (SELECT CASE WHEN feature = 'l_quantity' THEN 'amount' ELSE 'rate' END AS kind, spearman FROM ({_spearman('l_returnflag')})) GROUP BY 1")
def correlation_group_summary(spark, sf_dir):
    """Correlations summarised by feature group."""
    corr = rounded(stats.spearman_table(table(spark, sf_dir, "lineitem"), "l_extendedprice", list(_FEATURES), ["l_returnflag"]), "spearman")
    named = corr.withColumn("kind", columns.group_of({"amount": ["l_quantity"]}, "rate"))
    return rounded(stats.correlation_groups(named, "kind", "spearman"), "median_abs", "max_abs")


@query("""WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS r, count(*) OVER () AS n FROM supplier)
SELECT s_suppkey, CASE WHEN 3 * (r - 1) < n - 1 OR n = 1 THEN 'near' WHEN 3 * (r - 1) < 2 * (n - 1) THEN 'mid' ELSE 'far' END AS tercile FROM r""")
def rank_terciles(spark, sf_dir):
    return stats.terciles(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey").select("s_suppkey", "tercile")


@query(f"SELECT p_partkey, {_rank('p_size', 'p_brand')} AS size_rank FROM part")
def average_rank(spark, sf_dir):
    return stats.average_ranks(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size", "size_rank").select("p_partkey", "size_rank")


_GUESS = "SELECT l_returnflag, l_suppkey, l_extendedprice AS t, l_quantity * p_retailprice AS p FROM lineitem JOIN part ON l_partkey = p_partkey"


def guesses(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("guess", F.col("l_quantity") * F.col("p_retailprice"))


@query(f"SELECT {SCORES.replace('6)', '4)')} FROM ({_GUESS})")
def regression_metrics(spark, sf_dir):
    out = stats.regression_scores("l_extendedprice", "guess")(guesses(spark, sf_dir))
    return out.select("n", *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "bias", "r2")])


@query(f"""SELECT count(*) AS n, round(sqrt(avg((p - t) ** 2)), 4) AS rmse, round(avg(abs(p - t)), 4) AS mae, round(avg(p - t), 4) AS bias, round(1 - sum((ln(1 + p) - ln(1 + t)) ** 2) / (count(*) * var_pop(ln(1 + t))), 4) AS r2
FROM (SELECT t, CASE WHEN p < 0 THEN 0 ELSE p END AS p FROM (SELECT t, p - 5000 AS p FROM ({_GUESS})))""")
def regression_metrics_log(spark, sf_dir):
    out = stats.regression_scores("l_extendedprice", "guess", log_r2=True)(guesses(spark, sf_dir).withColumn("guess", F.col("guess") - 5000))
    return out.select("n", *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "bias", "r2")])


@query(f"SELECT l_suppkey, {SCORES.replace('6)', '4)')} FROM ({_GUESS}) GROUP BY 1 HAVING count(*) >= 5")
def metrics_by_group(spark, sf_dir):
    out = stats.regression_scores("l_extendedprice", "guess", ["l_suppkey"], least=5)(guesses(spark, sf_dir))
    return out.select("l_suppkey", "n", *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "bias", "r2")])


@query(f"SELECT count(*) AS folds, round(avg(rmse), 3) AS rmse_mean, round(stddev_samp(rmse), 3) AS rmse_std, round(avg(mae), 3) AS mae_mean FROM (SELECT sqrt(avg((p - t) ** 2)) AS rmse, avg(abs(p - t)) AS mae FROM ({_GUESS}) GROUP BY l_suppkey)")
def macro_average(spark, sf_dir):
    folds = stats.regression_scores("l_extendedprice", "guess", ["l_suppkey"])(guesses(spark, sf_dir))
    return folds.agg(F.count("*").alias("folds"), F.round(F.avg("rmse"), 3).alias("rmse_mean"), F.round(F.stddev_samp("rmse"), 3).alias("rmse_std"), F.round(F.avg("mae"), 3).alias("mae_mean"))


@query(f"""{PANEL}, s AS (SELECT *, lag(value, 1) OVER {W}) AS a, lag(value, 2) OVER {W}) AS b, lag(value, 3) OVER {W}) AS c FROM panel),
e AS (SELECT event_type, value AS t, (a + b + c) / 3 AS p FROM s WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND value IS NOT NULL) SELECT event_type, {SCORES} FROM e GROUP BY 1""")
def seed_ensemble(spark, sf_dir):
    """Mean of three forecasts joined one to one on their keys, scored by type."""
    lagged = windows.lags(panel(spark, sf_dir), KEYS, "day", "value", (1, 2, 3))
    frames = [lagged.select(*KEYS, "day", "value", F.col(f"value_lag{i}").alias("guess")).where("guess is not null") for i in (1, 2, 3)]
    joined = stats.ensemble([frames[0].drop("value"), *[f.drop("value") for f in frames[1:]]], [*KEYS, "day"], "guess").join(daily(spark, sf_dir), [*KEYS, "day"])
    return rounded(stats.regression_scores("value", "guess_mean", ["event_type"])(joined), "rmse", "mae", "bias", "r2")


@query(f"""{FILLED} SELECT event_type, {SCORES} FROM (SELECT a.event_type, a.filled AS p, b.value AS t FROM filled a JOIN panel b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.day = a.day + 7) WHERE p IS NOT NULL AND t IS NOT NULL GROUP BY 1""")
def persistence_lookup(spark, sf_dir):
    """The filled value of seven days before, found by an inner join on shifted dates."""
    df = filled_panel(spark, sf_dir)
    past = df.select(*KEYS, F.date_add("day", 7).alias("day"), "filled")
    joined = past.join(df.select(*KEYS, "day", "value"), [*KEYS, "day"]).dropna(subset=["filled", "value"])
    return rounded(stats.regression_scores("value", "filled", ["event_type"])(joined), "rmse", "mae", "bias", "r2")


@query("SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM events GROUP BY 1")
def describe_exact(spark, sf_dir):
    return rounded(stats.describe(table(spark, sf_dir, "events"), "value", ["event_type"]), "mean", "std", "q25", "q50", "q75")


@query("""WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn FROM labels)
SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""")
def precision_recall(spark, sf_dir):
    """Precision, recall and F1 of low quality as a guess of toxicity."""
    out = table(spark, sf_dir, "labels").agg(*stats.classification_scores(F.col("toxic") == 1, F.col("quality") == 0))
    return rounded(out, "precision", "recall", "f1")


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) = 1")
def argmin_trial(spark, sf_dir):
    best = F.min(F.struct("p_retailprice", "p_partkey")).alias("best")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(best).select("p_brand", "best.p_partkey", "best.p_retailprice")


@query("SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def topk(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_brand", "p_retailprice")


@query("SELECT p_brand, arg_max(p_partkey, p_retailprice * 1000000 + p_partkey) AS best, arg_min(p_partkey, p_retailprice * 1000000 + p_partkey) AS worst FROM part GROUP BY 1")
def best_and_worst(spark, sf_dir):
    order = F.col("p_retailprice") * 1000000 + F.col("p_partkey")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_partkey", order).alias("best"), F.min_by("p_partkey", order).alias("worst"))


@query(f"""{PANEL}, m AS (SELECT median(value) AS md FROM panel), f AS (SELECT *, coalesce(value, md) AS x FROM panel, m), s AS (SELECT avg(x) AS mu, stddev_samp(x) AS sd FROM f)
SELECT user_id, event_type, CAST(day AS VARCHAR) AS day, round((x - mu) / sd, 6) AS scaled FROM f, s""")
def standardize(spark, sf_dir):
    """Median fill, then standard scores, fitted on the whole panel."""
    from ..models.linear import Scaler

    df = panel(spark, sf_dir)
    return df.select(*KEYS, day_text("day", "day"), r6(Scaler.fit(df, ["value"], population=False).expressions()[0], "scaled"))


@query(f"WITH {DAILY} SELECT event_type, round(avg(value), 6) AS target_mean, round(stddev_pop(value), 6) AS target_std FROM daily GROUP BY 1")
def target_scale(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("event_type").agg(r6(F.avg("value"), "target_mean"), r6(F.stddev_pop("value"), "target_std"))


@query("SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'debt' WHEN c_acctbal <= 5000 THEN 'some' ELSE 'rich' END AS band FROM customer")
def bins_right_closed(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.bins_right_closed(F.col("c_acctbal"), [0, 5000], ["debt", "some", "rich"]).alias("band"))


@query("SELECT n_name, CASE WHEN count(c_custkey) <> 0 THEN round_even(100.0::DOUBLE * count(*) FILTER (c_acctbal < 0) / count(c_custkey), 2) ELSE 0 END AS debt_pct FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def safe_percent(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("nation").join(t("customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.groupBy("n_name").agg(F.count_if(F.col("c_acctbal") < 0).alias("a"), F.count("c_custkey").alias("b")).select("n_name", S.safe_percent(F.col("a"), F.col("b")).alias("debt_pct"))


@query("SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{v}' AS INTEGER) AS status_{v}" for v in "FOP") + " FROM orders")
def one_hot(spark, sf_dir):
    return S.one_hot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "status").drop("o_orderstatus")


@query("WITH m AS (SELECT CASE WHEN median(x) < 0 THEN -1 ELSE 1 END AS sign FROM (SELECT -p_retailprice AS x FROM part)) SELECT p_partkey, -p_retailprice * sign AS evaporation FROM part, m")
def sign_correction(spark, sf_dir):
    return S.flip_if_median_negative(table(spark, sf_dir, "part").select("p_partkey", (-F.col("p_retailprice")).alias("evaporation")), "evaporation")


@query("SELECT p_partkey, p_retailprice AS price, CAST(p_size AS VARCHAR) || 'cm' AS size_text FROM part")
def comma_decimal(spark, sf_dir):
    """Text prices with a decimal comma parse; a text column that does not parse stays as it is."""
    text = F.regexp_replace(F.format_string("%.2f", "p_retailprice"), r"\.", ",")
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("price"), F.concat(F.col("p_size").cast("string"), F.lit("cm")).alias("size_text"))
    return S.coerce_numeric(rows, ["price", "size_text"])


@query(f"""{PANEL}, s AS (SELECT user_id, event_type, day, value AS a, lag(value, 1) OVER {W}) AS b, lag(value, 2) OVER {W}) AS c FROM panel)
SELECT user_id, event_type, CAST(day AS VARCHAR) AS day, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif(CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER) + CAST(c IS NOT NULL AS INTEGER), 0), 6) AS mean, (a IS NULL OR b IS NULL OR c IS NULL) AS partial FROM s""")
def row_mean(spark, sf_dir):
    """Mean of the values that a row has, and whether one is missing."""
    df = windows.lags(panel(spark, sf_dir), KEYS, "day", "value", (1, 2))
    cols = ["value", "value_lag1", "value_lag2"]
    return df.select(*KEYS, day_text("day", "day"), r6(S.row_mean(cols), "mean"), S.any_null(cols).alias("partial"))


@query("SELECT 'retail' AS source, p_partkey AS id, p_retailprice AS price, CAST(NULL AS DOUBLE) AS balance FROM part UNION ALL SELECT 'customer', c_custkey, NULL, c_acctbal FROM customer")
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.lit("retail").alias("source"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    b = table(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS measure, round(avg({c}), 6) AS mean FROM lineitem GROUP BY 1" for c in _FEATURES))
def wide_to_long(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in _FEATURES])
    return rounded(wide.unpivot("l_returnflag", list(_FEATURES), "measure", "mean"), "mean")


@query("SELECT n_name, CAST(dense_rank() OVER (ORDER BY n_name) - 1 AS INTEGER) AS entity FROM nation")
def entity_index(spark, sf_dir):
    """Ordinal index of sorted entity names."""
    return columns.ordinal(table(spark, sf_dir, "nation"), "n_name")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


_LOG = "ln(1 + l_extendedprice)"


@query(" UNION ALL ".join(f"SELECT '{f}' AS feature, n, 0.0::DOUBLE AS missing_share, round(corr(x, t), 6) AS pearson, round(corr(a, b), 6) AS spearman, round(corr(x, lt), 6) AS pearson_log, round(corr(a, b), 6) AS spearman_log, round(abs(corr(a, b)), 6) AS abs_spearman_log FROM (SELECT {f} AS x, l_extendedprice AS t, {_LOG} AS lt, {_rank(f)} AS a, {_rank('l_extendedprice')} AS b, count(*) OVER () AS n FROM lineitem) GROUP BY n" for f in _FEATURES))
def correlation_table(spark, sf_dir):
    """Support, missing share and four coefficients of each feature."""
    out = stats.correlation_table(table(spark, sf_dir, "lineitem"), "l_extendedprice", list(_FEATURES))
    return rounded(out, "pearson", "spearman", "pearson_log", "spearman_log", "abs_spearman_log")


_SETS = (("overall", "'all'"), ("season", "CASE WHEN month(l_shipdate) IN (12, 1, 2, 3, 4, 5) THEN 'dry' ELSE 'wet' END"), ("flag", "l_returnflag"))


def _set_sql(kind: str, group: str, feature: str) -> str:
    rows = f"SELECT {group} AS g, CASE WHEN l_linenumber % 3 <> 0 THEN {feature} END AS x, l_extendedprice AS t FROM lineitem"
    ranks = f"SELECT g, x, t, {_rank('x', 'g')} AS a, {_rank('t', 'g')} AS b FROM ({rows}) WHERE x IS NOT NULL"
    share = f"SELECT g, avg(CAST(x IS NULL AS INTEGER)) AS missing_share FROM ({rows}) GROUP BY 1"
    return f"""SELECT '{kind}' AS group_type, g AS "group", '{feature}' AS feature, n, round(missing_share, 6) AS missing_share, round(p, 6) AS pearson, round(s, 6) AS spearman, round(pl, 6) AS pearson_log, round(s, 6) AS spearman_log, round(abs(s), 6) AS abs_spearman_log
FROM (SELECT g, count(*) AS n, corr(x, t) AS p, corr(a, b) AS s, corr(x, ln(1 + t)) AS pl FROM ({ranks}) GROUP BY 1) JOIN ({share}) USING (g)"""


@query(" UNION ALL ".join(_set_sql(k, g, f) for k, g in _SETS for f in _FEATURES))
def correlation_sets(spark, sf_dir):
    """Support, missing share and four coefficients over all rows, by season and by flag, from one scan."""
    season = F.when(F.month("l_shipdate").isin(12, 1, 2, 3, 4, 5), "dry").otherwise("wet")
    rows = table(spark, sf_dir, "lineitem").withColumns({"season_": season} | {f: F.when(F.col("l_linenumber") % 3 != 0, F.col(f)) for f in _FEATURES})
    out = stats.correlation_sets(rows, "l_extendedprice", list(_FEATURES), {"season": "season_", "flag": "l_returnflag"})
    return rounded(out, "missing_share", "pearson", "spearman", "pearson_log", "spearman_log", "abs_spearman_log")


@query("SELECT count(*) AS raw, count(*) FILTER (c_acctbal > 0) AS water, count(*) FILTER (c_acctbal > 0 AND c_nationkey < 10) AS near_river, count(*) FILTER (c_acctbal > 0 AND c_nationkey < 10 AND c_mktsegment <> 'BUILDING') AS mapped FROM customer")
def grid_audit(spark, sf_dir):
    """Rows left after each filter of a grid, in one pass."""
    c = F.col
    return P.audit(table(spark, sf_dir, "customer"), water=c("c_acctbal") > 0, near_river=c("c_nationkey") < 10, mapped=c("c_mktsegment") != "BUILDING")


@query("SELECT o_orderkey, l_partkey, l_suppkey FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1) ON l_orderkey = o_orderkey")
def save_first_join(spark, sf_dir):
    """Each order with the first of its lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    return P.first_match(table(spark, sf_dir, "orders").select("o_orderkey"), lines, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).drop("l_linenumber")
