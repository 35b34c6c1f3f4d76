"""Profiles, correlations and scores as single aggregations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from . import ranges
from .ranges import quantiles, running_totals


def describe(df: DataFrame, column: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, count, mean, std, min, q25, q50, q75, max) of a column; quartiles by selection, whatever a group's size."""
    groups = groups or []
    x = F.col(column)
    sums = df.groupBy(*groups).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    at = lambda s: F.max(F.when(F.col("share") == s, F.col("value")))
    quarters = quantiles(df, [column], [0.25, 0.5, 0.75], groups).groupBy(*groups).agg(at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))
    out = sums.alias("a").join(quarters.alias("b"), reduce(lambda p, q: p & q, [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups], F.lit(True)), "left")
    return out.select(*[F.col(f"a.{g}").alias(g) for g in groups], "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def missingness(df: DataFrame) -> DataFrame:
    """(column, dtype, missing_rows, missing_pct, non_missing_rows), most missing first, then by name; one pass."""
    names = df.columns
    counts = df.agg(F.count("*").alias("rows_"), *[F.count(c).alias(c) for c in names])
    kinds = F.create_map(*[x for c, k in df.dtypes for x in (F.lit(c), F.lit(k))])
    long = counts.unpivot("rows_", names, "column", "non_missing_rows")
    missing = F.col("rows_") - F.col("non_missing_rows")
    share = F.when(F.col("rows_") > 0, F.bround(100.0 * missing / F.col("rows_"), 2)).otherwise(0.0)
    return long.select("column", kinds[F.col("column")].alias("dtype"), missing.alias("missing_rows"), share.alias("missing_pct"), "non_missing_rows").orderBy(F.desc("missing_rows"), "column")


def key_values(df: DataFrame, **metrics: Column) -> DataFrame:
    """A (metric, value) table of text values from one aggregation."""
    return df.agg(*[c.cast("string").alias(n) for n, c in metrics.items()]).unpivot([], list(metrics), "metric", "value")


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """Some first rows, for the eye."""
    return df.limit(rows)


def summary(df: DataFrame, **metrics: Column) -> list[str]:
    """Lines for the console from one aggregation: `name: value`."""
    return [f"{r.metric}: {r.value}" for r in key_values(df, **metrics).collect()]


def without_label(df: DataFrame, column: str, label: str) -> DataFrame:
    """Rows of all labels but one; null labels stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(label)))


def fold_means(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Means of values over folds, by model or feature, with the number of folds."""
    return df.groupBy(*by).agg(F.count("*").alias("folds"), *[F.avg(v).alias(v) for v in values])


def panel_overview(df: DataFrame, key: str, day: str, observed: str, filled: str, invalid: str, weather: list[str], months_seen: DataFrame, month: str) -> DataFrame:
    """(metric, value): size, span, observation, gap filling, weather gaps and composite months of a panel.

    months_seen has one row for each composite, with its month as yyyy-MM; the months between the panel's
    first and last day that begin in it are expected.
    """
    share = lambda c: F.bround(100.0 * F.sum(F.col(c).cast("int")) / F.count("*"), 2)
    gaps = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in weather])
    own = key_values(
        df,
        station_count=F.count_distinct(key),
        grid_rows=F.count("*"),
        date_start=F.date_format(F.min(day), "yyyy-MM-dd"),
        date_end=F.date_format(F.max(day), "yyyy-MM-dd"),
        observed_rows=F.sum(F.col(observed).cast("int")),
        observed_pct=share(observed),
        invalid_rows=F.coalesce(F.sum(F.col(invalid).cast("int")), F.lit(0)),
        filled_rows=F.sum(F.col(filled).cast("int")),
        weather_rows_with_gaps=F.count_if(gaps),
    )
    seen = key_values(months_seen, composite_rows=F.count("*"), composite_months=F.count_distinct(month), composite_month_start=F.min(month), composite_month_end=F.max(month))
    low, high = F.min(day), F.max(day)
    first = F.when(F.trunc(low, "month") == low.cast("date"), low.cast("date")).otherwise(F.add_months(F.trunc(low, "month"), 1))
    expected = df.agg(first.alias("a"), F.trunc(high, "month").alias("b")).where("a <= b").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("m"))
    missing = expected.join(months_seen.select(F.col(month).alias("m")).distinct(), "m", "left_anti")
    gone = key_values(missing, composite_months_missing=F.array_join(F.array_sort(F.collect_set("m")), ","))
    return own.unionByName(seen).unionByName(gone)


def regression_scores(truth: str, guess: str, groups: list[str] | None = None, log_r2: bool = False, least: int = 0):
    """Function of a frame: n, rmse, mae, bias, r2 by group of at least `least` rows, over rows where both are not null.

    r2 is null where the truth does not vary. With log_r2 the guess is clipped at 0 and r2 is taken of
    log(1 + x); the errors stay on the natural scale.
    """

    def score(df: DataFrame) -> DataFrame:
        t, g = F.col(truth), F.col(guess)
        if log_r2:
            g = F.when(g < 0, 0.0).otherwise(g)
        a, b = (F.log1p(t), F.log1p(g)) if log_r2 else (t, g)
        e = g - t
        rows = df.where(t.isNotNull() & g.isNotNull()).select(*(groups or []), e.alias("e_"), ((b - a) ** 2).alias("s_"), a.alias("a_"))
        out = rows.groupBy(*(groups or [])).agg(
            F.count("*").alias("n"), F.sqrt(F.avg(F.col("e_") ** 2)).alias("rmse"), F.avg(F.abs("e_")).alias("mae"), F.avg("e_").alias("bias"), F.sum("s_").alias("ss_"), F.var_pop("a_").alias("v_")
        )
        r2 = F.when(F.col("v_") > 0, 1 - F.col("ss_") / (F.col("n") * F.col("v_")))
        return out.select(*(groups or []), "n", "rmse", "mae", "bias", r2.alias("r2")).where(F.col("n") >= least)

    return score


def pearson_table(df: DataFrame, target: str, features: list[str], least: int = 0) -> DataFrame:
    """(feature, n, pearson) over pairwise complete rows, all features in one aggregation."""
    pair = lambda f: F.when(F.col(f).isNotNull() & F.col(target).isNotNull(), F.col(f))
    sums = df.agg(*[F.struct(F.count(pair(f)).alias("n"), F.corr(pair(f).cast("double"), F.col(target).cast("double")).alias("pearson")).alias(f) for f in features])
    return sums.unpivot([], features, "feature", "s").select("feature", "s.n", "s.pearson").where(F.col("n") >= least)


def value_ranks(df: DataFrame, groups: list[str], value: str, name: str, times: str | None = None, most: int | None = None) -> DataFrame:
    """(groups, value, name): the rank of each distinct value, ties sharing their mean rank; a row counts `times` times."""
    by_value = df.groupBy(*groups, value).agg((F.sum(times) if times else F.count("*")).alias("ties_"))
    return running_totals(by_value, groups, value, "ties_", most=most).select(*groups, value, (F.col("before_") + (F.col("ties_") + 1) / 2).alias(name))


def average_ranks(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """df with each row's rank in its group; a frequent value is one row of the running totals."""
    return df.join(value_ranks(df, groups, value, name), [*groups, value])


#: Rows of a table that a join broadcasts at most.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    """df, written, and marked for broadcast if it is counted small: a join then moves no row of the other side, and no frequent key gathers in one task."""
    df = kept(df)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a with the other columns of b, joined on keys that may be null."""
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.alias("a").join(b.alias("b"), on, how).select("a.*", *[F.col(f"b.{c}").alias(c) for c in b.columns if c not in keys])


def _by_set(df: DataFrame, sets: list[list[str]], names: list[str], *columns: str, own: str | None = None) -> DataFrame:
    """df once for each set of key columns, with set_ and nulls in place of the names outside the set; own: a name whose column number set_ is taken."""
    kinds = dict(df.dtypes)
    pick = lambda s: [F.col(n) if n in s else F.lit(None).cast(kinds[n]).alias(n) for n in names]
    mine = lambda i: [F.col(f"r{i}_").alias(own)] if own else []
    return reduce(lambda x, y: x.unionByName(y), [df.select(F.lit(i).alias("set_"), *pick(s), *columns, *mine(i)) for i, s in enumerate(sets)])


def _value_counts(rows: DataFrame, names: list[str], features: list[str]) -> DataFrame:
    """(names, feature, x_, all_, w_, lw_), written: the rows of each value, those with a target, and those with one above -1."""
    long = rows.unpivot([*names, "t_"], features, "feature", "x_")
    return kept(long.groupBy(*names, "feature", "x_").agg(F.count("*").alias("all_"), F.count("t_").alias("w_"), F.count_if(F.col("t_") > -1).alias("lw_")))


def _pieces(sets: list[list[str]], names: list[str], values: dict[str | None, tuple[str, list[str]]]):
    """Function of the batches of one range of t_, none null: (set_, names, feature, lo_, n_, means, products around them) by key and piece.

    values: feature -> its column and its columns of ranks, one for each set; feature None: the column "feature" is a key.
    The rows of a key are cut where its first value of t_ ends and its last begins, as neighbouring ranges may share these. So pieces
    of one lo_ are ties, others are apart, and the mean rank of a piece follows from the n_ of all pieces. a: rank inside the piece.
    """

    def run(batches):
        whole = pa.Table.from_batches(list(batches))
        if not whole.num_rows:
            return
        numbers = lambda c: whole[c].fill_null(0).to_numpy()
        t = numbers("t_") + 0.0
        log = np.log1p(np.where(t > -1, t, np.nan))
        by_t = np.argsort(t, kind="stable")
        for i, keys in enumerate(sets):
            code = np.zeros(len(t), np.int64)
            for k in keys:
                one = pc.dictionary_encode(whole[k].combine_chunks(), null_encoding="encode").indices.to_numpy()
                code = np.unique(code * (one.max() + 1) + one, return_inverse=True)[1]
            order = by_t[np.argsort(code[by_t], kind="stable")]
            for feature, (column, ranks) in values.items():
                at = order[whole[column].is_valid().to_numpy()[order]]
                if not len(at):
                    continue
                key, v = code[at], {"t": t[at], "l": log[at], "x": numbers(column)[at], "r": numbers(ranks[i])[at]}
                same = (v["t"][1:] == v["t"][:-1]) | (np.isnan(v["t"][1:]) & np.isnan(v["t"][:-1]))
                start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | ~same])  # a run of equal t_ begins
                ties = np.diff(np.r_[start, len(at)])
                first = np.r_[True, key[start][1:] != key[start][:-1]]
                cut = first | np.r_[first[1:], True] | np.r_[False, first[:-1]]
                begin = start[cut]
                n = np.diff(np.r_[begin, len(at)])
                v["a"] = np.repeat(start - begin[np.cumsum(cut) - 1] + (ties + 1) / 2, ties)
                means = {c: np.add.reduceat(w, begin) / n for c, w in v.items()}
                off = {c: w - np.repeat(means[c], n) for c, w in v.items()}
                sums = [np.add.reduceat(off[p] * off[q], begin) for p, q in _PRODUCTS]
                rows = pa.array(at[begin])
                group = [whole[k].combine_chunks().take(rows) if k in keys else pa.nulls(len(n), whole.schema.field(k).type) for k in names]
                label = whole["feature"].combine_chunks().take(rows) if feature is None else pa.array([feature] * len(n), pa.string())
                arrays = [pa.array(np.full(len(n), i, np.int32)), *group, label, pa.array(v["t"][begin]), pa.array(n), *[pa.array(means[c]) for c in _MEANS], *[pa.array(s) for s in sums]]
                yield pa.RecordBatch.from_arrays(arrays, ["set_", *names, "feature", "lo_", "n_", *_MEANS, *[f"{p}{q}" for p, q in _PRODUCTS]])

    def quiet(batches):
        with np.errstate(invalid="ignore", over="ignore"):
            yield from run(batches)

    return quiet


#: Means and products that a piece tells: target, its log1p, feature, the feature's rank, and the target's rank inside.
_MEANS = ("t", "l", "x", "r")
_PRODUCTS = (("a", "a"), ("r", "a"), ("t", "t"), ("x", "t"), ("l", "l"), ("x", "l"))


def _in_ranges(rows: DataFrame, width: int, sets: list[list[str]], names: list[str], values: dict, look=lambda df: df) -> DataFrame:
    """_pieces of written rows, dealt by t_ to ranges of about RANGE values; a frequent t_ is split by the row's number. look: joins that move no row."""
    parts = max(1, -(-rows.count() * width // ranges.RANGE))
    dealt = rows.withColumn("salt_", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)).cast("int")).repartitionByRange(parts, "t_", "salt_").drop("salt_")
    told = ", ".join(["set_ int", *[f"`{n}` {dict(rows.dtypes)[n]}" for n in names], "feature string, lo_ double, n_ bigint", *[f"{c} double" for c in (*_MEANS, *[p + q for p, q in _PRODUCTS])]])
    return look(dealt).mapInArrow(_pieces(sets, names, values), told)


def _coefficients(rows: DataFrame, counts: DataFrame, sets: list[list[str]], names: list[str]) -> DataFrame:
    """(set_, names, feature, n, pearson, spearman, pearson_log) of written rows (names, t_, a column by feature; t_ not null).

    counts: (names, feature, x_, w_; x_ not null) of these rows. Values of features are ranked in each set from their counts. Rows are dealt by
    the target to ranges once, as they are, for all features and sets; ranks of features are looked up there, ranks of the target are counted, and
    a range leaves sums only, so no rank of the target is joined to a row. Features of more values than a broadcast holds are dealt as rows (feature, x_)
    that were joined to their ranks before. Coefficients are null without spread.
    """
    most, keys = counts.count(), ["set_", *names, "feature"]
    ranked = counts.select(*names, "feature", "x_", "w_")
    for i, s in enumerate(sets):
        ranked = _met(ranked, _small(value_ranks(counts, [*s, "feature"], "x_", f"r{i}_", "w_", most)), [*s, "feature", "x_"])
    ranked = kept(ranked)
    each, held, few, many = [f"r{i}_" for i in range(len(sets))], 0, [], []
    for r in ranked.groupBy("feature").count().orderBy("count").collect():
        held += r["count"]
        (few if held <= BROADCAST_ROWS else many).append(r["feature"])

    def look(df: DataFrame) -> DataFrame:
        for j, f in enumerate(few):
            mine = ranked.where(F.col("feature") == f).select(*names, F.col("x_").alias(f), *[F.col(c).alias(f"{c}{j}") for c in each])
            df = _met(df, F.broadcast(mine), [*names, f], "left")
        return df

    told = []
    if few:
        some = rows.select(*names, "t_", *few).where(F.coalesce(*[F.col(f) for f in few]).isNotNull())
        told.append(_in_ranges(some, len(few), sets, names, {f: (f, [f"{c}{j}" for c in each]) for j, f in enumerate(few)}, look))
    if many:
        long = rows.unpivot([*names, "t_"], many, "feature", "x_").where("x_ is not null")
        long = kept(_met(long, ranked.where(F.col("feature").isin(many)).drop("w_"), [*names, "feature", "x_"]))
        told.append(_in_ranges(long, 1, [[*s, "feature"] for s in sets], names, {None: ("x_", each)}))
    own = _by_set(ranked, sets, names, "feature", "x_", "w_", own="rx_")
    w, mid = F.col("w_"), (F.col("n") + 1) / 2
    x_means = own.groupBy(*keys).agg(F.sum(w).alias("n"), (F.sum(w * F.col("x_")) / F.sum(w)).alias("mx_"), (F.min("x_") < F.max("x_")).alias("x_spread"))
    if not told:
        return x_means.select(*keys, "n", *[F.lit(None).cast("double").alias(c) for c in ("pearson", "spearman", "pearson_log")])
    pieces, n = kept(reduce(lambda a, b: a.unionByName(b), told)), F.col("n_")
    t_means = pieces.groupBy(*keys).agg((F.sum(n * F.col("t")) / F.sum(n)).alias("mt_"), (F.sum(n * F.col("l")) / F.sum(n)).alias("ml_"), (F.min("lo_") < F.max("lo_")).alias("t_spread"))
    means = _small(_met(x_means, _small(t_means), keys))
    x_sums = _met(own, means.select(*keys, "n", "mx_"), keys).groupBy(*keys).agg(F.sum(w * (F.col("x_") - F.col("mx_")) ** 2).alias("xx"), F.sum(w * (F.col("rx_") - mid) ** 2).alias("rr"))
    placed = _met(pieces, _small(value_ranks(pieces, keys, "lo_", "rt_", "n_", pieces.count())), [*keys, "lo_"])
    off = {"t": F.col("t") - F.col("mt_"), "l": F.col("l") - F.col("ml_"), "x": F.col("x") - F.col("mx_"), "r": F.col("r") - mid, "a": F.col("rt_") - mid}
    sums = _met(placed, means, keys).groupBy(*keys).agg(F.max("n").alias("n"), (F.max("x_spread") & F.max("t_spread")).alias("spread"), *[F.sum(F.col(p + q) + n * off[p] * off[q]).alias(p + q) for p, q in _PRODUCTS])
    out = lambda a, b, name: F.when(F.col("spread") & (F.col(a + a) > 0) & (F.col(b + b) > 0), F.col(a + b) / F.sqrt(F.col(a + a) * F.col(b + b))).alias(name)
    return _met(sums, _small(x_sums), keys).select(*keys, "n", out("x", "t", "pearson"), out("r", "a", "spearman"), out("x", "l", "pearson_log"))


def spearman_table(df: DataFrame, target: str, features: list[str], groups: list[str] | None = None) -> DataFrame:
    """(groups, feature, n, spearman): Pearson of average ranks among each feature's complete pairs; null groups are groups.

    The rows are written once; values are counted and ranked, and the target's ranks are counted in ranges.
    """
    groups = groups or []
    names = [f"g{i}_" for i in range(len(groups))]
    rows = kept(df.select(*[F.col(g).alias(n) for n, g in zip(names, groups, strict=True)], F.col(target).cast("double").alias("t_"), *[F.col(f).cast("double").alias(f) for f in features]).where("t_ is not null"))
    counts = _value_counts(rows, names, features).where("x_ is not null")
    return _coefficients(rows, counts, [names], names).select(*[F.col(n).alias(g) for n, g in zip(names, groups, strict=True)], "feature", "n", "spearman")


def correlation_groups(table: DataFrame, group: str, value: str) -> DataFrame:
    """count, median and largest absolute correlation by feature group."""
    a = F.abs(value)
    return table.groupBy(group).agg(F.count(value).alias("features"), F.median(a).alias("median_abs"), F.max(a).alias("max_abs"))


def terciles(df: DataFrame, value: str, tie: str, names: tuple[str, str, str] = ("near", "mid", "far")) -> DataFrame:
    """Three bins by first-come rank (ties by another column), with the integer rule that equals quantile edges on ranks."""
    ranked = running_totals(df.withColumn("one_", F.lit(1)), [], value, "one_", [tie])
    r, n = F.col("before_"), F.col("n_")  # rank less one, and rows in all
    ranked = ranked.crossJoin(F.broadcast(df.agg(F.count("*").alias("n_"))))
    bin_ = F.when((3 * r < n - 1) | (n == 1), names[0]).when(3 * r < 2 * (n - 1), names[1]).otherwise(names[2])
    return ranked.withColumn("tercile", bin_).drop("before_", "n_", "one_")


def classification_scores(truth: Column, guess: Column) -> list[Column]:
    """tp, fp, fn, precision, recall and f1; 0 on a zero divisor."""
    tp, fp, fn = F.count_if(truth & guess), F.count_if(~truth & guess), F.count_if(truth & ~guess)
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1")]


def ensemble(frames: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """(keys, a value of each frame by position, their mean) of the keys that all frames have; a key that a frame repeats is an error.

    The frames are stacked and gathered by key in one shuffle; a second row of one frame and key fails the job.
    """
    stacked = reduce(lambda a, b: a.unionByName(b), [f.select(*keys, F.lit(i).alias("frame_"), F.col(value).alias("value_")) for i, f in enumerate(frames)])
    mine = lambda i: F.col("frame_") == i
    names = [f"{value}_{i}" for i in range(len(frames))]
    rows = stacked.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    met = rows.groupBy(*keys).agg(*[F.max(F.when(mine(i), F.col("value_"))).alias(n) for i, n in enumerate(names)], *[F.count_if(mine(i)).alias(f"{n}__n") for i, n in enumerate(names)])
    shown = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    most = reduce(F.greatest, [F.col(f"{n}__n") for n in names]) if len(names) > 1 else F.col(f"{names[0]}__n")
    whole = reduce(lambda a, b: a & b, [F.col(f"{n}__n") == 1 for n in names])
    fine = F.when(most > 1, F.raise_error(F.concat(F.lit("duplicate key "), shown)).cast("boolean")).otherwise(whole)
    mean = reduce(lambda a, b: a + b, [F.col(n) for n in names]) / len(frames)
    return met.where(fine).select(*keys, *names, mean.alias(f"{value}_mean"))


def correlation_sets(df: DataFrame, target: str, features: list[str], by: dict[str, str] | None = None, least: int = 20) -> DataFrame:
    """(group_type, group, feature, n, missing_share, four coefficients, abs_spearman_log) over all rows and in each group.

    by: group_type -> column. The rows are written once, values of features are counted once for all groupings, and one pass over ranges of
    the target makes the sums of all features and groupings. Ranks of log1p(target) are those of the target, unless a
    target is at or below -1, which has none: then they are taken anew. Null groups are groups ("null");
    features with under `least` complete pairs in a group are left out of it.
    """
    by = by or {}
    names = [f"g{i}_" for i in range(len(by))]
    rows = kept(df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(n) for n, c in zip(names, by.values(), strict=True)], F.col(target).cast("double").alias("t_"), *[F.col(f).cast("double").alias(f) for f in features]))
    sets, keys = [[], *[[n] for n in names]], ["set_", *names, "feature"]
    counts = _value_counts(rows, names, features)
    gone = F.sum(F.when(F.col("x_").isNull(), F.col("all_")).otherwise(0))
    missing = _by_set(counts, sets, names, "feature", "x_", "all_").groupBy(*keys).agg((gone / F.sum("all_")).alias("missing_share"))
    pairs = counts.where("x_ is not null and w_ > 0")
    full, whole = rows.where("t_ is not null"), pairs.where("w_ > lw_").isEmpty()
    out = _coefficients(full, pairs, sets, names)
    if whole:
        out = out.withColumn("spearman_log", F.col("spearman"))
    else:
        lifted = _coefficients(full.where("t_ > -1"), pairs.where("lw_ > 0").withColumn("w_", F.col("lw_")), sets, names)
        out = _met(out.drop("pearson_log"), _small(lifted.select(*keys, "pearson_log", F.col("spearman").alias("spearman_log"))), keys, "left")
    out = _met(out.where(F.col("n") >= least), _small(missing), keys)
    kind = reduce(lambda rest, i: F.when(F.col("set_") == i + 1, list(by)[i]).otherwise(rest), range(len(by)), F.lit("overall"))
    out = out.select(kind.alias("group_type"), F.coalesce(*[F.col(n) for n in names], F.lit("all")).alias("group"), "feature", "n", "missing_share", "pearson", "spearman", "pearson_log", "spearman_log")
    return out.withColumn("abs_spearman_log", F.abs("spearman_log"))


def correlation_table(df: DataFrame, target: str, features: list[str], least: int = 20) -> DataFrame:
    """(feature, n, missing_share, four coefficients, abs_spearman_log) of features against a target and its log1p."""
    return correlation_sets(df, target, features, None, least).drop("group_type", "group")
