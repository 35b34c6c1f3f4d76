"""Order statistics from counted ranges, correlations of several groupings, and boosted trees, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.models import boosting, trees
from panelforge.operators import ranges, stats


@pytest.fixture(params=[1_000_000, 7])
def few(request, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE", request.param)


def test_running_totals_over_ranges(spark, few):
    rng = np.random.default_rng(1)
    rows = [(rng.choice(["a", "b", None]), None if rng.random() < 0.05 else float(rng.integers(0, 30)), i, int(rng.integers(1, 5))) for i in range(120)]
    out = ranges.running_totals(spark.createDataFrame(rows, "g string, v double, i long, n long").repartition(3), ["g"], "v", "n", ["i"]).collect()
    key = lambda r: (r[1] is not None, r[1] or 0.0, r[2])
    assert {r.i: r.before_ for r in out} == {x[2]: sum(y[3] for y in rows if y[0] == x[0] and key(y) < key(x)) for x in rows}
    assert ranges.running_totals(spark.createDataFrame([], "g string, v double, n long"), ["g"], "v", "n").count() == 0


def test_quantiles_equal_numpy(spark, few):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": rng.choice(["x", "y"], 150), "a": rng.integers(0, 12, 150).astype(float), "b": rng.normal(size=150), "c": np.nan, "d": 5.0})
    frame.loc[::9, "a"] = np.nan
    df = spark.createDataFrame(frame)
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {(r.g, r.column, r.share): r.value for r in ranges.quantiles(df, ["a", "b", "c", "d"], shares, ["g"]).collect()}
    want = {(g, c, s): np.quantile(part[c].dropna(), s) for g, part in frame.groupby("g") for c in "abd" for s in shares}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert ranges.medians(df.where("false"), ["a"]) == {}


def test_a_value_held_by_half_of_the_rows_is_one_row(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE", 50)
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.col("id") % 400).alias("v"))
    by_value, parts = ranges.ranged(df.groupBy("v").agg(F.count("*").alias("n")), ["v"])
    assert parts == 4 and max(r["count"] for r in by_value.groupBy("range_").count().collect()) < 120
    assert ranges.medians(df, ["v"]) == {"v": np.median([7.0 if i % 2 == 0 else i % 400 for i in range(4000)])}


@pytest.mark.parametrize("low", [0.0, -3.0])
def test_correlation_sets_equal_pandas(spark, few, low):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"s": rng.choice(["dry", "wet"], 90), "c": rng.choice(["near", "mid", None], 90), "t": rng.integers(0, 20, 90) + low, "a": rng.integers(0, 9, 90).astype(float), "b": rng.normal(size=90), "k": 1.0})
    frame.loc[::7, "a"] = np.nan
    frame.loc[3, "t"] = np.nan
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "s string, c string, t double, a double, b double, k double")
    got = {(r.group_type, r.group, r.feature): r for r in stats.correlation_sets(df, "t", ["a", "b", "k"], {"season": "s", "coast": "c"}, 20).collect()}
    want, parts = {}, [("overall", "all", frame)] + [(k, g, p) for k, c in (("season", "s"), ("coast", "c")) for g, p in frame.fillna({"c": "null"}).groupby(c)]
    for kind, group, part in parts:
        for f in "abk":
            both = part.dropna(subset=[f, "t"])
            if len(both) >= 20:
                want[kind, group, f] = (len(both), part[f].isna().mean(), both[f].corr(both.t), both[f].rank().corr(both.t.rank()))
                logs = both[both.t > -1]
                want[kind, group, f] += (logs[f].corr(np.log1p(logs.t)), logs[f].rank().corr(logs.t.rank()))
    assert got.keys() == want.keys()
    for k, (n, share, *rest) in want.items():
        r = got[k]
        assert r.n == n and abs(r.missing_share - share) < 1e-12
        for a, b in zip((r.pearson, r.spearman, r.pearson_log, r.spearman_log), rest, strict=True):
            assert (a is None) == bool(np.isnan(b)) and (a is None or abs(a - b) < 1e-9)


def test_correlation_sets_write_rows_and_counts_but_no_pairs(spark, monkeypatch):
    """Pairs of each feature and grouping were written and joined to ranks of the target; now no table is longer than the rows."""
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"s": rng.choice(["dry", "wet"], 600), "c": rng.choice(["near", "far"], 600), "t": rng.normal(size=600), **{f: rng.integers(0, 3, 600) * 0.1 for f in "abd"}})
    written, kept = [], stats.kept
    monkeypatch.setattr(stats, "kept", lambda df: written.append(kept(df)) or written[-1])
    out = stats.correlation_sets(spark.createDataFrame(frame), "t", ["a", "b", "d"], {"season": "s", "coast": "c"})
    got = {(r.group_type, r.group, r.feature): r.spearman for r in out.collect()}
    assert max(df.count() for df in written) == 600 and sum(df.count() for df in written) < 1500
    assert len(got) == 15 and abs(got["season", "dry", "b"] - frame[frame.s == "dry"][["b", "t"]].corr("spearman").b.t) < 1e-12


@pytest.mark.parametrize("broadcast", [200_000, 12])
def test_a_target_held_by_half_of_the_rows_is_split_and_ranked_whole(spark, monkeypatch, broadcast):
    """Ties cross ranges; with 12 rows of broadcast the values of b, then of a, are joined to rows. Null groups are groups."""
    monkeypatch.setattr(ranges, "RANGE", 100)
    monkeypatch.setattr(stats, "BROADCAST_ROWS", broadcast)
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"g": rng.choice(["x", "y", None], 600), "t": np.where(rng.random(600) < 0.5, 7.0, rng.integers(-40, 40, 600) / 4), "a": rng.integers(0, 2, 600) * 0.1, "b": rng.normal(size=600), "k": 0.1})
    frame.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "g string, t double, a double, b double, k double")
    got = {(r.g, r.feature): r for r in stats.spearman_table(df, "t", ["a", "b", "k"], ["g"]).collect()}
    assert len(got) == 9 and all(got[g, "k"].spearman is None for g in ("x", "y", None))
    for g, part in frame.fillna({"g": "null"}).groupby("g"):
        for f in "ab":
            r, both = got[None if g == "null" else g, f], part.dropna(subset=[f])
            assert r.n == len(both) and abs(r.spearman - both[[f, "t"]].corr("spearman").loc[f, "t"]) < 1e-12


def test_pieces_of_a_frequent_target_stay_small(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE", 100)
    rows = stats.kept(spark.range(2000).select(F.lit(7.0).alias("t_"), (F.col("id") % 3).cast("double").alias("x"), F.lit(1.0).alias("r")))
    pieces = stats._in_ranges(rows, 1, [[]], [], {"x": ("x", ["r"])}).collect()
    assert sum(p.n_ for p in pieces) == 2000 and max(p.n_ for p in pieces) < 400


def gappy(n=300):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((3, n)) < 0.2, np.nan, rng.integers(0, 12, (3, n)).astype(float))
    y = np.where(np.isnan(x[0]), 7, x[0]) * 2 + np.nan_to_num(x[1]) ** 1.5 + rng.normal(size=n)
    return x, y, rng.integers(1, 4, n).astype(float)


def as_frame(spark, x, y, w):
    rows = [(*(None if np.isnan(v) else float(v) for v in c), float(t), float(k), "other") for c, t, k in zip(x.T, y, w, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, w double, bin string").repartition(3)


def brute_trees(x, y, w, rounds, rate, depth, logistic=False):
    """Margins of boosted trees that try every cut of every feature, with nulls on either side."""
    mean = (y * w).sum() / w.sum()
    margin = np.full(len(y), np.log(mean / (1 - mean)) if logistic else mean)

    def grow(at, g, h, left):
        total = g[at].sum(), h[at].sum()
        best = (1e-9, None)
        for f in range(len(x)) if left else ():
            v = x[f][at]
            gone = np.isnan(v)
            for cut in [*sorted(set(v[~gone]))[1:], np.inf]:
                for default in (True, False):
                    side = np.where(gone, default, v < cut)
                    gl, hl = g[at][side].sum(), h[at][side].sum()
                    if min(hl, total[1] - hl) >= 1:
                        gain = (gl**2 / (hl + 1) + (total[0] - gl) ** 2 / (total[1] - hl + 1) - total[0] ** 2 / (total[1] + 1)) / 2
                        if gain > best[0] * (1 + 1e-12):
                            best = (gain, side)
        if best[1] is None:
            margin[at] -= rate * total[0] / (total[1] + 1)
            return
        grow(at[best[1]], g, h, left - 1)
        grow(at[~best[1]], g, h, left - 1)

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = (w * (q - y), w * q * (1 - q)) if logistic else (w * (margin - y), w)
        grow(np.arange(len(y)), g, h, depth)
    return margin


def test_trees_equal_brute_force(spark, monkeypatch):
    """Squared loss over a refresh of the margins: splits, sides of nulls and leaves are those of all cuts tried."""
    monkeypatch.setattr(boosting, "REFRESH", 2)
    x, y, w = gappy()
    df = as_frame(spark, x, y, w)
    model = boosting.fit(df, ["a", "b", "c"], F.col("y"), boosting.Params(rounds=3, rate=0.3, depth=2), weight=F.col("w"))
    got = {(r.a, r.b, r.c, r.y): r.prediction for r in model.predict()(df).collect()}
    want = brute_trees(x, y, w, 3, 0.3, 2)
    for c, t, m in zip(x.T, y, want, strict=True):
        assert abs(got[(*(None if np.isnan(v) else v for v in c), t)] - m) < 1e-9
    assert abs(sum(v for _, v in model.importances()) - 1) < 1e-12 and dict(model.importances())["c"] < 0.1


def test_classifier_equals_brute_force(spark):
    x, y, w = gappy(200)
    label = (y > np.median(y)).astype(float)
    df = as_frame(spark, x, label, w)
    model = trees.fit_classifier(df, ["a", "b", "c"], "y", "w", iterations=2, rate=0.5, depth=2, share=1.0, columns_share=1.0)
    want = 1 / (1 + np.exp(-brute_trees(x, label, w, 2, 0.5, 2, True)))
    got = sorted(r.probability for r in trees.predict(model, df).collect())
    assert np.abs(np.array(got) - np.sort(want)).max() < 1e-9


def test_trees_stop_early_and_take_any_null(spark, tmp_path):
    x, y, w = gappy(250)
    df = as_frame(spark, x, np.abs(y), w)
    model = trees.fit_regression(df.where("c is not null"), ["a", "b", "c"], "y", validation=df.where("c is null"), iterations=12, rate=0.9, depth=3, patience=2)
    assert 0 < len(model.trees) < 12
    nothing = spark.createDataFrame([(None, None, None), (float("nan"), 1e300, -1e300)], "a double, b double, c double")
    assert all(np.isfinite(r.prediction) for r in trees.predict(model, nothing).collect())
    model.save(spark, str(tmp_path / "m"))
    assert boosting.Booster.load(spark, str(tmp_path / "m")) == model
    with pytest.raises(ValueError, match="target"):
        boosting.fit(df.where("false"), ["a"], F.col("y"))


def test_rows_and_columns_are_drawn_alike_on_every_run(spark):
    x, y, w = gappy(200)
    df = as_frame(spark, x, y, w)
    p = boosting.Params(rounds=2, depth=2, row_share=0.5, column_share=0.6)
    a, b = (boosting.fit(df.coalesce(1), ["a", "b", "c"], F.col("y"), p) for _ in range(2))
    assert [t.feature for t in a.trees] == [t.feature for t in b.trees] and [t.bin for t in a.trees] == [t.bin for t in b.trees]
    draws = np.mean([boosting._drawn(k, 10_000, 3, boosting.Params(row_share=0.3)).mean() for k in range(5)])
    assert abs(draws - 0.3) < 0.02
    assert all(len({f for f in t.feature if f >= 0}) <= 2 for t in a.trees)


def test_a_killed_fit_goes_on_from_its_checkpoint(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    x, y, w = gappy(150)
    df, path = as_frame(spark, x, y, w).coalesce(1).cache(), str(tmp_path / "fit")
    p = boosting.Params(rounds=5, depth=2, row_share=0.7, column_share=0.7)
    whole = boosting.fit(df, ["a", "b", "c"], F.col("y"), p)
    level, calls = boosting._level, []

    def failing(*args):
        calls.append(args[3])
        if args[3] == 3:
            raise RuntimeError("lost")
        return level(*args)

    monkeypatch.setattr(boosting, "_level", failing)
    with pytest.raises(RuntimeError):
        boosting.fit(df, ["a", "b", "c"], F.col("y"), p, checkpoint=path)
    calls.clear()
    monkeypatch.setattr(boosting, "_level", lambda *args: calls.append(args[3]) or level(*args))
    again = boosting.fit(df, ["a", "b", "c"], F.col("y"), p, checkpoint=path)
    assert set(calls) == {2, 3, 4} and [t.feature for t in again.trees] == [t.feature for t in whole.trees]
    assert all(abs(a - b) < 1e-9 for s, t in zip(again.trees, whole.trees, strict=True) for a, b in zip(s.value, t.value, strict=True))
    calls.clear()
    assert boosting.fit(df, ["a", "b", "c"], F.col("y"), p, checkpoint=path) == again and not calls
    with pytest.raises(ValueError, match="other columns"):
        boosting.fit(df, ["a", "b"], F.col("y"), p, checkpoint=path)
    df.unpersist()


def test_blocks_hold_each_tuple_of_bins_once(spark, monkeypatch):
    """Margins and leaves are worked out for distinct tuples of bins, not for rows; blocks end at BLOCK_ROWS, and trees are the same."""
    x, y, w = gappy(400)
    df = as_frame(spark, x % 3, y, w).coalesce(1)
    p = boosting.Params(rounds=2, depth=2, rate=0.3)
    whole = boosting.fit(df, ["a", "b", "c"], F.col("y"), p, weight=F.col("w"))
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 150)
    rows = boosting._blocks(df, ["a", "b", "c"], F.col("y"), F.col("w"), None, whole.cuts, 0.0).orderBy("block").collect()
    assert [r.n for r in rows] == [150, 150, 100] and all(len(r.margin) <= 8 * 4**3 for r in rows)
    parts = boosting.fit(df, ["a", "b", "c"], F.col("y"), p, weight=F.col("w"))
    assert all(s.feature == t.feature and np.allclose(s.value, t.value, atol=1e-9) for s, t in zip(whole.trees, parts.trees, strict=True))
    wide = np.random.default_rng(1).integers(0, 3, (90, 50)).repeat(2, 1)
    cell, first = boosting.cells_of(wide, [60_000] * 90)
    assert len(first) == 50 and (wide[:, first][:, cell] == wide).all()
