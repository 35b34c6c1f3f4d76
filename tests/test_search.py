"""A search that is killed and goes on, and sinks through Spark's file systems."""

import threading

import pytest

from panelforge.models import search
from panelforge.sources import sinks


def test_a_killed_search_goes_on_where_it_stopped(spark, tmp_path):
    log, trials, ran = str(tmp_path / "log"), [{"rate": r, "size": 8} for r in (0.3, 0.1, 0.2, 0.5, 0.4, 0.9, 0.8, 0.7)], []

    def run(trial, stop=None):
        if len(ran) == stop:
            raise KeyboardInterrupt
        ran.append(trial["rate"])
        return {"val_rmse": trial["rate"] if trial["rate"] < 0.85 else None}

    with pytest.raises(KeyboardInterrupt):
        search.search(spark, trials, lambda t: run(t, 3), log, "val_rmse", at_once=1)
    assert ran == [0.3, 0.1, 0.2] and sorted(search.logged(spark, log)) == [0, 1, 2]
    table = [r.rate for r in spark.read.option("header", True).csv(f"{log}/table").collect()]
    assert table == ["0.1", "0.2", "0.3"]
    done = search.search(spark, trials, run, log, "val_rmse", at_once=1)
    assert ran == [0.3, 0.1, 0.2, 0.5, 0.4, 0.9, 0.8, 0.7]
    assert [r["trial"] for r in done] == [1, 2, 0, 4, 3, 7, 6, 5]
    assert [r.trial for r in spark.read.option("header", True).csv(f"{log}/table").collect()] == ["1", "2", "0", "4", "3", "7", "6", "5"]
    assert search.search(spark, trials, run, log, "val_rmse") == done and len(ran) == 8
    with pytest.raises(ValueError, match="another trial"):
        search.search(spark, [{"rate": 9.0, "size": 8}], run, log, "val_rmse")


def test_what_trials_share_is_made_once():
    made, out = [], []
    once = search.Once(lambda k: made.append(k) or k * 10)
    work = [threading.Thread(target=lambda k=k: out.append(once(k % 3))) for k in range(12)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert sorted(made) == [0, 1, 2] and sorted(out) == [0] * 4 + [10] * 4 + [20] * 4


def test_records_and_reports_are_written_through_spark(spark, tmp_path):
    path = f"file://{tmp_path}/deep/er/record.json"
    sinks.write_record({"é": 1}, path)
    sinks.write_record({"é": 2}, path)
    assert (tmp_path / "deep/er/record.json").read_text(encoding="utf-8") == '{\n  "é": 2\n}'


def test_a_scope_drops_what_was_kept_inside_it(spark):
    from panelforge.session import kept, scope

    outer = kept(spark.range(3))
    with scope():
        a = kept(spark.range(5))
        with scope():
            b = kept(a)
            assert b.count() == 5
        assert not search.there(spark, b._kept_path) and search.there(spark, a._kept_path)
    assert not search.there(spark, a._kept_path) and outer.count() == 3
