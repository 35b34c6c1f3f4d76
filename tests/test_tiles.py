"""Raster tiles: round trip, pruning by box, day and band, and odd pixels."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.sources import tiles


def frame(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(d), float(x), float(y), float(i), None if i % 5 == 0 else float(-i)) for i, (d, (x, y)) in enumerate(zip(rng.integers(0, 3, n), rng.uniform(-20, 20, (n, 2)), strict=True))]
    return rows, spark.createDataFrame([*rows, (1, None, 0.0, 1.0, 1.0), (None, 0.0, 0.0, 1.0, 1.0)], "day int, x double, y double, red double, nir double")


def brute(rows, days=(0, 2), box=(-99, -99, 99, 99)):
    cells = {}
    for d, x, y, r, n in rows:
        cells.setdefault((d, np.floor(x) + 0.5, np.floor(y) + 0.5), []).append((r, n))
    mean = lambda v: float(np.mean(v)) if v else None
    return sorted((d, x, y, mean([r for r, _ in v]), mean([n for _, n in v if n is not None])) for (d, x, y), v in cells.items() if days[0] <= d <= days[1] and box[0] <= x <= box[2] and box[1] <= y <= box[3])


def shown(df):
    return sorted((r.day, r.x, r.y, r.red, r.nir) for r in df.collect())


def test_tiles_come_back_as_pixels(spark, tmp_path):
    rows, df = frame(spark)
    path = str(tmp_path / "t")
    tiles.write_tiles(tiles.make_tiles(df, ["red", "nir"], 1.0, 5), path)
    bands = ["red", "nir"]
    assert shown(tiles.pixels(tiles.read_tiles(spark, path, bands), bands)) == brute(rows)
    box = (-7.2, 0.0, 9.9, 13.5)
    assert shown(tiles.pixels(tiles.read_tiles(spark, path, bands, box, ("1", "2")), bands, box)) == brute(rows, (1, 2), box)
    made = {(r.x, r.y): (r.images, r.red) for r in tiles.composite(tiles.pixels(tiles.read_tiles(spark, path, ["red"]), ["red"], clear=F.col("red") < 200), ["red"]).collect()}
    want = {}
    for _, x, y, r, _ in brute(rows):
        if r < 200:
            want.setdefault((x, y), []).append(r)
    assert made == {k: (len(v), float(np.median(v))) for k, v in want.items()}


def test_scans_open_only_what_is_asked_for(spark, tmp_path):
    _, df = frame(spark)
    path = str(tmp_path / "t")
    tiles.write_tiles(tiles.make_tiles(df, ["red", "nir"], 1.0, 5), path)
    read = tiles.read_tiles(spark, path, ["red"], (0.0, 0.0, 4.0, 4.0), ("2", "2"))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "nir" not in re.search(r"ReadSchema: (.*)", plan)[1]
    assert "GreaterThan(east,0.0)" in plan and re.search(r"PartitionFilters: \[.*day", plan)
    assert {re.search(r"day=(\d)", r[0])[1] for r in read.select(F.input_file_name()).distinct().collect()} == {"2"}
    with pytest.raises(ValueError, match="swir"):
        tiles.read_tiles(spark, path, ["swir"])
    assert tiles.make_tiles(df.where("false"), ["red"], 1.0, 5).count() == 0
