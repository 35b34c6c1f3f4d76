"""Raster collections as tables of tiles: one row for each tile and time, one array column for each band.

A tile's pixels are a row-major array of each band, from its south-west corner on; null is a masked pixel.
Box and time conditions reach the scan, which skips files and row groups by their statistics, and only the
bands that are asked for are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = ("day", "tx", "ty", "west", "south", "east", "north", "side", "step")


def make_tiles(pixels: DataFrame, bands: list[str], step: float, side: int, x: str = "x", y: str = "y", day: str = "day") -> DataFrame:
    """Tiles of side x side cells of width `step` from pixel rows (x, y, day, bands); the means of pixels in one cell.

    Rows without a place or day are left out; cells without a pixel are null in every band.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(step)).cast("long")
    rows = pixels.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(day).isNotNull()).select(F.col(day).alias("day"), cell(x).alias("cx"), cell(y).alias("cy"), *[F.col(b).cast("double").alias(b) for b in bands])
    cells = rows.groupBy("day", "cx", "cy").agg(*[F.avg(b).alias(b) for b in bands])
    tile = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")
    at = (F.pmod("cy", F.lit(side)) * side + F.pmod("cx", F.lit(side))).cast("int")
    held = cells.groupBy("day", tile("cx").alias("tx"), tile("cy").alias("ty")).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), F.struct(*bands).alias("v")))).alias("held"))
    whole = F.sequence(F.lit(0), F.lit(side * side - 1))
    arrays = [F.transform(whole, lambda i: F.try_element_at("held", i)[b]).alias(b) for b in bands]  # noqa: B023
    width = F.lit(step * side)
    return held.select("day", "tx", "ty", (F.col("tx") * width).alias("west"), (F.col("ty") * width).alias("south"), ((F.col("tx") + 1) * width).alias("east"), ((F.col("ty") + 1) * width).alias("north"), F.lit(side).alias("side"), F.lit(step).alias("step"), *arrays)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles below `path`, a folder for each day, sorted by place so that statistics tell row groups apart."""
    tiles.repartitionByRange("day", "ty", "tx").sortWithinPartitions("day", "ty", "tx").write.partitionBy("day").mode("overwrite").parquet(path)


def read_tiles(spark, path: str, bands: list[str], box: tuple[float, float, float, float] | None = None, days: tuple[str, str] | None = None) -> DataFrame:
    """Tiles of some bands that meet a box (west, south, east, north) and a closed range of days."""
    tiles = spark.read.parquet(path)
    unknown = sorted(set(bands) - set(tiles.columns))
    if unknown:
        raise ValueError(f"no such bands: {', '.join(unknown)}")
    if box:
        west, south, east, north = box
        tiles = tiles.where((F.col("east") > west) & (F.col("west") <= east) & (F.col("north") > south) & (F.col("south") <= north))
    if days:
        tiles = tiles.where(F.col("day").between(*[F.lit(d).cast(tiles.schema["day"].dataType) for d in days]))
    return tiles.select(*GRID, *bands)


def pixels(tiles: DataFrame, bands: list[str], box: tuple[float, float, float, float] | None = None, clear: Column | None = None) -> DataFrame:
    """(day, x, y, bands) of each pixel, x and y its middle; of a box if given, and where `clear` (of bands) holds.

    Pixels that are null in every band are masked ones and left out.
    """
    i = F.col("i_")
    rows = tiles.select("day", "west", "south", "side", "step", F.posexplode(F.arrays_zip(*bands)).alias("i_", "v_"))
    middle = lambda origin, n: (F.col(origin) + (n + 0.5) * F.col("step")).alias(origin)
    out = rows.select("day", middle("west", F.pmod(i, F.col("side"))).alias("x"), middle("south", F.floor(i / F.col("side"))).alias("y"), *[F.col(f"v_.{b}").alias(b) for b in bands])
    out = out.where(F.coalesce(*bands).isNotNull())
    if box:
        west, south, east, north = box
        out = out.where(F.col("x").between(west, east) & F.col("y").between(south, north))
    return out if clear is None else out.where(clear)


def composite(rows: DataFrame, bands: list[str]) -> DataFrame:
    """(x, y, images, bands) of pixels over time: medians of the images that have a value."""
    return rows.groupBy("x", "y").agg(F.count("*").alias("images"), *[F.median(b).alias(b) for b in bands])
