"""Leakage-safe folds by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .ranges import running_totals


def fold_cycles(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, list[int]]]:
    """(size, first rank, order of folds): groups of a size, by rank from there on, go to the folds of `order` in turn.

    sizes: (size, number of groups), largest first. Each group goes to the lightest fold (ties: the smaller);
    folds lighter than the lightest by a size take turns until the next one is as light, so a size needs as many
    entries as there are folds at most.
    """
    load, out = [0] * folds, []
    for size, many in sizes:
        rank = 0
        while rank < many:
            by_load = sorted(range(folds), key=lambda f: (load[f], f))
            low = load[by_load[0]]
            turn = [f for f in by_load if load[f] < low + size]
            rest = [load[f] for f in by_load if load[f] >= low + size]
            rounds = (min(rest) - low) // size if rest else many
            taken = min(many - rank, max(rounds, 1) * len(turn))
            out.append((size, rank, turn))
            for k, f in enumerate(turn):
                load[f] += size * (taken // len(turn) + (k < taken % len(turn)))
            rank += taken
    return out


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): groups by size, largest first (ties: larger key first), each to the lightest fold.

    Only the numbers of groups by size reach the driver, which lays out the folds' turns; a group finds its
    turn by its rank within its size. No groups, or fewer than folds, are an error; a null group is a group.
    """
    groups = kept(df.groupBy(group).agg(F.count("*").alias("n_")))
    sizes = [(r["n_"], r["m"]) for r in groups.groupBy("n_").agg(F.count("*").alias("m")).orderBy(F.desc("n_")).collect()]
    if sum(m for _, m in sizes) < folds:
        raise ValueError("fewer groups than folds")
    turns = df.sparkSession.createDataFrame(fold_cycles(sizes, folds), "size_ long, first_ long, turn_ array<int>")
    until = F.coalesce(F.lead("first_").over(Window.partitionBy("size_").orderBy("first_")), F.lit(2**62))
    ranked = running_totals(groups.withColumn("one_", F.lit(1)), ["n_"], group, "one_")
    whole = groups.groupBy("n_").agg(F.count("*").alias("m_"))
    ranked = ranked.join(whole, "n_").withColumn("rank_", F.col("m_") - 1 - F.col("before_"))
    placed = ranked.join(turns.withColumn("until_", until), (F.col("n_") == F.col("size_")) & (F.col("rank_") >= F.col("first_")) & (F.col("rank_") < F.col("until_")))
    at = F.pmod(F.col("rank_") - F.col("first_"), F.size("turn_")).cast("int")
    return placed.select(group, (F.get("turn_", at) + 1).alias("fold"))


def fold_parts(df: DataFrame, folds: DataFrame, group: str, n: int, train: Column, valid: Column, test: Column, require: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Rows once for each fold with part train / val (other groups) or test (the fold's groups); unused rows go.

    Folds without rows in a required part are dropped. The fold table has one row for each group.
    """
    mine = df.join(folds.withColumnRenamed("fold", "own_"), group)
    rows = mine.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n))))
    held = F.col("own_") == F.col("fold")
    part = F.when(held & test, "test").when(~held & valid, "val").when(~held & train, "train")
    rows = rows.withColumn("part", part).where("part is not null").drop("own_")
    full = rows.groupBy("fold").agg(F.collect_set("part").alias("parts_")).where(F.size(F.array_intersect("parts_", F.array(*map(F.lit, require)))) == len(require)).select("fold")
    return rows.join(F.broadcast(full), "fold")
