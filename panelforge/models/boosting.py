"""Boosted trees over histograms, with missing values as they are.

Rows become blocks, written once; rows of a block with equal bin numbers are one cell, and as trees cannot tell
them apart, margins, leaves and gradients are worked out by cell, from sums over its drawn rows. A level of a tree
is one job: every task adds up gradients by (node, feature, bin), Spark sums them, and the driver, which sees these
sums only, picks the splits.
Nulls and NaN have a bin of their own, and each split learns the side they go to.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_kept, kept
from .linear import load_record, save_record

#: Trees after which the written margins are brought up to date.
REFRESH = 8
#: Sums by (node, feature, bin) that a job brings to the driver at most; more nodes than that take turns.
CELLS = 1_000_000
#: Rows and bytes of a block at most.
BLOCK_ROWS, BLOCK_BYTES = 1 << 20, 32 << 20


@dataclass
class Params:
    """loss: "squared" (of the target as given) or "logistic" (0/1). Shares are drawn for each tree."""

    rounds: int = 100
    rate: float = 0.1
    depth: int = 4
    bins: int = 256
    row_share: float = 1.0
    column_share: float = 1.0
    penalty: float = 1.0
    least_gain: float = 0.0
    least_weight: float = 1.0
    patience: int = 0
    loss: str = "squared"
    seed: int = 7


@dataclass
class Tree:
    """Flat nodes: feature is -1 in a leaf; bins up to `bin` go left, missing ones where `default` says."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    default: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, default: int, gain: float, values: tuple[float, float]) -> None:
        """The right child follows the left one."""
        self.feature[node], self.bin[node], self.default[node], self.left[node], self.gain[node] = feature, bin_, default, len(self.feature), gain
        for v in values:
            for name, x in (("feature", -1), ("bin", 0), ("default", 0), ("left", 0), ("value", v), ("gain", 0.0)):
                getattr(self, name).append(x)

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row (of bins by feature, rows second) ends in."""
        at = np.zeros(bins.shape[1], np.int32)
        feature, cut, default, left = (np.array(x) for x in (self.feature, self.bin, self.default, self.left))
        rows = np.arange(bins.shape[1])
        for _ in range(depth):
            f = feature[at]
            b = bins[np.maximum(f, 0), rows]
            right = np.where(b == 0, default[at] == 1, b > cut[at])
            at = np.where(f >= 0, left[at] + right, at).astype(np.int32)
        return at


@dataclass
class Booster:
    columns: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]
    params: Params

    def added(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """What the trees from `first` on add to each row's margin."""
        out = np.zeros(bins.shape[1])
        for t in self.trees[first:]:
            out += np.array(t.value)[t.leaves(bins, self.params.depth)]
        return out

    def predict(self, name: str = "prediction"):
        """Function of a frame: adds the margin (squared loss) or the probability (logistic) of each row; null features are fine."""

        def score(df: DataFrame) -> DataFrame:
            shared = df.sparkSession.sparkContext.broadcast(self)

            @F.pandas_udf("double")
            def run(x):
                import pandas as pd

                model = shared.value
                m = model.base + model.added(binned([x[c].to_numpy(dtype=float, na_value=np.nan) for c in x.columns], model.cuts))
                return pd.Series(1 / (1 + np.exp(-m)) if model.params.loss == "logistic" else m)

            return df.withColumn(name, run(F.struct(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.columns)])))

        return score

    def importances(self) -> list[tuple[str, float]]:
        """Each feature's mean gain of its splits, as a share."""
        total, times = np.zeros(len(self.columns)), np.zeros(len(self.columns))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[f] += g
                    times[f] += 1
        mean = total / np.maximum(times, 1)
        return list(zip(self.columns, (mean / (mean.sum() or 1.0)).tolist(), strict=True))

    def save(self, spark, path: str) -> None:
        save_record(spark, asdict(self), path)

    @classmethod
    def load(cls, spark, path: str) -> Booster:
        return cls.of(load_record(spark, path))

    @classmethod
    def of(cls, r: dict) -> Booster:
        return cls(r["columns"], r["cuts"], r["base"], [Tree(**t) for t in r["trees"]], Params(**r["params"]))


def binned(columns: list[np.ndarray], cuts: list[list[float]]) -> np.ndarray:
    """Bin numbers by feature: 0 if missing, else 1 + the number of cuts at or below the value."""
    out = np.empty((len(columns), len(columns[0]) if columns else 0), np.uint16)
    for k, (x, c) in enumerate(zip(columns, cuts, strict=True)):
        out[k] = np.where(np.isnan(x), 0, np.searchsorted(np.array(c), x, "right") + 1)
    return out


def find_cuts(rows: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """Ascending cuts of each column: at most `bins` - 1 of its values, at even ranks, from one aggregation of sketches."""
    shares = [k / bins for k in range(1, bins)]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    found = rows.agg(*[F.percentile_approx(value(c), shares, 50 * bins).alias(f"q{k}") for k, c in enumerate(columns)], *[F.min(value(c)).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    return [sorted({float(x) for x in found[f"q{k}"] or () if x > found[f"m{k}"]}) for k in range(len(columns))]


def _blocks(rows: DataFrame, columns: list[str], target: Column, weight: Column | None, held: Column | None, cuts: list[list[float]], base: float) -> DataFrame:
    """Blocks (block, n, cell, bins, y, w, held, margin), each an array as bytes; rows without a target are left out.

    bins and margin are those of the block's cells, cell is the number of each row's.
    """
    f = len(columns)
    shown = [F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(columns)]
    y = target.cast("double")
    rows = rows.where(y.isNotNull() & ~F.isnan(y)).select(*shown, y.alias("y"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"), F.coalesce(held if held is not None else F.lit(False), F.lit(False)).alias("held"))
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (2 * f + 29)))

    def block(number, parts):
        bins, *rest = (np.concatenate(p, axis=-1) for p in zip(*parts, strict=True))
        cell, first = cells_of(bins, [len(c) + 2 for c in cuts])
        arrays = [cell.astype(np.uint32), bins[:, first], *rest, np.full(len(first), base)]
        return pa.RecordBatch.from_pydict({"block": [number], "n": [len(cell)]} | {k: [a.tobytes()] for k, a in zip(("cell", "bins", "y", "w", "held", "margin"), arrays, strict=True)})

    def run(batches):
        from pyspark import TaskContext

        number, parts, n = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                b = whole.slice(at, most)
                if n + b.num_rows > most:
                    yield block(number, parts)
                    number, parts, n = number + 1, [], 0
                column = lambda k, b=b: b.column(k).to_numpy(zero_copy_only=False)
                parts.append((binned([column(k).astype(float) for k in range(f)], cuts), column("y").astype(float), column("w").astype(float), column("held").astype(np.uint8)))
                n += b.num_rows
        if n:
            yield block(number, parts)

    return kept(rows.mapInArrow(run, "block bigint, n bigint, cell binary, bins binary, y binary, w binary, held binary, margin binary"))


def cells_of(bins: np.ndarray, widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each row (of bins by feature, rows second) the number of its distinct tuple of bins, and a row of each tuple."""
    key, size = np.zeros(bins.shape[1], np.int64), 1
    for b, width in zip(bins, widths, strict=True):
        if size * width >= 2**62:
            seen, key = np.unique(key, return_inverse=True)
            size = len(seen)
        key, size = key * width + b, size * width
    _, first, cell = np.unique(key, return_index=True, return_inverse=True)
    return cell, first


def _opened(batches, f: int):
    for b in batches:
        for r in b.to_pylist():
            get = lambda k, kind: np.frombuffer(r[k], kind)  # noqa: B023, E731
            yield r, get("cell", np.uint32), get("bins", np.uint16).reshape(f, -1), get("y", float), get("w", float), get("held", np.uint8).astype(bool), get("margin", float)


def _drawn(block: int, n: int, tree: int, p: Params) -> np.ndarray:
    """Which rows of a block a tree sees: a generator seeded by (seed, tree, block), the same on every retry."""
    if p.row_share >= 1:
        return np.ones(n, bool)
    bits = np.random.Generator(np.random.SFC64((p.seed, tree, block))).integers(0, 2**32, n, np.uint32)
    return bits < np.uint32(int(p.row_share * (2**32 - 1)))


def _gradients(wy, w, margin, loss: str):
    """Sums of gradients and curvatures of cells, from their sums of w * y and w (squared loss: y and margin around any one value)."""
    if loss == "logistic":
        q = 1 / (1 + np.exp(-margin))
        return q * w - wy, w * np.maximum(q * (1 - q), 1e-16)
    return margin * w - wy, w


def _level(blocks: DataFrame, model: Booster, first: int, number: int, tree: Tree, open_: list[int], chosen: list[int]) -> tuple[dict, tuple[float, float]]:
    """Best split of each open node {node: row}, and (loss, weight) of the held-out rows before this tree."""
    p, f, width = model.params, len(model.columns), max(len(c) for c in model.cuts) + 2
    slot = {v: k for k, v in enumerate(open_)}
    shared = blocks.sparkSession.sparkContext.broadcast((model, tree))

    def run(batches):
        model, tree = shared.value
        sums = np.zeros((2, len(open_), len(chosen), width))
        loss = np.zeros(2)
        where = np.full(len(tree.feature), -1)
        where[list(slot)] = list(slot.values())
        centre = model.base if p.loss == "squared" else 0.0
        for r, cell, bins, y, w, held, margin in _opened(batches, f):
            margin = margin + model.added(bins, first)
            if held.any() and len(open_) == 1 and open_[0] == 0:
                m, t = margin[cell[held]], y[held]
                e = (m - t) ** 2 if p.loss == "squared" else np.logaddexp(0, np.where(t > 0.5, -m, m))
                loss += (w[held] @ e, w[held].sum())
            mine = _drawn(r["block"], r["n"], number, p) & ~held
            wy, weight = (np.bincount(cell, np.where(mine, v, 0.0), len(margin)) for v in (w * (y - centre), w))
            at = where[tree.leaves(bins, p.depth)]
            use = (at >= 0) & (weight != 0)
            g, h = _gradients(wy[use], weight[use], margin[use] - centre, p.loss)
            at = at[use] * width
            for k, c in enumerate(chosen):
                place = at + bins[c][use]
                for s, v in enumerate((g, h)):
                    sums[s, :, k] += np.bincount(place, v, len(open_) * width).reshape(-1, width)
        node, k, b = np.nonzero((sums != 0).any(0))
        out = [np.append(open_, -1)[node], np.append(chosen, -1)[k], b, sums[0][node, k, b], sums[1][node, k, b]]
        if loss[1]:
            out = [np.append(a, v) for a, v in zip(out, (-1, -1, 0, *loss), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(t)) for a, t in zip(out, (np.int32, np.int32, np.int32, float, float), strict=True)], ["node", "feature", "bin", "g", "h"])

    parts = blocks.mapInArrow(run, "node int, feature int, bin int, g double, h double")
    sums = parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    node, feature, b, g, h = (sums.column(k).to_numpy() for k in ("node", "feature", "bin", "g", "h"))
    told = np.flatnonzero(node < 0)
    loss = (float(g[told[0]]), float(h[told[0]])) if len(told) else (0.0, 0.0)
    table, mine = np.zeros((2, len(open_), len(chosen), width)), node >= 0
    at = np.array([slot.get(v, 0) for v in node[mine]], int), np.searchsorted(chosen, feature[mine]), b[mine]
    table[0][at], table[1][at] = g[mine], h[mine]
    found = {v: best_split(table[:, k], chosen, p) for v, k in slot.items() if table[1, k].any()}
    return found, loss


def best_split(sums: np.ndarray, chosen: list[int], p: Params) -> dict:
    """feature, bin, default, gain, gl, hl, g, h of a node's best split, from sums of (g, h) by feature and bin.

    Bins up to `bin` go left; bin 0 holds the missing rows, which go left (default 0) or right (1), whichever
    gains more. Ties go to the smaller feature, then bin, then left. Without a split the gain is None.
    """
    g, h = sums[0, 0].sum(), sums[1, 0].sum()
    up = np.cumsum(sums, axis=2)[:, :, 1:]
    left = np.stack([up, up - sums[:, :, :1]], axis=3)  # (g or h, feature, bin, default)
    gl, hl = left
    score = lambda a, b: a * a / (b + p.penalty)
    gain = (score(gl, hl) + score(g - gl, h - hl) - score(g, h)) / 2
    slack = 1e-9 * h  # sums in other orders differ by as much
    gain[(hl < p.least_weight - slack) | (h - hl < p.least_weight - slack)] = -np.inf
    f, b, d = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[f, b, d] > max(p.least_gain, 1e-12):
        return {"gain": None, "g": float(g), "h": float(h)}
    return {"feature": chosen[f], "bin": int(b) + 1, "default": int(d), "gain": float(gain[f, b, d]), "gl": float(gl[f, b, d]), "hl": float(hl[f, b, d]), "g": float(g), "h": float(h)}


def fit(rows: DataFrame, columns: list[str], target: Column, params: Params | None = None, weight: Column | None = None, held: Column | None = None, checkpoint: str | None = None) -> Booster:
    """Trees on all rows that have a target; rows where `held` is true only stop early (params.patience > 0).

    Null, NaN and constant columns are fine; a null weight counts as 0 and such a row teaches nothing; no row
    with a target is an error. Training is the same on every run up to the order of sums of doubles.

    With `checkpoint`, a folder, the trees so far and the best count of them are saved there after every
    REFRESH trees; a run that finds them goes on from there (other columns or parameters are an error), and
    the finished model is saved in its place.
    """
    p = params or Params()
    if p.loss not in ("squared", "logistic"):
        raise ValueError(f"unknown loss {p.loss}")
    if p.bins > 60_000:
        raise ValueError("at most 60,000 bins")
    w = F.coalesce(weight.cast("double"), F.lit(0.0)) if weight is not None else F.lit(1.0)
    y, mine = target.cast("double"), F.lit(True) if held is None else ~F.coalesce(held, F.lit(False))
    taught = rows.where(mine & y.isNotNull() & ~F.isnan(y))
    sums = taught.agg(F.sum(w * y).alias("y"), F.sum(w).alias("w")).first()
    if not sums["w"]:
        raise ValueError("no row has a target")
    mean = sums["y"] / sums["w"]
    base = mean if p.loss == "squared" else math.log(max(mean, 1e-6) / max(1 - mean, 1e-6))
    cuts = find_cuts(taught, columns, p.bins)
    model, first, best = Booster(list(columns), cuts, base, [], p), 0, (math.inf, 0)
    if checkpoint and (found := _resumed(rows.sparkSession, checkpoint)):
        saved, best, over = found
        if (saved.columns, saved.params) != (model.columns, p):
            raise ValueError(f"{checkpoint} holds trees of other columns or parameters")
        if over:
            return saved
        model = saved
        base, cuts = model.base, model.cuts
    blocks = _blocks(rows, columns, target, w, held, cuts, base)
    many = max(1, math.ceil(p.column_share * len(columns)))
    for number in range(len(model.trees), p.rounds + (p.patience > 0)):
        chosen = sorted(np.random.default_rng((p.seed, number)).choice(len(columns), many, replace=False).tolist())
        tree, open_, total = Tree(), [0], None
        for depth in range(p.depth):
            found, loss = {}, (0.0, 0.0)
            many_nodes = max(1, CELLS // (many * (p.bins + 2)))
            for k in range(0, len(open_), many_nodes):
                some, told = _level(blocks, model, first, number, tree, open_[k : k + many_nodes], chosen)
                found, loss = found | some, told if not k else loss
            if not depth and loss[1]:
                total = loss[0] / loss[1]
            deeper = []
            for node in open_:
                r = found.get(node)
                if r is None or r["gain"] is None:
                    if r is not None and not depth:
                        tree.value[0] = -p.rate * r["g"] / (r["h"] + p.penalty)
                    continue
                leaf = lambda g, h: -p.rate * g / (h + p.penalty)
                tree.split(node, r["feature"], r["bin"], r["default"], r["gain"], (leaf(r["gl"], r["hl"]), leaf(r["g"] - r["gl"], r["h"] - r["hl"])))
                deeper += [len(tree.feature) - 2, len(tree.feature) - 1]
            open_ = deeper
            if not open_:
                break
        if p.patience and total is not None:
            best = min(best, (total, number))
            if number - best[1] >= p.patience:
                break
        if number == p.rounds:
            break
        model.trees.append(tree)
        if len(model.trees) - first >= REFRESH:
            fresh = _refreshed(blocks, model, first)
            drop_kept(blocks)
            blocks, first = fresh, len(model.trees)
            if checkpoint:
                _save(rows.sparkSession, checkpoint, model, best, False)
    drop_kept(blocks)
    if p.patience and best[0] < math.inf:
        del model.trees[best[1] :]
    if checkpoint:
        _save(rows.sparkSession, checkpoint, model, best, True)
    return model


def _save(spark, path: str, model: Booster, best: tuple[float, int], over: bool) -> None:
    """One numbered record each time; the one before stays until the new one is whole."""
    n = max(_numbers(spark, path), default=0) + 1
    save_record(spark, {"model": asdict(model), "best": None if best[0] == math.inf else best, "over": over}, f"{path}/state-{n:06d}")
    for old in _numbers(spark, path):
        if old < n - 1:
            files(spark, path)[0].delete(files(spark, f"{path}/state-{old:06d}")[1], True)


def files(spark, path: str):
    """(Hadoop file system, path) of a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _numbers(spark, path: str) -> list[int]:
    system, at = files(spark, f"{path}/state-*/_SUCCESS")
    return [int(str(s.getPath().getParent().getName())[-6:]) for s in system.globStatus(at) or []]


def _resumed(spark, path: str) -> tuple[Booster, tuple[float, int], bool] | None:
    numbers = _numbers(spark, path)
    if not numbers:
        return None
    r = load_record(spark, f"{path}/state-{max(numbers):06d}")
    return Booster.of(r["model"]), tuple(r["best"]) if r["best"] else (math.inf, 0), r["over"]


def _refreshed(blocks: DataFrame, model: Booster, first: int) -> DataFrame:
    f, shared = len(model.columns), blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for r, _, bins, _, _, _, margin in _opened(batches, f):
            yield pa.RecordBatch.from_pylist([r | {"margin": (margin + shared.value.added(bins, first)).tobytes()}])

    return kept(blocks.mapInArrow(run, blocks.schema.simpleString()[7:-1].replace(":", " ")))


