"""Forecasts from sliding windows: persistence, ridge on the flattened window, and recurrent networks trained by all tasks at once."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats, windows
from ..session import drop_kept, kept, shared_dir
from . import linear
from .network import AdamW, Network
from .search import Once, as_frame, search


def samples(df: DataFrame, keys: list[str], day: str, value: str, target: str, lookback: int, horizon: int, train_end: str, valid_end: str) -> DataFrame:
    """One row for each window: x0 (oldest) to x{lookback-1}, baseline (last valid value), target and split."""
    rows = windows.sequences(df, keys, day, [value], target, lookback, horizon)
    x = {f"x{i}": F.col("sequence")[i][value] for i in range(lookback)}
    valid = F.filter("sequence", lambda s: s[value].isNotNull())
    return rows.withColumns(x | {"baseline": F.element_at(F.transform(valid, lambda s: s[value]), F.when(F.size(valid) > 0, -1).otherwise(F.lit(None))), "split": windows.split_by_date(F.col("target_date"), train_end, valid_end)}).drop("sequence")


def compare(df: DataFrame, keys: list[str], day: str, value: str, target: str, lookback: int, horizon: int, train_end: str, valid_end: str) -> DataFrame:
    """Scores by split and model on the rows that have a baseline."""
    rows = kept(samples(df, keys, day, value, target, lookback, horizon, train_end, valid_end).where("baseline is not null"))
    model = linear.ridge(rows.where("split = 'train'"), [f"x{i}" for i in range(lookback)], "target")
    guess = model.predict()
    long = rows.withColumns({"persistence": F.col("baseline"), "ridge": F.when(guess < 0, 0.0).otherwise(guess)}).unpivot(["split", "target"], ["persistence", "ridge"], "model", "guess")
    return stats.regression_scores("target", "guess", ["split", "model"])(long)


def tune(df: DataFrame, keys: list[str], day: str, value: str, target: str, trials: list[tuple[int, float]], horizon: int, train_end: str, valid_end: str, log: str | None = None) -> DataFrame:
    """(trial, lookback, alpha, val_rmse, test_rmse) of ridge trials, least validation error first; see search().

    Windows of a lookback are written once for all its trials; a log folder lets a restart go on.
    """
    spark = df.sparkSession
    rows_of = Once(lambda lookback: kept(samples(df, keys, day, value, target, lookback, horizon, train_end, valid_end)))

    def run(trial: dict) -> dict:
        lookback, rows = trial["lookback"], rows_of(trial["lookback"])
        model = linear.ridge(rows.where("split = 'train'"), [f"x{i}" for i in range(lookback)], "target", alphas=[trial["alpha"]])
        found = {r.split: r.rmse for r in stats.regression_scores("target", "guess", ["split"])(rows.withColumn("guess", model.predict())).collect()}
        return {"val_rmse": found.get("val"), "test_rmse": found.get("test")}

    named = [{"lookback": n, "alpha": float(a)} for n, a in trials]
    done = search(spark, named, run, log or new_log(spark), "val_rmse")
    drop_kept(*rows_of.made.values())
    return as_frame(spark, done, "trial int, lookback int, alpha double, val_rmse double, test_rmse double")


def new_log(spark) -> str:
    return f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Spec:
    """What a sequence network reads and how it is trained."""

    dynamic: tuple[str, ...]
    context: tuple[str, ...] = ()
    entity: str | None = None
    lookback: int = 7
    horizon: int = 3
    mode: str = "direct"  # or "residual": the change from the last valid value
    hidden: int = 16
    context_hidden: int = 8
    fusion: int = 16
    embedding: int = 4
    dropout: float = 0.0
    rate: float = 0.01
    decay: float = 1e-4
    clip: float = 1.0
    delta: float | None = 1.0
    epochs: int = 10
    patience: int = 4
    batch: int = 128
    tasks: int = 4
    seed: int = 1


@dataclass
class Fitted:
    """A trained network with what it takes to read a panel; epochs: (epoch, train loss, validation RMSE, rate)."""

    spec: Spec
    scaler: linear.Scaler
    entities: dict
    mean: float
    std: float
    weights: np.ndarray
    epochs: list[tuple]

    def to_record(self) -> dict:
        return {"spec": asdict(self.spec), "scaler": asdict(self.scaler), "entities": list(self.entities.items()), "mean": self.mean, "std": self.std, "weights": self.weights.tolist(), "epochs": self.epochs}

    def save(self, spark, path: str) -> None:
        linear.save_record(spark, self.to_record(), path)

    @classmethod
    def load(cls, spark, path: str) -> Fitted:
        r = linear.load_record(spark, path)
        spec = Spec(**{k: tuple(v) if isinstance(v, list) else v for k, v in r["spec"].items()})
        return cls(spec, linear.Scaler(**r["scaler"]), dict(map(tuple, r["entities"])), r["mean"], r["std"], np.array(r["weights"]), [tuple(e) for e in r["epochs"]])

    def network(self) -> Network:
        s = self.spec
        net = Network(len(s.dynamic), len(s.context), len(self.entities), s.hidden, s.context_hidden, s.fusion, s.embedding, s.seed)
        net.load(self.weights)
        return net


#: Entities that an embedding names at most; later ones (by order) share its last row.
ENTITIES = 10_000


def network_samples(df: DataFrame, keys: list[str], day: str, value: str, target: str, spec: Spec, scaler: linear.Scaler, train_end: str, valid_end: str) -> DataFrame:
    """(keys, target_date, split, y_true, baseline, x_, c_, e_): scaled windows, and the scaled context of their last day."""
    scaled = dict(zip(scaler.columns, scaler.expressions(), strict=False))
    named = {f"s{i}_": scaled[c] for i, c in enumerate((*spec.dynamic, *spec.context))}
    entity = {"e_": F.col(spec.entity)} if spec.entity else {}
    rows = windows.sequences(df.withColumns(named | entity | {"value_": F.col(value)}), keys, day, ["value_", *named, *entity], target, spec.lookback, spec.horizon)
    n, last = len(spec.dynamic), F.element_at("sequence", -1)
    x = F.flatten(F.transform("sequence", lambda s: F.array(*[s[f"s{i}_"] for i in range(n)])))
    context = F.array(*[last[f"s{n + i}_"] for i in range(len(spec.context))]).cast("array<double>")
    valid = F.filter(F.transform("sequence", lambda s: s["value_"]), lambda v: v.isNotNull())
    baseline = F.when(F.size(valid) > 0, F.element_at(valid, -1))
    out = rows.select(*keys, "target_date", windows.split_by_date(F.col("target_date"), train_end, valid_end).alias("split"), F.col("target").alias("y_true"), baseline.alias("baseline"), x.alias("x_"), context.alias("c_"), (last["e_"] if spec.entity else F.lit(None).cast("string")).cast("string").alias("e_"))
    return out.where("baseline is not null") if spec.mode == "residual" else out


def _arrays(batch, fitted: Fitted):
    """x, context, entity, target (scaled) and baseline of an Arrow batch or table."""
    s, n = fitted.spec, batch.num_rows
    flat = lambda c: np.asarray(batch.column(c).combine_chunks().flatten() if hasattr(batch.column(c), "combine_chunks") else batch.column(c).flatten(), np.float64)
    x, context = flat("x_").reshape(n, s.lookback, len(s.dynamic)), flat("c_").reshape(n, len(s.context))
    most = max(len(fitted.entities) - 1, 0)
    entity = np.array([fitted.entities.get(e, most) for e in batch.column("e_").to_pylist()], np.int64)
    y, base = (np.array(batch.column(c).to_pylist(), np.float64) for c in ("y_true", "baseline"))
    return x, context, entity, ((y - base if s.mode == "residual" else y) - fitted.mean) / fitted.std, base


def _epoch(rows: DataFrame, fitted: Fitted, state: np.ndarray, epoch: int, step: float, rate: float) -> tuple[np.ndarray, dict[str, float]]:
    """One pass of every task over its own windows in small batches; the mean of the tasks' weights and moments by windows.

    Validation errors are those of the weights that the pass starts from.
    """
    shared = rows.sparkSession.sparkContext.broadcast((fitted, state))
    size = len(state) // 3

    def run(batches):
        import pyarrow as pa

        fitted, state = shared.value
        s, net = fitted.spec, fitted.network()
        net.load(state[:size])
        before = fitted.network()
        before.load(state[:size])
        opt = AdamW(net, state[size : 2 * size], state[2 * size :], step, rate, s.decay, s.clip)
        rng = np.random.default_rng((s.seed, epoch))
        sums = np.zeros(4)  # windows, loss, validation windows, squared validation error
        for b in batches:
            x, c, e, y, _ = _arrays(b, fitted)
            split = np.array(b.column("split").to_pylist())
            held = split == "val"
            if held.any():
                out = before.forward(x[held], c[held], e[held])[0]
                sums[2:] += held.sum(), (((out - y[held]) * fitted.std) ** 2).sum()
            train = rng.permutation(np.flatnonzero(split == "train"))
            for part in np.array_split(train, max(1, -(-len(train) // s.batch))) if len(train) else []:
                g, loss = net.gradient(x[part], c[part], e[part], y[part], rng, s.dropout, s.delta)
                opt.apply(g)
                sums[:2] += len(part), loss * len(part)
        whole = np.concatenate((net.flat(), opt.m, opt.v, [opt.step])) * sums[0]
        yield pa.RecordBatch.from_pydict({"s": [np.concatenate((whole, sums)).tolist()]})

    parts = rows.select("split", "x_", "c_", "e_", "y_true", "baseline").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v"))
    total = np.zeros(len(state) + 5)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        total[r["i"]] = r["v"]
    shared.unpersist()
    n, loss, held, squares = total[-4:]
    return total[:-4] / max(n, 1), {"loss": loss / max(n, 1), "rmse": float((squares / held) ** 0.5) if held else float("nan")}


def _columns_kept(df: DataFrame, keys: list[str], day: str, value: str, target: str, specs: list[Spec]) -> DataFrame:
    """What networks read of a panel, written once: scaling and windows pass over it several times."""
    read = [c for s in specs for c in (*s.dynamic, *s.context, *([s.entity] if s.entity else []))]
    return kept(df.select(*dict.fromkeys([*keys, day, value, target, *read])))


def _scaler(df: DataFrame, day: str, spec: Spec, train_end: str) -> linear.Scaler:
    return linear.Scaler.fit(df.where(F.col(day) <= F.lit(train_end).cast("date")), [*spec.dynamic, *spec.context])


def _windows(df: DataFrame, keys: list[str], day: str, value: str, target: str, spec: Spec, scaler: linear.Scaler, train_end: str, valid_end: str) -> DataFrame:
    rows = network_samples(df, keys, day, value, target, spec, scaler, train_end, valid_end)
    return kept(rows.repartition(spec.tasks, *keys).sortWithinPartitions(F.xxhash64(*keys, "target_date")))


def fit_network(df: DataFrame, keys: list[str], day: str, value: str, target: str, spec: Spec, train_end: str, valid_end: str, made: tuple[linear.Scaler, DataFrame] | None = None) -> tuple[Fitted, DataFrame]:
    """A network trained on all training windows, and the written windows; made: scaler and windows, where trials share them.

    Each epoch is one job: tasks train on their own windows from the common weights, and the weights are
    averaged; only the weights travel. The rate halves when the validation error has not fallen for a
    third of the patience (3 epochs at least), training stops after `patience` such epochs, and the
    weights of the least validation error are kept (without validation windows: the last).
    """
    if made is None:
        panel = _columns_kept(df, keys, day, value, target, [spec])
        scaler = _scaler(panel, day, spec, train_end)
        made = scaler, _windows(panel, keys, day, value, target, spec, scaler, train_end, valid_end)
        drop_kept(panel)
    scaler, rows = made
    entities = {}
    if spec.entity:
        names = rows.where("split = 'train'").groupBy("e_").count().select("e_").orderBy("e_").limit(ENTITIES + 1).collect()
        if len(names) > ENTITIES:
            raise ValueError(f"an embedding takes at most {ENTITIES} entities; give a coarser column")
        entities = {r[0]: i for i, r in enumerate(names)} | {"\0 other": len(names)}
    goal = F.col("y_true") - F.col("baseline") if spec.mode == "residual" else F.col("y_true")
    m = rows.where("split = 'train'").agg(F.avg(goal).alias("mean"), F.stddev_pop(goal).alias("std")).first()
    if m["mean"] is None:
        raise ValueError("no training window")
    net = Network(len(spec.dynamic), len(spec.context), len(entities), spec.hidden, spec.context_hidden, spec.fusion, spec.embedding, spec.seed)
    fitted = Fitted(spec, scaler, entities, m["mean"], m["std"] or 1.0, net.flat(), [])
    state, step, rate = np.concatenate((net.flat(), np.zeros(2 * len(net.flat())))), 0.0, spec.rate
    best, stale, size = float("inf"), 0, len(net.flat())
    for epoch in range(spec.epochs + 1):  # the last pass only measures
        new, told = _epoch(rows, fitted, state, epoch, step, rate)
        fitted.epochs.append((epoch, told["loss"], told["rmse"], rate))
        if not told["rmse"] >= best:  # less, or not known
            fitted.weights, best, stale = state[:size].copy(), min(best, told["rmse"] if told["rmse"] == told["rmse"] else best), 0
        else:
            stale += 1
            if stale % max(3, spec.patience // 3) == 0:
                rate /= 2
            if stale >= spec.patience:
                break
        state, step = new[:-1], float(new[-1])
    return fitted, rows


def predict_network(fitted: Fitted, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target_date, split, y_true, baseline, y_pred) of windows, in Arrow batches against the broadcast weights; not below 0."""
    shared = rows.sparkSession.sparkContext.broadcast(fitted)
    names = [*keys, "target_date", "split", "y_true", "baseline"]

    def run(batches):
        import pyarrow as pa

        f = shared.value
        net = f.network()
        for b in batches:
            x, c, e, _, base = _arrays(b, f)
            out = net.forward(x, c, e)[0] * f.std + f.mean + (base if f.spec.mode == "residual" else 0)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(np.maximum(out, 0.0))], [*names, "y_pred"])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.select(*names, "x_", "c_", "e_").mapInArrow(run, f"{kinds}, y_pred double")


def network_scores(df: DataFrame, keys: list[str], day: str, value: str, target: str, spec: Spec, train_end: str, valid_end: str) -> DataFrame:
    """(split, model, n, rmse, mae, bias, r2) of the network and of last-value persistence, on windows that have a last value."""
    fitted, rows = fit_network(df, keys, day, value, target, spec, train_end, valid_end)
    out = predict_network(fitted, rows, keys).where("baseline is not null")
    long = out.withColumnsRenamed({"y_pred": "network", "baseline": "persistence"}).unpivot(["split", "y_true"], ["network", "persistence"], "model", "guess")
    return stats.regression_scores("y_true", "guess", ["split", "model"])(long)


def tune_networks(df: DataFrame, keys: list[str], day: str, value: str, target: str, trials: list[Spec], train_end: str, valid_end: str, log: str | None = None) -> DataFrame:
    """(trial, lookback, hidden, rate, dropout, epochs, val_rmse, test_rmse), least validation error first; the test error never chooses.

    Trials are logged as search() does; a log folder lets a restart go on. The panel is written once, its scaling is
    fitted once for all trials of the same columns, and windows are written once for all that read the same ones.
    """
    spark = df.sparkSession
    panel = Once(lambda _: _columns_kept(df, keys, day, value, target, trials))
    scaler = Once(lambda like: _scaler(panel(None), day, like, train_end))
    windows_of = Once(lambda like: _windows(panel(None), keys, day, value, target, like, scaler(Spec(like.dynamic, like.context)), train_end, valid_end))

    def run(trial: dict) -> dict:
        spec = trials[trial["number"]]
        like = Spec(spec.dynamic, spec.context, spec.entity, spec.lookback, spec.horizon, spec.mode, tasks=spec.tasks)
        made = scaler(Spec(spec.dynamic, spec.context)), windows_of(like)
        fitted, rows = fit_network(df, keys, day, value, target, spec, train_end, valid_end, made)
        scored = stats.regression_scores("y_true", "y_pred", ["split"])(predict_network(fitted, rows, keys)).collect()
        found = {r.split: r.rmse for r in scored}
        return {"epochs": len(fitted.epochs) - 1, "val_rmse": found.get("val"), "test_rmse": found.get("test")}

    named = [{"number": i, "lookback": t.lookback, "hidden": t.hidden, "rate": t.rate, "dropout": t.dropout} for i, t in enumerate(trials)]
    done = search(spark, named, run, log or new_log(spark), "val_rmse")
    drop_kept(*windows_of.made.values(), *panel.made.values())
    out = [{k: v for k, v in r.items() if k != "number"} for r in done]
    return as_frame(spark, out, "trial int, lookback int, hidden int, rate double, dropout double, epochs int, val_rmse double, test_rmse double")
