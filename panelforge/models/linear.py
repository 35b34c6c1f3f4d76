"""Imputing, scaling and ridge regression from a few aggregations; only p x p algebra runs on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import medians, quantiles


def finite_double(c: str) -> Column:
    """A column as doubles, null where it is not finite."""
    return F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(c) != float("inf")), F.col(c).cast("double"))


def save_record(spark, record: dict, path: str) -> None:
    """A small model as one line of JSON, written by Spark, so that remote paths work."""
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_record(spark, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


@dataclass
class Scaler:
    """Medians fill nulls, then (x - mean) / std with population (or sample) std, 0 and null counting as 1.

    With `indicators`, a column that had nulls where it was fitted adds a 0/1 column for them.
    """

    columns: list[str]
    median: dict[str, float]
    mean: dict[str, float]
    std: dict[str, float]
    indicators: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], indicators: bool = False, population: bool = True) -> Scaler:
        clean = [finite_double(c).alias(c) for c in columns]
        rows = df.select(*clean)
        first = rows.agg(F.count("*").alias("n_"), *[F.count(c).alias(f"{c}__n") for c in columns]).first()
        median = dict.fromkeys(columns, 0.0) | medians(rows, columns)
        missing = [c for c in columns if indicators and first[f"{c}__n"] < first["n_"]]
        named = {c: F.coalesce(F.col(c), F.lit(median[c])) for c in columns} | {f"{c}__null": F.col(c).isNull().cast("double") for c in missing}
        std = F.stddev_pop if population else F.stddev_samp
        filled = rows.select(*[x.alias(c) for c, x in named.items()])
        second = filled.agg(*[F.avg(c).alias(f"{c}__m") for c in named], *[std(c).alias(f"{c}__s") for c in named]).first()
        return cls(list(columns), median, {c: second[f"{c}__m"] or 0.0 for c in named}, {c: second[f"{c}__s"] or 1.0 for c in named}, missing)

    @property
    def outputs(self) -> list[str]:
        return [*self.columns, *[f"{c}__null" for c in self.indicators]]

    def expressions(self) -> list[Column]:
        raw = {c: F.coalesce(finite_double(c), F.lit(self.median[c])) for c in self.columns}
        raw |= {f"{c}__null": F.col(c).isNull().cast("double") for c in self.indicators}
        return [((x - F.lit(self.mean[c])) / F.lit(self.std[c])).alias(c) for c, x in raw.items()]

    def transform(self, df: DataFrame, name: str = "scaled") -> DataFrame:
        return df.withColumn(name, F.array(*self.expressions()))


@dataclass
class Ridge:
    scaler: Scaler
    weights: np.ndarray
    intercept: float
    alpha: float
    log_target: bool

    def predict(self) -> Column:
        """A column expression: the whole model stays inside code generation."""
        total = F.lit(float(self.intercept))
        for x, w in zip(self.scaler.expressions(), self.weights, strict=True):
            total = total + x * F.lit(float(w))
        return F.expm1(total) if self.log_target else total

    def save(self, spark, path: str) -> None:
        save_record(spark, self.to_record(), path)

    def to_record(self) -> dict:
        return {"scaler": self.scaler.__dict__, "weights": [float(w) for w in self.weights], "intercept": self.intercept, "alpha": self.alpha, "log_target": self.log_target}

    @classmethod
    def load(cls, spark, path: str) -> Ridge:
        r = load_record(spark, path)
        return cls(Scaler(**r["scaler"]), np.array(r["weights"]), r["intercept"], r["alpha"], r["log_target"])

    def coefficients(self) -> list[tuple[str, float]]:
        return list(zip(self.scaler.outputs, map(float, self.weights), strict=True))


def _totals(rows: DataFrame, size: int, part) -> dict:
    """fold -> the sum of part(fold, X, y) (`size` numbers) over Arrow batches of rows (fold_, x_, y_): one partial sum of each fold leaves a task."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for f in pc.unique(b.column("fold_")).to_pylist():
                mine = b.filter(pc.equal(b.column("fold_"), f))
                y = mine.column("y_").to_numpy(zero_copy_only=False)
                totals[f] = totals.get(f, 0) + part(f, np.asarray(mine.column("x_").flatten(), np.float64).reshape(len(y), -1), y)
        yield pa.RecordBatch.from_pydict({"fold_": list(totals), "s": [t.tolist() for t in totals.values()]}, schema=pa.schema({"fold_": pa.int32(), "s": pa.list_(pa.float64())}))

    sums = rows.select("fold_", "x_", "y_").mapInArrow(run, "fold_ int, s array<double>").select("fold_", F.posexplode("s").alias("i", "v"))
    out: dict[int, np.ndarray] = {}
    for r in sums.groupBy("fold_", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["fold_"], np.zeros(size))[r["i"]] = r["v"]
    return out


def _by_fold(values: dict[int, float]) -> Column:
    """The number of a row's fold; few folds, so that this is a literal map."""
    return F.create_map(*[F.lit(x) for f, v in values.items() for x in (int(f), float(v))])[F.col("fold_")]


def ridges(df: DataFrame, fold: str, columns: list[str], target: str, alphas=None, indicators: bool = True, log_target: bool = True) -> dict[int, Ridge]:
    """fold -> ridge regression on the rows of that fold, alpha by leave-one-out error, the intercept free.

    All folds are fitted in the same passes: medians, moments, Gram matrices, then every alpha's leave-one-out
    errors at once, as in the eigenbasis of a Gram matrix a row's leverages and residuals for all alphas are
    two small products. Folds are few; a fold without targets has no model.
    """
    alphas = np.logspace(-3, 4, 40) if alphas is None else np.asarray(alphas, float)
    y = F.log1p(target) if log_target else F.col(target).cast("double")
    rows = df.where(F.col(target).isNotNull()).select(F.col(fold).cast("int").alias("fold_"), *[finite_double(c).alias(c) for c in columns], y.alias("y_"))
    first = {r["fold_"]: r for r in rows.groupBy("fold_").agg(F.count("*").alias("n_"), *[F.count(c).alias(f"{c}__n") for c in columns]).collect()}
    if not first:
        return {}
    median = {f: dict.fromkeys(columns, 0.0) for f in first}
    for r in quantiles(rows, columns, [0.5], ["fold_"]).collect():
        median[r["fold_"]][r["column"]] = r["value"]
    missing = {f: [c for c in columns if indicators and r[f"{c}__n"] < r["n_"]] for f, r in first.items()}
    flagged = [c for c in columns if any(c in m for m in missing.values())]
    named = {c: F.coalesce(F.col(c), _by_fold({f: m[c] for f, m in median.items()})) for c in columns} | {f"{c}__null": F.col(c).isNull().cast("double") for c in flagged}
    filled = rows.select("fold_", "y_", *[x.alias(c) for c, x in named.items()])
    second = {r["fold_"]: r for r in filled.groupBy("fold_").agg(*[F.avg(c).alias(f"{c}__m") for c in named], *[F.stddev_pop(c).alias(f"{c}__s") for c in named]).collect()}
    mean, std = ({f: {c: r[f"{c}__{k}"] or none for c in named} for f, r in second.items()} for k, none in (("m", 0.0), ("s", 1.0)))
    x = filled.select("fold_", "y_", F.array(*[(F.col(c) - _by_fold({f: mean[f][c] for f in first})) / _by_fold({f: std[f][c] for f in first}) for c in named]).alias("x_"))
    p = len(named)
    fits = {}
    for f, sums in _totals(x, 2 + p + p * p, lambda _, m, t: np.concatenate(([len(t), t.sum()], m.T @ t, (m.T @ m).ravel()))).items():
        values, vectors = np.linalg.eigh(sums[2 + p :].reshape(p, p))
        turned = vectors.T @ sums[2 : 2 + p]
        fits[f] = (sums[0], sums[1] / sums[0], vectors, turned, 1 / np.maximum(np.maximum(values, 0)[:, None] + alphas, 1e-300))

    def errors(f, m, t):
        n, middle, vectors, turned, shrink = fits[f]
        z = m @ vectors
        leverage = 1 / n + (z * z) @ shrink
        e = (t[:, None] - middle - (z * turned) @ shrink) / np.maximum(1 - leverage, 1e-12)
        return (e * e).sum(0)

    out = {}
    for f, loss in (_totals(x, len(alphas), errors) if len(alphas) > 1 else dict.fromkeys(fits, np.zeros(1))).items():
        _, middle, vectors, turned, shrink = fits[f]
        best = int(np.argmin(loss))
        keep = [i for i, c in enumerate(named) if i < len(columns) or c[: -len("__null")] in missing[f]]
        names = [list(named)[i] for i in keep]
        scaler = Scaler(list(columns), median[f], {c: mean[f][c] for c in names}, {c: std[f][c] for c in names}, missing[f])
        out[f] = Ridge(scaler, (vectors @ (turned * shrink[:, best]))[keep], float(middle), float(alphas[best]), log_target)
    return out


def ridge(df: DataFrame, columns: list[str], target: str, alphas=None, indicators: bool = True, log_target: bool = True) -> Ridge:
    """Ridge regression on all rows that have a target: ridges() of one fold."""
    found = ridges(df.withColumn("only_", F.lit(1)), "only_", columns, target, alphas, indicators, log_target)
    if not found:
        raise ValueError("no row has a target")
    return found[1]
