"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its site is like.

A linear classifier over document statistics gives each document log odds. Grouped aggregation over all
documents gives hosts, and paths below them, their mean quality; a host is shrunk toward the global mean
by a prior whose strength the spread between hosts tells, a path toward its host by one that the spread
of paths within their hosts tells (or by a given one). The site's posterior
then shifts the document's log odds, so a sparse site hardly moves anything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .common import BROADCAST_ROWS, map_texts
from .quality_rules import labelled_sample, sample_features
from .text_stats import FEATURES, Stats

#: Log odds of one document are kept within this, so that no site average rests on a few sure documents.
SURE = 6.0


@dataclass
class Linear:
    """Standardised features and their squares -> log odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.clip(np.concatenate((z, z * z), 1) @ self.weights + self.intercept, -SURE, SURE)


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 40) -> Linear:
    """Ridge logistic regression by Newton steps."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -6, 6)
    z = np.concatenate((z, z * z, np.ones((len(z), 1))), 1)
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return Linear(mean, scale, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Linear | None:
    """Fit on at most `most` labelled rows outside the held-out fold; None without rows of both labels."""
    x, y = sample_features(labelled_sample(docs, labels, label_col, most, id_col, text_col))
    return fit(x.reshape(-1, len(FEATURES)), y) if len(set(y.tolist())) == 2 else None


def evidence(docs: DataFrame, model: Linear | None, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, host, path, log_odds): hash is xxhash64 of the text; without a model all log odds are 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(ids, texts, hashes, hosts, paths):
            odds = m.log_odds(np.array([Stats(t).features for t in texts])).tolist() if m else [0.0] * len(ids)
            return {"doc_id": ids, "hash": hashes, "host": hosts, "path": paths, "log_odds": odds}

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    return map_texts(rows, make, f"doc_id {kind}, hash bigint, host string, path string, log_odds double", "doc", "text", binary=True, extra=("hash", "host", "path"))


def site_posteriors(rows: DataFrame, path_strength: float | None = 20.0) -> DataFrame:
    """(host, path, n, s, hn, hs, strength, base, below, host_quality, path_quality) for each path of `rows` (host, path, log_odds).

    n and s are the documents and summed quality of the path, hn and hs those of the host. The prior's
    strength comes from the variance of host means beyond what documents explain (method of moments,
    between 2 and 1000 documents); no host is gathered anywhere, only its sums, which combine before
    they shuffle. `below`, the strength of a path's prior, is `path_strength`, or, where that is None, comes from the
    paths of hosts with more than one in the same way (1000 if there are none). Null hosts and paths are a site of their own; no rows in, no rows out.
    """
    p = 1 / (1 + F.exp(-F.col("log_odds")))
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).select(((F.col("s") + 1) / (F.col("n") + 2)).alias("base"))
    rate = F.col("hs") / F.col("hn")
    spread = hosts.crossJoin(F.broadcast(whole)).agg(F.first("base").alias("base"), (F.sum(F.col("hn") * (rate - F.col("base")) ** 2) / F.sum("hn")).alias("between"), (F.count("*") * F.first("base") * (1 - F.first("base")) / F.sum("hn")).alias("noise"))
    extra = F.greatest(F.col("between") - F.col("noise"), F.lit(1e-9))
    strength = F.least(F.greatest(F.col("base") * (1 - F.col("base")) / extra - 1, F.lit(2.0)), F.lit(1000.0))
    prior = spread.select("base", strength.alias("strength"))
    hosts = hosts.crossJoin(F.broadcast(prior)).select(F.col("host").alias("h"), "hn", "hs", "strength", "base")
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    if path_strength is None:
        mean, alone = F.col("hs") / F.col("hn"), F.col("n") == F.col("hn")
        free = mean * (1 - mean)
        between = F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2 - free * (1 - F.col("n") / F.col("hn")))
        told = joined.where(~alone).agg((F.sum(F.col("n") * free) / F.greatest(between, F.sum("n") * 1e-9) - 1).alias("below"))
        joined = joined.crossJoin(F.broadcast(told.select(F.least(F.greatest(F.coalesce("below", F.lit(1000.0)), F.lit(2.0)), F.lit(1000.0)).alias("below"))))
    else:
        joined = joined.withColumn("below", F.lit(float(path_strength)))
    host_quality, path_quality = shrunken()
    return joined.withColumn("host_quality", host_quality).withColumn("path_quality", path_quality)


def shrunken(own: Column | None = None) -> tuple[Column, Column]:
    """Posterior qualities of host and path from the columns of site_posteriors, without the quality `own` of one document."""
    q, one = (F.lit(0.0), 0) if own is None else (own, 1)
    host = (F.col("hs") - q + F.col("strength") * F.col("base")) / (F.col("hn") - one + F.col("strength"))
    return host, (F.col("s") - q + F.col("below") * host) / (F.col("n") - one + F.col("below"))


#: Parts that the documents of one site are dealt to when sites are too many to broadcast.
SALTS = 32


def classify(docs: DataFrame, model: Linear | None, host: Column | None = None, path: Column | None = None, site_weight: float = 0.5, threshold: float = 0.5, path_strength: float | None = 20.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, host, path, doc_score, host_quality, path_quality, score, kept) for each row of docs.

    host and path default to column source, and to source and lang. score is the logistic of the
    document's log odds plus `site_weight` times the log odds of its path's posterior against the global
    mean; the posteriors are those of the site's other documents, so no document speaks twice. kept:
    score >= threshold. Null hosts and paths are a site of their own; a null text counts as empty; equal
    ids each keep their row; no rows in, no rows out; other columns are not read. Without a model all
    documents score alike and are kept. `path_strength` None: estimated (see site_posteriors). A counted number of sites is broadcast; beyond it each site meets
    its documents in SALTS parts.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    rows = kept(evidence(docs, model, host, path, id_col, text_col))
    sites = kept(site_posteriors(rows, path_strength).drop("host_quality", "path_quality")).withColumnsRenamed({"host": "h", "path": "p"})
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    if sites.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sites = F.broadcast(sites)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(SALTS)))
        sites = sites.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = same & (F.col("salt") == F.col("part"))
    logistic = lambda z: 1 / (1 + F.exp(-z))
    host_quality, path_quality = shrunken(logistic(F.col("log_odds")))
    joined = rows.join(sites, same).withColumn("host_quality", host_quality).withColumn("path_quality", path_quality)
    odds = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    total = F.col("log_odds") + site_weight * (odds("path_quality") - odds("base"))
    return joined.select("doc_id", "hash", "host", "path", logistic(F.col("log_odds")).alias("doc_score"), "host_quality", "path_quality", logistic(total).alias("score"), (F.lit(model is None) | (total >= float(np.log(threshold / (1 - threshold))))).alias("kept"))
