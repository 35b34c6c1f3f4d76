"""Toxicity by weak supervision.

A bounded labelled sample chooses the lexicon: word beginnings and whole words that are much commoner in
toxic texts. They are dealt to LEXICONS lexicon voters, each of all languages, beside a few surface
patterns. How every document of the corpus is voted for is counted by pattern of votes (at most 2^16 of
them), and on these counts, without labels, a generative label model is fitted by EM: how often each voter
fires given the hidden label, and how far voters repeat each other. Its posterior labels train a linear
classifier over lexicon counts. Labels start the EM and calibrate the classifier's scale, no more. Texts
are read once: the hits of each document are kept, and the score is taken from them.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_kept, kept
from .common import least_hashed, map_texts
from .quality_rules import labelled_sample

_WORD = re.compile(r"[^\W\d_]+")
#: Shortest and longest word beginning that can be a voter.
SHORT, LONG = 3, 8
#: Lexicon voters; with the patterns they are the bits of a vote.
LEXICONS = 12
#: Patterns that vote besides the words: shouting, exclamations, drawn-out letters, symbol runs.
PATTERNS = (re.compile(r"\b[A-ZÀ-Þ]{4,}\b(?:\W+\b[A-ZÀ-Þ]{4,}\b){4}"), re.compile(r"!{2,}"), re.compile(r"(\w)\1{3}"), re.compile(r"[#$%&*@]{3}"))


def word_keys(word: str) -> list[str]:
    """Voter names that a lower-cased word answers to: its beginnings, and itself in full (with a stop)."""
    return [word[:n] for n in range(SHORT, min(LONG, len(word)) + 1)] + [word + "."]


class _Hits(dict):
    """Word -> numbers of the voters that it fires; bounded."""

    def __init__(self, voters: list[str]):
        super().__init__()
        self.number = {v: i for i, v in enumerate(voters)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        self[word] = hit = tuple(self.number[k] for k in word_keys(word) if k in self.number)
        return hit


def counts(text: str, hits: _Hits) -> tuple[Counter, int]:
    """Times that each voter fires (word voters, then patterns), and the number of words."""
    words = _WORD.findall(text.lower())
    found: Counter = Counter()
    for hit in filter(None, map(hits.__getitem__, words)):
        found.update(hit)
    base = len(hits.number)
    for i, p in enumerate(PATTERNS):
        if p.search(text):
            found[base + i] = 1
    return found, len(words)


@dataclass
class LabelModel:
    """Firing rates of voters under both labels, their correlation given the label, weights against repetition, and the prior of label 1."""

    rates: np.ndarray  # 2 x voters: P(fires | label)
    correlation: np.ndarray
    weight: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fired, silent = np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        z = np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * fired) + (1 - votes) @ (self.weight * silent)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_label_model(votes: np.ndarray, times: np.ndarray, start: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
    """EM over distinct vote patterns (rows of 0 and 1) and their counts, from starting rates (2 x voters) and prior; no labels.

    A voter's weight is 1 over the voters that it is correlated with. Correlation is measured within the
    hidden classes (residuals of votes from their class means), so voters that only agree because both
    are right keep their full weight.
    """
    n = votes.shape[1]
    model = LabelModel(np.clip(start, 1e-4, 1 - 1e-4), np.eye(n), np.ones(n), float(np.clip(prior, 1e-3, 1 - 1e-3)))
    total = times.sum()
    for i in range(rounds if total else 0):
        q = model.posterior(votes)
        toxic, clean = q * times, (1 - q) * times
        rates = np.stack(((clean @ votes + 0.1) / (clean.sum() + 0.2), (toxic @ votes + 0.1) / (toxic.sum() + 0.2)))
        rates = np.clip(rates, 1e-4, 1 - 1e-4)
        correlation, weight = model.correlation, model.weight
        if i >= 2:
            residual = votes - q[:, None] * rates[1] - (1 - q)[:, None] * rates[0]
            spread = np.sqrt((times[:, None] * residual**2).sum(0) / total) + 1e-6
            correlation = ((residual * times[:, None]).T @ residual / total) / np.outer(spread, spread)
            weight = 1 / np.maximum(np.clip(correlation, 0, 1).sum(1), 1)
        model = LabelModel(rates, correlation, weight, float(np.clip(toxic.sum() / total, 1e-3, 1 - 1e-3)))
    return model


def features(found: dict, n_words: int, voters: int) -> np.ndarray:
    """Log counts of voters, and how many word voters fire, how often, and how densely."""
    x = np.zeros(voters + len(PATTERNS) + 3)
    for j, n in found.items():
        x[j] = np.log1p(n)
    words = [n for j, n in found.items() if j < voters]
    x[-3:] = np.log1p(len(words)), np.log1p(sum(words)), np.log1p(100.0 * sum(words) / max(n_words, 20))
    return x


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 3.0, rounds: int = 30) -> tuple[np.ndarray, float, np.ndarray]:
    """Logistic regression on soft labels by Newton steps: weights, intercept and column scales."""
    scale = np.maximum(x.std(0), 1e-6)
    z = np.concatenate((x / scale, np.ones((len(x), 1))), 1)
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1]), scale


def calibration(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (never negative) and shift that make the logistic of z fit labels y; drawn toward 1 and 0."""
    a, w, home = np.stack((z, np.ones_like(z)), 1), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2), a.T @ (y - p) - 0.01 * (w - home))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


@dataclass
class Model:
    voters: list[str]
    labels: LabelModel
    weights: np.ndarray
    intercept: float
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x / self.scale @ self.weights + self.intercept

    def score(self, found: dict, n_words: int) -> float:
        z = self.slope * float(self.raw(features(found, n_words, len(self.voters)))) + self.shift
        return 1 / (1 + np.exp(-min(max(z, -50.0), 50.0)))


def _document_keys(sample: DataFrame, label: int, wanted: set[str] | None, most: int) -> list[tuple[str, int]]:
    """(voter name, documents of that label with it), the `most` commonest; each task keeps as many."""

    def make():
        def run(ids, texts):
            c: Counter = Counter()
            for t in texts:
                keys = {k for w in set(_WORD.findall(t.lower())) for k in word_keys(w)}
                c.update(keys if wanted is None else keys & wanted)
            top = c.most_common(most)
            return {"key": [k for k, _ in top], "n": [n for _, n in top]}

        return run

    rows = map_texts(sample.where(F.col("label") == label).select("doc_id", "text"), make, "key string, n bigint")
    return [(r[0], r[1]) for r in rows.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(most).collect()]


def find_voters(sample: DataFrame, n1: int, n0: int, most: int = 200, least_lift: float = 8.0, least_share: float = 0.004) -> list[str]:
    """Names of at most `most` voters by log-likelihood gain; of nested ones with like support, the shorter.

    A voter is at least `least_lift` times as common in toxic documents, in `least_share` of them or more,
    and so much commoner that among as many candidates chance would hardly bring one.
    """
    toxic = dict(_document_keys(sample, 1, None, 50_000))
    clean = dict(_document_keys(sample, 0, set(toxic), 50_000))
    ranked, share, chance = [], n1 / (n1 + n0), np.log(max(len(toxic), 2))
    for key, a in toxic.items():
        b = clean.get(key, 0)
        p1, p0 = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
        sure = a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0)
        if a >= max(3, least_share * n1) and p1 >= least_lift * p0 and sure >= chance:
            ranked.append((-round(float(a * np.log(p1 / p0) - n1 * (p1 - p0)), 6), len(key), key, a, b))
    chosen: list[tuple[str, int, int]] = []
    for _, _, key, a, b in sorted(ranked):
        if len(chosen) == most:
            break
        bare = key.rstrip(".")
        if not any((bare.startswith(k.rstrip(".")) or k.rstrip(".").startswith(bare)) and 0.8 * x <= a <= 1.25 * x and abs(b - y) <= 0.2 * y + 1 for k, x, y in chosen):
            chosen.append((key, a, b))
    return [k for k, _, _ in chosen]


def cast_votes(docs: DataFrame, voters: list[str], id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, at, times, n_words[, extra]): which voters and patterns each whole text fires, how often, and its words."""

    def make():
        hits = _Hits(voters)

        def run(ids, texts, *more):
            found = [counts(t, hits) for t in texts]
            return {"doc_id": ids, "at": [sorted(c) for c, _ in found], "times": [[c[j] for j in sorted(c)] for c, _ in found], "n_words": [w for _, w in found]} | dict(zip(extra, more, strict=True))

        return run

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return map_texts(docs, make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, at array<int>, times array<int>, n_words int" + kinds, id_col, text_col, extra=extra)


def vote_counts(votes: DataFrame, n_voters: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vote patterns of all documents (lexicon voters, then patterns) and how many documents have each.

    A pattern is one number of LEXICONS + len(PATTERNS) bits, so at most 2^16 rows leave the aggregation.
    """
    bits = [1 << (j % LEXICONS) for j in range(n_voters)] + [1 << (LEXICONS + i) for i in range(len(PATTERNS))]
    table = F.array(*[F.lit(b) for b in bits])
    pattern = F.aggregate("at", F.lit(0), lambda seen, j: seen.bitwiseOR(F.element_at(table, j + 1)))
    rows = votes.select(pattern.alias("p")).groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect()
    p = np.array([r[0] for r in rows], np.int64)
    return ((p[:, None] >> np.arange(LEXICONS + len(PATTERNS))) & 1).astype(np.float64), np.array([r[1] for r in rows], np.float64)


def _patterns(x: np.ndarray, n_voters: int) -> np.ndarray:
    """Vote patterns of feature rows."""
    out = np.zeros((len(x), LEXICONS + len(PATTERNS)))
    for j in range(n_voters):
        out[:, j % LEXICONS] = np.maximum(out[:, j % LEXICONS], x[:, j] > 0)
    out[:, LEXICONS:] = x[:, n_voters : n_voters + len(PATTERNS)] > 0
    return out


def _gathered(votes: DataFrame, n_voters: int, *more: str) -> tuple[np.ndarray, list]:
    """Feature rows of a bounded number of documents, in a fixed order, and their other columns."""
    rows = sorted(tuple(r) for r in votes.select("n_words", "at", "times", *more).collect())
    x = [features(dict(zip(at, times, strict=True)), n, n_voters) for n, at, times, *_ in rows]
    return np.array(x).reshape(len(rows), n_voters + len(PATTERNS) + 3), [r[3:] for r in rows]


def fit(votes: DataFrame, sample: DataFrame, voters: list[str], most: int = 20_000) -> Model:
    """The model from all documents' votes (cast_votes) and a labelled sample (doc_id, text, label).

    The label model sees every document and no label; labels give the rates and the share that it starts
    from. The classifier is trained on the posteriors of at most `most` documents outside the held-out
    fold, those of least hash, and brought to the labels' scale by two numbers.
    """
    x, y = _gathered(cast_votes(sample, voters, extra=("label",)), len(voters), "label")
    y = np.array([r[0] for r in y], np.float64)
    told = _patterns(x, len(voters))
    start = np.stack([(told[y == c].sum(0) + 0.5) / ((y == c).sum() + 1) for c in (0, 1)])
    labels = fit_label_model(*vote_counts(votes, len(voters)), start, y.mean())
    open_ = votes.where(~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    seen, _ = _gathered(least_hashed(open_, F.xxhash64(F.lit(17), "doc_id"), most, ties=("n_words", "at", "times")), len(voters))
    model = Model(voters, labels, *fit_linear(seen, labels.posterior(_patterns(seen, len(voters)))))
    model.slope, model.shift = calibration(model.raw(x), y)
    return model


def _lexicon(docs: DataFrame, labels: DataFrame, most: int, label_col: str, id_col: str, text_col: str) -> tuple[DataFrame, list[str] | None]:
    """The labelled sample, and the words that it chooses (None without both labels)."""
    sample = kept(labelled_sample(docs, labels, label_col, most, id_col, text_col))
    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    return sample, find_voters(sample, n[1], n[0]) if n.get(0) and n.get(1) else None


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The model of docs and at most `most` labelled ids outside the held-out fold (see labelled_sample); None without both labels."""
    sample, voters = _lexicon(docs, labels, most, label_col, id_col, text_col)
    votes = kept(cast_votes(docs, voters, id_col, text_col)) if voters is not None else None
    model = fit(votes, sample, voters, most) if voters is not None else None
    drop_kept(sample, votes)
    return model


def score_votes(votes: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of cast_votes; see score()."""
    shared = votes.sparkSession.sparkContext.broadcast(model)
    kind = votes.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in ("at", "times", "n_words")], strict=True)
            found = [m.score(dict(zip(at, times, strict=True)), n) if m else 0.0 for at, times, n in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = votes.select("doc_id", "at", "times", "n_words").mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; only texts enter the score.

    held_out: crc32 of the id as text, modulo 4, is 2 (null id: false). An empty or null text gets the
    score of a text in which no voter fires; without a model every score is 0. Whole texts count,
    whatever their length; equal ids each keep their row; no rows in, no rows out; other columns are not
    read.
    """
    return score_votes(cast_votes(docs, model.voters if model else [], id_col, text_col), model, threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 20_000, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """train() and score() of the same documents with one reading of their texts."""
    sample, voters = _lexicon(docs, labels, most, label_col, id_col, text_col)
    votes = kept(cast_votes(docs, voters or [], id_col, text_col))
    model = fit(votes, sample, voters, most) if voters is not None else None
    drop_kept(sample)
    return score_votes(votes, model, threshold)
