"""Quality rules: boosted trees over document statistics, scored from flat numpy node arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosted_trees
from .common import least_hashed, map_texts
from .text_stats import FEATURES, Stats

#: Quality never rises with these shares.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "top_word_share", "run_share", "wordless_share")
MONOTONE = {FEATURES.index(f): -1 for f in FALLING}


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled ids, those of least hash, one row each, outside the held-out fold.

    The held-out fold (crc32 of the id as text, modulo 4, is 2) never trains. At most `most` small rows
    are broadcast; null labels and ids take no part. Where an id has several labels the least counts, and
    where it has several documents the least text: minima combine before they shuffle, so an id that
    repeats without end still gives one row.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % 4
    few = labels.where(F.col(label_col).isin(0, 1) & (fold != 2)).groupBy(F.col(id_col).alias("id_of_label_")).agg(F.min(label_col).cast("int").alias("label_"))
    few = least_hashed(few, F.xxhash64(F.lit(11), "id_of_label_"), most, ties=("id_of_label_",))
    rows = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    found = rows.join(F.broadcast(few), F.col("id_") == F.col("id_of_label_"))
    return found.groupBy(F.col("id_").alias("doc_id"), F.col("label_").alias("label")).agg(F.min("text_").alias("text")).select("doc_id", "text", "label")


def sample_features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of a bounded labelled sample, on the driver, in a fixed order."""

    def make():
        def run(ids, texts, label):
            return {"label": label, "x": [[float(v) for v in Stats(t).features] for t in texts]}

        return run

    rows = map_texts(sample, make, "label int, x array<double>", "doc_id", "text", binary=True, extra=("label",)).collect()
    rows.sort(key=lambda r: (r[1], r[0]))
    return np.array([r[1] for r in rows], np.float64).reshape(-1, len(FEATURES)), np.array([r[0] for r in rows], np.int64)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = 20_000, id_col: str = "doc_id", text_col: str = "text"):
    """Node arrays fitted on a bounded labelled sample; None without rows of both labels."""
    x, y = sample_features(labelled_sample(docs, labels, label_col, most, id_col, text_col))
    return boosted_trees.fit(x, y, MONOTONE) if len(set(y.tolist())) == 2 else None


def apply_rules(docs: DataFrame, model, threshold: float = 0.5, least_words: int = 10, most_repeat_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score).

    base_failed: under `least_words` words, or over `most_repeat_percent` percent of the words lie in
    5-word windows that the text holds twice. kept: not base_failed and the trees' score reaches
    `threshold`. Without a model the score is null and the base rules decide alone. A null text has no
    words; equal ids each keep their row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        nodes = shared.value

        def run(ids, texts):
            rows = [Stats(t) for t in texts]
            score = nodes.score(np.array([r.features for r in rows])).tolist() if nodes else [None] * len(rows)
            failed = [r.n_words < least_words or 100 * r.n_repeat_words > most_repeat_percent * r.n_words for r in rows]
            kept = [not bad and (s is None or s >= threshold) for bad, s in zip(failed, score, strict=True)]
            counts = {c: [getattr(r, c) for r in rows] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            return {"doc_id": ids} | counts | {"base_failed": failed, "kept": kept, "score": score}

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"
    return map_texts(docs, make, schema, id_col, text_col, binary=True)
