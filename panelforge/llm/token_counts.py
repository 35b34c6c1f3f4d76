"""Token counts by a map-side two-tier lookup.

A text is cut at ASCII white space, which no pre-token of the tokenizer crosses, so the tokens of a
text are the sum of the tokens of its pieces. Tier one is a broadcast table piece -> tokens of the most
frequent pieces; tier two is a cache in each Python worker, filled by encoding only the pieces that
both tiers miss. No piece is ever shuffled; the one small aggregation is over the bounded sample that
seeds tier one, which changes speed only, never a count.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, spaced_files, worker_state


#: Bytes of the longest piece that a worker keeps.
KEPT_PIECE = 64


def frequent_pieces(sample: DataFrame, size: int = 65_536, text_col: str = "text") -> list[bytes]:
    """The `size` most frequent pieces of a sample; each task keeps its own `size` largest."""

    def make():
        def count(ids, texts):
            c = Counter(chain.from_iterable(t.split() for t in texts)).most_common(size)
            c = [(p, n) for p, n in c if n > 1 and len(p) < 64]
            return {"piece": [p for p, _ in c], "n": [n for _, n in c]}

        return count

    out = map_texts(sample.select(F.lit(0).alias("id"), text_col), make, "piece binary, n bigint", "id", text_col, binary=True)
    return [bytes(r[0]) for r in out.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size).collect()]


def piece_lengths(pieces: list[bytes], tokenizer) -> list[int]:
    texts = [p.decode("utf-8", "replace") for p in pieces]
    return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    max_tokens: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: DataFrame | None = None,
    table_size: int = 65_536,
    cache_size: int = 250_000,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of `docs`.

    `tokenizer_path` is a JSON file of the `tokenizers` library whose pre-tokens hold no white space.
    `sample` seeds the broadcast table (at most `table_size` pieces; none: the table starts empty), and
    a worker's cache holds at most `cache_size` pieces of up to KEPT_PIECE bytes. A text of any length is counted whole, an
    empty table stays empty. A null text counts as empty (0 bytes, 0 tokens),
    equal ids each keep their row, a null id stays null, and no other column is read.
    """
    from tokenizers import Tokenizer

    spark: SparkSession = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    known: list[bytes] = frequent_pieces(sample, table_size, text_col) if sample is not None else []
    tier_one = dict(zip(known, piece_lengths(known, Tokenizer.from_str(spec)), strict=True))
    shared = spark.sparkContext.broadcast((spec, tier_one))

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        state = worker_state("token_counts")
        spec, table = shared.value
        if (state.get("spec"), state.get("table")) != (spec, table):
            state.update(spec=spec, tokenizer=Tokenizer.from_str(spec), table=table, lengths=dict(table))
        tokenizer = state["tokenizer"]

        def count(ids, texts):
            lengths = state["lengths"]
            if len(lengths) > len(state["table"]) + cache_size:
                lengths = state["lengths"] = dict(state["table"])
            n_tokens = []
            for at in range(0, len(texts), 256):
                words = [t.split() for t in texts[at : at + 256]]
                missing = list(set(chain.from_iterable(words)).difference(lengths))
                lengths.update(zip(missing, piece_lengths(missing, tokenizer), strict=True))
                n_tokens += [sum(map(lengths.__getitem__, w)) for w in words]
                for p in missing:
                    if len(p) > KEPT_PIECE:
                        del lengths[p]
            return {"doc_id": ids, "n_bytes": [len(t) for t in texts], "n_tokens": n_tokens, "over_limit": [n > max_tokens for n in n_tokens]}

        return count

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, make, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", id_col, text_col, binary=True, owner="token_counts")


def sampled(spark: SparkSession, docs: DataFrame, rows: int = 20_000, files: int = 4) -> DataFrame:
    """About `rows` rows of at most `files` of the files of `docs`, to seed the broadcast table."""
    few = spark.read.parquet(*spaced_files(docs, files))
    return few.sample(min(1.0, rows / max(1, few.count())), seed=7)
