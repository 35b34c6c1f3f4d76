"""A corpus pipeline: quality, near duplicates, personal data, mixture, token ids.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns
the columns of documents; the last returns token ids. Stages are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import byte_bpe, mixing, ngram_join, pii, quality_classifier
from panelforge.llm.common import chosen, free_name, without
from panelforge.session import drop_kept, kept, on_workers, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    Null and empty texts are scored like any other; equal rows go or stay together; extra columns stay,
    whatever they are called; an empty table stays empty.
    """
    on_workers(spark)
    scored = quality_classifier.classify(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")), path_strength=None)
    return without(docs, kept(scored.where("not kept").select("doc_id", "hash")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of linked documents: that of least id (null last), then text hash, then row hash.

    Texts without words (and null ones) link with nothing and all stay. Rows of one id are documents of
    their own. Columns stay as they are; an empty table stays empty.
    """
    on_workers(spark)
    classes = kept(ngram_join.join_groups(docs, 5, 80).select("doc_id", "hash", "first", "n_shingles"))
    single = without(docs, kept(classes.where("not first").select("doc_id", "hash")))
    again = classes.where("first and n_shingles > 0").groupBy("doc_id", "hash").agg(F.count("*").alias("n")).where("n > 1")
    again = kept(again.select("doc_id", "hash"))
    if again.isEmpty():
        return single
    row, whole = free_name(docs.columns, "row_"), [F.col(f"`{c}`") for c in docs.columns]
    repeated = chosen(docs, again).groupBy(F.col("doc_id"), F.xxhash64("text")).agg(F.min_by(F.struct(*whole), F.xxhash64(*whole)).alias(row))
    return without(single, again).unionByName(repeated.select(f"{row}.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data; n_chars follows the new text.

    Null and empty texts stay as they are, equal rows are masked alike, long texts are masked whole, and
    other columns are not touched; an empty table stays empty.
    """
    on_workers(spark)
    masked = pii.mask_column(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents so that sources share the words by weights 5, 2, 1 (3 epochs at most).

    A null source is a source, null and empty texts cost nothing, equal rows go together, a long document
    is taken whole or not. Columns stay as they are, whatever they are called; an empty table stays empty.
    """
    on_workers(spark)
    sizes = kept(mixing.sized(docs))
    taken = mixing.plan(sizes, (5.0, 2.0, 1.0), 3.0).take(docs)
    drop_kept(sizes)
    copies, _ = mixing.taken_names(docs)
    times = F.explode(F.sequence(F.lit(1), F.col(copies))).alias(free_name([*docs.columns, copies], "epoch_"))
    return taken.where(F.col(copies) > 0).select("*", times).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): byte-level BPE of each text, ids as little-endian 32-bit integers.

    Null texts count as empty and have no ids; every row gives one, repeated ones too; other columns are
    not read; an empty table stays empty.
    """
    import public_tokenizers

    on_workers(spark)
    out = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_decoded=True)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: SQL cannot express these stages; tests hold the result against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
