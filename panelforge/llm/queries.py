"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import ann, byte_bpe, chat_format, dual_tree, mixing, ngram_join, oracles, pii, quality_classifier, quality_rules, spelling, token_files, toxicity
from .token_counts import count_tokens, sampled


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the lower-casing word BPE."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, sample=sampled(spark, docs))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and their decoding, as digests."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    out = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and boosted trees over the statistics of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts of all spans, the base spans' digest, and all spans."""
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count(F.col("spans"), k).alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(pii.joined(F.filter("spans", lambda s: s["base"])), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, formatted and read back."""
    said = F.lit("</s>[INST] ok [/INST]")
    one = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(one)
    back = chat_format.read_back(chat_format.format_trees(chat_format.thread_nodes(rows)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 over their sources, 3 epochs at most."""
    out = mixing.mix(table(spark, sf_dir, "documents"), (5.0, 2.0, 1.0), 3.0, exact=True)
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 5-word shingles at Jaccard 0.8."""
    return ngram_join.join_groups(table(spark, sf_dir, "documents"), 5, 80).select("doc_id", "n_shingles", "component_id")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50, among all rows."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, per_list=512, boundary=1.02, recall=0.98)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a classifier trained on a label model's posteriors."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.3)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its own evidence and the posteriors of its source and source/lang."""
    docs = table(spark, sf_dir, "documents")
    out = quality_classifier.classify(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")), path_strength=None)
    return out.select("doc_id", "score", "kept", "doc_score", "host_quality", "path_quality", "host", "path")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their commonest near word, near words and the root of their chain of forms."""
    out = spelling.variants(spelling.count_words(table(spark, sf_dir, "documents")))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, written as Simple-8b files and read back."""
    import public_tokenizers

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 clusters of all embeddings after three rounds."""
    return dual_tree.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op4_byte_bpe, op10_quality_rules, op6_pii, op3_chat_format, op5_mixing, op7_ngram_join, op9_nearest, op2_toxicity, op8_quality_classifier, op11_spelling, op12_token_files, op13_dual_tree)}
ORACLE: dict[str, str] = {"op3_chat_format": oracles.CHAT_FORMAT, "op5_mixing": oracles.MIXING, "op7_ngram_join": oracles.NGRAM_JOIN, "op13_dual_tree": oracles.DUAL_TREE}
