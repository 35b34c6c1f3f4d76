"""Connected components by minimum labels with pointer jumping; everything stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_kept, kept


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for each id of edges (a, b): label is the smallest id that its links reach.

    Each round takes the least label among an id's neighbours and then that label's own label, so the
    distance that labels travel doubles, until no label changes. Rows with a null end or a == b link
    nothing, repeated edges count once, no edges give no rows, other columns are not read. Minima combine
    before they shuffle, so an id with very many links sends one row from each task.
    """
    pairs = edges.where("a != b").select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")
    pairs = kept(pairs.distinct())
    labels = kept(pairs.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("least")).select("id", F.least("id", "least").alias("label")))
    while True:  # labels only fall, so this ends
        near = pairs.join(labels, pairs.src == labels.id).select(F.col("dst").alias("id"), "label")
        lower = kept(near.unionByName(labels).groupBy("id").agg(F.min("label").alias("label")))
        a, b = lower.alias("a"), lower.alias("b")
        jumped = kept(a.join(b, F.col("a.label") == F.col("b.id")).select("a.id", F.col("b.label").alias("label")))
        a, b = jumped.alias("a"), labels.alias("b")
        changed = not a.join(b, F.col("a.id") == F.col("b.id")).where("a.label != b.label").isEmpty()
        drop_kept(labels, lower)
        labels = jumped
        if not changed:
            drop_kept(pairs)
            return labels
