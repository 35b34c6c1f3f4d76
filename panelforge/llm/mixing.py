"""Mixing sources to target weights by exact cuts in hash-random order.

Each document has a random key, a hash of its id and text. A source's documents, in key order, are taken
as many whole times as its target allows, and once more up to the cut where the running sum of sizes
comes nearest to the target (or, if asked, exactly at it, inside the last document). The running sums are
distributed: sums of key ranges first, sums of ranges of ranges for their offsets, and single documents
only in the one range of each source that holds its cut. A cut is then one key per source, so taking
documents is a filter: no text is ever shuffled or sorted. Sources are ranked and given their targets by
aggregations too, so their number has no limit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_kept, kept
from .common import free_name, small

#: Documents in a key range, on average, and ranges in a range of ranges.
RANGE, RANGES = 256, 1024
#: Hash keys are below this.
KEYS = 1 << 52
#: The columns of a plan.
_FIELDS = ("source", "source_size", "target", "epochs", "rest", "again", "ranges", "cut_range", "cut_key", "part_key", "part_share")


@dataclass
class Mix:
    """Per source: size, target, full epochs, and the cut of the last epoch (key range and key)."""

    cuts: DataFrame

    def take(self, docs: DataFrame, source: str = "source", id_col: str = "doc_id", text_col: str | None = "text", names: tuple[str, str] = ("copies_", "part_")) -> DataFrame:
        """docs with two more columns: copies, and the share taken besides of the one document cut; a map-side join while sources are few.

        The names are lengthened while docs has such columns; see taken_names().
        """
        cut = free_name(docs.columns, "cut_")
        rows = docs.join(small(self.cuts.select(F.struct(*_FIELDS).alias(cut))), F.col(source).eqNullSafe(F.col(f"{cut}.source")), "left")
        here = {f: F.col(f"{cut}.{f}") for f in _FIELDS}
        copies, part = _copies(here, key_of(id_col, text_col) if text_col else F.col("key"))
        copies_name, part_name = taken_names(docs, names)
        return rows.select(*[F.col(f"`{c}`") for c in docs.columns], copies.alias(copies_name), part.alias(part_name), here["source_size"].alias(free_name([*docs.columns, copies_name, part_name], "source_size_")), here["target"].alias(free_name([*docs.columns, copies_name, part_name], "target_")))


def taken_names(docs: DataFrame, names: tuple[str, str] = ("copies_", "part_")) -> tuple[str, str]:
    """What Mix.take calls its columns over docs."""
    return free_name(docs.columns, names[0]), free_name(docs.columns, names[1])


def key_of(id_col: str, text_col: str) -> Column:
    """A random key from id and text: rows that differ have their own, equal rows share one."""
    told = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("long")


def _range(ranges: Column, key: Column) -> Column:
    """The number of a key's range, growing with the key (bitwise exact in doubles)."""
    return F.floor(key.cast("double") / F.lit(float(KEYS)) * ranges).cast("long")


def _copies(cut: dict[str, Column], key: Column) -> tuple[Column, Column]:
    at = _range(cut["ranges"], key)
    before = (at < cut["cut_range"]) | ((at == cut["cut_range"]) & (key <= cut["cut_key"]))
    copies = cut["epochs"] + F.when(before & cut["again"], 1).otherwise(0)
    part = F.when((key == cut["part_key"]) & cut["again"] & ~F.coalesce(before, F.lit(False)), cut["part_share"])
    return copies.cast("int"), F.coalesce(part, F.lit(0.0))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """sizes with rank (from 0) by source, null last: a range sort, then offsets from the counts of its parts."""
    placed = sizes.orderBy(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id())
    placed = kept(placed.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}))
    parts = [r[0] for r in placed.groupBy("part").count().orderBy("part").select(F.struct("part", "count")).collect()]  # one row for each part
    starts, total = [], 0
    for part, n in parts:
        starts.append((part, total))
        total += n
    offsets = sizes.sparkSession.createDataFrame(starts, "p bigint, start bigint")
    out = placed.join(F.broadcast(offsets), F.col("part") == F.col("p")).withColumn("rank", F.col("start") + F.col("at")).drop("part", "at", "p", "start")
    out._kept_path = placed._kept_path
    return out


def with_targets(sizes: DataFrame, weights: tuple[float, ...], most: float, share: float = 1.0) -> DataFrame:
    """sizes (source, size, n) with target: `share` of all sizes split by the weights in order of source, null last.

    No target is above most times its source's size; what that leaves goes to the others by weight, until
    none is above. Each round is one aggregation: the price of a unit of weight rises until it stays.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked_sources(sizes)
    rows = kept(ranked.withColumn("weight", weight))
    drop_kept(ranked)
    total = share * float(rows.agg(F.sum("size")).first()[0] or 0)
    cap = F.col("size") * F.lit(float(most))
    price = 0.0
    while True:
        open_ = F.lit(price) * F.col("weight") <= cap
        full, left = rows.agg(F.sum(F.when(~open_, cap)), F.sum(F.when(open_, F.col("weight")))).first()
        if not left:
            break
        new = max(0.0, total - (full or 0.0)) / left
        if new <= price:
            break
        price = new
    out = rows.withColumn("target", F.least(F.lit(price) * F.col("weight"), cap))
    out._kept_path = rows._kept_path
    return out


def sized(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, key): words (runs without ASCII white space) of each text, and its random key; null: 0.

    Every row is kept, whatever repeats or is null; an empty table gives no rows, and texts have no limit of length.
    """
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), words.alias("size"), key_of(id_col, text_col).alias("key"))


def plan(rows: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, share: float = 1.0, exact: bool = False) -> Mix:
    """Targets and cuts from (source, size, key) rows.

    Sources in code-point order, null last, get the weights in turn; they share `share` of all sizes,
    none more than `most` times its own. A document is taken at most ceil(`most`) times. Equal rows of a
    source share a key and go together. The last epoch ends at the whole document whose end or start is
    nearest to the target; with `exact` the document at the cut is taken in part instead; a document
    without words costs nothing and is taken once where its source takes none whole. One small row for
    each source is broadcast while a count allows. Sizes that are null count as 0; no rows, no cuts.
    """
    rows = rows.select("source", F.coalesce("size", F.lit(0)).alias("size"), "key")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    priced = with_targets(sizes, weights, most, share)
    epochs = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(math.floor(most)))).otherwise(0)
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("size"))
    sources = priced.withColumn("epochs", epochs.cast("int")).withColumn("rest", rest)
    ranges = F.greatest(F.lit(1.0), F.ceil(F.col("n") / F.lit(float(RANGE))).cast("double"))
    sources = kept(sources.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target", "epochs", "rest", ((F.col("rest") > 0) | (F.col("epochs") == 0)).alias("again"), ranges.alias("ranges")))
    drop_kept(priced)
    keyed = rows.join(small(sources.select("s", "rest", "ranges")), F.col("source").eqNullSafe(F.col("s"))).select("s", "rest", "size", "key", _range(F.col("ranges"), F.col("key")).alias("range"))
    sums = keyed.groupBy("s", "rest", "range").agg(F.sum("size").alias("size")).withColumn("far", F.floor(F.col("range") / RANGES))
    sums = kept(sums)
    far = sums.groupBy("s", "far").agg(F.sum("size").alias("total"))
    far = far.withColumn("start", F.sum("total").over(Window.partitionBy("s").orderBy("far")) - F.col("total"))
    here = F.sum("size").over(Window.partitionBy("s", "far").orderBy("range")) - F.col("size")
    s, f = sums.withColumn("here", here).alias("s"), far.alias("f")
    offsets = s.join(f, F.col("s.s").eqNullSafe(F.col("f.s")) & (F.col("s.far") == F.col("f.far"))).select("s.s", "s.rest", "s.range", (F.col("f.start") + F.col("s.here")).alias("before"))
    cut = offsets.where("before <= rest").groupBy(F.col("s").alias("cs")).agg(F.max(F.struct("range", "before")).alias("cut")).select("cs", F.col("cut.range").alias("cut_range"), F.col("cut.before").alias("before"))
    cut = kept(cut)
    inside = keyed.join(small(cut), F.col("s").eqNullSafe(F.col("cs")) & (F.col("range") == F.col("cut_range")))
    units = inside.groupBy("s", "rest", "before", "key").agg(F.sum("size").alias("size"))
    units = units.withColumn("end", F.col("before") + F.sum("size").over(Window.partitionBy("s").orderBy("key")))
    whole = F.col("end") - (F.lit(0) if exact else F.col("size") / 2) <= F.col("rest")
    rest = F.struct("key", ((F.col("rest") - F.col("end") + F.col("size")) / F.col("size")).alias("share"))
    last = units.groupBy(F.col("s").alias("ls")).agg(F.max(F.when(whole, F.col("key"))).alias("cut_key"), F.min(F.when(~whole & F.lit(exact), rest)).alias("part"))
    last = last.select("ls", "cut_key", F.col("part.key").alias("part_key"), F.col("part.share").alias("part_share"))
    joined = sources.join(small(cut), F.col("s").eqNullSafe(F.col("cs")), "left").join(small(kept(last)), F.col("s").eqNullSafe(F.col("ls")), "left")
    cuts = kept(joined.withColumnRenamed("s", "source").select(*_FIELDS))
    drop_kept(sums, cut, sources)
    return Mix(cuts)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, share: float = 1.0, exact: bool = False, id_col: str = "doc_id", source: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs; see plan(). taken: words, repeats counted."""
    rows = kept(sized(docs, id_col, source, text_col))
    taken = plan(rows, weights, most, share, exact).take(rows, "source", "doc_id", None)
    words = F.col("copies_") * F.col("size") + F.round(F.col("part_") * F.col("size")).cast("long")
    return taken.select("doc_id", "source", "size", F.col("source_size_").alias("source_size"), F.col("target_").alias("target"), F.col("copies_").alias("copies"), words.alias("taken"))
