"""Chat formatting of reply trees, with DataFrame operations only.

Pointer doubling by self-joins gives each node its 2^k-th ancestor and the summed score of the nodes up
to it, so a leaf's score is known after log2(depth) joins, before any path is written. Branches are ranked
by it; the same pointers then enumerate the root-to-leaf paths of the chosen leaves only, as (leaf, node,
distance) rows, again in log2(depth) joins. All of this carries ids; texts are shuffled once, by tree,
when each chosen path becomes one conversation.

Template: <|turn|> role <|say|> text <|end|> for each turn, without the spaces. Inside roles and texts
a backslash is doubled, and one is put after the first character of every control string, so the output
splits at its markers without doubt and unescapes to what went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_kept, kept

TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"
_CONTROL = r"(<)(\||/?s>)|(\[)(/?INST\])"


def escape(text: Column) -> Column:
    """Double backslashes, then break control strings (<|, <s>, </s>, [INST], [/INST]); null is empty."""
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, _CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def thread_nodes(turns: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of plain conversations: rows by turn (null first), then role, hash of the text and text; each row answers the one before.

    Repeated rows are turns of their own; null conversations are one; null roles and texts stay null;
    other columns are not read; no rows in, no rows out. The numbers are the same whether or not the
    texts are read, but for rows that are equal.
    """
    rows = turns.select(F.col(tree).alias("tree"), F.col(turn).alias("at"), F.col(role).alias("role"), F.col(text).alias("text"))
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("at"), F.asc_nulls_first("role"), F.xxhash64("text"))
    node = F.row_number().over(order).cast("long")
    return rows.withColumn("node", node).select("tree", "node", "role", "text", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"))


def _same(x: str, y: str) -> Column:
    """Rows of a and b in the same tree (null: one too) where a.x is b.y."""
    return F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col(f"a.{x}") == F.col(f"b.{y}"))


def _ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, node, up) of 2^k-th ancestors, k = 0, 1, ..., and (tree, node, total): the summed score from each node to its root.

    A round doubles the pointers of what has not reached a root. Some node always reaches one unless all
    that is left hangs on circles of replies; that is left out of the totals.
    """
    known = nodes.select("tree", F.col("node").alias("up"))
    own = nodes.where(F.col("parent") != F.col("node")).select("tree", "node", "score", F.col("parent").alias("up"))
    rooted = own.alias("a").join(known.alias("b"), _same("up", "up"), "left_semi").select("tree", "node", "up", "score")
    n, r = nodes.alias("a"), rooted.alias("b")
    step = kept(n.join(r, _same("node", "node"), "left").select("a.tree", "a.node", "b.up", F.col("a.score").alias("total")))
    ups, done = [], step.where("up is null").select("tree", "node", "total")
    steps = [step]
    while True:
        up = step.where("up is not null")
        left = up.count()
        if not left:
            break
        ups.append(up.select("tree", "node", "up"))
        there = up.select("tree", "node", "up", "total").unionByName(done.withColumn("up", F.lit(None).cast(nodes.schema["node"].dataType)))
        a, b = up.alias("a"), there.alias("b")
        step = kept(a.join(b, _same("up", "node")).select("a.tree", "a.node", "b.up", (F.col("a.total") + F.col("b.total")).alias("total")))
        steps.append(step)
        finished = step.where("up is null")
        if finished.isEmpty():
            break
        done = done.unionByName(finished.select("tree", "node", "total"))
    totals = kept(done)
    totals.steps_ = steps
    return ups, totals


def chosen_paths(nodes: DataFrame, keep: int) -> DataFrame:
    """(tree, leaf, node, above, score, branch_rank): the nodes from each chosen leaf to its root; above: their distance from the leaf.

    nodes: (tree, node, parent, score), one row a node. The `keep` leaves of greatest total are chosen in
    each tree; ties: the smaller leaf.
    """
    ups, totals = _ancestors(nodes)
    leaves = totals
    if ups:
        leaves = totals.alias("a").join(ups[0].alias("b"), _same("node", "up"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    chosen = leaves.withColumn("branch_rank", rank).where(F.col("branch_rank") <= keep)
    found = kept(chosen.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"), F.col("total").alias("score"), "branch_rank"))
    for k, up in enumerate(ups):
        further = found.alias("a").join(up.alias("b"), _same("node", "node")).select("a.tree", "a.leaf", F.col("b.up").alias("node"), (F.col("a.above") + (1 << k)).alias("above"), "a.score", "a.branch_rank")
        old, found = found, kept(found.unionByName(further))
        drop_kept(old)
    drop_kept(totals, *totals.steps_)
    return found


def format_trees(nodes: DataFrame, keep: int = 1, score: str | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each of the `keep` best branches of every tree: (tree, leaf, branch_rank, score, n_turns, formatted, loss_spans).

    `nodes` has tree, node, parent, role, text and perhaps a score column; other columns are not read.
    A branch's score is the sum over its nodes (null and no column: 0); equal scores go to the smaller
    leaf. loss_spans are [start, end) code points of `formatted` that hold the escaped text of each turn
    of a loss role, in order. A node without parent, or whose parent is not in its tree, is a root.
    Repeated (tree, node) rows count once, the one of least parent, role, hash of the text, score and
    text; rows without node are dropped, a null tree is a tree of its own; replies in a circle have no
    root and yield nothing. A null role or text is empty; texts may have any length, though a whole
    conversation is one row of the result. No rows in, no rows out. `nodes` is read twice, the first time
    without texts.
    """
    value = F.coalesce(F.col(score), F.lit(0.0)).cast("double") if score else F.lit(0.0)
    role, said = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    first = [F.col("parent").alias("parent"), role.alias("role"), F.xxhash64(said).alias("hash"), value.alias("score")]
    real = nodes.where("node is not null")
    links = kept(real.groupBy("tree", "node").agg(F.min(F.struct(*first)).alias("row")).select("tree", "node", "row.parent", "row.score"))
    chosen = chosen_paths(links, keep)
    drop_kept(links)
    # texts and places meet by grouping, so that one shuffle by tree serves for this and for what follows
    place = F.struct("leaf", "above", F.col("score").alias("total"), "branch_rank")
    texts = real.select("tree", "node", F.struct(*first, said.alias("text")).alias("row"), F.lit(None).cast(chosen.select(place.alias("p")).schema["p"].dataType).alias("place"))
    places = chosen.repartition("tree").select("tree", "node", F.lit(None).cast(texts.schema["row"].dataType).alias("row"), place.alias("place"))
    both = texts.unionByName(places).groupBy("tree", "node").agg(F.min("row").alias("row"), F.collect_list("place").alias("places"))
    turns = both.select("tree", "row", F.explode("places").alias("place"))
    turns = turns.select("tree", "place.leaf", "place.branch_rank", "place.above", F.col("place.total").alias("score"), F.concat(F.lit(TURN), escape(F.col("row.role")), F.lit(SAY)).alias("head"), escape(F.col("row.text")).alias("said"), F.col("row.role").isin(*loss_roles).alias("loss"))
    in_order = Window.partitionBy("tree", "leaf").orderBy(F.desc("above"))
    end = F.sum(F.length("head") + F.length("said") + len(END)).over(in_order) - len(END)
    turns = turns.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("said"))
    packed = turns.groupBy("tree", "leaf", "branch_rank", "score").agg(F.array_sort(F.collect_list(F.struct("start", "end", "loss", "head", "said"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["said"], F.lit(END))), "")
    return packed.select("tree", "leaf", "branch_rank", "score", F.size("turns").cast("long").alias("n_turns"), whole.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse format_trees' output: adds turns (array of role and text) and loss_texts (unescaped texts under the mask).

    Rows with a null `formatted` get nulls; an empty one has no turns; repeated and long rows are read alike.
    """
    pieces = F.split("formatted", r"<\|end\|>", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    part = lambda t, i: unescape(F.split(F.substring(t, len(TURN) + 1, 2_147_483_647), r"<\|say\|>", -1)[i])
    turns = F.transform(pieces, lambda t: F.struct(part(t, 0).alias("role"), part(t, 1).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_texts", masked)
