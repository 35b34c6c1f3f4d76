"""Lloyd's clustering of integer vectors by a tree over vectors and a tree over centroids.

Vectors are cut into blocks, and each block's cover tree is built once and written. A round is one job:
each task walks the pairs (node of vectors, nodes of centroids), drops centroid nodes that are too far for
every vector of the node, takes a node whole where one centroid is left, and compares leaves exactly.
Only sums by centroid leave a task. Distances, sums and new centroids are exact integers.
"""

from __future__ import annotations

import decimal
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_kept, kept

#: Vectors of one tree; a leaf's vectors at most (equal ones stay together); children of fewer are pooled.
BLOCK, LEAF, POOL = 1024, 16, 8
#: Components below this have exact products in doubles; below the second, exact distances in 64-bit integers.
DOUBLE, LONG = 1 << 22, 1 << 27
#: Vectors with a component of this size have squared distances that no long holds, and take no part.
LIMIT = 1 << 31
#: Bounds are kept this much (of their size) too wide, for rounding.
SLACK = 1e-9


@dataclass
class Tree:
    """Nodes in an order where each covers rows start to stop; children of node i are first[i] to first[i] + many[i]."""

    order: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    many: np.ndarray


def cover_tree(x: np.ndarray, leaf: int = LEAF, pool: int = POOL) -> Tree:
    """A cover tree of the rows of x (floats): a node's rows lie within its radius of its center, one of them.

    Children have half the radius and centers more than that apart; children of fewer than `pool` rows
    are taken together, as a leaf around their parent's center.
    """
    order = np.arange(len(x))
    nodes: list[list] = []

    def node(start, stop, center):
        d = np.sqrt(((x[order[start:stop]] - x[center]) ** 2).sum(1))
        nodes.append([center, float(d.max(initial=0.0)), start, stop, 0, 0])
        return d

    def far(rows, center):
        return np.sqrt(((x[rows] - x[center]) ** 2).sum(1))

    queue = [0]
    if len(x):
        node(0, len(x), 0)
    while queue and nodes:
        i = queue.pop()
        center, radius, start, stop, _, _ = nodes[i]
        if stop - start <= leaf or radius == 0.0 or nodes[i][5] < 0:
            continue
        rest, own, groups, loose = order[start:stop].copy(), center, [], []
        while len(rest):
            near = far(rest, own) <= radius / 2
            near[rest == own] = True
            mine = rest[near]
            (groups if len(mine) >= pool else loose).append((own, mine))
            rest = rest[~near]
            own = rest[0] if len(rest) else own
        if not groups:
            continue
        parts = groups + ([(center, np.concatenate([m for _, m in loose]))] if loose else [])
        nodes[i][4], nodes[i][5], at = len(nodes), len(parts), start
        for k, (own, mine) in enumerate(parts):
            order[at : at + len(mine)] = mine
            node(at, at + len(mine), own)
            if k < len(groups):
                queue.append(len(nodes) - 1)
            at += len(mine)
    c = list(zip(*nodes, strict=True)) if nodes else [[]] * 6
    return Tree(order, np.array(c[0], np.int64), np.array(c[1], float), *[np.array(v, np.int64) for v in c[2:]])


def exact_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and c, in whole numbers of any size."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if most < DOUBLE:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    if most >= LONG:
        x, c = x.astype(object), c.astype(object)
    return ((x[:, None, :] - c[None]) ** 2).sum(2)


def assign(x: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> tuple[np.ndarray, int]:
    """(number of the nearest centroid of each row, ties to the smaller; distances that were computed in leaves).

    x holds the rows in the tree's order.
    """
    label, met = np.empty(len(x), np.int64), 0
    if not len(x):
        return label, 0
    xf, cf = x.astype(float), centroids.astype(float)
    middle = {int(i): k for k, i in enumerate(tree.order)}
    stack = [(0, np.array([0]))]
    while stack:
        v, nodes = stack.pop()
        r, p = tree.radius[v], xf[middle[int(tree.center[v])]]
        while True:
            d = np.sqrt(((cf[over.center[nodes]] - p) ** 2).sum(1))
            best = d.min() + r  # some centroid is that near to every vector of the node
            slack = SLACK * (best + d.max(initial=0.0) + 1.0)
            nodes = nodes[d - over.radius[nodes] - r <= best + slack]
            open_ = (over.radius[nodes] > 0) | (over.stop[nodes] - over.start[nodes] > 1)
            wide = open_ & ((over.radius[nodes] >= r) | (tree.many[v] == 0))
            if not wide.any():
                break
            nodes = np.concatenate([nodes[~wide], *[_below(over, int(k)) for k in nodes[wide]]])
        start, stop = tree.start[v], tree.stop[v]
        if len(nodes) == 1 and not open_.any():
            label[start:stop] = over.order[over.start[nodes[0]]]
        elif tree.many[v]:
            stack += [(int(k), nodes) for k in range(tree.first[v], tree.first[v] + tree.many[v])]
        else:
            numbers = np.sort(np.concatenate([over.order[over.start[k] : over.stop[k]] for k in nodes]))
            met += (stop - start) * len(numbers)
            label[start:stop] = numbers[np.argmin(exact_distances(x[start:stop], centroids[numbers]), axis=1)]
    return label, met


def _below(over: Tree, k: int) -> np.ndarray:
    return np.arange(over.first[k], over.first[k] + over.many[k])


def centroid_tree(c: np.ndarray) -> Tree:
    """A cover tree of centroids whose leaves are single ones (equal centroids get a leaf each)."""
    t = cover_tree(c.astype(float), leaf=1, pool=1)
    parts = [[*row] for row in zip(t.center.tolist(), t.radius.tolist(), t.start.tolist(), t.stop.tolist(), t.first.tolist(), t.many.tolist(), strict=True)]
    for i in range(len(parts)):
        _, _, start, stop, _, many = parts[i]
        if not many and stop - start > 1:
            parts[i][4], parts[i][5] = len(parts), stop - start
            parts += [[int(t.order[j]), 0.0, j, j + 1, 0, 0] for j in range(start, stop)]
    cols = list(zip(*parts, strict=True))
    return Tree(t.order, np.array(cols[0], np.int64), np.array(cols[1], float), *[np.array(v, np.int64) for v in cols[2:]])


def quantised(vectors: DataFrame, dims: int, factor: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): floor(factor * component) of vectors of exactly `dims` finite components below LIMIT."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * factor) < float(LIMIT)))
    whole = F.transform(v, lambda e: F.floor(e.cast("double") * factor).cast("long"))
    return vectors.where(v.isNotNull() & (F.size(v) == dims)).where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), whole.alias("x"))


def plant(rows: DataFrame, dims: int) -> DataFrame:
    """Blocks of (id, x) with their trees: (ids, x, nodes), x in tree order as 64-bit integers."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.asarray(part.column("x").flatten(), np.int64).reshape(-1, dims)
                t = cover_tree(x.astype(float))
                nodes = np.column_stack([t.center, t.start, t.stop, t.first, t.many]).astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("id").take(pa.array(t.order)).to_pylist()], pa.list_(part.schema.field("id").type)), pa.array([x[t.order].astype("<i8").tobytes()]), pa.array([t.order.astype("<i8").tobytes()]), pa.array([nodes.tobytes()]), pa.array([t.radius.tobytes()])],
                    ["ids", "x", "order", "nodes", "radius"],
                )

    return kept(rows.mapInArrow(run, f"ids array<{kind}>, x binary, order binary, nodes binary, radius binary"))


def _labelled(batches, dims: int, centroids: np.ndarray):
    """(ids as Arrow list values, x, labels, distances met) of each block."""
    over = centroid_tree(centroids)
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)  # noqa: B023, E731
            x, n = get("x", "<i8").reshape(-1, dims), get("nodes", "<i8").reshape(-1, 5)
            tree = Tree(get("order", "<i8"), n[:, 0], get("radius", float), n[:, 1], n[:, 2], n[:, 3], n[:, 4])
            yield batch.column("ids")[k].values, x, *assign(x, tree, centroids, over)


def lloyd_round(blocks: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """(new centroids, leaf distances computed): exact floors of means; an empty cluster's centroid stays."""
    k, dims = centroids.shape

    def run(batches):
        total, many, met = np.zeros((k, dims), object), np.zeros(k, np.int64), 0
        for _, x, label, m in _labelled(batches, dims, centroids):
            sums = np.zeros((k, dims), np.int64)
            np.add.at(sums, label, x)
            total, many, met = total + sums, many + np.bincount(label, minlength=k), met + m
        whole = pa.decimal128(38, 0)
        for c in np.flatnonzero(many):
            yield pa.RecordBatch.from_arrays([pa.array([int(c)] * dims), pa.array(range(dims)), pa.array([decimal.Decimal(int(v)) for v in total[c]], whole), pa.array([int(many[c])] * dims), pa.array([int(met)] + [0] * (dims - 1))], ["cluster", "i", "total", "n", "met"])
            met = 0

    sums = blocks.mapInArrow(run, "cluster bigint, i bigint, total decimal(38,0), n bigint, met bigint")
    out, met = centroids.copy(), 0
    for r in sums.groupBy("cluster", "i").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"), F.sum("met").alias("met")).collect():
        out[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
        met += r["met"]
    return out, met


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The k rows of least hex sha256 of `1:<id>`, in that order (a null id last; ties by components)."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    found = rows.select("x", h.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in found], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, factor: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of vectors after `rounds` rounds.

    Vectors that are null, of another length, or hold null or non-finite components (or ones of LIMIT and
    more after scaling) take no part. Repeated ids are vectors of their own, a null id stays null, fewer than
    k vectors make as many centroids, equal centroids leave all to the smaller number, no vectors give no rows,
    and other columns are not read. k rows of `dims` integers pass through the driver in each round. A sum of
    distances beyond a long is null.
    """
    rows = quantised(vectors, dims, factor, id_col, vec_col)
    kind = rows.schema["id"].dataType.simpleString()
    centroids = first_centroids(rows, k)
    if not len(centroids):
        empty = f"{id_col} {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return rows.sparkSession.createDataFrame([], empty)
    blocks = plant(rows, dims)
    for _ in range(rounds):
        centroids, _ = lloyd_round(blocks, centroids)

    def run(batches):
        for ids, x, label, _ in _labelled(batches, dims, centroids):
            far = np.empty(len(x), object)
            for c in np.unique(label):
                mine = label == c
                far[mine] = exact_distances(x[mine], centroids[c : c + 1])[:, 0]
            yield pa.RecordBatch.from_arrays([ids, pa.array(label.astype(np.int32)), pa.array([int(d) if d < 1 << 63 else None for d in far], pa.int64())], ["id", "cluster", "distance"])

    told = kept(blocks.mapInArrow(run, f"id {kind}, cluster int, distance bigint"))
    drop_kept(blocks)
    sums = told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    total = sums.agg(F.sum("s").alias("t"))
    long = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    hashes = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    names = rows.sparkSession.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    each = sums.crossJoin(F.broadcast(total)).select("cluster", long("s").alias("cluster_inertia"), long("t").alias("inertia")).join(F.broadcast(names), "cluster")
    return told.join(F.broadcast(each), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
