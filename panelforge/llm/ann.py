"""Nearest neighbours through balanced posting lists, at a wanted recall or exactly.

Centroids, a bounded number, come from a size-penalised k-means over a bounded sample. Every vector is indexed: it goes to
its nearest centroid's list and, near a boundary, to further ones. Centroids are found by beam search
on an in-memory neighbour graph, and a query probes the lists whose centroids are not much farther than
its nearest. Long lists are split, so that no task gets more of one than its share; scores are exact
cosines in double precision on the original vectors.

With a wanted recall the lists alone answer: how much farther a centroid may be is measured on the sample. A
query that meets fewer than k others in its lists is the exact scan's. Without one the k-th score that a few lists
give a query is a floor: the scan meets blocks of queries with every vector and passes on what reaches the floor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_kept, kept
from .common import least_hashed

#: Bytes of query vectors that the scan broadcasts at once, rows that it multiplies at once, and pairs that it scores at once.
SCAN_BYTES, SCAN_ROWS, SCAN_PAIRS = 32 << 20, 2_048, 1 << 16
#: Vectors, and queries, of a list that meet in one task; pairs of query and list that leave a worker at once.
BLOCK, COPIES = 2_048, 16_384
#: Distances that differ by less are equal (single precision).
SLACK = 1e-6


@dataclass
class Centroids:
    """Unit centroids and, for each, its neighbours in the graph."""

    points: np.ndarray
    graph: np.ndarray
    entry: np.ndarray

    def nearest(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for unit vectors: centroid numbers and squared distances of the `width` nearest found."""
        width = min(width, len(self.points))
        at, far = np.zeros((len(x), width), np.int64), np.zeros((len(x), width))
        for a in range(0, len(x), 512):
            at[a : a + 512], far[a : a + 512] = self._search(x[a : a + 512], width)
        return at, far

    def within(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of all centroids at most `ratio` times as far as the row's nearest; the beam widens while its last is still as near."""
        k, width = len(self.points), 32
        rows, found = np.arange(len(x)), ([], [])
        while len(rows):
            if width * 4 >= k:  # a beam as wide as that meets nearly all
                far = np.maximum(2 - 2 * x[rows] @ self.points.T, 0)
                at, limit = np.broadcast_to(np.arange(k), far.shape), far.min(1, keepdims=True)
            else:
                at, far = self.nearest(x[rows], width)
                limit = far[:, :1]
            near = np.isfinite(far) & (np.sqrt(far) <= ratio * np.maximum(np.sqrt(limit), SLACK) + SLACK)
            done = np.ones(len(rows), bool) if width * 4 >= k else ~near[:, -1]
            i, j = np.nonzero(near & done[:, None])
            found[0].append(rows[i])
            found[1].append(at[i, j])
            rows, width = rows[~done], width * 4
        return tuple(np.concatenate([np.zeros(0, np.int64), *f]) for f in found)

    def _search(self, x: np.ndarray, width: int):
        """A beam of the nearest found; each hop opens four of it and meets their neighbours once."""
        n, k = len(x), len(self.points)
        beam = min(k, max(width, 16) + 16)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, k), bool)

        def measured(c: np.ndarray) -> np.ndarray:
            """Distances, infinite where a centroid was met before or stands twice in a row of c (sorted)."""
            far = np.maximum(2 - 2 * np.einsum("nd,ncd->nc", x, self.points[c]), 0).astype(np.float32)
            again = seen[rows, c]
            again[:, 1:] |= c[:, 1:] == c[:, :-1]
            seen[rows, c] = True
            return np.where(again, np.inf, far)

        at = np.repeat(np.sort(self.entry)[None], n, 0)
        far = measured(at)
        done = np.zeros(at.shape, bool)
        while True:
            score = np.where(done, np.inf, far)
            take = np.argsort(score, 1, kind="stable")[:, :4]
            usable = np.isfinite(np.take_along_axis(score, take, 1))
            if not usable.any():
                break
            np.put_along_axis(done, take, np.take_along_axis(done, take, 1) | usable, 1)
            near = np.sort(self.graph[np.take_along_axis(at, take, 1)].reshape(n, -1), 1)
            at, far, done = np.concatenate((at, near), 1), np.concatenate((far, measured(near)), 1), np.concatenate((done, np.zeros(near.shape, bool)), 1)
            if at.shape[1] > beam:
                best = np.argpartition(far, beam - 1, 1)[:, :beam]
                at, far, done = (np.take_along_axis(m, best, 1) for m in (at, far, done))
        order = np.argsort(far, 1, kind="stable")[:, :width]
        return np.take_along_axis(at, order, 1), np.take_along_axis(far, order, 1)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 10, degree: int = 16, penalty: float = 0.3, seed: int = 3) -> Centroids:
    """Size-penalised k-means on unit vectors, then the graph of the `degree` nearest centroids and random far ones."""
    rng = np.random.default_rng(seed)
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    x = np.unique(x.astype(np.float32), axis=0)
    k = max(1, min(k, len(x)))
    points = x[rng.permutation(len(x))[:k]]
    load = np.zeros(k)
    for _ in range(rounds):
        own = np.concatenate([(2 - 2 * b @ points.T + penalty * load / max(len(x) / k, 1) * 0.1).argmin(1) for b in np.array_split(x, max(1, len(x) // 2048))])
        load = np.bincount(own, minlength=k).astype(np.float64)
        total = np.zeros_like(points)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        lost = (norm[:, 0] < 1e-9) | (load == 0)
        points = np.where(lost[:, None], x[rng.permutation(len(x))[:k]], total / np.maximum(norm, 1e-9)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    near = [np.argsort(-(part @ points.T), 1, kind="stable")[:, 1 : degree + 1] for part in np.array_split(points, max(1, k // 512))]
    close = np.concatenate(near) if k > 1 else np.zeros((1, 1), np.int64)
    graph = np.concatenate((close, rng.integers(0, k, (k, 4))), 1)
    return Centroids(points, graph, rng.permutation(k)[: min(k, 32)])


def usable(vectors: DataFrame, id_col: str, vector_col: str, size: int | None = None) -> DataFrame:
    """(vec_id, v) of rows with an id and a finite, non-zero vector (of `size` components)."""
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    if size is not None:
        fine = fine & (F.size(v) == size)
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(column), -1)


def _listed(rows: DataFrame, shared, width: int, ratio: float) -> DataFrame:
    """(list, place, vec_id, v) for each list whose centroid's distance is within `ratio` of the nearest, `width` at most, the nearest in place 0."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"))
            at, far = shared.value.nearest((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32), width)
            i, j = np.nonzero(np.isfinite(far) & (np.sqrt(far) <= ratio * np.sqrt(far[:, :1]) + 1e-6))
            part = b.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([pa.array(at[i, j].astype(np.int32)), pa.array(j.astype(np.int32)), part.column("vec_id"), part.column("v")], ["list", "place", "vec_id", "v"])

    return rows.mapInArrow(run, "list int, place int, vec_id bigint, v array<double>")


def measured_ratio(index: Centroids, sample: np.ndarray, k: int, recall: float, replicas: int, boundary: float, queries: int = 500) -> float:
    """The distance ratio at which lists hold `recall` of the k nearest within the sample, over its first `queries` rows.

    Neighbours in a sample are farther apart than in the whole table, so the ratio errs to the wide side.
    """
    unit = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    n = min(queries, len(unit))
    if len(unit) <= k:
        return np.inf
    score = unit[:n] @ unit.T
    score[np.arange(n), np.arange(n)] = -np.inf
    near = np.argpartition(-score, k - 1, 1)[:, :k]
    far = np.sqrt(np.maximum(2 - 2 * unit[:n] @ index.points.T, 0))
    at, to = index.nearest(unit[near.ravel()], replicas)
    held = np.isfinite(to) & (np.sqrt(to) <= boundary * np.sqrt(to[:, :1]) + SLACK)
    asks = np.repeat(np.arange(n), k)
    read = np.where(held, far[asks[:, None], at], np.inf).min(1)
    return float(np.quantile((read - SLACK) / np.maximum(far.min(1)[asks], SLACK), recall, method="higher"))


def _copies(rows: DataFrame, shared, ratio: float) -> DataFrame:
    """(list, vec_id, v) for each list within `ratio` of a vector's nearest, however many."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for a in range(0, b.num_rows, 512):
                piece = b.slice(a, 512)
                v = _matrix(piece.column("v"))
                i, c = shared.value.within((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32), ratio)
                for s in range(0, len(i), COPIES):
                    part = piece.take(pa.array(i[s : s + COPIES]))
                    yield pa.RecordBatch.from_arrays([pa.array(c[s : s + COPIES].astype(np.int32)), part.column("vec_id"), part.column("v")], ["list", "vec_id", "v"])

    return rows.mapInArrow(run, "list int, vec_id bigint, v array<double>")


def _through_lists(rows: DataFrame, is_query, shared, ratio: float, k: int, size: int, replicas: int, boundary: float) -> DataFrame:
    """(query_id, rank, vec_id, score) of what the lists within `ratio` hold; queries that find fewer than k there are scanned for.

    Both sides of a list are cut into blocks of BLOCK rows, and every block of queries meets every block of vectors.
    """
    spark = rows.sparkSession
    lists = kept(_listed(rows, shared, replicas, boundary).select("list", "vec_id", "v"))
    queries = _copies(rows.where(is_query), shared, ratio)
    of = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(name))
    blocks = of(lists, "parts").join(of(queries, "turns"), "list").collect()  # one row for each list, max_lists at most
    blocks = F.broadcast(spark.createDataFrame(blocks, "list int, parts int, turns int"))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    posted = lists.join(blocks, "list").select("list", dealt("parts").alias("part"), each("turns").alias("turn"), "vec_id", "v")
    queries = queries.join(blocks, "list").select("list", each("parts").alias("part"), dealt("turns").alias("turn"), "vec_id", "v")
    keys = ("list", "part", "turn")
    found = kept(_ranked(queries.groupBy(*keys).cogroup(posted.groupBy(*keys)).applyInArrow(_scores(k), "query_id bigint, vec_id bigint, score double"), k))
    drop_kept(lists)
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = kept(rows.where(is_query).join(full, "vec_id", "left_anti").select("vec_id", "v", F.lit(float("-inf")).alias("floor"), F.lit(0).cast("long").alias("last")))
    if short.isEmpty():
        drop_kept(short)
        return found.select("query_id", "rank", "vec_id", "score")
    return _ranked(found.select("query_id", "vec_id", "score").unionByName(_scan(rows, short, k, size)), k)


def _scores(k: int):
    """The function of a cogroup of queries and vectors: (query_id, vec_id, score) of each query's k best there."""

    def score(left, right):
        import pyarrow as pa

        out = ([], [], [])
        if left.num_rows and right.num_rows:
            q, p = _matrix(left.column("v")), _matrix(right.column("v"))
            q_id, p_id = (np.asarray(t.column("vec_id").combine_chunks()) for t in (left, right))
            q_norm, p_norm = (np.sqrt((m * m).sum(1)) for m in (q, p))
            rough = (q / q_norm[:, None]) @ (p / p_norm[:, None]).T
            rough[q_id[:, None] == p_id[None, :]] = -np.inf
            keep = min(len(p), k * int(np.unique(p_id, return_counts=True)[1].max())) - 1  # rows that hold k ids
            for i in range(len(q)):
                floor = -np.partition(-rough[i], keep)[keep]
                j = np.flatnonzero((rough[i] >= floor - 1e-9) & np.isfinite(rough[i]))
                exact = (q[i] * p[j]).sum(1) / (q_norm[i] * p_norm[j])  # summed row by row: equal vectors score equally
                best = _best(np.zeros(len(j), np.int64), p_id[j], exact, k) if len(j) else j
                out[0].extend([q_id[i]] * len(best))
                out[1].extend(p_id[j][best].tolist())
                out[2].extend(exact[best].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return score


def _best(i: np.ndarray, ids: np.ndarray, exact: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each i, by score and then smaller id, each id once; in order of i and rank."""
    order = np.lexsort((-exact, ids, i))
    order = order[np.concatenate(([True], (np.diff(i[order]) != 0) | (np.diff(ids[order]) != 0)))]
    order = order[np.lexsort((ids[order], -exact[order], i[order]))]
    first = np.searchsorted(i[order], i[order])
    return order[np.arange(len(order)) - first < k]


def _scan(rows: DataFrame, asked: DataFrame, k: int, size: int) -> DataFrame:
    """(query_id, vec_id, score) of all vectors that reach a query's floor, the k best of a slice at most.

    asked: (vec_id, v, floor, last), the k-th score known for the query and its id; -inf: fewer than k known.
    """
    spark, schema = rows.sparkSession, "query_id bigint, vec_id bigint, score double"
    blocks = -(-asked.count() * size * 8 // SCAN_BYTES)
    margin = 4e-7 * (size + 8)  # more than single precision can be off

    def block(b: int) -> DataFrame:
        part = asked.where(F.pmod(F.xxhash64(F.lit(21), "vec_id", "v"), F.lit(blocks)) == b).toArrow()
        if not part.num_rows:
            return spark.createDataFrame([], schema)
        numbers = [part.column(c).to_numpy() for c in ("vec_id", "floor", "last")]
        shared = spark.sparkContext.broadcast((_matrix(part.column("v")), *numbers))

        def run(batches):
            import pyarrow as pa

            q, q_id, *known = shared.value
            floor, last = (x.copy() for x in known)  # they rise with what this task finds
            q_norm = np.sqrt((q * q).sum(1))
            q_unit = (q / q_norm[:, None]).astype(np.float32)
            for batch in batches:
                for a in range(0, batch.num_rows, SCAN_ROWS):
                    piece = batch.slice(a, SCAN_ROWS)
                    p, p_id = _matrix(piece.column("v")), piece.column("vec_id").to_numpy()
                    p_norm = np.sqrt((p * p).sum(1))
                    p_unit = np.ascontiguousarray((p / p_norm[:, None]).astype(np.float32).T)
                    least = k * np.unique(p_id, return_counts=True)[1].max()  # rows that hold k ids, if any do
                    for c in range(0, len(q), SCAN_ROWS):
                        here = slice(c, c + SCAN_ROWS)
                        rough = q_unit[here] @ p_unit
                        cut = (floor[here] - margin).astype(np.float32)
                        free = np.flatnonzero(np.isinf(cut))
                        if len(free) and least < len(p_id):
                            other = np.where(q_id[here][free, None] == p_id, -np.inf, rough[free])
                            cut[free] = -np.partition(-other, least - 1, 1)[:, least - 1] - 2 * margin
                        i, j = np.nonzero(rough >= cut[:, None])
                        i += c
                        i, j = (x[q_id[i] != p_id[j]] for x in (i, j))
                        if not len(i):
                            continue
                        exact = np.concatenate([(q[i[s : s + SCAN_PAIRS]] * p[j[s : s + SCAN_PAIRS]]).sum(1) for s in range(0, len(i), SCAN_PAIRS)]) / (q_norm[i] * p_norm[j])
                        fine = np.flatnonzero((exact > floor[i]) | (exact >= floor[i] - 1e-14) & (p_id[j] <= last[i]))
                        if not len(fine):
                            continue
                        best = fine[_best(i[fine], p_id[j[fine]], exact[fine], k)]
                        i, ids, exact = i[best], p_id[j[best]], exact[best]
                        yield pa.RecordBatch.from_arrays([pa.array(q_id[i]), pa.array(ids), pa.array(exact)], ["query_id", "vec_id", "score"])
                        full = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == k - 1)
                        full = full[(exact[full] > floor[i[full]]) | (exact[full] == floor[i[full]]) & (ids[full] < last[i[full]])]
                        floor[i[full]], last[i[full]] = exact[full], ids[full]

        return rows.mapInArrow(run, schema)

    found = [block(b) for b in range(blocks)]
    out = found[0] if found else spark.createDataFrame([], schema)
    for more in found[1:]:
        out = out.unionByName(more)
    drop_kept(asked)
    return out


def search(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 20_000,
    per_list: int = 128,
    max_lists: int = 2_048,
    replicas: int = 4,
    boundary: float = 1.1,
    probes: int = 48,
    prune: float = 1.3,
    part: int = 256,
    parts_read: int = 64,
    recall: float | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors, by cosine, ties to the smaller id.

    `is_query` is a condition on the id column; the candidates are all rows with other ids than the
    query's. Rows without id, and vectors that are null, zero, not finite, hold nulls or differ in
    length from the commonest length, take no part; ids that repeat give one result, their best.
    `sample_rows` (those of least hash) bound what fits the centroids, `max_lists` their number; all
    rows are indexed, to at most `replicas` lists.

    With `recall` a query reads whole lists only, as many as the distance ratio asks for at which lists hold that share
    of the neighbours in the sample; one that finds fewer than k there meets all rows. Neither the queries nor
    the rows pass through the driver, but for such queries, in blocks.

    Without `recall` the result is exact: a query reads at most `probes` lists, which gives its floor; then it meets
    all rows. Lists grow with the table and are cut into parts of about `part`
    vectors; a query reads at most `parts_read` of its nearest list, half as many of the next, and so on,
    and what it does not read there the scan shows it. Fewer than k candidates: all. No usable vector:
    no rows. The driver holds the sample, and distances of 512 centroids to all at once.
    """
    spark = vectors.sparkSession
    lengths = usable(vectors, id_col, vector_col).groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    size, n = lengths[0]
    rows = usable(vectors, id_col, vector_col, size)
    sample = least_hashed(rows, F.xxhash64(F.lit(9), "vec_id"), sample_rows, n, ("vec_id",)).toArrow()
    index = fit_centroids(_matrix(sample.column("v")), min(max_lists, max(1, n // per_list)))
    shared = spark.sparkContext.broadcast(index)
    if recall is not None:
        return _through_lists(rows, is_query, shared, measured_ratio(index, _matrix(sample.column("v")), k, recall, replicas, boundary), k, size, replicas, boundary)
    posted = _listed(rows, shared, replicas, boundary)
    queries = _listed(rows.where(is_query), shared, probes, prune)
    counts = posted.groupBy("list").agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("parts"))
    counts = F.broadcast(counts)  # one row for each list, max_lists at most
    posted = posted.join(counts, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v")
    read = F.least(F.col("parts"), F.greatest(F.lit(1), F.floor(F.lit(float(parts_read)) / F.pow(F.lit(2.0), F.col("place"))).cast("int")))
    queries = queries.join(counts, "list").select("list", F.explode(F.sequence(F.lit(0), read - 1)).alias("part"), "vec_id", "v")

    found = queries.groupBy("list", "part").cogroup(posted.groupBy("list", "part")).applyInArrow(_scores(k), "query_id bigint, vec_id bigint, score double")
    floors = _ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"), F.col("vec_id").alias("last"))
    asked = rows.where(is_query).join(floors, "vec_id", "left")
    asked = kept(asked.select("vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), F.coalesce("last", F.lit(0)).cast("long").alias("last")))
    return _ranked(_scan(rows, asked, k, size), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best of the pairs found, a pair once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
