"""N-gram Jaccard self-join by token-combination prefixes.

A document's tokens are its distinct word shingles (64-bit hashes). All tokens have one global order:
unlisted (rare) ones by hash, then the listed frequent ones by count. Of n tokens, a partner at the
threshold lacks at most t = n - ceil(threshold * n). The prefix of a document is extended in that order
until losing t tokens cannot destroy all its signatures: each rare token is a signature; frequent
tokens are dealt into subsets, and each pair of one subset is a signature (p tokens of a subset survive
p - 2 losses). Two linked documents always share a signature, whatever the list of frequent tokens
holds, so that list is a bounded summary and steers cost only.

The few documents of a small bucket are paired (NEAR partners each at most) and a pair goes unless sizes
and parity bitmaps, whose differing bits are a lower bound of differing tokens, allow the threshold; in a
larger bucket each document is tied to the first only. Components of these ties are groups of
look-alikes. Inside a group every pair is verified exactly, in blocks, and only a spanning forest of the
true links comes out, so a large group costs no pair rows. Equal token sets are one vertex throughout.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_kept, kept
from .common import map_texts, worker_state
from .components import components

_SALTS = (np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: Frequent tokens that are listed at most; the least count of one; tokens that one slice of a task reports at most.
LISTED, LEAST, REPORTED = 1 << 20, 8, 32_768
#: Bits in which a task notes the tokens of its earlier slices; tokens below this are noted (prefixes end before).
NOTED_BITS, NOTED_BELOW = 1 << 27, np.uint64(1 << 63)
#: Documents of a bucket that are paired rather than tied to the first, less one; sets that are fetched by a broadcast at most.
NEAR, FETCHED = 63, 500_000
#: Sets of one signature that a slice sends on at most; sets and bytes of tokens in a block of a large group's second pass.
GATHERED, WIDE, WIDE_BYTES = 32, 256, 8 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def tokens(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes: ASCII-lower-cased words, windows of `width`; fewer words: all as one."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(worker_state("ngram_join").setdefault("words", _WordHashes()).__getitem__, words), np.uint64, n)
    if n < width:
        return _mix(np.array([(hashes * _SALTS[32 : 32 + n]).sum() + np.uint64(n)], np.uint64))
    out = hashes[: n - width + 1] * _SALTS[0]
    for k in range(1, width):
        out = out + hashes[k : n - width + 1 + k] * _SALTS[k]
    return np.unique(_mix(out))


def fingerprint(toks: np.ndarray, which: int = 0) -> int:
    """A hash of the token set (as a signed 64-bit integer); `which` names one of two independent ones."""
    with np.errstate(over="ignore"):
        h = _mix(np.array([(_mix(toks ^ _SALTS[40 + 2 * which]) * _SALTS[41 + 2 * which]).sum() + np.uint64(len(toks))], np.uint64))
    return int(h.view(np.int64)[0])


def vertex(toks: np.ndarray, shared: frozenset[int]) -> int:
    """The key of a token set: its first fingerprint, or the second where different sets share the first."""
    first = fingerprint(toks)
    return fingerprint(toks, 1) if first in shared else first


def parity(toks: np.ndarray) -> bytes:
    """Parity of the tokens in each of at least 2n places (a power of two, 256 at least)."""
    places = max(256, 1 << (2 * len(toks)).bit_length())
    return np.packbits(np.bincount((toks & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_link(a: bytes, b: bytes, n: int, percent: int) -> bool:
    """False only if sets with these parities and n tokens in all are surely below the threshold."""
    if len(a) < len(b):
        a, b = b, a
    x, bits = int.from_bytes(a, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (100 + percent) * (x ^ int.from_bytes(b, "little")).bit_count() <= (100 - percent) * n


def _size_class(n: int) -> int:
    return max(n, 1).bit_length()


def signatures(toks: np.ndarray, listed: np.ndarray, order: np.ndarray, percent: int = 80) -> np.ndarray:
    """Signatures of a token set. listed: sorted frequent tokens; order: their place in the global order."""
    n = len(toks)
    need = n - -(-percent * n // 100) + 1  # signatures must survive the loss of one token less
    at = np.minimum(np.searchsorted(listed, toks), max(len(listed) - 1, 0))
    frequent = listed[at] == toks if len(listed) else np.zeros(n, bool)
    rare = toks[~frequent]
    if len(rare) >= need:
        return rare[:need]
    need -= len(rare)
    ranked = toks[frequent][np.argsort(order[at[frequent]], kind="stable")]
    out = [rare]
    for size in sorted({_size_class(n), _size_class(percent * n // 100), _size_class(-(-100 * n // percent))}):
        subsets = max(1, (1 << size) // 32)
        subset = (_mix(ranked ^ _SALTS[50]) % np.uint64(subsets)).astype(np.int64)
        # the token of rank r brings one more survivor unless it is the first of its subset
        first = np.zeros(len(ranked), bool)
        first[np.unique(subset, return_index=True)[1]] = True
        enough = np.flatnonzero(np.cumsum(~first) >= need)
        end = int(enough[0]) + 1 if len(enough) else len(ranked)
        by = np.argsort(subset[:end], kind="stable")
        groups = np.split(ranked[:end][by], np.flatnonzero(np.diff(subset[:end][by])) + 1)
        for g in groups:
            if len(g) > 1:
                i, j = np.array(list(combinations(range(len(g)), 2))).T if len(g) < 40 else np.triu_indices(len(g), 1)
                out.append(_mix(g[i] * _SALTS[51] + g[j] * _SALTS[52] + np.uint64(size)))
    return np.unique(np.concatenate(out))


class _Noted:
    """Which low tokens a task met in its earlier slices: two bits for each, so now and then one is wrongly told."""

    def __init__(self):
        self.bits = np.zeros(NOTED_BITS // 8, np.uint8)

    def met(self, toks: np.ndarray) -> np.ndarray:
        """Whether each token was noted before; those below NOTED_BELOW are noted now."""
        low = toks < NOTED_BELOW
        out = np.zeros(len(toks), bool)
        places = [(h % np.uint64(NOTED_BITS)).astype(np.int64) for h in (toks[low], _mix(toks[low]))]
        out[low] = np.logical_and.reduce([self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 for at in places])
        for at in places:
            np.bitwise_or.at(self.bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return out


def _census(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each document (kind 0: id, n tokens, key and check fingerprints, hash of the text) and for tokens that a slice or, below NOTED_BELOW, a task repeats (kind 1: n times, key).

    A token that many texts of a large table share stands once in most slices, so slices alone would not tell of it.
    """

    def make():
        noted = _Noted()

        def run(ids, texts, hashes):
            sets = [tokens(t, width) for t in texts]
            n, key, check = [len(s) for s in sets], [fingerprint(s) for s in sets], [fingerprint(s, 1) for s in sets]
            once = {k: s for k, s in zip(key, sets, strict=True) if len(s)}
            found, times = np.unique(np.concatenate(list(once.values())), return_counts=True) if once else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            again = noted.met(found) | (times > 1)
            found, times = found[again], times[again]
            if len(found) > REPORTED:
                top = np.argsort(-times, kind="stable")[:REPORTED]
                found, times = found[top], times[top]
            none = [None] * len(found)
            return {"kind": [0] * len(ids) + [1] * len(found), "id": ids + none, "n": n + times.tolist(), "key": key + found.view(np.int64).tolist(), "check": check + none, "hash": hashes + none, "parity": [parity(x) for x in sets] + none}

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    hashed = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    return map_texts(hashed, make, f"kind int, id {kind}, n bigint, key bigint, check bigint, hash bigint, parity binary", "doc", "text", binary=True, extra=("hash",), owner="ngram_join")


def _vertices(census: DataFrame) -> DataFrame:
    """One row for each key: its first document, rows, tokens and parity, and whether it is one set alone."""
    alone = (F.min("check") == F.max("check")).alias("alone")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("first")
    one = census.where("kind = 0").groupBy("key").agg(first, F.count("*").alias("copies"), F.max("n").alias("n"), F.min("parity").alias("parity"), alone)
    return one.select("key", "first", "first.id", "first.hash", "copies", "n", "parity", "alone")


def _listed(census: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most LISTED frequent tokens, sorted, and their places by count: a bounded summary."""
    top = census.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "key").limit(LISTED).select("key").toArrow()
    keys = top.column("key").to_numpy().view(np.uint64)
    by = np.argsort(keys)
    return keys[by], (len(keys) - 1 - np.arange(len(keys)))[by]


def gathered(sig: np.ndarray, key: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Signature rows of one slice, where a signature of more than `most` sets keeps its least key's row only.

    Returned are the numbers of the rows that stay, those that speak for others last, how many these are,
    and the (key, hub) ties of what they speak for.
    """
    _, place, times = np.unique(sig, return_inverse=True, return_counts=True)
    hot = times[place] > most
    if not hot.any():
        return np.arange(len(sig)), 0, key[:0], key[:0]
    order = np.lexsort((key[hot], place[hot]))
    rows = np.flatnonzero(hot)[order]
    first = np.concatenate(([True], np.diff(place[rows]) != 0))
    hub = key[rows][np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
    stay = np.concatenate((np.flatnonzero(~hot), rows[first]))
    ties = np.unique(np.stack((key[rows], hub), 1)[key[rows] != hub], axis=0)
    return stay, int(first.sum()), ties[:, 0], ties[:, 1]


def _signed(docs: DataFrame, listed, twins: frozenset[int], width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(sig, key, n, hub) for each distinct token set of each task.

    A signature of more than GATHERED sets in a slice of texts sends one row, whose hub is its own key; the
    other sets are tied to that key by rows with that hub and a sig of their own. Elsewhere hub is null.
    """
    shared = docs.sparkSession.sparkContext.broadcast((listed, twins))

    def make():
        import pyarrow as pa

        listed, twins = shared.value

        seen: set[int] = set()

        def run(ids, texts):
            sig, key, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for t in texts:
                s = tokens(t, width)
                k = vertex(s, twins)
                if len(s) and k not in seen:
                    seen.add(k)
                    found = signatures(s, *listed, percent)
                    sig.append(found)
                    key.append(np.full(len(found), k, np.int64))
                    n.append(np.full(len(found), len(s), np.int32))
            sig, key, n = np.concatenate(sig), np.concatenate(key), np.concatenate(n)
            stay, crowds, tied, hub = gathered(sig, key, n, GATHERED)
            sig, key, n = sig[stay], key[stay], n[stay]
            own = _mix(np.ascontiguousarray(tied).view(np.uint64) ^ _SALTS[55])
            none = np.arange(len(sig) + len(tied)) < len(sig) - crowds
            return {"sig": np.concatenate((sig, own)).view(np.int64), "key": np.concatenate((key, tied)), "n": np.concatenate((n, np.zeros(len(tied), np.int32))), "hub": pa.array(np.concatenate((key, hub)), pa.int64(), mask=none)}

        return run

    return map_texts(docs, make, "sig bigint, key bigint, n int, hub bigint", id_col, text_col, binary=True, owner="ngram_join")


def _ties(sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) ties whose components hold every link: filtered pairs of small buckets, stars of large ones."""
    whole, ordered = Window.partitionBy("sig"), Window.partitionBy("sig").orderBy("n", "key", F.asc_nulls_last("hub"))
    crowd, tied = F.col("hub") == F.col("key"), F.col("hub") != F.col("key")
    shared = sigs.withColumn("rows", F.count("*").over(whole)).where(F.col("hub").isNotNull() | (F.col("rows") > 1))  # most signatures end here
    once = shared.withColumn("last", F.lag("key").over(ordered)).where("last is null or last != key")
    free = ~F.coalesce(tied, F.lit(False))
    members, least = F.count(F.when(free, 1)).over(whole), F.min(F.when(free, F.col("key"))).over(whole)
    bucket = once.select("sig", "key", "n", "hub", members.alias("members"), least.alias("least"), F.max(F.coalesce(crowd, F.lit(False))).over(whole).alias("crowd"))
    small = free & (F.col("members") <= NEAR + 1) & ~F.col("crowd")  # a row that speaks for others cannot be ruled out by its own tokens
    ahead = F.collect_list(F.when(small, F.struct("key", "n"))).over(ordered.rowsBetween(1, NEAR))  # nothing in large buckets
    bucket = bucket.where("members > 1 or hub is not null").select("key", "n", small.alias("pair"), F.when(free, F.col("least")).otherwise(F.col("hub")).alias("hub"), ahead.alias("ahead"))
    fits = F.filter("ahead", lambda o: 100 * F.col("n") >= percent * o["n"])
    star = F.filter(F.array(F.struct(F.col("hub").alias("key"), F.lit(0).alias("n"))), lambda o: o["key"] != F.col("key"))
    ties = kept(bucket.select(F.col("key").alias("a"), "pair", F.explode(F.when(F.col("pair"), fits).otherwise(star)).alias("o")).select("pair", "a", F.col("o.key").alias("b")).distinct())
    sides = sets.select("key", "n", "parity")
    both = ties.where("pair").join(sides.select(F.col("key").alias("a"), F.col("n").alias("an"), F.col("parity").alias("ap")), "a")
    both = both.join(sides.select(F.col("key").alias("b"), F.col("n").alias("bn"), F.col("parity").alias("bp")), "b")

    def close(batches):
        import pyarrow as pa

        for t in batches:
            columns = [t.column(c).to_pylist() for c in ("ap", "bp", "an", "bn")]
            yield t.filter(pa.array([may_link(x, y, n + m, percent) for x, y, n, m in zip(*columns, strict=True)], pa.bool_())).select(["a", "b"])

    near = both.select("a", "b", "ap", "bp", "an", "bn").mapInArrow(close, "a bigint, b bigint")
    out = near.unionByName(ties.where("not pair").select("a", "b"))
    out._kept_path = ties._kept_path
    return out


def _token_rows(docs: DataFrame, wanted: DataFrame, twins: frozenset[int], width: int, id_col: str, text_col: str) -> DataFrame:
    """(key, toks, place) for the wanted sets, each from one document of that id and text hash."""
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    few = wanted.limit(FETCHED + 1).count() <= FETCHED  # small rows; beyond that both sides are shuffled
    wanted = F.broadcast(wanted) if few else wanted
    texts = texts.join(wanted, (F.col("text_hash") == F.col("hash")) & F.col("doc").eqNullSafe(F.col("id")))

    def make():
        def run(keys, texts, label, blocks, own):
            sets = [tokens(t, width) for t in texts]
            good = [i for i, s in enumerate(sets) if vertex(s, twins) == keys[i]]
            return {"key": [keys[i] for i in good], "label": [label[i] for i in good], "blocks": [blocks[i] for i in good], "own": [own[i] for i in good], "toks": [sets[i].tobytes() for i in good]}

        return run

    return map_texts(texts, make, "key bigint, label bigint, blocks int, own int, toks binary", "key", "text", binary=True, extra=("label", "blocks", "own"), owner="ngram_join")


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int = 80) -> np.ndarray:
    """(i, j) of each pair from left x right, i before j, with Jaccard at least percent / 100; by blocks of shared tokens."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    both = np.zeros((len(left), len(right)))
    step = 8192
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (c, c + step))
        block = np.zeros((len(sets), step), np.float32)
        block[row[a:b], column[a:b] - c] = 1
        both += block[left] @ block[right].T
    together = sizes[left][:, None] + sizes[right][None, :] - both
    i, j = np.nonzero((100 * both >= percent * together) & (left[:, None] < right[None, :]))
    return np.stack((left[i], right[j]), 1)


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The pairs that join what earlier ones have not joined."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def _verified(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the true links in each group (label, i, j) of rows with own block, key and toks."""

    def verify(table):
        import pyarrow as pa

        table = table.take(pa.array(np.unique(table.column("key").to_numpy(), return_index=True)[1]))  # repeated rows
        first = table.column("i")[0].as_py()
        same = first == table.column("j")[0].as_py()
        key = table.column("key").to_pylist()
        own = np.array(table.column("own").to_pylist())
        sets = [np.frombuffer(x, np.uint64) for x in table.column("toks").to_pylist()]
        order = np.argsort(own != first, kind="stable")  # the first block's rows come first
        sets, key, n = [sets[k] for k in order], [key[k] for k in order], int((own == first).sum())
        left, right = np.arange(n), np.arange(len(sets)) if same else np.arange(n, len(sets))
        links = _forest(linked_pairs(sets, left, right, percent), len(sets)) if len(right) else []
        return pa.table({"a": pa.array([key[a] for a, _ in links], pa.int64()), "b": pa.array([key[b] for _, b in links], pa.int64())})

    return rows.groupBy("label", "i", "j").applyInArrow(verify, "a bigint, b bigint")


def _rest(toks: DataFrame, found: DataFrame, block: int, percent: int) -> DataFrame:
    """Rows for the pairs of a large group that may still join two classes (found so far).

    Blocks hold sets of one size range, so that only blocks of equal or adjacent ranges can link. Classes
    of at least `block` sets fill blocks of their own, which need not meet each other; the sets of smaller
    classes share blocks. So a group whose sets mostly link with its first block costs its few others
    times its size; one of m look-alikes of like size that do not link sends m * m / WIDE rows.
    """
    t, f = toks.alias("t"), found.alias("f")
    span = F.floor(F.log(F.octet_length("toks") / 8.0) / F.lit(float(np.log(100.1 / percent)))).cast("int")
    toks = t.join(f, F.col("t.key") == F.col("f.id"), "left").select("t.label", "key", "toks", F.coalesce("f.label", "t.key").alias("class"), span.alias("span"))
    size = kept(toks.groupBy("label", "class").agg(F.count("*").alias("n")).where(F.col("n") >= block).select(F.col("label").alias("l"), F.col("class").alias("pure")))
    t, d = toks.alias("t"), size.alias("d")
    named = kept(t.join(d, (F.col("t.label") == F.col("d.l")) & (F.col("t.class") == F.col("d.pure")), "left").select("label", "key", "toks", "span", "pure"))
    deal = named.groupBy("label", "span", "pure").agg(F.ceil(F.greatest(F.count("*") / F.lit(WIDE), F.sum(F.octet_length("toks")) / F.lit(WIDE_BYTES))).cast("int").alias("parts"))
    deal = deal.select(F.col("label").alias("l"), F.col("span").alias("s"), F.col("pure").alias("p"), "parts")
    n, d = named.alias("n"), deal.alias("d")
    same = (F.col("n.label") == F.col("d.l")) & (F.col("n.span") == F.col("d.s")) & F.col("n.pure").eqNullSafe(F.col("d.p"))
    placed = kept(n.join(d, same).select("label", "key", "toks", "span", "pure", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part")))
    order = F.row_number().over(Window.partitionBy("label").orderBy("span", F.asc_nulls_first("pure"), "part"))
    names = kept(placed.select("label", "span", "pure", "part").distinct().withColumn("own", order))
    a, b = names.alias("a"), names.alias("b")
    meets = (F.col("a.own") <= F.col("b.own")) & (F.col("b.span") <= F.col("a.span") + 1) & F.coalesce(F.col("a.pure") != F.col("b.pure"), F.lit(True))
    pairs = a.join(b, F.col("a.label") == F.col("b.label")).where(meets).select("a.label", F.col("a.own").alias("i"), F.col("b.own").alias("j"))
    pairs = pairs.withColumn("own", F.explode(F.array_distinct(F.array("i", "j"))))
    p, o = placed.alias("p"), names.alias("o")
    mine = (F.col("p.label") == F.col("o.label")) & (F.col("p.span") == F.col("o.span")) & F.col("p.pure").eqNullSafe(F.col("o.pure")) & (F.col("p.part") == F.col("o.part"))
    numbered = p.join(o, mine).select("p.label", "own", "key", "toks")
    out = numbered.join(pairs, ["label", "own"]).select("label", "i", "j", "own", "key", "toks")
    out.kept_ = (size, named, placed, names)
    return out


def join_groups(docs: DataFrame, width: int = 5, percent: int = 80, block: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, copies, hash, first) for each row of docs.

    Documents link when their shingle sets' Jaccard similarity is at least percent / 100; component_id
    is the smallest id that links reach, the document's own included; copies: rows with the same set;
    hash: xxhash64 of the text; first: the row is the one of least id (null last) and then hash in its
    class, or equal to it.
    A text without words (or null) has no shingles and links with nothing; null ids keep their row and
    never become a component_id unless alone. Rows of equal id are separate documents that share a
    name. Other columns are not read. `block` bounds the documents, and WIDE_BYTES the bytes of token sets, that one task compares
    with as many others; larger groups are compared block by block. Token sets are told apart by two 64-bit
    fingerprints: where different sets share the first, the second is their key.
    """
    census = kept(_census(docs, width, id_col, text_col))
    listed = _listed(census)
    one = kept(_vertices(census))
    twins = frozenset(r[0] for r in one.where("not alone").select("key").collect())  # pairs of sets in 2^64; hardly ever one
    if twins:
        again = census.where(F.col("kind") == 0).join(F.broadcast(one.where("not alone").select(F.col("key").alias("twin"))), F.col("key") == F.col("twin"), "left")
        named = kept(again.withColumn("key", F.when(F.col("twin").isNull(), F.col("key")).otherwise(F.col("check"))).drop("twin"))
        drop_kept(one, census)
        census, one = named, kept(_vertices(named))
    sigs = _signed(docs, listed, twins, width, percent, id_col, text_col)
    ties = _ties(sigs, one, percent)
    loose = components(ties)
    drop_kept(ties)
    texts = kept(loose.withColumnRenamed("id", "key").join(one, "key").select("key", "label", "n", "id", "hash"))
    parts = F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum(F.col("n").cast("long") * 8) / F.lit(WIDE_BYTES))).cast("int")
    sizes = kept(texts.groupBy("label").agg(parts.alias("blocks")))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    wanted = kept(texts.join(sizes, "label").select("key", "label", "blocks", own.alias("own"), "id", "hash"))
    few = _token_rows(docs, wanted.where("blocks = 1"), twins, width, id_col, text_col)  # read once, so not written
    one_block = few.select("label", F.lit(0).alias("i"), F.lit(0).alias("j"), "own", "key", "toks")
    toks = kept(_token_rows(docs, wanted.where("blocks > 1"), twins, width, id_col, text_col))
    # the first block of a group meets all of it
    partner = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    first = toks.select("label", F.lit(0).alias("i"), F.explode(partner).alias("j"), "own", "key", "toks")
    links = kept(_verified(one_block, percent).unionByName(_verified(first, percent)))
    found = components(links)
    if not toks.isEmpty():
        rest = _rest(toks.where("blocks > 1 and own > 0"), found, block, percent)
        more = kept(_verified(rest, percent))
        drop_kept(found, *rest.kept_)
        found = components(links.unionByName(more))
        drop_kept(more)
    classes = one.join(found.withColumnRenamed("id", "key"), "key", "left").select("key", "first", "copies", F.coalesce("label", "key").alias("class"))
    least = classes.groupBy("class").agg(F.min("first").alias("least"))
    named = kept(classes.join(least, "class").select("key", "copies", "least"))
    rows = census.where("kind = 0").alias("c").join(named.alias("m"), F.col("c.key") == F.col("m.key"))
    empty = F.col("c.n") == 0
    first = F.col("c.id").eqNullSafe(F.col("m.least.id")) & (F.col("c.hash") == F.col("m.least.hash"))
    out = rows.select(
        F.col("c.id").alias("doc_id"),
        F.col("c.n").alias("n_shingles"),
        F.when(empty, F.col("c.id")).otherwise(F.col("m.least.id")).alias("component_id"),
        F.when(empty, 1).otherwise(F.col("m.copies")).cast("long").alias("copies"),
        F.col("c.hash").alias("hash"),
        (empty | first).alias("first"),
    )
    drop_kept(loose, texts, sizes, wanted, toks, links, found, one)
    return out
