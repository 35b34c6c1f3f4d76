"""Operators that compare or group rows, and the pipeline: brute force on small fixtures, and edge cases."""

import hashlib
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import ann, chat_format, components, mixing, ngram_join
from panelforge.session import table

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(docs):
    """Row -> smallest id of its class, by all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        ids[find(i)].append(doc)
    return [(doc, len(sets[i]), doc if not sets[i] else min((x for x in ids[find(i)] if x is not None), default=None)) for i, (doc, _) in enumerate(docs)]


def near_copies(rng, n, words=120, edits=12):
    base = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.integers(0, edits)):
            at = rng.integers(0, len(w))
            w[at : at + rng.integers(0, 2)] = [f"x{rng.integers(0, 40)}"]
        out.append(" ".join(w))
    return out


def joined(df, **more):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_groups(df, **more).collect())


def test_join_equals_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    assert joined(table(spark, SMALL, "documents")) == Counter(brute_components(docs))


@pytest.mark.parametrize("listed", [8, 1])
def test_join_of_a_dense_group(spark, monkeypatch, listed):
    """Hundreds of near copies whose shingles are all frequent, over several blocks, with hubs in large buckets."""
    monkeypatch.setattr(ngram_join, "LEAST", listed)
    monkeypatch.setattr(ngram_join, "NEAR", 5)
    rng = np.random.default_rng(9)
    texts = near_copies(rng, 220) + near_copies(rng, 30, 12, 2) + [" ".join(f"u{rng.integers(0, 3000)}" for _ in range(60)) for _ in range(30)]
    docs = [(1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert joined(df, block=32) == Counter(brute_components(docs))


@pytest.mark.parametrize("gathered", [1, 4])
def test_join_when_slices_gather(spark, monkeypatch, gathered):
    """Signatures that one slice holds often: one row speaks for the others, in small and in large buckets."""
    monkeypatch.setattr(ngram_join, "GATHERED", gathered)
    monkeypatch.setattr(ngram_join, "LEAST", 2)
    monkeypatch.setattr(ngram_join, "WIDE", 16)
    rng = np.random.default_rng(19)
    texts = near_copies(rng, 150) + near_copies(rng, 60, 60, 9) + near_copies(rng, 40, 12, 2) + [" ".join(f"u{rng.integers(0, 3000)}" for _ in range(60)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert joined(df, block=16) == Counter(brute_components(list(enumerate(texts))))


def test_join_when_fingerprints_collide(spark, monkeypatch):
    """Different sets with one first fingerprint stay different."""
    rows = [(i, f"a{i // 2} b c d e f g h") for i in range(12)] + [(20, "x y"), (21, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    census = ngram_join._census(df, 5, "doc_id", "text").withColumn("key", F.when(F.col("kind") == 0, F.col("key") % 3).otherwise(F.col("key")))
    one = ngram_join._vertices(census).collect()
    assert any(not r.alone for r in one) and sum(r.copies for r in one) == len(rows)
    sets = [ngram_join.tokens(t.encode()) for _, t in rows[:-1]]
    twins = frozenset(map(ngram_join.fingerprint, sets))
    assert len({ngram_join.vertex(s, twins) for s in sets}) == len({ngram_join.vertex(s, frozenset()) for s in sets}) == 7
    assert all(ngram_join.vertex(s, twins) == ngram_join.fingerprint(s, 1) for s in sets)
    real = ngram_join._vertices
    calls = []

    def first_time(census):
        calls.append(1)
        return real(census).withColumn("alone", F.lit(False)) if len(calls) == 1 else real(census)

    monkeypatch.setattr(ngram_join, "_vertices", first_time)
    assert joined(df) == Counter(brute_components(rows)) and len(calls) == 2


def test_lookalikes_that_do_not_link_send_few_rows(spark):
    rng = np.random.default_rng(20)
    sets = [np.unique(rng.integers(1, 2**62, 60, dtype=np.uint64)) for _ in range(5_000)]
    rows = [(7, i, s.tobytes()) for i, s in enumerate(sets)]
    toks = spark.createDataFrame(rows, "label long, key long, toks binary")
    rest = ngram_join._rest(toks, spark.createDataFrame([], "id long, label long"), 64, 80)
    assert rest.count() < 5_000 * 5_000 / 150  # m * m / 64 was three times that


def test_long_texts_of_one_group_are_dealt_by_bytes(spark, monkeypatch):
    """Few sets that hold many bytes fill many blocks; the classes stay those of brute force."""
    rng = np.random.default_rng(26)
    monkeypatch.setattr(ngram_join, "WIDE_BYTES", 4_000)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[: 300 - int(rng.integers(0, 90))])) for i in range(24)] + [(90 + i, " ".join(f"v{i}x{j}" for j in range(200))) for i in range(3)]
    calls, real = [], ngram_join._rest

    def rest(toks, *more):
        calls.append(toks.select("own").distinct().count())
        return real(toks, *more)

    monkeypatch.setattr(ngram_join, "_rest", rest)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == Counter(brute_components(rows)) and calls[0] >= 8


def test_join_edges(spark):
    docs = [(5, None), (6, ""), (6, ""), (7, "a b"), (8, "A  b"), (9, "a b c"), (None, "one two three four five six"), (3, "one two three four five six"), (2, "p q r s t u v w x y"), (1, "p q r s t u v w x y z"), (1, "other text here that is long enough"), (4, " ".join(f"k{i}" for i in range(50_000))), (11, " ".join(f"k{i}" for i in range(300_000))), (12, " ".join(f"k{i}" for i in range(299_000))), (10, "\x1ca b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "hash", "n", "id", "sig", "label", "text_hash")})
    assert joined(df) == Counter(brute_components(docs))
    assert ngram_join.join_groups(df.where("false")).count() == 0
    assert {r.hash for r in ngram_join.join_groups(df).where("doc_id = 7").collect()} == {df.where("doc_id = 7").select(F.xxhash64("text")).first()[0]}


def test_signatures_meet():
    """Any two sets at the threshold share a signature, whichever tokens are listed."""
    rng = np.random.default_rng(10)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        both = rng.integers(1, 2**63, n, dtype=np.uint64)
        extra = rng.integers(0, max(1, n // 4) + 1)
        a = np.unique(both)
        b = np.unique(np.concatenate((both, rng.integers(1, 2**63, extra, dtype=np.uint64)))[: n + extra])
        drop = rng.integers(0, max(1, len(a) // 8) + 1)
        b = np.sort(rng.permutation(b)[drop:]) if drop < len(b) else b
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common) or np.array_equal(a, b):
            continue
        pool = np.unique(np.concatenate((a, b)))
        listed = np.sort(rng.permutation(pool)[: rng.integers(0, len(pool) + 1)])
        order = rng.permutation(len(listed))
        x, y = (ngram_join.signatures(s, listed, order) for s in (a, b))
        assert len(np.intersect1d(x, y)), (len(a), len(b), common)
        assert ngram_join.may_link(ngram_join.parity(a), ngram_join.parity(b), len(a) + len(b), 80)


def test_parity_bound_never_lies():
    rng = np.random.default_rng(11)
    for n, m in ((10, 12), (300, 380), (5000, 4100)):
        a, b = (np.unique(rng.integers(1, 2**63, k, dtype=np.uint64)) for k in (n, m))
        assert not ngram_join.may_link(ngram_join.parity(a), ngram_join.parity(b), n + m, 80)
        near = np.unique(np.concatenate((a[: int(n * 0.95)], b[:1])))
        assert ngram_join.may_link(ngram_join.parity(a), ngram_join.parity(near), len(a) + len(near), 80)


def test_components(spark):
    rng = np.random.default_rng(12)
    edges = [(i, i + 1) for i in range(0, 130)] + [(500, 400), (7, 7), (None, 3)] + [(1000, int(x)) for x in rng.integers(2000, 2100, 80)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(131)) and got[500] == 400 and {got[i] for i in got if i >= 1000} == {1000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def spread(sizes, weights, most):
    """Targets by resharing what caps leave, on lists."""
    out, open_ = [0.0] * len(sizes), dict(enumerate(weights[i % len(weights)] for i in range(len(sizes))))
    while open_:
        left = sum(sizes) - sum(x for i, x in enumerate(out) if i not in open_)
        full = [i for i, w in open_.items() if left * w / sum(open_.values()) > most * sizes[i]]
        for i in full or list(open_):
            out[i] = float(most * sizes[i]) if full else left * open_[i] / sum(open_.values())
        open_ = {i: w for i, w in open_.items() if i not in full} if full else {}
    return out


def test_targets(spark):
    rng = np.random.default_rng(13)
    for sizes in ([10, 10, 10], [1, 100, 0], [0, 0], [], *(rng.integers(0, 1000, n).tolist() for n in (12, 12, 300))):
        names = sorted(f"s{i}" for i in range(len(sizes)))[: max(0, len(sizes) - 1)] + [None] * bool(sizes)
        df = spark.createDataFrame(list(zip(names, sizes, sizes, strict=True)), "source string, size long, n long").repartition(5)
        got = mixing.with_targets(df, (5.0, 2.0, 1.0), 3.0).orderBy("rank").collect()
        assert [r.source for r in got] == names
        assert [r.target for r in got] == pytest.approx(spread(sizes, (5, 2, 1), 3))


def mix_rows(df, **more):
    return Counter(tuple(r) for r in mixing.mix(df, **more).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect())


@pytest.mark.parametrize("exact", [True, False])
def test_mixture_meets_targets(spark, monkeypatch, exact):
    monkeypatch.setattr(mixing, "RANGE", 4)
    monkeypatch.setattr(mixing, "RANGES", 3)
    df = table(spark, SMALL, "documents").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    rows = mixing.mix(df, exact=exact).collect()
    assert len(rows) == df.count()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    for own in by.values():
        off = abs(sum(r.taken for r in own) - own[0].target)
        assert off <= (1 if exact else max(r["size"] for r in own) / 2 + 1e-6)
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1
    assert mix_rows(df, exact=exact) == mix_rows(df.repartition(7), exact=exact)


def test_mixture_edges(spark):
    rows = [(1, None, "a b"), (1, None, "a b"), (2, "x", None), (3, "x", ""), (None, "y", "w " * 50), (4, "z", "q")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(0) for c in ("size", "key", "range", "n", "target", "copies")})
    out = {(r.doc_id, r.source): r for r in mixing.mix(df).collect()}
    assert out[4, "z"].taken == 3 and out[2, "x"].copies == 1 and out[1, None].copies == 3 and out[None, "y"].taken == 50
    assert mixing.mix(df.where("false")).count() == 0
    many = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 1_000).alias("source"), F.lit("a b c").alias("text"))
    assert mixing.mix(many, exact=True).agg(F.sum("taken")).first()[0] == pytest.approx(9_000, abs=1_000)  # a word a source at most


def conversation_rows(spark):
    rows = [(1, 0, "user", "hi \\ <|end|> \\<| [INST]x"), (1, 1, "assistant", "\\\\|é😀"), (1, 1, "assistant", "\\\\|é😀"), (2, None, None, None), (None, 0, "user", "no id"), (None, 1, "assistant", ""), (3, 0, "assistant", "long " * 30_000), (4, 5, "ro\nle<|say|>", "</s>[/INST]")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("tree", "node", "leaf", "parent", "above", "row", "score")})


def test_conversations_read_back(spark):
    rows, df = conversation_rows(spark)
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    got = {r.tree: r for r in chat_format.read_back(chat_format.format_trees(chat_format.thread_nodes(df))).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in turns]
        assert got[c].loss_texts == [x for _, r, x in turns if r == "assistant"] and got[c].n_turns == len(turns)
        assert got[c].formatted.count("<|turn|>") == got[c].formatted.count("<|end|>") == len(turns)
    assert chat_format.format_trees(chat_format.thread_nodes(df.where("false"))).count() == 0


def test_trees(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 3, "user", "c", None), (1, 4, 3, "user", "c", None), (1, 5, 2, "user", "d", 1.0), (2, 1, 2, "u", "x", 9.0), (2, 2, 1, "u", "y", 9.0), (2, 3, 2, "u", "below a circle", 9.0), (3, 7, 99, "assistant", "orphan", 0.0), (3, None, 7, "u", "no node", 0.0)]
    df = spark.createDataFrame(nodes, "tree int, node int, parent int, role string, text string, score double")
    out = chat_format.read_back(chat_format.format_trees(df, keep=2, score="score")).collect()
    assert {(r.tree, r.branch_rank): "".join(t.text for t in r.turns) for r in out} == {(1, 1): "qbc", (1, 2): "qad", (3, 1): "orphan"}  # equal scores: the smaller leaf first


def test_deep_thread_and_random_trees(spark):
    deep = [(0, i, i - 1 if i else None, "user", str(i)) for i in range(300)]
    rng = np.random.default_rng(14)
    wide = [(t, i, int(rng.integers(0, i)) if i else None, "assistant", f"{t}.{i}") for t in range(1, 6) for i in range(40)]
    df = spark.createDataFrame(deep + wide, "tree int, node int, parent int, role string, text string")
    got = {(r.tree, r.leaf): [t.text for t in r.turns] for r in chat_format.read_back(chat_format.format_trees(df, keep=1000)).collect()}
    parent = {(t, i): p for t, i, p, _, _ in deep + wide}
    text = {(t, i): x for t, i, _, _, x in deep + wide}
    want = {}
    for t, i in set(parent) - {(t, p) for (t, _), p in parent.items()}:
        path, at = [], i
        while at is not None:
            path.append(text[t, at])
            at = parent[t, at]
        want[t, i] = path[::-1]
    assert got == want


def test_branches_are_ranked_before_paths_are_written(spark):
    comb = [(0, i, i - 1 if i else None, 0.0) for i in range(400)] + [(0, 400 + i, i, float(i == 7)) for i in range(400)]
    df = spark.createDataFrame(comb, "tree int, node int, parent int, score double")
    found = chat_format.chosen_paths(df, 1)
    assert sorted((r.leaf, r.node, r.above) for r in found.collect()) == sorted([(407, 407, 0)] + [(407, i, 8 - i) for i in range(8)])
    rng = np.random.default_rng(21)
    nodes = [(t, i, int(rng.integers(max(0, i - 4), i)) if i else None, float(rng.integers(0, 9))) for t in (1, None) for i in range(150)]
    got = chat_format.chosen_paths(spark.createDataFrame(nodes, "tree int, node int, parent int, score double"), 3).where("above = 0").collect()
    for t in (1, None):
        up, value = ({i: x for s, i, p, v in nodes if s == t for x in [p if k else v]} for k in (1, 0))
        total = {}
        for i in range(150):
            total[i] = value[i] + (total[up[i]] if up[i] is not None else 0)
        leaves = sorted(set(up) - set(up.values()), key=lambda i: (-total[i], i))[:3]
        assert sorted((r.branch_rank, r.leaf, r.score) for r in got if r.tree == t) == [(n + 1, i, total[i]) for n, i in enumerate(leaves)]


def test_a_very_long_turn(spark):
    rows = [(1, 0, "user", "[INST] \\ " * 50_000), (1, 1, "assistant", "é" * 400_000), (None, 0, None, None), (None, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in ("leaf", "node", "tree", "score", "at")})
    got = {r.tree: r for r in chat_format.read_back(chat_format.format_trees(chat_format.thread_nodes(df))).collect()}
    assert [t.text for t in got[1].turns] == [r[3] for r in rows[:2]] and got[1].loss_texts == [rows[1][3]] and got[None].n_turns == 2


def brute_nearest(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            s = sorted((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 12), j) for j, w in good if j != i)
            out[i] = [j for _, j in s[:k]]
    return out


def test_nearest_finds_most(spark):
    rng = np.random.default_rng(15)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[rng.integers(0, 12)] + 0.4 * rng.normal(size=8)).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[7][1]) for i in range(300)]  # one very common vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0, 5, per_list=60, part=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = brute_nearest(rows)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    assert got[3000] == want[3000]  # all ties: the smallest ids


def test_nearest_is_exact_beyond_the_lists_read(spark):
    """Far more lists than probes, and vectors without clusters: the nearest often lie in lists that are not read."""
    rng = np.random.default_rng(21)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows + rows[::7], "vec_id long, embedding array<double>")  # with repeated rows
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0, 5, per_list=10, probes=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == brute_nearest(rows)


def recall_of(got, want):
    return np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want])


@pytest.mark.parametrize("clusters", [0, 40])
def test_nearest_through_lists_alone(spark, monkeypatch, clusters):
    """The wanted recall without any scan, on vectors with and without clusters; repeated rows and small blocks."""
    rng = np.random.default_rng(23)
    centres = rng.normal(size=(max(clusters, 1), 8)) * (clusters > 0)
    rows = [(i, (centres[rng.integers(0, len(centres))] + 0.3 * rng.normal(size=8)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows + rows[::7], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "BLOCK", 48)
    monkeypatch.setattr(ann, "_scan", None)
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0, 5, per_list=60, boundary=1.02, sample_rows=2000, recall=0.98).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = brute_nearest(rows)
    assert set(got) == set(want) and all(len(set(v)) == 5 for v in got.values()) and recall_of(got, want) >= 0.95


def test_lists_within_a_ratio():
    """The widening beam names the centroids that a full measurement names, but for a few."""
    rng = np.random.default_rng(24)
    index = ann.fit_centroids(rng.normal(size=(6_000, 12)), 900, rounds=3)
    x = rng.normal(size=(300, 12))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    far = np.sqrt(np.maximum(2 - 2 * x @ index.points.T, 0))
    for ratio in (1.0, 1.2, 1.6, np.inf):
        true = set(zip(*(m.tolist() for m in np.nonzero(far <= ratio * far.min(1, keepdims=True) + ann.SLACK)), strict=True))
        told = list(zip(*(m.tolist() for m in index.within(x, ratio)), strict=True))
        assert len(set(told)) == len(told) and len(set(told) & true) > 0.9 * len(true)
    assert all(len(m) == 0 for m in index.within(x[:0], 1.2))


def test_nearest_of_isolated_queries_through_lists(spark):
    """Queries whose lists hold fewer than 5 others meet all rows; fewer rows than 5: all."""
    rng = np.random.default_rng(22)
    rows = [(i, (np.eye(8)[0] + 0.05 * rng.normal(size=8)).tolist()) for i in range(1, 1200) if i % 50]
    rows += [(50 * i, (-np.eye(8)[i] + 1e-9 * rng.normal(size=8)).tolist()) for i in range(1, 8)]  # alone
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for frame, want in ((df, brute_nearest(rows)), (df.where("vec_id between 48 and 51"), brute_nearest(r for r in rows if 48 <= r[0] <= 51))):
        got = defaultdict(list)
        for r in ann.search(frame, F.col("vec_id") % 50 == 0, 5, per_list=10, recall=0.98).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        assert got == want
    assert ann.search(df.where("false"), F.col("vec_id") % 50 == 0, recall=0.98).count() == 0


def test_nearest_of_isolated_queries(spark):
    """A query whose list holds fewer than 5 others still gets its 5 nearest of all rows."""
    rng = np.random.default_rng(22)
    rows = [(i, (np.eye(8)[0] + 0.05 * rng.normal(size=8)).tolist()) for i in range(1, 1200) if i % 50]
    rows += [(50 * i, (-np.eye(8)[i] + 1e-9 * rng.normal(size=8)).tolist()) for i in range(1, 8)]  # alone
    rows += [(50 * i + 2001, (-np.eye(8)[i]).tolist()) for i in range(1, 4)]  # or one of a tight pair
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0, 5, per_list=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == brute_nearest(rows)


def test_graph_search_finds_nearest_centroids():
    rng = np.random.default_rng(22)
    index = ann.fit_centroids(rng.normal(size=(6_000, 16)), 600, rounds=3)
    x = rng.normal(size=(700, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    at, far = index.nearest(x, 12)
    true = 2 - 2 * x @ index.points.T
    assert all(len(set(r)) == 12 for r in at.tolist()) and np.allclose(np.take_along_axis(true, at, 1), far, atol=1e-5)
    best = np.argsort(true, 1)[:, :12]
    assert np.mean([len(set(a) & set(b)) / 12 for a, b in zip(at.tolist(), best.tolist(), strict=True)]) > 0.9
    few = ann.fit_centroids(rng.normal(size=(3, 16)), 600)
    assert few.nearest(x, 12)[0].shape == (700, 3)


def test_nearest_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0] * 8), (50, [0.0] * 8), (100, None), (150, [nan] * 8), (200, [None] * 8), (None, [1.0] * 8), (1, [2.0] * 8), (2, [1.0] + [0.0] * 7), (2, [1.0] + [0.0] * 7), (3, [1.0, 2.0]), (250, [-1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("v", "list", "part", "score", "rank")})
    out = ann.search(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in out] == [(0, 1), (0, 2), (0, 250), (250, 2), (250, 0), (250, 1)]
    assert out[0].score == pytest.approx(1.0) and out[2].score == pytest.approx(-1.0)
    assert ann.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline_against_brute_force(spark):
    """The stages on a small table: what stays, that personal data is gone, and the ids of what is left."""
    import corpus_pipeline as p

    docs = table(spark, SMALL, "documents")
    kept = [docs]
    for _, stage in p.STAGES:
        path = f"{tempfile.mkdtemp()}/stage"
        stage(spark, kept[-1], SMALL).write.parquet(path)
        kept.append(spark.read.parquet(path))
    assert all(k.columns == docs.columns for k in kept[:-1])
    quality, unique, clean, mixed, ids = [[r.asDict() for r in k.collect()] for k in kept[1:]]
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    assert {i for i, y in labels.items() if y == 1} <= {r["doc_id"] for r in quality}
    want = [(d, n, c) for d, n, c in brute_components([(r["doc_id"], r["text"]) for r in quality])]
    assert {r["doc_id"] for r in unique} == {d for d, _, c in want if d == c}
    from panelforge.llm import pii

    before = {r["doc_id"]: r["text"] for r in unique}
    for r in clean:
        base = pii.base_spans(before[r["doc_id"]])
        assert r["text"] == pii.mask(before[r["doc_id"]], base) and r["n_chars"] == len(r["text"])
    masked = {r["doc_id"]: r["text"] for r in clean}
    copies = Counter(r["doc_id"] for r in mixed)
    assert all(masked[r["doc_id"]] == r["text"] for r in mixed) and max(copies.values()) <= 3
    sizes, names = defaultdict(int), sorted({r["source"] for r in clean})
    for r in clean:
        sizes[r["source"]] += len(WORDS.findall(r["text"]))
    for name, target in zip(names, spread([sizes[n] for n in names], (5.0, 2.0, 1.0), 3.0), strict=True):
        own = [len(WORDS.findall(r["text"])) for r in clean if r["source"] == name]
        taken = sum(len(WORDS.findall(r["text"])) for r in mixed if r["source"] == name)
        assert abs(taken - target) <= max(own) / 2 + 1e-6
    assert Counter(r["doc_id"] for r in ids) == copies
    assert all(r["decoded_sha256"] == hashlib.sha256(masked[r["doc_id"]].encode()).hexdigest() for r in ids)


CLASHES = ("gone_id", "gone_hash", "told_id", "told_hash", "epochs_", "copies_", "epoch_", "rest_", "source_", "ranges_", "target_", "part_", "cut_", "row_", "hash", "key", "first", "label", "id_", "text_", "size", "kept", "score", "doc", "n")


def test_pipeline_stages_with_nulls_repeats_and_clashing_names(spark):
    import corpus_pipeline as p

    good = [r.text for r in table(spark, SMALL, "documents").where("n_chars > 400").orderBy("doc_id").limit(6).collect()]
    rows = [(1, good[0], "en", "a"), (1, good[0], "en", "a"), (1, good[0], "de", "b"), (2, good[0] + " more", None, None), (None, good[1], "en", "a"), (None, good[1], "en", "a"), (3, None, "en", None), (3, None, "en", None), (4, "", None, "b"), (None, None, None, None)]
    rows += [(5, good[2], "en", "b"), (5, good[3], "fr", "b"), (6, "w " * 200_000, "en", "c"), (7, good[4], "en", "c"), (8, good[4], "en", "c")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    out = {}
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, docs, SMALL)
        assert got.columns == docs.columns
        out[name] = got.collect()
        assert all(r[c] == f"own {c}" for r in out[name] for c in CLASHES)
    told = Counter((r.doc_id, r.text) for r in out["n-gram Jaccard join"])
    want = {(1, good[0]): 1, (None, good[1]): 1, (3, None): 2, (4, ""): 1, (None, None): 1, (5, good[2]): 1, (5, good[3]): 1, (6, "w " * 200_000): 1, (7, good[4]): 1}
    assert told == Counter(want)
    assert Counter((r.doc_id, r.source) for r in out["PII"]) == Counter((r[0], r[3]) for r in rows)
    assert p.STAGES[-1][1](spark, docs, SMALL).count() == len(rows)


def test_registered_queries_meet_their_contracts(spark):
    """Each query as registered: its columns, one row a document, and what is fixed in it."""
    from panelforge.llm.queries import QUERIES

    docs = table(spark, SMALL, "documents").count()
    columns = {
        "op1_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op2_toxicity": "doc_id held_out score predicted",
        "op3_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op4_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op5_mixing": "doc_id size source_size target taken",
        "op6_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op7_ngram_join": "doc_id n_shingles component_id",
        "op8_quality_classifier": "doc_id score kept",
        "op9_nearest": "query_id rank vec_id score",
        "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op11_spelling": "word form root n n_near form_n",
        "op12_token_files": "doc_id start n_tokens ids_crc32",
        "op13_dual_tree": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    }
    assert set(columns) == set(QUERIES)
    for name, wanted in columns.items():
        got = QUERIES[name](spark, SMALL)
        assert got.columns[: len(wanted.split())] == wanted.split()
        rows = got.collect()
        if name == "op3_chat_format":
            said = "</s>[INST] ok [/INST]"
            one = next(r for r in rows if r.conv_id == -1)
            assert (one.n_turns, one.loss_chars, one.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
            assert one.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
        elif name == "op9_nearest":
            assert {r.query_id % 50 for r in rows} == {0} and Counter(r.query_id for r in rows).most_common()[-1][1] == 5
        elif name == "op11_spelling":
            assert len({r.word for r in rows}) == len(rows) and all(r.n >= 3 and len(r.word) >= 5 for r in rows)
        elif name == "op13_dual_tree":
            assert len(rows) == table(spark, SMALL, "embeddings").count() and {r.cluster for r in rows} <= set(range(16))
        else:
            assert len(rows) == docs
        if name in ("op11_spelling", "op12_token_files", "op13_dual_tree"):
            kinds = dict(got.dtypes)
            assert all(kinds[c] == ("string" if c in ("word", "form", "root", "centroid_sha256") else "int" if c == "cluster" else "bigint") for c in wanted.split())
        if name == "op2_toxicity":
            assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_a_token_that_stands_once_in_each_slice_is_listed_and_ties_no_unrelated_texts(spark, monkeypatch):
    real = ngram_join.map_texts
    monkeypatch.setattr(ngram_join, "map_texts", lambda *a, **k: real(*a, **k, limit=1))  # every text is a slice
    monkeypatch.setattr(ngram_join, "NEAR", 5)
    common = " ".join(f"c{i}" for i in range(24))
    rows = [(i, common + " " + " ".join(f"w{i}x{j}" for j in range(24))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    listed, _ = ngram_join._listed(ngram_join._census(df, 5, "doc_id", "text"))
    shared = ngram_join.tokens(common.encode())
    assert set(shared[shared < ngram_join.NOTED_BELOW].tolist()) <= set(listed.tolist())
    census = ngram_join._census(df, 5, "doc_id", "text")
    sigs = ngram_join._signed(df, ngram_join._listed(census), frozenset(), 5, 80, "doc_id", "text")
    assert ngram_join._ties(sigs, ngram_join._vertices(census), 80).isEmpty()
    assert {r.component_id for r in ngram_join.join_groups(df).collect()} == set(range(40))


@pytest.mark.parametrize("name", ["op3_chat_format", "op5_mixing", "op7_ngram_join"])
def test_twins(spark, name):
    import oracle

    from panelforge.llm.queries import ORACLE, QUERIES

    assert oracle.differ(QUERIES[name](spark, SMALL), oracle.connect(SMALL), ORACLE[name]) is None


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline as p

    docs = table(spark, SMALL, "documents").where("false")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
