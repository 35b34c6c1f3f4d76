"""Spelling variants, token id files and dual-tree clusters: brute force, exact round trips, and edge cases."""

import re
import tempfile
import zlib
from collections import Counter
from itertools import product

import numpy as np
import oracle
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import dual_tree, queries, spelling, token_files
from panelforge.session import table

SMALL = "/root/testdata/sf0.001"
RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_words(rows, least=5, least_n=3, one_in=97):
    counts = Counter()
    for i, t in rows:
        for w in RUNS.findall((t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= least_n}


def edits(w, letters):
    for i in range(len(w) + 1):
        yield from (w[:i] + c + w[i:] for c in letters)
        if i < len(w):
            yield w[:i] + w[i + 1 :]
            yield from (w[:i] + c + w[i + 1 :] for c in letters)


def brute_variants(words):
    letters = sorted({c for w in words for c in w})
    near = {w: {x for x in edits(w, letters) if x != w and x in words} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def variant_rows(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_spelling_query_equals_brute_force(spark):
    docs = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = variant_rows(queries.op11_spelling(spark, SMALL))
    assert len(got) == len(set(got)) and set(got) == brute_variants(brute_words(docs))


@pytest.mark.parametrize(("rare", "split"), [(1500, 4096), (0, 4096), (2, 7), (10_000, 16)])
def test_variants_of_dense_words(spark, monkeypatch, rare, split):
    """Words of few letters, whose grams are common: pairs of grams, and groups cut into blocks."""
    monkeypatch.setattr(spelling, "RARE", rare)
    monkeypatch.setattr(spelling, "SPLIT", split)
    rng = np.random.default_rng(rare + split)
    some = ["".join(x) for x in product("ab", repeat=5)] + ["".join(rng.choice(list("abé"), rng.integers(2, 9))) for _ in range(300)]
    words = {w: int(rng.integers(1, 40)) for w in some}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = variant_rows(spelling.variants(df))
    assert len(got) == len(words) and set(got) == brute_variants(words)


def test_word_counts_of_odd_rows(spark):
    long = "x" * 70_000 + " " + "Étés " * 50_000
    rows = [(1, long), (1, long), (2, None), (None, "ABCDE abcde İabcde ×÷×÷×"), (3, ""), (4, long + "\U0001f600abcde中abcde"), (5, "ÀbcdÀ " * 3 + "àbcdà")]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string")
    for one_in in (97, 1, 2):
        got = {r.word: r.n for r in spelling.count_words(df, one_in=one_in).collect()}
        assert got == brute_words(rows, one_in=one_in)
    assert spelling.variants(spelling.count_words(df.where("false"))).count() == 0


def test_long_words_meet(spark):
    base = "".join(np.random.default_rng(3).choice(list("abcdefgh"), 60_000))
    words = [(base, 9), (base[:-1], 2), (base[:30_000] + "z" + base[30_001:], 1), (base[1:] + "q", 4), (None, 3), ("", 3), ("a", 5)]
    got = {(r.n, r.form_n, r.n_near) for r in spelling.variants(spark.createDataFrame(words, "word string, n long").where("word is not null")).collect()}
    assert got == {(9, None, 2), (2, 9, 1), (1, 9, 1), (4, None, 0), (3, None, 0), (5, None, 0)}


@given(st.lists(st.text("abc", min_size=2, max_size=7), unique=True, max_size=30))
@settings(max_examples=150, deadline=None)
def test_a_group_finds_what_one_edit_allows(words):
    for length in range(2, 9):
        want = {frozenset(p) for p in product(words, words) if max(map(len, p)) == length and spelling.one_edit(*p)}
        got = list(spelling.near_in_group(words, None, length))
        assert len(got) == len(want) and {frozenset(p) for p in got} == want
        halves = list(spelling.near_in_group(words[::2], words[1::2], length))
        across = {frozenset(p) for p in product(words[::2], words[1::2]) if max(map(len, p)) == length and spelling.one_edit(*p)}
        assert len(halves) == len(across) and {frozenset(p) for p in halves} == across


WIDE = st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers((1 << 60) - 3, (1 << 60) + 2), st.integers(0, (1 << 64) - 1))


@given(st.lists(st.tuples(WIDE, st.integers(1, 300)), max_size=40), st.integers(0, 10_000), st.integers(0, 10_000))
@settings(max_examples=200, deadline=None)
def test_ids_of_any_size_come_back(runs, a, b):
    ids = np.array([v for v, n in runs for _ in range(n)], np.uint64)
    cut = min(a, len(ids))
    f = token_files.TokenFile(token_files.encode_file(ids, np.array([cut, len(ids) - cut]), ["é", None], 3, 4))
    assert (f.ids() == ids).all() and f.names() == ["é", None] and (f.partition, f.sequence) == (3, 4)
    assert (f.ids(min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()
    assert [len(x) for x in f.documents()] == [cut, len(ids) - cut]


def test_words_hold_as_many_ids_as_the_table_says():
    for count, bits in token_files.MODES[:1] + token_files.MODES[2:]:
        ids = np.full(count * 3, (1 << bits) - 1 if bits < 60 else (1 << 59), np.uint64)
        assert len(token_files.TokenFile(token_files.encode_file(ids, np.array([len(ids)]), ["a"])).words) == 3


PARTS = [*" \n\t\x0b\x1c\x1f\x85\xa0", " ", "a", "b'll", "it's", "é", "ß ", "1", "!", "̀", "\U0001f600", "<|endoftext|>", "  ", "the ", "“ ", " ", "　", " ", "x\ny", "\r\n"]


@pytest.fixture(scope="module")
def byte_level():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return token_files.PieceEncoder(f.read()), Tokenizer.from_file(path)


@given(st.lists(st.one_of(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), st.text(max_size=20)), max_size=4))
@settings(max_examples=400, deadline=None)
def test_pieces_equal_the_library(byte_level, texts):
    encode, library = byte_level
    ids, n = encode([t.encode() for t in texts])
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_new_pieces_are_joined_for_the_library(byte_level):
    """Thousands of new words take a few calls' texts, not one text each; odd ends, long words and repeats come out the same."""
    encode, library = token_files.PieceEncoder(byte_level[0].tokenizer.to_str()), byte_level[1]
    words = [f"w{k:x}q{k * 7919 % 104729:x}" + (",", ".", "", "!?", " ", "\n", "\nx", "\u0300")[k % 8] for k in range(6000)] + ["y" * 70 + str(k) for k in range(50)]
    texts = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)] + ["", " a", "a ", ",", "\n"]
    told = []

    class Counted:
        def encode_batch_fast(self, asked, **how):
            told.extend(asked)
            return library.encode_batch_fast(asked, **how)

    encode.tokenizer = Counted()
    ids, n = encode([t.encode() for t in texts])
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(told) < 1000
    again, _ = encode([t.encode() for t in texts])
    assert again.tolist() == ids.tolist() and len(encode.known.n) == len(encode.known.number)


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError, match="byte-level"):
        token_files.PieceEncoder(f.read())


def expected_files(rows, library):
    out, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_file_query(spark, byte_level):
    docs = sorted(tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect())
    got = queries.op12_token_files(spark, SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == expected_files(docs, byte_level[1])


def test_token_files_of_odd_rows(spark, byte_level, monkeypatch):
    """Nulls, repeats, long texts, clashing names, many small files, and an empty table."""
    monkeypatch.setattr(token_files, "FILE_IDS", 50)
    path, long = public_tokenizers.path("byte_bpe_50k.json"), "wordé " * 60_000 + "z" * 200_000
    rows = [(None, "no id"), (None, "no id"), *[(k, f"text {k} of many words " * (k % 7)) for k in range(-40, 40)], (40, None), (41, ""), (42, long), (42, long)]
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, start int, file binary").repartition(5)
    got = sorted((tuple(r) for r in token_files.round_trip(df, path).collect()), key=lambda r: r[1])
    assert got == expected_files(rows, byte_level[1])
    assert token_files.round_trip(df.where("false"), path).count() == 0


def test_files_stay_and_documents_are_read_from_them(spark, byte_level):
    path = tempfile.mkdtemp() + "/ids"
    df = spark.createDataFrame([("b", "two words"), ("a", "one"), ("c", None)], "name string, body string")
    token_files.write_files(df, public_tokenizers.path("byte_bpe_50k.json"), path, None, "name", "body")
    read = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_documents(spark, path).collect()}
    assert read == {"a": byte_level[1].encode("one").ids, "b": byte_level[1].encode("two words").ids, "c": []}
    starts = {r.doc_id: r.start for r in token_files.with_starts(token_files.read_documents(spark, path)).collect()}
    assert starts == {"a": 0, "b": len(read["a"]), "c": len(read["a"]) + len(read["b"])}


def brute_clusters(rows, k=16, rounds=3, dims=64):
    import hashlib
    import math

    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(64 * x) < 1 << 31 for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else old for j, old in enumerate(c)]
    out = [(i, (j := nearest(v)), far(v, c[j])) for i, v in kept]
    sums = Counter()
    for _, j, d in out:
        sums[j] += d
    return sorted((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out)


def cluster_rows(df):
    return sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clusters_equal_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SMALL, "embeddings").select("vec_id", "embedding").collect()]
    assert cluster_rows(queries.op13_dual_tree(spark, SMALL)) == brute_clusters(rows)


def test_clusters_equal_their_twin(spark):
    assert oracle.differ(queries.op13_dual_tree(spark, SMALL), oracle.connect(SMALL), queries.ORACLE["op13_dual_tree"]) is None


@pytest.mark.parametrize("n", [0, 5, 400])
def test_clusters_of_odd_vectors(spark, n):
    """Null, short, non-finite, huge and equal vectors, repeated ids, fewer vectors than centroids, clashing names."""
    rng = np.random.default_rng(n)
    fine = [(int(i) // 2, (rng.normal(size=64) * 10.0 ** rng.integers(-2, 6)).tolist()) for i in range(n)]
    rows = fine + [(7, fine[0][1])] * (n // 3) if n else []
    odd = [(1, None), (2, [1.0] * 63), (3, [float("nan")] * 64), (4, [float("inf")] + [0.0] * 63), (5, [None] + [0.0] * 63), (6, [1e30] * 64)]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows + odd], "vec_id long, embedding array<double>, cluster int, distance string").repartition(4)
    assert cluster_rows(dual_tree.cluster(df)) == brute_clusters(rows)


@pytest.mark.parametrize("scale", [3, 1000, 1 << 23, 1 << 28])
def test_trees_prune_only_what_is_too_far(scale):
    rng = np.random.default_rng(scale)
    met = []
    for spread in (1, 30):
        base = rng.integers(-scale, scale, (6, 8))
        x = base[rng.integers(0, 6, 700)] * spread + rng.integers(-scale, scale, (700, 8))
        x[::3] = x[0]
        c = np.concatenate([x[:12], x[:2]])
        t = dual_tree.cover_tree(x.astype(float))
        label, n = dual_tree.assign(x[t.order], t, c, dual_tree.centroid_tree(c))
        want = np.argmin(((x.astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(2), axis=1)
        assert (label == want[t.order]).all()
        met.append(n)
        for i in range(len(t.center)):
            mine = t.order[t.start[i] : t.stop[i]]
            assert np.sqrt(((x[mine].astype(float) - x[t.center[i]]) ** 2).sum(1)).max() <= t.radius[i] * (1 + 1e-12)
    assert met[1] < met[0]  # tight clusters are taken node by node
