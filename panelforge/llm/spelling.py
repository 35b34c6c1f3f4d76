"""Spelling variants: words one edit apart, grouped under their commonest form.

Near words share all but three padded 3-grams of the longer one, so each word posts its rarest grams
(or pairs of its rarest common grams) together with its length, and near words meet in some posting
group. A group is a small positional inverted index: the posting lists of a word's grams, at the
positions that one edit allows, are heap-merged; words found as often as the one-edit overlap bound asks
are verified. A pair is told in the first group that both words share, so none is told twice.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import combinations, cycle
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_kept, kept
from .common import give_back, slices, small

Q = 3
#: Counters of the fixed table that orders grams by how common they are.
SLOTS = 1 << 16
#: A gram of more words than this is met in pairs of grams only.
RARE = 1500
#: Words of one posting group that one task indexes at most; larger groups meet in pairs of blocks.
SPLIT = 4096
#: Runs longer than this are hashed one by one.
LONG = 48

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def _hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """crc32 of head + run for each run: heads are the heads' own crc32; runs are Latin-1, hashed as UTF-8."""
    crc = heads ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-np.minimum(lengths, LONG), kind="stable")
    at, size, state = starts[order], lengths[order], crc[order]
    step = lambda c, b: _CRC[(c ^ b) & 255] ^ (c >> 8)
    for k in range(min(int(lengths.max(initial=0)), LONG)):
        n = int(np.searchsorted(-size, -k, "left")) if k < LONG else 0
        if not n:
            break
        b = raw[at[:n] + k].astype(np.uint32)
        s = state[:n]
        wide = b >= 0x80
        state[:n] = np.where(wide, step(step(s, np.uint32(0xC3)), b - np.uint32(0x40)), step(s, b)) if wide.any() else step(s, b)
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > LONG):
        out[i] = zlib.crc32(raw[starts[i] : starts[i] + lengths[i]].tobytes().decode("latin-1").encode(), int(heads[i]))
    return out


def slice_words(ids: list[str], texts: list[str], least: int = 5, one_in: int = 97) -> tuple[pa.Array, pa.Array]:
    """(words as Latin-1 bytes, counts) of some texts: see count_words."""
    data = "\n".join(texts).encode("latin-1", "replace").translate(_LOWER)
    raw = np.frombuffer(data, np.uint8)
    letter = _LETTER[raw]
    edge = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=0, append=0))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    fine = lengths >= least
    starts, lengths = starts[fine], lengths[fine]
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, starts, "right")
    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = _hashes(raw, starts, lengths, heads[doc])
    hit = np.flatnonzero(h % one_in == 0)
    keep = np.zeros(len(raw) + 1, np.int32)
    keep[starts] += 1
    keep[starts + lengths] -= 1
    keep = np.cumsum(keep[:-1]).astype(bool)
    keep[starts[hit] + h[hit] % lengths[hit].astype(np.uint32)] = False
    sizes = lengths.copy()
    sizes[hit] -= 1
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw[keep])])
    counts = pc.value_counts(words.filter(pa.array(sizes >= least)))
    return counts.field(0), counts.field(1)


def count_words(docs: DataFrame, least: int = 5, least_n: int = 3, one_in: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): maximal runs of A-Za-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased.

    Where the crc32 of `<id>:<run>` is a multiple of `one_in`, the run loses its code point number crc32
    modulo its length. Words have at least `least` code points and occur at least `least_n` times. A null
    text has no runs, a null id counts as an empty text, repeated rows count each, an empty table has no
    words, a run may be as long as its text, and other columns are not read. Counts are combined in each
    slice and each task before the one shuffle.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_"):
                words, counts = slice_words(part.column("id_").to_pylist(), part.column("text_").to_pylist(), least, one_in)
                for at in range(0, len(words), 65_536):
                    yield pa.RecordBatch.from_pydict({"word": words.slice(at, 65_536).cast(pa.binary()), "n": counts.slice(at, 65_536)})
        give_back()

    found = rows.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)
    return found.select(F.decode("word", "ISO-8859-1").alias("word"), "n")


def grams(word: str) -> list[str]:
    """The padded 3-grams of a word, by position; the pads are no letters."""
    padded = "\x01\x01" + word + "\x02\x02"
    return [padded[i : i + Q] for i in range(len(word) + Q - 1)]


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % SLOTS


def _wide(gram: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(gram.encode("utf-8", "surrogatepass"))


def gram_counts(words: DataFrame) -> np.ndarray:
    """Words by slot of their distinct grams: a table of fixed size, summed over all words."""

    def run(batches):
        total, known = np.zeros(SLOTS, np.int64), {}
        for batch in batches:
            for w in batch.column(0).to_pylist():
                for g in set(grams(w)):
                    s = known.get(g)
                    if s is None:
                        if len(known) > 200_000:
                            known.clear()
                        s = known[g] = _slot(g)
                    total[s] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": used.astype(np.int64), "n": total[used]})

    sums = words.select("word").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(SLOTS, np.int64)
    for r in sums.collect():
        out[r["slot"]] = r["n"]
    return out


_MASK = (1 << 64) - 1


class Signatures:
    """The posting keys of a word under one table of gram counts."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.tolist()
        self.known: dict[str, tuple[int, int]] = {}

    def rarest(self, word: str) -> list[tuple]:
        """The five rarest tokens (count, gram's hash, occurrence); equal grams of a word are told apart by occurrence."""
        known, tokens = self.known, []
        for g in grams(word):
            t = known.get(g)
            if t is None:
                if len(known) > 200_000:
                    known.clear()
                t = known[g] = (self.counts[_slot(g)], _wide(g))
            tokens.append(t)
        tokens.sort()
        out, k = [], 0
        for i, t in enumerate(tokens[: Q + 2]):
            k = k + 1 if i and t == tokens[i - 1] else 0
            out.append((*t, k))
        return out

    @staticmethod
    def key(a: tuple, b: tuple | None = None) -> int:
        h = a[1] + a[2] * 0x9E3779B97F4A7C15
        if b:
            h = h * 0xC2B2AE3D27D4EB4F ^ (b[1] + b[2] * 0x9E3779B97F4A7C15)
        return (h & _MASK) - (1 << 63)

    def of(self, word: str) -> list[int]:
        """Rare tokens among the first four alone, common ones among the first five in pairs.

        Near words share one of their first four and two of their first five tokens, whatever the order is.
        """
        first, key = self.rarest(word), self.key
        common = [t for t in first if t[0] > RARE]
        return list({key(t) for t in first[: Q + 1] if t[0] <= RARE} | {key(a, b) for a, b in combinations(common, 2)})

    def meeting(self, a: list[tuple], b: list[tuple]) -> int | None:
        """The key of the group in which two near words are told."""
        shared = [t for t in a if t in b]
        if not shared:
            return None
        if shared[0][0] <= RARE:
            return self.key(shared[0])
        return self.key(shared[0], shared[1]) if len(shared) > 1 else None


def one_edit(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point turns a into b."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) != 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :]


class _Index:
    """The positional inverted index of the longer words of one posting group."""

    def __init__(self):
        self.words: list[str] = []
        self.held: list[list[str]] = []
        self.postings: dict[str, list[int]] = {}

    def add(self, word: str, places: list[str]) -> None:
        i = len(self.words)
        self.words.append(word)
        self.held.append(places)
        for x in places:
            at = self.postings.get(x)
            if at is None:
                self.postings[x] = [i]
            elif at[-1] != i:
                at.append(i)

    def near(self, word: str, choices: list[tuple[str, ...]], bound: int) -> Iterator[str]:
        """Words of the index one edit from `word`, whose grams may each stand at one of some places.

        Of n grams at most n - bound may be missed, so what is looked for stands in one of the
        n - bound + 1 shortest posting lists: these are heap-merged, and what they hold is counted
        against the bound over all grams and then verified.
        """
        lost = missing = len(choices) - bound
        lists, get = [], self.postings.get
        for c in choices:
            found = [at for x in c if (at := get(x))]
            if found:
                lists.append(found)
            else:
                missing -= 1
                if missing < 0:
                    return
        lists.sort(key=lambda found: sum(map(len, found)))
        last = -1
        for i in heapq.merge(*[at for found in lists[: missing + 1] for at in found]):
            if i != last:
                last, has = i, set(self.held[i])
                if sum(map(has.isdisjoint, choices)) <= lost and one_edit(word, self.words[i]):
                    yield self.words[i]


_PLACES = [chr(p) for p in range(3, 50_003)]


def placed(word: str) -> list[str]:
    """The grams of a word, each marked with its position (of very long words modulo 50,000)."""
    return [g + c for g, c in zip(grams(word), cycle(_PLACES) if len(word) > 49_000 else _PLACES, strict=False)]


def near_in_group(left: list[str], right: list[str] | None, length: int) -> Iterator[tuple[str, str]]:
    """Near pairs of one group whose longer word has `length` code points, both words from `left`.

    With `right` a pair has a word from either.
    """
    for first, second in [(left, None)] if right is None else [(left, right), (right, left)]:
        index = _Index()
        for w in first:
            if len(w) == length:
                places = placed(w)
                if second is None:
                    for x in index.near(w, [(p,) for p in places], length - 1):
                        yield w, x
                index.add(w, places)
        if not index.words:
            continue
        for w in first if second is None else second:
            if len(w) < length:  # what follows the edit stands one further in the longer word
                gs = grams(w)
                one, two = placed(w), [g + _PLACES[(p + 1) % 50_000] for p, g in enumerate(gs)]
                for x in index.near(w, list(zip(one, two, strict=True)), length - 1):
                    yield w, x
            elif len(w) == length and first is left and second is not None:
                for x in index.near(w, [(p,) for p in placed(w)], length - 1):
                    yield w, x


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each two words (word, n; words distinct) one edit apart, once.

    Words post under two lengths, their own and the next, as the longer of a pair has. A group of over
    SPLIT words meets in pairs of blocks by all tasks. Null words and words under two code points take no
    part; no words give no rows.
    """
    words = words.where(F.length("word") > 1).select("word", "n")
    counts = words.sparkSession.sparkContext.broadcast(gram_counts(words))

    def post(batches):
        signatures = Signatures(counts.value)
        for batch in batches:
            sigs = [signatures.of(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(sigs, pa.list_(pa.int64()))], ["word", "n", "sigs"])

    signed = kept(words.mapInArrow(post, "word string, n bigint, sigs array<bigint>"))
    size = F.length("word")
    posts = signed.select("word", "n", F.explode("sigs").alias("sig")).withColumn("length", F.explode(F.array(size, size + 1)))
    large = kept(posts.groupBy("sig", "length").agg(F.count("*").alias("size")).where(F.col("size") > SPLIT).select("sig", "length", F.ceil(F.col("size") / SPLIT).cast("int").alias("blocks")))
    none = F.lit(0)
    if large.isEmpty():
        dealt = posts.select("sig", "length", none.alias("i"), none.alias("j"), none.alias("side"), "word", "n")
    else:
        mine = posts.join(small(large), ["sig", "length"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = mine.withColumn("own", F.pmod(F.xxhash64("word"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(none, F.col("blocks") - 1)))
        dealt = mine.select("sig", "length", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "word", "n")
    keys = ["sig", "length", "i", "j"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def meet(batches):
        signatures = Signatures(counts.value)

        def told(table):
            """Rows of the complete groups of a sorted table; groups of one word are skipped by arrays."""
            at = [table.column(k).to_numpy() for k in keys]
            new = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in at], axis=0))))
            longer = pc.equal(pc.utf8_length(table.column("word")), table.column("length")).to_numpy(zero_copy_only=False)
            sizes = np.diff(np.append(new, len(at[0])))
            fine = (sizes > 1) & (np.add.reduceat(longer.astype(np.int64), new) > 0)
            rows = table.filter(pa.array(np.repeat(fine, sizes)))
            words, n, side = (rows.column(k).to_pylist() for k in ("word", "n", "side"))
            start, out = 0, []
            for first, size in zip(new[fine].tolist(), sizes[fine].tolist(), strict=True):
                mine = words[start : start + size]
                left, right = mine, None
                if at[2][first] != at[3][first]:
                    left, right = ([w for w, s in zip(mine, side[start : start + size], strict=True) if s == k] for k in (0, 1))
                sig, many = int(at[0][first]), None
                for a, b in near_in_group(left, right, int(at[1][first])):
                    many = many or dict(zip(mine, n[start : start + size], strict=True))
                    if signatures.meeting(signatures.rarest(a), signatures.rarest(b)) == sig:
                        out.append((a, many[a], b, many[b]))
                start += size
            return out

        def batch_of(rows):
            return pa.RecordBatch.from_pydict(dict(zip(("a", "n_a", "b", "n_b"), zip(*rows, strict=True), strict=True)))

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            last = [table.column(k)[-1].as_py() for k in keys]
            open_ = np.all([table.column(k).to_numpy() == v for k, v in zip(keys, last, strict=True)], axis=0)
            cut = int(np.argmax(open_))
            if cut and (rows := told(table.slice(0, cut))):
                yield batch_of(rows)
            rest = table.slice(cut)
        if rest is not None and (rows := told(rest)):
            yield batch_of(rows)

    pairs = kept(dealt.mapInArrow(meet, "a string, n_a bigint, b string, n_b bigint"))
    drop_kept(signed, large)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last word, which has none.

    A form is at least twice as common as its word, so chains are short and have no rings; each round
    doubles the steps taken.
    """
    now = kept(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        further = kept(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        drop_kept(now)
        now = further


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, form, form_n, root, n_near) of each of `words` (word, n; words distinct).

    form is the near word of largest n (ties: smallest in code-point order) if that n is at least
    `factor` (two or more) times the word's; root follows forms to the last, and is the word itself
    without one. Other columns are not read, and no words give no rows.
    """
    words = kept(words.select("word", "n"))
    pairs = near_pairs(words)
    way = lambda a, b: F.struct(F.col(a).alias("word"), F.col(b).alias("other"), F.col(f"n_{b}").alias("m"))
    both = pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other"))).alias("best"))
    fine = -F.col("best.less") >= factor * F.col("n")
    out = kept(words.join(near, "word", "left").select("word", "n", F.when(fine, F.col("best.other")).alias("form"), F.when(fine, -F.col("best.less")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")))
    drop_kept(words, pairs)
    return out.join(roots(out), "word", "left").withColumn("root", F.coalesce("root", "word"))
