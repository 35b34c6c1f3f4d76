"""Byte-level BPE by merge replay over an inverted index.

A worker gathers the distinct pre-tokens of a large slice of the corpus, lays their bytes out in one
linked array and keeps an index from the rank of a token pair to the positions where it stands. Ranks
are then replayed in ascending order, each over all words at once, and only the two neighbours of a
merged pair are looked up again. Every document is then assembled from its words' ids, so there is no
shuffle at all, and words stay known to the worker (a bounded number) for later slices of its task.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, worker_state

NONE = np.iinfo(np.int32).max
#: Bytes of words that a worker keeps between slices, beside their number.
MOST_BYTES = 16 << 20
#: Bytes of text of one slice: new words take over ten times their bytes while they are merged.
SLICE = 2 << 20


class MergeRanks:
    """Vocabulary and pair ranks of a rank file (lines of base64 bytes and rank)."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        self.token = dict(zip(self.ranks.values(), self.ranks, strict=True))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = max(self.token) + 1  # a pair of ranks is one number below its square
        if min(self.token) < 0 or self.width > NONE:
            raise ValueError("ranks must be 0 to 2,147,483,646")
        pairs = {}
        for whole, rank in self.ranks.items():
            for cut in range(1, len(whole)):
                a, b = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode_word(self, word: bytes) -> list[int]:
        """One word, pair by pair: the lowest rank first, the leftmost of equal ones; a heap of pairs, so long words take n log n."""
        if word in self.ranks:
            return [self.ranks[word]]
        n = len(word)
        start, end, after, before = list(range(n)), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: self.ranks.get(word[start[i] : end[after[i]]]) if after[i] < n else None
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]  # the ends of both parts tell whether a pair still stands
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, left_end, right_end = heapq.heappop(heap)
            if gone[i] or end[i] != left_end or after[i] >= n or end[after[i]] != right_end:
                continue
            j = after[i]
            end[i], after[i], gone[j] = end[j], after[j], True
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[k], end[after[k]]))
        return [self.ranks[word[start[i] : end[i]]] for i in range(n) if not gone[i]]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of ids of each. Words must not be empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not len(words):
            return np.zeros(0, np.int32), lengths
        size = int(lengths.sum())
        ends = np.cumsum(lengths)
        starts = ends - lengths
        token = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.arange(1, size + 1)
        after[ends - 1] = -1
        before = np.arange(-1, size - 1)
        before[starts] = -1
        head = np.ones(size, bool)
        rank = np.full(size, NONE, np.int32)
        left = np.flatnonzero(after >= 0)
        rank[left] = self.rank_of(token[left], token[left + 1])
        for i, known in enumerate(map(self.ranks.get, words)):  # a word of the vocabulary is one id, whatever its merges give
            if known is not None:
                a, b = starts[i], ends[i]
                rank[a:b] = NONE
                token[a] = known
                head[a + 1 : b] = False
        index: dict[int, list[np.ndarray]] = {}

        def post(where: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            where, ranks = where[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                r = int(ranks[a])
                if r in index:
                    index[r].append(where[a:b])
                else:
                    index[r] = [where[a:b]]
                    heapq.heappush(queue, r)

        queue: list[int] = []
        found = np.flatnonzero(rank != NONE)
        if len(found):
            post(found, rank[found])
        marked = np.zeros(size, bool)
        again: set[int] = set()
        while queue:
            r = heapq.heappop(queue)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                marked[at] = True
                previous = before[at]
                follows = marked[previous] & (previous >= 0)
                marked[at] = False
                if follows.any():  # overlapping pairs: the left one wins, then every other
                    keep = np.ones(len(at), bool)
                    for i in np.flatnonzero(follows).tolist():
                        keep[i] = not keep[i - 1]
                    at = at[keep]
            gone = after[at]
            follow = after[gone]
            token[at] = r
            after[at] = follow
            more = follow >= 0
            before[follow[more]] = at[more]
            head[gone] = False
            rank[gone] = NONE
            rank[at] = NONE
            previous = before[at]
            touched = np.concatenate((previous[previous >= 0], at[more]))
            if not len(touched):
                continue
            fresh = self.rank_of(token[touched], token[after[touched]])
            rank[touched] = fresh
            real = fresh != NONE
            touched, fresh = touched[real], fresh[real]
            if not len(touched):
                continue
            if fresh.min() < r:  # a rank that should have come before other merges of r in the same word
                word_of = np.searchsorted(ends, at, "right")
                twice = word_of[:-1][word_of[1:] == word_of[:-1]]
                if len(twice):
                    again.update(np.intersect1d(twice, np.searchsorted(ends, touched[fresh < r], "right")).tolist())
            post(touched, fresh)
        for i in again:
            ids = self.encode_word(words[i])
            head[starts[i] : ends[i]] = False
            head[starts[i] : starts[i] + len(ids)] = True
            token[starts[i] : starts[i] + len(ids)] = ids
        return token[head].astype(np.int32), np.add.reduceat(head, starts, dtype=np.int64)


class _Words(dict):
    """Word -> number, given out as words are first seen."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes slices of texts; keeps at most about `most_words` words, of MOST_BYTES, between slices."""

    def __init__(self, lines: bytes, pattern: str, most_words: int):
        import regex

        self.table, self.find, self.most = MergeRanks(lines), regex.compile(pattern).findall, most_words
        self.clear()

    def clear(self) -> None:
        self.words, self.bytes = _Words(), 0
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]):
        """An array of ids for each text."""
        if len(self.words) > self.most or self.bytes > MOST_BYTES:
            self.clear()
        number = self.words.__getitem__
        rows = []
        for t in texts:
            found = self.find(t)
            rows.append(np.fromiter(map(number, found), np.int32, len(found)))
        new = [w.encode() for w in self.words.new]
        self.bytes += sum(map(len, new))
        ids, lengths = self.table.replay(new)
        self.words.new = []
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.ids = np.concatenate((self.ids, ids))
        for row in rows:
            n = self.lengths[row]
            first = np.cumsum(n) - n
            yield self.ids[np.repeat(self.starts[row] - first, n) + np.arange(int(n.sum()))]


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_decoded: bool = False,
    most_words: int = 150_000,
) -> DataFrame:
    """(doc_id, n_tokens, ids[, decoded]): ids as binary, little-endian unsigned 32-bit integers.

    With `with_decoded` the ids are turned back into bytes in column `decoded`. A null or empty text
    has no ids (an empty binary), equal ids of documents each keep their row, and other columns are not
    read. Whole texts are encoded, whatever their length. An empty table stays
    empty. `most_words` bounds a worker's cache only.
    """
    with open(ranks_path, "rb") as f:
        lines = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((lines, pattern, most_words))

    def make():
        state = worker_state("byte_bpe")
        if state.get("key") != shared.value:
            state.update(key=shared.value, encoder=Encoder(*shared.value))
        encoder = state["encoder"]
        token = encoder.table.token.__getitem__

        def run(ids, texts):
            out = {"doc_id": ids, "n_tokens": [], "ids": []} | ({"decoded": []} if with_decoded else {})
            for row in encoder.encode(texts):
                out["n_tokens"].append(len(row))
                out["ids"].append(row.astype("<u4").tobytes())
                if with_decoded:
                    out["decoded"].append(b"".join(map(token, row.tolist())))
            return out

        return run

    def done():
        for encoder in filter(None, [worker_state("byte_bpe").get("encoder")]):
            encoder.clear()  # workers take turns, and the idle ones count too

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, make, f"doc_id {kind}, n_tokens bigint, ids binary" + ", decoded binary" * with_decoded, id_col, text_col, limit=SLICE, owner="byte_bpe", done=done)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes of each row's ids; null ids decode to empty bytes, rows of any length and repeated ones each
    give one row, an empty table stays empty, other columns are not read. An unknown id raises."""
    with open(ranks_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def make():
        state = worker_state("byte_bpe decode")
        if state.get("key") != shared.value:
            state.update(key=shared.value, token=MergeRanks(shared.value).token)
        token = state["token"].__getitem__

        def run(ids, rows):
            return {"doc_id": ids, "decoded": [b"".join(map(token, np.frombuffer(r, "<u4").tolist())) for r in rows]}

        return run

    from pyspark.sql import functions as F

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col), F.coalesce(F.col(ids_col), F.lit(b"")).alias(ids_col))
    rows = rows.select(F.col(id_col).alias("id_"), F.col(ids_col).alias("text_"))

    def mapped(batches):
        import pyarrow as pa

        f = make()
        for b in batches:
            yield pa.RecordBatch.from_pydict(f(b.column("id_").to_pylist(), b.column("text_").to_pylist()))

    return rows.mapInArrow(mapped, f"doc_id {kind}, decoded binary")
