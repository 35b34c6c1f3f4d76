"""Token ids in binary files: Simple-8b words in blocks, one document after another.

A file (all numbers little-endian, 8 bytes): magic; partition, sequence, documents, ids, words, escapes,
bytes of names; then, each as 64-bit numbers, the ids of each document, the first word of each block, the
first escape of each block, the words, the escapes; then the names (ids of documents as text, each after
its 4-byte length, all ones for null). A block holds BLOCK ids, and starts a word, so it decodes alone.

A word's top four bits select how many ids its low 60 bits hold, and how wide each is. An id of 60 bits
that are all ones stands for the next of the block's escapes, which are kept whole.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_kept, kept, shared_dir
from .common import give_back, slices, worker_state

#: (ids in a word, bits of each) by selector: the fixed table of Simple-8b.
MODES = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([c for c, _ in MODES], np.int64)
MARK = np.uint64((1 << 60) - 1)
BLOCK = 4096
#: Ids after which a file is closed (a longer document is in one file of its own or with what came before).
FILE_IDS = 4 << 20
MAGIC = b"S8BIDS\x00\x01"
#: What a text writer puts behind each file.
END = "S8BEND"
#: Ids that are packed at a time.
CHUNK = 256 * BLOCK


def _pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, words of each block, escapes of each block) of ids (uint64) from the start of a block on."""
    n = len(ids)
    at = np.arange(n)
    end = np.minimum((at // BLOCK + 1) * BLOCK, n)
    blocks, choice = -(-n // BLOCK), np.full(n, len(MODES) - 1, np.int8)
    narrow = ids.astype(np.uint16 if n and ids.max() < 1 << 16 else np.uint32) if n and ids.max() < 1 << 32 else ids
    padded = np.zeros(blocks * BLOCK, narrow.dtype)
    padded[:n] = narrow
    for mode in range(len(MODES) - 2, -1, -1):
        count, bits = MODES[mode]
        fits = np.ones((blocks, BLOCK + count), bool)  # what lies behind a block fits any word
        if bits < 8 * narrow.dtype.itemsize:
            fits[:, :BLOCK] = (padded < 1 << bits).reshape(blocks, BLOCK)
        width = 1
        while width < count and fits[:, :BLOCK].any():  # whether the next `width` ids fit as well
            step = min(width, count - width)
            fits[:, :-step] &= fits[:, step:]
            width += step
        choice[fits[:, :BLOCK].reshape(-1)[:n]] = mode
    ends, here, walked = end[::BLOCK], at[::BLOCK], [np.zeros(0, np.int64)]
    while len(here):  # one word further in all blocks at once
        walked.append(here)
        here = here + COUNTS[choice[here]]
        inside = here < ends
        if not inside.all():
            here, ends = here[inside], ends[inside]
    starts = np.sort(np.concatenate(walked))
    modes = choice[starts]
    words = modes.astype(np.uint64) << np.uint64(60)
    for mode in np.unique(modes):
        count, bits = MODES[mode]
        mine = np.flatnonzero(modes == mode)
        for k in range(count if bits else 0):
            where = starts[mine] + k
            inside = where < end[starts[mine]]
            v = np.minimum(ids[np.where(inside, where, 0)], MARK) * inside.astype(np.uint64)
            words[mine] |= v << np.uint64(k * bits)
    return words, np.bincount(starts // BLOCK, minlength=blocks), np.bincount(np.flatnonzero(ids >= MARK) // BLOCK, minlength=blocks)


def encode_file(ids: np.ndarray, lengths: np.ndarray, names: list, partition: int = 0, sequence: int = 0) -> bytes:
    """One file of documents: their ids (one array), numbers of ids, and names (text or None)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    parts = [_pack(ids[k : k + CHUNK]) for k in range(0, len(ids), CHUNK)]
    words = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
    first = [np.concatenate(([0], np.cumsum(np.concatenate([p[k] for p in parts]))))[:-1] if parts else np.empty(0) for k in (1, 2)]
    escapes = ids[ids >= MARK]
    told = b"".join(b"\xff" * 4 if n is None else struct.pack("<I", len(n.encode())) + n.encode() for n in names)
    head = struct.pack("<7q", partition, sequence, len(names), len(ids), len(words), len(escapes), len(told))
    return b"".join([MAGIC, head, lengths.astype("<i8").tobytes(), *[x.astype("<i8").tobytes() for x in first], words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(), told])


class TokenFile:
    """A file in memory; ids(first, last) decodes only the blocks that are asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        self.partition, self.sequence, docs, self.n_ids, words, escapes, told = struct.unpack_from("<7q", data, 8)
        blocks = -(-self.n_ids // BLOCK)
        at, out = 64, []
        for n, kind in ((docs, "<i8"), (blocks, "<i8"), (blocks, "<i8"), (words, "<u8"), (escapes, "<u8")):
            out.append(np.frombuffer(data, kind, n, at))
            at += 8 * n
        self.lengths, self.first_word, self.first_escape, self.words, self.escapes = out
        self.told = data[at : at + told]

    def names(self) -> list:
        out, at = [], 0
        for _ in range(len(self.lengths)):
            (n,) = struct.unpack_from("<I", self.told, at)
            none = n == 0xFFFFFFFF
            out.append(None if none else self.told[at + 4 : at + 4 + n].decode())
            at += 4 + (0 if none else n)
        return out

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop, from whole arrays of words of one selector at a time."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint64)
        b0, b1 = start // BLOCK, -(-stop // BLOCK)
        edge = np.append(self.first_word, len(self.words))
        words = self.words[edge[b0] : edge[b1]]
        modes = (words >> np.uint64(60)).astype(np.int64)
        counts = COUNTS[modes]
        block = np.repeat(np.arange(b0, b1), np.diff(edge[b0 : b1 + 1]))
        before = np.cumsum(counts) - counts
        at = block * BLOCK + before - before[edge[block] - edge[b0]]
        end = np.minimum((block + 1) * BLOCK, self.n_ids)
        out = np.zeros(min(b1 * BLOCK, self.n_ids) - b0 * BLOCK, np.uint64)
        for mode in np.unique(modes):
            count, bits = MODES[mode]
            mine = np.flatnonzero(modes == mode)
            for k in range(count if bits else 0):
                where = at[mine] + k
                inside = where < end[mine]
                out[where[inside] - b0 * BLOCK] = (words[mine[inside]] >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)
        marks = np.flatnonzero(out == MARK)
        if len(marks):
            e0 = self.first_escape[b0]
            out[marks] = self.escapes[e0 : e0 + len(marks)]
        return out[start - b0 * BLOCK : stop - b0 * BLOCK]

    def documents(self) -> Iterator[np.ndarray]:
        ends = np.cumsum(self.lengths)
        ids = self.ids()
        for e, n in zip(ends, self.lengths, strict=True):
            yield ids[e - n : e]


#: Bytes that pieces and ids may take in a worker before the older half goes, and the longest piece kept.
KEPT_BYTES, KEPT_PIECE = 128 << 20, 64
#: New pieces that the tokenizer sees as one text.
JOINED = 2048

_PLAIN = np.zeros(256, bool)  # ASCII characters that are no white space
_PLAIN[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b",.;:!?"]] = True
_START = _PLAIN.copy()  # first bytes of characters that are no white space
_START[[*range(0xC3, 0xE0), 0xE0, *range(0xE4, 0xF5)]] = True


def cuts(raw: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where pieces of UTF-8 texts start: at `docs` (starts of texts), and where a byte-level pre-token surely does.

    That is at a single blank between two characters that are no white space, on both sides of such
    a line end, and between an ASCII letter and a full stop, comma or the like. Characters that share a first byte with Unicode's white space count as white space here.
    """
    if not len(raw):
        return docs[:0]
    before = np.zeros(len(raw), bool)
    before[1:] = _PLAIN[raw[:-1]]
    far = np.flatnonzero((raw[:-1] >= 0x80) & ((raw[1:] == 0x20) | (raw[1:] == 0x0A))) + 1
    lead = lambda k: raw[np.maximum(far - k, 0)]
    low, three = lead(2), lead(3)
    before[far] = ~((low == 0xC2) | ((three >= 0xE1) & (three <= 0xE3)))
    after = np.zeros(len(raw), bool)
    after[:-1] = _START[raw[1:]]
    first = docs[docs < len(raw)]
    before[first] = False
    after[first[first > 0] - 1] = False
    fine = before & after
    starts = fine & (raw == 0x20)
    starts[1:] |= _LETTER[raw[:-1]] & _STOP[raw[1:]]
    line = np.flatnonzero(fine & (raw == 0x0A))
    starts[line] = True
    starts[line + 1] = True
    starts[first] = True
    return np.flatnonzero(starts)


def _taken(ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of ids one after another, each told by its start and length."""
    return ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class _Kept:
    """Pieces with their ids: a number for each, and one array of all ids, which grow by doubling."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.space = [np.zeros(1024, np.uint32), np.zeros(1024, np.int64), np.zeros(1024, np.int64)]
        self.used = [0, 0, 0]

    ids, first, n = (property(lambda self, i=i: self.space[i][: self.used[i]]) for i in range(3))

    def _append(self, i: int, values: np.ndarray) -> None:
        end = self.used[i] + len(values)
        if end > len(self.space[i]):
            self.space[i] = np.concatenate((self.space[i][: self.used[i]], np.zeros(end + end // 2 - self.used[i], self.space[i].dtype)))
        self.space[i][self.used[i] : end] = values
        self.used[i] = end

    def find(self, pieces: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))

    def add(self, pieces: list[bytes], ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = np.arange(self.used[2], self.used[2] + len(n))
        self.number.update(zip(pieces, at.tolist(), strict=True))
        self._append(1, self.used[0] + np.cumsum(n) - n)
        self._append(0, ids)
        self._append(2, n)
        return at


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, which sees a piece of text that repeats once.

    For byte-level tokenizers without a normalizer, a prefix blank or stripping added tokens; others are refused.
    """

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        told = json.loads(spec)
        how = told.get("pre_tokenizer") or {}
        odd = any(t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \n,.;:!?") for t in told.get("added_tokens", ()))
        if told.get("normalizer") or how.get("type") != "ByteLevel" or how.get("add_prefix_space") or not how.get("use_regex", True) or odd:
            raise ValueError("only plain byte-level tokenizers cut texts as this encoder does")
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.widths = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)  # bytes of each id: a character of a byte-level token is one
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            if i < len(self.widths):
                self.widths[i] = len(token)
        for t in told.get("added_tokens", ()):
            self.widths[t["id"]] = len(t["content"].encode())
        self.known, self.older, self.bytes = _Kept(), _Kept(), 0

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) of pieces encoded as one text, a line end before those without a blank.

        Pieces where that text does not surely cut as well are encoded alone.
        """
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        parts = [p if p[:1] == b" " else b"\n" + p for p in pieces]
        data = b"".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        starts = ends - size
        raw = np.frombuffer(data, np.uint8)
        sure = np.zeros(len(raw) + 1, bool)
        sure[cuts(raw, np.zeros(1, np.int64))] = True
        sure[len(raw)] = True
        ids = np.array(self._encode([data])[0], np.uint32)
        edges = np.concatenate(([0], np.cumsum(self.widths[ids])))
        first, last = np.searchsorted(edges, starts), np.searchsorted(edges, ends)
        fine = sure[starts] & sure[ends] & (edges[np.minimum(first, len(ids))] == starts) & (edges[np.minimum(last, len(ids))] == ends) & (edges[-1] == len(raw))
        n = np.where(fine, last - first, 0)
        alone = np.flatnonzero(~fine)
        if not len(alone):
            return _taken(ids, first, n), n
        more = self._encode([pieces[k] for k in alone.tolist()])
        n[alone] = [len(m) for m in more]
        first[alone] = len(ids) + np.cumsum(n[alone]) - n[alone]
        return _taken(np.concatenate((ids, *[np.array(m, np.uint32) for m in more])), first, n), n

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, the first and the number of them for each piece)."""
        code = self.known.find(pieces)
        missing = np.flatnonzero(code < 0)
        asked = [pieces[k] for k in missing.tolist()]
        held = self.older.find(asked)
        seen = np.flatnonzero(held >= 0)
        n = self.older.n[held[seen]]
        code[missing[seen]] = self.known.add([asked[k] for k in seen.tolist()], _taken(self.older.ids, self.older.first[held[seen]], n), n)
        self.bytes += 200 * len(seen) + 4 * int(n.sum())
        new = missing[held < 0]
        size = np.fromiter((len(pieces[k]) for k in new.tolist()), np.int64, len(new))
        short, long = new[size <= KEPT_PIECE], new[size > KEPT_PIECE]
        for at in range(0, len(short), JOINED):
            fresh = [pieces[k] for k in short[at : at + JOINED].tolist()]
            code[short[at : at + JOINED]] = self.known.add(fresh, *(told := self._joined(fresh)))
            self.bytes += 200 * len(fresh) + 4 * len(told[0])
        known = self.known
        ids, first, n = known.ids, known.first, known.n
        if len(long):  # encoded each time
            found = self._encode([pieces[k] for k in long.tolist()])
            more = np.fromiter(map(len, found), np.int64, len(found))
            code[long] = len(n) + np.arange(len(long))
            first, n = np.concatenate((first, len(ids) + np.cumsum(more) - more)), np.concatenate((n, more))
            ids = np.concatenate((ids, *[np.array(m, np.uint32) for m in found]))
        if self.bytes > KEPT_BYTES // 2:
            self.known, self.older, self.bytes = _Kept(), known, 0
        return ids, first[code], n[code]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of UTF-8 texts."""
        data = b"".join(texts)
        edges = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        starts = cuts(np.frombuffer(data, np.uint8), np.unique(edges[:-1]))
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        _, edge, told = pieces.dictionary.buffers()
        told, edge = told.to_pybytes() if told else b"", np.frombuffer(edge, np.int32)[: len(pieces.dictionary) + 1].tolist()
        pool, first, each = self._ids([told[a:b] for a, b in pairwise(edge)])
        code = pieces.indices.to_numpy()
        n = each[code]
        ends = np.cumsum(n)
        ids = _taken(pool, first[code], n)
        total = np.concatenate(([0], ends))[np.searchsorted(starts, edges)]
        return ids, np.diff(total)


def write_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the ids, `end_id` after each document, in ascending order of ids as files below `path`.

    `tokenizer_path` is a byte-level JSON file of the tokenizers library, used without added special
    tokens. Rows are dealt by ranges of ids, so files ascend with their partition and sequence, and one
    task holds one file. Null ids come first; equal ids follow each other by hash of text, then as they
    were read; ranges cut between them too. Null texts count as empty; a text of any length is one
    document; an empty table gives no documents; other columns are not read. Spark's own writer commits
    the files, so lost executors leave none half written and any file system of Spark will do.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    rows = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    order = ["id_", "hash_", "row_"]
    rows = rows.withColumns({"hash_": F.xxhash64("text_"), "row_": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("id_").cast("string").alias("id_"), "text_")

    def run(batches):
        from pyspark import TaskContext

        state = worker_state("token_files")
        if state.get("spec") != shared.value:
            state.update(spec=shared.value, encoder=PieceEncoder(shared.value))
        encode, partition, sequence = state["encoder"], TaskContext.get().partitionId(), 0
        names, ids, lengths, size = [], [], [], 0

        def file():
            return pa.RecordBatch.from_pydict({"file": [encode_file(np.concatenate(ids), np.concatenate(lengths), names, partition, sequence)]}, schema=pa.schema({"file": pa.binary()}))

        for batch in batches:
            for part in slices(batch, "text_", 4 << 20):
                some, n = encode(part.column("text_").cast(pa.binary()).to_pylist())
                if end_id is not None:
                    some, n = np.insert(some, np.cumsum(n), end_id), n + 1
                names += part.column("id_").to_pylist()
                ids.append(some)
                lengths.append(n)
                size += len(some)
                if size >= FILE_IDS:
                    yield file()
                    names, ids, lengths, size, sequence = [], [], [], 0, sequence + 1
        if names:
            yield file()
        give_back()

    files = rows.mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def read_files(spark, path: str, make, schema: str) -> DataFrame:
    """Rows of make(TokenFile) -> {column: values} for each file below `path`, read by Spark alone."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                yield pa.RecordBatch.from_pydict(make(TokenFile(data.as_buffer().to_pybytes())), schema=arrow)
        give_back()

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(run, schema)


def read_documents(spark, path: str) -> DataFrame:
    """(partition, sequence, number, doc_id, start_in_file, n_tokens, ids): every document of the files, ids as little-endian 32-bit integers."""

    def make(f: TokenFile):
        n = len(f.lengths)
        return {
            "partition": [f.partition] * n, "sequence": [f.sequence] * n, "number": range(n), "doc_id": f.names(),
            "start_in_file": np.cumsum(f.lengths) - f.lengths, "n_tokens": f.lengths, "ids": [x.astype("<u4").tobytes() for x in f.documents()],
        }

    return read_files(spark, path, make, "partition bigint, sequence bigint, number bigint, doc_id string, start_in_file bigint, n_tokens bigint, ids binary")


def with_starts(read: DataFrame) -> DataFrame:
    """read_documents' rows with start: the ids of all documents before.

    Sums of files run inside their partition and are shifted by the sums of the partitions before: one row
    for each partition of the writing job meets in one task, whatever the number of documents.
    """
    files = read.groupBy("partition", "sequence").agg(F.sum("n_tokens").alias("total"))
    parts = files.groupBy("partition").agg(F.sum("total").alias("total"))
    before = parts.select("partition", (F.sum("total").over(Window.orderBy("partition")) - F.col("total")).alias("parts_before"))
    inside = F.sum("total").over(Window.partitionBy("partition").orderBy("sequence")) - F.col("total")
    shifts = files.select("partition", "sequence", inside.alias("files_before")).join(before, "partition")
    shifts = shifts.select("partition", "sequence", (F.col("files_before") + F.col("parts_before")).alias("shift"))
    return read.join(shifts, ["partition", "sequence"]).withColumn("start", F.col("start_in_file") + F.col("shift"))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from files that are written for it; see write_files for edge cases."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_files(docs, tokenizer_path, path, end_id, id_col, text_col)
    read = read_documents(spark, path)
    told = kept(read.select(*[c for c in read.columns if c != "ids"], F.crc32("ids").alias("ids_crc32")))
    out = told._kept_path
    kind = docs.schema[id_col].dataType
    written = docs.sparkSession.read.schema(told.schema).parquet(out)
    _delete(spark, path)
    return with_starts(written).select(F.col("doc_id").cast(kind).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def _delete(spark, path: str) -> None:
    frame = spark.range(0)
    frame._kept_path = path
    drop_kept(frame)
