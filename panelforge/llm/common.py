"""What the text operators share: Arrow mapping over (id, text) rows in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one slice of an Arrow batch holds at most (one longer text is a slice of its own).
SLICE_BYTES = 8 << 20


_WORKER: dict[str, dict] = {}


def worker_state(owner: str) -> dict:
    """What a Python worker keeps between tasks of one operator; another operator's state goes first."""
    if owner not in _WORKER:
        _WORKER.clear()
        _WORKER[owner] = {}
    return _WORKER[owner]


def give_back() -> None:
    """Return freed memory to the system, so that idle workers do not hold what their last task needed."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has at most `limit` bytes of `column`, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield batch.slice(start)


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list, list], dict]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    binary: bool = False,
    extra: tuple[str, ...] = (),
    limit: int = SLICE_BYTES,
    owner: str = "",
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """Map (id, text) rows in Arrow slices, without a shuffle.

    `make` runs once in each task and returns f(ids, texts, *extras) -> {column: list or array}, the
    columns of `schema` in order; what it keeps for later tasks is worker_state(owner), which `done` may cut down
    at the end of each task. Null texts arrive as empty ones; other columns of `docs` are not read.
    """
    kept = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"), *[F.col(c).alias(f"x{i}_") for i, c in enumerate(extra)])

    def run(batches):
        worker_state(owner)
        f = make()
        for batch in batches:
            for part in slices(batch, "text_", limit):
                texts = part.column("text_")
                texts = (texts.cast(pa.binary()) if binary else texts).to_pylist()
                more = [part.column(f"x{i}_").to_pylist() for i in range(len(extra))]
                out = f(part.column("id_").to_pylist(), texts, *more)
                if len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
                del out, texts, more
        del f
        if done:
            done()
        give_back()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return kept.mapInArrow(run, schema)


def spaced_files(docs: DataFrame, most: int) -> list[str]:
    """At most `most` of the files that `docs` reads, evenly spaced over their sorted names."""
    files = sorted(docs.inputFiles())
    return files if len(files) <= most else [files[i * len(files) // most] for i in range(most)]


def least_hashed(rows: DataFrame, key: Column, most: int, n: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """At most `most` of the rows, those of least `key` (a 64-bit hash); n: their number, if known.

    Rows beyond about the share wanted are filtered out by the hash before any sort, so a task passes on
    its part of `most` rows, not `most` rows.
    """
    n = rows.count() if n is None else n
    if n > most:
        share = min(1.0, (most + 8 * most**0.5 + 8) / n)
        rows = rows.where(key <= int(share * 2**64) - 2**63 - (share == 1.0))
    return rows.orderBy(key, *ties).limit(most)


#: Rows of (id, hash) that a filter broadcasts at most; beyond that both sides are shuffled.
BROADCAST_ROWS = 500_000


def small(rows: DataFrame) -> DataFrame:
    """rows, marked for broadcast if a count shows at most BROADCAST_ROWS of them; beyond that a join shuffles them."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def free_name(taken: Iterable[str], wanted: str) -> str:
    """`wanted`, lengthened until it is no name in `taken` (case does not tell names apart)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def _by_hash(docs: DataFrame, rows: DataFrame, how: str, id_col: str, text_col: str) -> DataFrame:
    told_id, told_hash = free_name(docs.columns, "told_id"), free_name(docs.columns, "told_hash")
    told = small(rows.select(F.col("doc_id").alias(told_id), F.col("hash").alias(told_hash)).distinct())
    return docs.join(told, F.col(id_col).eqNullSafe(F.col(told_id)) & (F.xxhash64(text_col) == F.col(told_hash)), how)


def without(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id and text hash stand in rejected (doc_id, hash); columns stay as they are.

    Null ids and texts match null ones; repeated rows go or stay together; no column name is reserved.
    """
    return _by_hash(docs, rejected, "left_anti", id_col, text_col)


def chosen(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that without() would drop."""
    return _by_hash(docs, wanted, "left_semi", id_col, text_col)
