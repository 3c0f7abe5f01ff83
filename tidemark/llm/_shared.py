"""Helpers that several operators use: shared folders, Arrow slices, prefix sums."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that an Arrow slice holds at most, unless one row alone has more.
SLICE_BYTES = 1 << 18
#: Rows that Python gets at a time where they hold whole texts, and where they are short.
TEXT_ROWS, SHORT_ROWS = 250, 4000
#: Row groups of the tables between steps: what a task holds of a file that it writes.
ROW_GROUP_BYTES = 16 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only where the session has no such setting (as in tests on one machine) is a
    local folder set instead.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or None
    if base is None:
        found = context._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
            found = context._jsc.sc().getCheckpointDir()
        base = found.get()
    elif context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS):
    """Jobs inside send Python at most ``rows`` rows at a time: texts are long, and each task holds a batch on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries inside remove their shuffle files when they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def materialize(df: DataFrame, name: str, rows: int = TEXT_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage.

    Python gets ``rows`` rows at a time.  What was shuffled for it goes once it is written.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with small_batches(spark, rows), shuffles_removed(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*written: DataFrame) -> None:
    """Delete the files of materialized tables that nothing will read any more."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give freed memory back to the system: a Python worker stays for other tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.Table]:
    """A table for each run of rows that are equal in the columns (long integers), whatever batches it spans."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in columns])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = keys[:, a].tolist()
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
    held = []
    trim()


_models: dict[str, tuple] = {}


def model_of(kind: str, make: Callable, *args):
    """What ``make`` gives for the arguments, kept in the Python worker for its next tasks of this kind."""
    if _models.get(kind, (None,))[0] != args:
        _models[kind] = args, make(*args)
    return _models[kind][1]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, model: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of ``column`` (or one row).

    Models that the worker keeps for tasks of other kinds than ``model`` are dropped.
    """
    for kind in [k for k in _models if k != model]:
        del _models[kind]
    seen = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        width = np.int64 if pa.types.is_large_string(col.type) else np.int32
        ends = np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
        seen += int(ends[-1] - ends[0])
    if seen > 32 * SLICE_BYTES:
        trim()


def filled(col: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return col.fill_null("") if col.null_count else col


def ramp(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


def raw_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without nulls, and the row boundaries in them."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    ends = np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


_RANDOM = np.random.default_rng(20240607).integers(0, 1 << 64, 256 + 16, np.uint64) | np.uint64(1)
_BASE = int(_RANDOM[256])
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the next call."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        made = []
        for base in (_BASE, _INVERSE):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        _powers[:] = made
    return _powers


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: polynomials of the bytes, from differences of one running sum."""
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_RANDOM[raw] * power[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def word_spans(raw: np.ndarray, bounds: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of all words of all texts, and the number of the first word of each text.

    ``raw`` has the texts' bytes, ``bounds`` their boundaries, ``between`` is true for
    the byte values that separate words.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~between[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True  # a word ends with its text
    begin = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    return begin, end, np.searchsorted(begin, bounds)


def word_hashes(raw: np.ndarray, bounds: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the number of the first word of each text."""
    begin, end, firsts = word_spans(raw, bounds, between)
    return span_hashes(raw, begin, end), firsts


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of a text, and the number of each shingle's first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * _RANDOM[257 + j]
    left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(len(words))  # words from here to the text's end
    at = np.flatnonzero(left[:n] >= k)
    return mix(out[at]), at


class KeyTable:
    """Open-addressing table of 64-bit keys that numbers them as they come; works on many keys at once."""

    def __init__(self, keys: np.ndarray | None = None):
        self.keys, self.bits, self.slots = np.zeros(1, np.uint64), 10, np.full(1 << 10, -1, np.int32)
        if keys is not None:
            self.add(keys)

    def __len__(self) -> int:
        return len(self.keys) - 1

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        n = len(self)
        self.keys = np.concatenate([self.keys[:-1], keys.view(np.uint64), np.zeros(1, np.uint64)])
        if 2 * len(self) > len(self.slots):
            self.bits = max(self.bits, int(3 * len(self)).bit_length())
            self.slots, n = np.full(1 << self.bits, -1, np.int32), 0
        at, left = self._home(self.keys[n:-1]), np.arange(n, len(self), dtype=np.int32)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            at, left = (at[lost] + 1) & ((1 << self.bits) - 1), left[lost]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 for those that aren't there."""
        keys = keys.view(np.uint64)
        at = self._home(keys)
        out = self.slots[at]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            out[left] = self.slots[at]
            wrong = (out[left] >= 0) & (self.keys[out[left]] != keys[left])
            left, at = left[wrong], at[wrong]
        return out
