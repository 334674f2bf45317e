"""Shared pieces of the corpus operators: shared-folder tables and vectorised text kernels.

The kernels work on the value buffer of an Arrow text column as one numpy byte array, so
the cost per byte is a handful of vector passes instead of a Python loop.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text a kernel looks at together; working arrays are 8 to 60 times this.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 1 << 13
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in plain local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    path = "file://" + tempfile.mkdtemp(prefix="quarrygraph-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in a table that
    survives the loss of executors. Shuffle files of the write are freed when it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before, rows = spark.conf.get(_CLEANUP, "false"), spark.conf.get(_BATCH)
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_BATCH, min(int(rows), 2048) if int(rows) > 0 else 2048)  # texts are long: less memory on both sides of the pipe
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
        spark.conf.set(_BATCH, rows)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = (spark, path)
    return table


def quoted(name: str) -> str:
    """A column name as an expression, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(table: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    _delete(*table._written_to)
    _written.remove(table._written_to)


def release() -> None:
    """Delete the tables that materialize() wrote; runs by itself when Python ends."""
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has gone; its folder goes with it
            pass
    _written.clear()


atexit.register(release)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text or binary column in one array, and the rows' offsets. Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, values = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task, until chunks() runs for something else."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def trim() -> None:
    """Give freed memory back, which workers would else hold while other operators run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def tidy(group: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of groups that trims when it is done."""

    @wraps(group)
    def run(table: pa.Table) -> pa.Table:
        try:
            return group(table)
        finally:
            trim()

    return run


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, keep: str = "") -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about limit bytes of text and at most CHUNK_ROWS rows, or one row where that is longer. Of what kept() has, only keep stays."""
    for name in [k for k in _kept if k != keep]:
        del _kept[name]
    trim()
    try:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            _, off = text_bytes(batch.column(column))
            at = 0
            while at < n:
                to = min(at + CHUNK_ROWS, max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1))
                yield batch.slice(at, to - at)
                at = to
    finally:
        trim()


# --- words, as runs of bytes other than ASCII white space -------------------------------

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, which never cross rows, and the index of each row's first word (one more at the end)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


# --- hashes ------------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class Hasher:
    """64-bit polynomial hashes of any spans of a byte array, in constant time per span."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self._inverse = _power(n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * power[:n], out=self._sum[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self._sum[ends] - self._sum[starts]) * self._inverse[starts]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64))


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of true flags in each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """Row index of each item, of the rows' first items."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
