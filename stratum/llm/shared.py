"""What the operators of this subpackage share: staged tables, size-checked joins, and byte-level text handling."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.sources.tables import reread, small_batches  # noqa: F401

#: A word is a run of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Serialized bytes up to which a side of a join is broadcast; beyond that the join shuffles both sides.
BROADCAST_BYTES = 16 << 20


def _give_back() -> None:
    """Free memory goes back to the system: an idle worker otherwise keeps what its largest batch took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library that has no such call
        pass


def tidy(run: Callable) -> Callable:
    """A function over batches that gives memory back when a task's batches are done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return wrapped


def tidy_group(run: Callable) -> Callable:
    """The same for a function over groups, after each."""

    def wrapped(group: pa.Table) -> pa.Table:
        out = run(group)
        _give_back()
        return out

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. It is set here only where the session has none, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints"
    return root.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, and a lost executor loses nothing. Its shuffle files go with it."""
    return reread(df, f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}")


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns of df as one struct named row, so that no name of theirs meets one of an operator's own."""
    return F.struct(*[quoted(c) for c in columns or df.columns]).alias("row")


def unboxed(columns: list[str]) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in columns]


def small_side(df: DataFrame, size: Column | int) -> DataFrame:
    """df, marked for broadcast if its rows take BROADCAST_BYTES at most together; size: bytes of a row. Give a staged df: it is read for this."""
    n = df.agg(F.sum(F.lit(size) if isinstance(size, int) else size)).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def heldout_mod(column: str, mod: int) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def buffers(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values one after the other (null: none), and n + 1 offsets."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    a = values.cast(pa.binary())
    if a.null_count:
        a = a.fill_null(b"")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if a.buffers()[2] is None else np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def slices(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of up to limit bytes, one document at least."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; none crosses an offset."""
    inside = ~_SEP[data]
    before = np.empty(len(data), bool)
    before[1:] = inside[:-1]
    edge = off[(off < len(data))]
    before[edge] = False
    after = np.empty(len(data), bool)
    after[:-1] = inside[1:]
    after[off[off > 0] - 1] = False
    if len(data):
        before[0] = after[-1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


_RANDOM = np.random.default_rng(20240229)
_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


#: Powers that a worker keeps at most; those of a longer text are made for it alone.
KEPT_POWERS = (1 << 20) + (1 << 16)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps))
    if n <= KEPT_POWERS:
        _POWERS[:] = made
    return made[0], made[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Substrings:
    """64-bit hashes of any substrings of a buffer, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Of the k bytes from each position on."""
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)
