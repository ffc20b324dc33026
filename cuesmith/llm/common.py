"""What the operators share: shared storage, row numbers, the byte-level word scanner, packed shuffles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; bounds the memory of a task whatever the texts' lengths.
STEP = 1 << 21

#: Rows of one Arrow batch; with texts of some KB, a few MB.
BATCH_ROWS = 1000

#: Whether a query's shuffle files are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

U64 = np.uint64


# ---------------------------------------------------------------- shared storage


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a run on one machine uses the temporary folder; a cluster can't."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def save(df: DataFrame, by: str | None = None, free: bool = False) -> DataFrame:
    """df written as a table in shared storage and read again: the lineage ends here and lost executors cost nothing before it.
    free: the shuffles that made it go when it is written, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = scratch(spark)
    writer = df.write
    if by:
        writer = writer.partitionBy(by)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true" if free else before)
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._saved_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Removes tables made by save() that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the session's Arrow batches to BATCH_ROWS, since rows of these tables carry whole texts."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def row_ids(df: DataFrame, name: str = "rid") -> DataFrame:
    """Adds a number that names the row: split index and place in it. df must be a plain scan, so that every reading numbers alike."""
    return df.withColumn(name, F.monotonically_increasing_id())


# ---------------------------------------------------------------- bytes and words

#: \x20 and \x09-\x0D end words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _byte_codes(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


BYTE = _byte_codes(20231)
BYTE_LOWER = BYTE[LOWER]
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Powers:
    """BASE ** i and its inverse, as far as a step has needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                up, down = np.full(n, BASE, U64), np.full(n, BASE_INVERSE, U64)
                up[0] = down[0] = 1
                self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, one after another, and the offsets of each row (null: empty), without a copy of the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` bytes together; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+ in data, and for each row the number of words before it."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = inside[firsts]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each of the ascending spans: a polynomial from running sums, then mixed with the length."""
    out = np.empty(len(starts), U64)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            base = starts[first]
            last = max(first + 1, int(np.searchsorted(ends, base + STEP, side="right")))
            stop = ends[first:last].max()
            up, down = POWERS.get(int(stop - base) + 1)
            total = np.zeros(stop - base + 1, U64)
            np.cumsum(codes[data[base:stop]] * up[: stop - base], out=total[1:])
            s, e = starts[first:last] - base, ends[first:last] - base
            out[first:last] = (total[e] - total[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
            first = last
    return mix(out)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of h[i:i+n] for each i; the caller leaves out windows that cross texts."""
    if len(h) < n:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, U64)
        for j in range(n):
            out = out * BASE + h[j : len(h) - n + 1 + j]
        return mix(out + U64(n))


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = 5, codes: np.ndarray = BYTE_LOWER) -> Iterator[np.ndarray]:
    """For each text its n-word shingles' hashes in order; a text of fewer words has its whole sequence as one, one without words none."""
    for first, last in steps(offsets):
        at = offsets[first : last + 1]
        part = data[at[0] : at[-1]]
        starts, ends, cut = words_of(part, at - at[0])
        h = span_hashes(part, starts, ends, codes)
        w = window_hashes(h, n)
        for i in range(last - first):
            a, b = cut[i], cut[i + 1]
            if b - a >= n:
                yield w[a : b - n + 1]
            elif b > a:
                yield window_hashes(h[a:b], int(b - a))
            else:
                yield h[:0]
