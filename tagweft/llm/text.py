"""What the operators share: Arrow text columns as numpy bytes, hashes of words, durable tables."""

from __future__ import annotations

import bisect
import ctypes
import functools
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: An odd multiplier for polynomial hashes modulo 2**64, and its inverse.
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: Bytes of text that vectorised code takes at a time; a longer text is taken whole.
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space of the contracts: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def shared_dir(spark) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tagweft-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def durable(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, without the lineage: lost executors don't lose them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Like durable, as Parquet: for wide rows, and for reading single columns, or the rows of one value of `by`, again."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(table: DataFrame) -> None:
    """Deletes the files of a stored table that nothing will read again."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives back to the system what this process has freed; Arrow's pool and the allocator keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def tidy(work):
    """A function of batches that releases memory before and after its work: Python workers outlive their stages, and what
    they keep of one counts beside the JVM's in the next."""

    @functools.wraps(work)
    def run(batches):
        release()
        yield from work(batches)
        release()

    return run


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of each row in them) for runs of rows of about `size` bytes. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    col = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER**i and INVERSE**i for i up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((MULTIPLIER, INVERSE)):
            p = np.full(max(2 * n, CHUNK + 1), np.uint64(base))
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none of them across a row's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(inside)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def apart(found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each span of found overlaps none of base, which is in order of starts."""
    starts = [a for a, _, _ in base]
    ends = list(itertools.accumulate((b for _, _, b in base), max))
    return [not (i := bisect.bisect_left(starts, b)) or ends[i - 1] <= a for a, _, b in found]


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Of which span_hashes takes differences."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes, equal hash, wherever they stand."""
    sums = byte_sums(data) if sums is None else sums
    return mix((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each node's component in the graph with edges a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label
