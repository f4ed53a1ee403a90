"""Things that all operators of this subpackage share.

Text rules
----------
``alnum_words``   words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z
``space_words``   words ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z

Both work on UTF-8 bytes: every byte of a non-ASCII character is 0x80 or more,
so a byte table gives the same words as the pattern on characters.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALNUM = bytes(
    LOWER[c] if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32
    for c in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    # bytes.split() without an argument cuts at 0x20 and 0x09-0x0D and nothing else
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
#: bytes hashed at once; every worker keeps 16 bytes for each
_HASHED = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all texts in one, and where each begins (one more than texts). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return b"", np.zeros(1, np.int64)
    large = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data else b""), offsets - offsets[0]


def word_places(texts: pa.Array, table: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts (through table, if given), where each word begins and ends, and each text's first word (one more than texts)."""
    data, offsets = text_bytes(texts)
    raw = np.frombuffer(data.translate(table) if table else data, np.uint8)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    before = np.concatenate([[False], word[:-1]]) if len(raw) else word
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    begins = word & ~before
    begins[inner] = word[inner]
    starts = np.flatnonzero(begins)
    stops = ~word & before
    stops[inner] |= before[inner]
    ends = np.flatnonzero(stops)
    if len(raw) and word[-1]:
        ends = np.append(ends, len(raw))
    return raw, starts, ends, np.searchsorted(starts, offsets)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(_BASE))]))
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)))]))
    return up, down


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, mixed with its length."""
    out = np.zeros(len(starts), np.uint64)
    up, down = _powers(_HASHED)
    with np.errstate(over="ignore"):
        a = 0
        while a < len(starts):
            base = int(starts[a])
            b = max(a + 1, int(np.searchsorted(ends, base + _HASHED, "right")))
            if ends[b - 1] - base <= _HASHED:
                part = raw[base : ends[b - 1]].astype(np.uint64) + np.uint64(1)
                part *= up[: len(part)]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
                out[a:b] = (sums[ends[a:b] - base] - sums[starts[a:b] - base]) * down[starts[a:b] - base]
            else:  # a single word beyond the block
                out[a] = int.from_bytes(hashlib.blake2b(raw[base : ends[a]].tobytes(), digest_size=8).digest(), "little")
            a = b
        return mix(out + (ends - starts).astype(np.uint64) * _STEP)


#: Spark's setting that removes an execution's shuffle files at its end
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset (tests), below a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="bitquarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/bq-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """Writes df below the shared folder and rereads it: lineage is cut and a lost executor costs no recomputation.

    What the write shuffled is removed as it ends, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(written: DataFrame) -> None:
    """Removes the folder of a materialized DataFrame that nothing reads any more."""
    spark = written.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(written.inputFiles()[0]).getParent() if written.inputFiles() else None
    if folder is not None:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps Arrow batches small where the session has the default: texts may be long and Python workers are small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def text_slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows whose texts have about ``most`` bytes, or one row."""
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        raise TypeError("a batch, not a table")
    if not batch.num_rows or col.nbytes <= most:
        yield batch
        return
    sizes = np.diff(np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64))
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def lean(step: Callable) -> Callable:
    """step, with the memory that its batches took given back when a partition ends: Python workers live on."""

    @wraps(step)
    def run(batches):
        try:
            yield from step(batches)
        finally:
            trim()

    return run


def trim() -> None:
    """Gives freed memory of this process back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@lru_cache(1)
def large_apart() -> None:
    """From now on, arrays of 1 MB or more of this process have pages of their own, which go back as each is freed.

    Otherwise the C library raises that limit with the first ones, and what later ones leave stays with the worker.
    """
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


def lean_group(step: Callable[[pa.Table], pa.Table], most: int = 4 << 20) -> Callable[[pa.Table], pa.Table]:
    """step on a group, with the memory that a large one took given back."""

    @wraps(step)
    def run(table):
        large_apart()
        large = table.nbytes > most
        out = step(table)
        del table
        if large:
            trim()
        return out

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
