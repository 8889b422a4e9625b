"""Shared pieces of the training-data operators: scratch tables, Arrow sizes, vectorised word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word contract: \x20 and \x09-\x0D.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_U64 = (1 << 64) - 1
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches, for texts may be long: by rows, and by bytes where Spark has that setting. All operators use the same bounds,
    so what a plan runs with does not depend on which was built last; those that need smaller pieces slice them in the task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def batches_of(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over bounded batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sedimenta-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts the lineage: writes df below the shared folder and reads it back. The shuffle files of the write go as soon as it is done, for
    the table stands for itself then."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sedimenta/{tag}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was) if was is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


_memories: dict[str, Callable[[], None]] = {}


def sole_memory(name: str = "", forget: Callable[[], None] | None = None) -> None:
    """Called where a task begins: a worker process that served another operator gives up what that one remembers across tasks."""
    for other, f in _memories.items():
        if other != name:
            f()
    if forget:
        _memories[name] = forget


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function whose worker gives freed memory back to the system when a task ends, for workers are kept and wait beside others."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return go


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def clean_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have, for helper columns beside columns of any name."""
    name, taken = wanted, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


# ---------------------------------------------------------------- vectorised words

_rng = np.random.default_rng(20240607)
_LETTER = _rng.integers(1, _U64, size=256, dtype=np.uint64, endpoint=True)
_LETTER[65:91] = _LETTER[97:123]  # A-Z fold to a-z
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        m = max(n, 1 << 18)
        up, down = np.full(m, _P, np.uint64), np.full(m, _PINV, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary array; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if offs else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offs


def slices(offs: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about `most` bytes, one row at least."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (relative to offs[0]) of all words, and for each row the index of its first word."""
    base = offs[0]
    body, rel = data[base : offs[-1]], offs - base
    if not len(body):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = _IS_WORD[body]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cut = rel[:-1]
    before[cut[cut < len(body)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    cut = rel[1:]
    after[cut[cut > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, rel)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words with A-Z folded to a-z, and for each row the index of its first word.

    A random value per byte times a power per place, summed; equal words have equal hashes wherever they stand.
    """
    starts, ends, first = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    body = data[offs[0] : offs[-1]]
    up, down = _power_tables(len(body) + 1)
    sums = np.empty(len(body) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_LETTER[body] * up[: len(body)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), first


def hash_words(words: list[bytes]) -> np.ndarray:
    """The same hashes for single words that are already apart."""
    offs = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]) if words else np.zeros(1, np.int64)
    hashes, first = word_hashes(np.frombuffer(b"".join(words), np.uint8), offs)
    if len(hashes) != len(words):
        raise ValueError("each must be one word")
    return hashes
