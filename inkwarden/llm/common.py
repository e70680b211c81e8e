"""Shared helpers: tables, scratch tables, bounded label samples, hashing of words inside tasks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame below the shared folder the cluster names and reads it again: the lineage ends there.

    Only where ``spark.checkpoint.dir`` is unset (tests on one machine) a temporary folder is taken.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    path = f"{shared.rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: Column | str, modulus: int) -> Column:
    """crc32 of a key written as text, modulo ``modulus``; a null key counts as the empty text."""
    key = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def sample_share(rows: DataFrame, wanted: int, *on: str) -> DataFrame:
    """About ``wanted`` rows (all, if fewer), chosen by a hash of the columns ``on``: repeatable and not by place.

    It counts the rows first, so give it a frame of narrow columns and join the texts after it.
    """
    share = min(1.0, wanted / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64(F.lit(7), *on), F.lit(1 << 30)) < int(share * (1 << 30)))


def release_memory() -> None:
    """Gives freed memory of this process back to the system: that of Arrow's pool, and of the C heap, which else keeps
    what thousands of small arrays of a fit in the driver took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over an array of uint64."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHashes(dict):
    """Word (bytes) to 64-bit hash; forgets all of them at a bound, so a task's memory stays bounded."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = (zlib.crc32(word) << 32 | zlib.crc32(word[::-1], 0x5BD1E995)) * 0x9E3779B97F4A7C15 & MASK
        value = (value ^ value >> 29) ^ (len(word) * 0xBF58476D1CE4E5B9 & MASK)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def column_texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 2000, text: str = "text",
           size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and about ``size`` bytes of text, one row at least."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(text))
        lengths = np.fromiter((x.as_buffer().size if x.is_valid else 0 for x in sizes), np.int64, len(sizes)) \
            if len(sizes) and batch.nbytes > size else None
        start = 0
        while start < batch.num_rows:
            end = min(batch.num_rows, start + rows)
            if lengths is not None:
                ends = np.cumsum(lengths[start:end])
                end = start + max(1, int(np.searchsorted(ends, size, "right")))
            yield batch.slice(start, end - start)
            start = end


def ends_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets 0, l0, l0+l1, ... of concatenated parts."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each part of concatenated values; an empty part sums to 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def array_parts(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Arrays of doubles as rows (block, salt, part); the salt spreads the parts of a block over some tasks."""
    for block, values in parts.items():
        data = zlib.compress(np.ascontiguousarray(values, np.float64).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.crc32(data) & 15], pa.int32()),
                                          pa.array([data], pa.binary())], ["block", "salt", "part"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the parts of each block as they arrive; memory holds one sum per block."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), strict=True):
            values = np.frombuffer(zlib.decompress(part))
            found[k] = found[k] + values if k in found else values
    yield from array_parts(found)


def added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the arrays of each block over all tasks (rows of :func:`array_parts`), flat.

    Tasks add up what falls to each (block, salt); the driver adds at most 16 arrays for each block.  Whoever calls
    this states why all blocks together are bounded.
    """
    found: dict[int, np.ndarray] = {}
    for row in parts.repartition("block", "salt").mapInArrow(_summed, "block int, salt int, part binary").toArrow().to_pylist():
        values = np.frombuffer(zlib.decompress(row["part"]))
        found[row["block"]] = found[row["block"]] + values if row["block"] in found else values
    return found
