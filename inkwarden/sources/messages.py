"""Raw message files as tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _as_messages(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(name.alias("msg_id"), "path", "length", "content")


def read_messages(spark: SparkSession, path: str, max_bytes: int = fixed.MAX_MESSAGE_BYTES,
                  pattern: str = "*.eml", recursive: bool = True) -> DataFrame:
    """``msg_id, path, length, content``.

    The size filter is pushed into the file source, so the content of an oversized file is
    never read; its row comes from a second scan without the content column and goes to
    review.  Files that vanish or cannot be read are skipped.
    """
    reader = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
              .option("recursiveFileLookup", str(recursive).lower())
              .option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true"))
    usable = reader.load(path).where(F.col("length") <= max_bytes)
    oversized = reader.load(path).where(F.col("length") > max_bytes).select(
        "path", "length", F.lit(None).cast("binary").alias("content"))
    return _as_messages(usable).unionByName(_as_messages(oversized))


def stream_messages(spark: SparkSession, path: str, batch_cap: int = fixed.MAX_PER_BATCH,
                    pattern: str = "*.eml") -> DataFrame:
    """New message files as a stream, at most ``batch_cap`` per batch."""
    files = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
             .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", batch_cap)
             .option("recursiveFileLookup", "true").load(path))
    return _as_messages(files)
