"""Continuous scoring of new messages with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ops import without_released


def run_scoring(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str,
                checkpoint: str, released: Callable[[], DataFrame] | None = None,
                seconds: int | None = None) -> StreamingQuery:
    """Score every micro-batch and write it below ``out``.

    * ``seconds`` (30 to 3,600) polls continuously; ``None`` takes what is there and ends.
    * Progress lives in the checkpoint, so a restart does not rescan; a batch that runs again
      overwrites its own folder, so it is not stored twice.
    * ``released`` is called inside each batch, after its messages are known: a message that
      someone releases meanwhile is never quarantined again.
    """
    if seconds is not None and not 30 <= seconds <= 3600:
        raise ValueError("the polling interval must lie between 30 and 3,600 seconds")

    def process(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if released is not None:
            rows = without_released(rows, released())
        score(rows).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(
        processingTime=f"{seconds} seconds")
    return writer.start()


def scored_rows(spark, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(out).drop("batch")


def with_content_hash(stream: DataFrame, column: str = "content") -> DataFrame:
    return stream.withColumn("content_sha256", F.sha2(F.col(column).cast("binary"), 256))
