"""Exact sliding-window admission: a hit is admitted while fewer than ``limit`` admitted hits of its key lie in the
last ``seconds`` (inclusive).

Each admission depends on the ones before it, but little of the work does.  Hits of one moment are counted before the
shuffle; moments are range-sorted by (key, time), so a key with most rows spreads over many tasks, and packed into
blocks of sorted times; one ordered pass per key jumps through its blocks from one admission to the next moment that
may be admitted, and skips blocks in which nothing can be; the admitted moments then meet the hits again by id, spread
evenly.  The pass reads 16 bytes a distinct moment and holds one Arrow batch of blocks and ``limit`` times.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed

#: Moments in a block: a batch of 10,000 blocks stays near 80 MB.
BLOCK = 512
ADMISSIONS = "key string, us bigint, admitted bigint, recent array<bigint>"
STATE = "key string, recent array<bigint>"
_BLOCKS = "key string, first bigint, times binary, counts binary, recent array<bigint>"


def timed_hits(hits: DataFrame, key: str, ts: str) -> DataFrame:
    """``key, us, hit_id``: a null key is a key of its own, a hit without a time is never admitted."""
    return hits.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
                       F.col("hit_id").cast("bigint").alias("hit_id"))


def _first_hits(hits: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` hits of each moment, cut in every task before the shuffle."""
    place = F.row_number().over(W.partitionBy("key", "us").orderBy("hit_id"))
    return hits.where("us is not null").withColumn("place", place).where(F.col("place") <= limit)


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        keys, times = frame["key"], frame["us"].to_numpy("<i8")
        counts = frame["n"].to_numpy("<i8")
        changes = np.flatnonzero((keys != keys.shift()).to_numpy())
        ends = np.append(changes[1:], len(frame))
        cuts = [(i, min(i + BLOCK, b)) for a, b in zip(changes, ends, strict=True) for i in range(a, b, BLOCK)]
        yield pd.DataFrame({
            "key": [keys.iat[a] for a, _ in cuts], "first": [int(times[a]) for a, _ in cuts],
            "times": [times[a:b].tobytes() for a, b in cuts], "counts": [counts[a:b].tobytes() for a, b in cuts],
            "recent": [None] * len(cuts)})


def _passing(limit: int, span: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def admit(recent: list[int], times: np.ndarray, counts: np.ndarray, note: Callable) -> list[int]:
        i = 0
        while True:
            if len(recent) >= limit:
                i = max(i, int(np.searchsorted(times, recent[len(recent) - limit] + span, "right")))
            if i >= len(times):
                break
            now = int(times[i])
            recent = [t for t in recent if now - t <= span]
            room = min(limit - len(recent), int(counts[i]))
            note(now, room)
            for _ in range(room):
                bisect.insort(recent, now)
            i += 1
        return [t for t in recent if int(times[-1]) - t <= span]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = object()
        key, recent = nothing, []
        for frame in frames:
            rows = []
            for name, times, counts, start in zip(frame["key"], frame["times"], frame["counts"], frame["recent"],
                                                  strict=True):
                if name != key:
                    if key is not nothing:
                        rows.append((key, None, None, recent))
                    key, recent = name, []
                if times is None:
                    recent = sorted(int(t) for t in start)
                else:
                    recent = admit(recent, np.frombuffer(times, "<i8"), np.frombuffer(counts, "<i8"),
                                   lambda now, room, name=name: rows.append((name, now, room, None)))
            yield _frame(rows)
        if key is not nothing:
            yield _frame([(key, None, None, recent)])

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["key", "us", "admitted", "recent"], dtype=object)
        return out.astype({"us": "Int64", "admitted": "Int64"})

    return run


def admissions(hits: DataFrame, limit: int, seconds: int = fixed.BURST_SECONDS,
               recent: DataFrame | None = None) -> DataFrame:
    """How many hits of each moment are admitted (``key, us, admitted``), and per key one row with ``recent``, the
    admitted times that still count after its last hit.  ``recent`` given are those of an earlier call."""
    if limit < 1:
        raise ValueError("the limit must be at least 1")
    moments = _first_hits(hits, limit).groupBy("key", "us").agg(F.count("*").alias("n"))
    blocks = moments.repartitionByRange("key", "us").sortWithinPartitions("key", "us").mapInPandas(_packed, _BLOCKS)
    if recent is not None:
        # A state row sorts before every block of its key.
        blocks = blocks.unionByName(recent.select("key", F.lit(-2 ** 63).cast("bigint").alias("first"), "recent"),
                                    allowMissingColumns=True)
    ordered = blocks.repartition("key").sortWithinPartitions("key", "first")
    return ordered.mapInPandas(_passing(limit, seconds * 1_000_000), ADMISSIONS)


def decisions(hits: DataFrame, admitted: DataFrame, limit: int) -> DataFrame:
    """``key, hit_id, admitted`` of every hit; of one moment the smallest ids are admitted.  ``hit_id`` is unique."""
    moments = admitted.where("us is not null").select(
        F.col("key").alias("_key"), F.col("us").alias("_us"), F.col("admitted").alias("_n"))
    same: Column = F.col("key").eqNullSafe(F.col("_key")) & (F.col("us") == F.col("_us"))
    let = _first_hits(hits, limit).join(moments, same).where("place <= _n").select(
        F.col("hit_id"), F.lit(True).alias("_let"))
    return hits.join(let, "hit_id", "left").select(
        "key", "hit_id", F.coalesce("_let", F.lit(False)).alias("admitted"))


def admit(hits: DataFrame, key: str, ts: str, limit: int, seconds: int = fixed.BURST_SECONDS) -> DataFrame:
    """``key, hit_id, admitted`` for a table of hits."""
    rows = timed_hits(hits, key, ts)
    return decisions(rows, admissions(rows, limit, seconds), limit)
