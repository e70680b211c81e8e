"""Audit of filters that are applied one after the other, in every order.

Filters of a text (null: empty; words are maximal runs of other than ASCII white space, case kept); a text fails

* A with fewer than 100 words,
* B with fewer than 80 distinct words in 100,
* C with more than 10 of ``[A-Z]`` in 100 code points,
* D with any of ``#$%&*|``,
* E if a row with a smaller doc_id, anywhere in the table, has the identical text.

E is found without moving texts that occur once.  A counting Bloom sketch, cut into shards so that it grows with the
table, takes every text's hash: each task counts its own rows, the counts (2 stands for more) are added shard by
shard, and a hash with a slot that was counted once belongs to one row only.  Texts of the other hashes are grouped
by their whole text for the smallest doc_id.  The five flags of a row are a mask; the number of rows by part and mask
(with and without the labels) is all that the 120 orders need.

A null lang counts as the empty part.  A row without doc_id fails E never and makes no other row fail; rows with the
same doc_id do not make each other fail, each counts as a row of its own, and of several labels of a doc_id the
largest counts.  Empty tables give no row; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, chunks, documents, mix, scratch_table

FILTERS = "ABCDE"
WORDS, DISTINCT, CAPITALS = 100, 80, 10
#: Hashes a shard is made for, its slots, and the slots of a hash.
SHARD, SLOTS, TIMES = 1 << 16, 1 << 20, 3
UPPER, SIGNS = bytes(range(65, 91)), b"#$%&*|"
TRAILING = bytes(range(0x80, 0xC0))


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails; ``bytes.split`` cuts at just the white space meant here."""
    words = text.split()
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, TRAILING)))
    return (len(words) < WORDS) | (100 * len(set(words)) < DISTINCT * len(words)) << 1 | \
        (100 * (len(text) - len(text.translate(None, UPPER))) > CAPITALS * points) << 2 | \
        (len(text.translate(None, SIGNS)) < len(text)) << 3


def _masks(names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            masks = pa.array(np.fromiter(map(text_mask, texts), np.int32, len(texts)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), masks], [*names, "mask"])

    return rows


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, part, text (null: empty) and the text's hash."""
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return own.withColumn("hash", F.xxhash64("text"))


def flagged(docs: DataFrame) -> DataFrame:
    """A narrow row for each row of ``docs``: doc_id, part, hash of the text, mask of A to D."""
    return hashed(docs).mapInArrow(_masks(["doc_id", "part", "hash"]), "doc_id bigint, part string, hash bigint, mask int")


def slots(hashes: np.ndarray) -> np.ndarray:
    """(TIMES, n): the slots of each hash in its shard."""
    at = [mix(hashes.astype(np.uint64) * MIX + np.uint64(k)) >> np.uint64(44) for k in range(1, TIMES + 1)]
    return np.array(at, np.int64).reshape(TIMES, len(hashes))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (mix(hashes.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _distinct(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a task and how often they occur, 2 standing for more."""
    hashes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    waiting, size = [], 0

    def merged():
        every = np.concatenate([hashes, *waiting])
        weight = np.concatenate([counts, np.ones(len(every) - len(counts), np.int64)])
        unique, back = np.unique(every, return_inverse=True)
        return unique, np.minimum(2, np.bincount(back, weight, len(unique)).astype(np.int64))

    for batch in batches:
        waiting.append(batch.column("hash").to_numpy())
        size += batch.num_rows
        if size >= 1 << 20:
            (hashes, counts), waiting, size = merged(), [], 0
    return merged()


def _partial(shards: int):
    """A task's counts by shard, sparse: sorted slots (4 bytes each), then their counts (1 byte each)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = _distinct(batches)
        shard = shard_of(hashes, shards)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        for k in np.flatnonzero(np.diff(ends)):
            own = order[ends[k]:ends[k + 1]]
            # A hash whose slots coincide counts once in that slot.
            keys = np.sort(slots(hashes[own]), axis=0)
            first = np.concatenate([np.ones((1, len(own)), bool), keys[1:] != keys[:-1]])
            used, back = np.unique(keys[first], return_inverse=True)
            total = np.bincount(back, np.broadcast_to(counts[own], keys.shape)[first], len(used))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int64()), pa.array([used.astype(np.uint32).tobytes() +
                                                      np.minimum(2, total).astype(np.uint8).tobytes()], pa.binary())],
                ["shard", "counts"])

    return rows


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the counts of each shard as they arrive; a bit of the result is a slot counted twice or more.

    Memory holds one byte a slot for each shard of the task.
    """
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column("shard").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            n = len(part) // 5
            at, total = np.frombuffer(part, np.uint32, n), found.setdefault(k, np.zeros(SLOTS, np.uint8))
            total[at] = np.minimum(2, total[at] + np.frombuffer(part, np.uint8, n, 4 * n))
    for k, total in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(total > 1).tobytes()], pa.binary())],
                                         ["shard", "often"])


def _keys(shards: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, _ = _distinct(batches)
        yield pa.RecordBatch.from_arrays([pa.array(shard_of(hashes, shards)), pa.array(hashes)], ["shard", "hash"])

    return rows


def _left(keys: pd.DataFrame, sketch: pd.DataFrame) -> pd.DataFrame:
    """Hashes of a shard none of whose slots was counted once."""
    hashes = np.unique(keys["hash"].to_numpy(np.int64))
    often = np.unpackbits(np.frombuffer(sketch["often"].iloc[0], np.uint8)).astype(bool)
    return pd.DataFrame({"hash": hashes[often[slots(hashes)].all(axis=0)]})


def possible_repeats(rows: DataFrame, n: int) -> DataFrame:
    """Hashes of ``rows`` that may occur in more than one row; a hash that is not among them occurs in one.

    ``n`` is the number of rows.  A hash reaches its shard once from each task, however many rows have it.
    """
    shards = max(1, -(-n // SHARD))
    sketch = (rows.select("hash").mapInArrow(_partial(shards), "shard bigint, counts binary")
              .repartition("shard").mapInArrow(_merged, "shard bigint, often binary"))
    keys = rows.select("hash").mapInArrow(_keys(shards), "shard bigint, hash bigint")
    return keys.groupBy("shard").cogroup(scratch_table(sketch, "sketch").groupBy("shard")).applyInPandas(_left, "hash bigint")


def first_ids(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The smallest doc_id of each text whose hash is among ``hashes``: hash, text, first; equality is that of whole texts."""
    own = hashed(docs.where(F.col("doc_id").isNotNull())).join(hashes, "hash", "left_semi")
    return own.groupBy("hash", "text").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))


def later_copies(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (of :func:`flagged`, written) with the bit of E in their mask."""
    hashes = scratch_table(possible_repeats(rows, rows.count()), "repeats")
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    groups = first_ids(docs, hashes).groupBy("hash").agg(
        F.count("*").alias("texts"), F.min("first").alias("first"), F.sum("rows").alias("rows"))
    groups = scratch_table(groups.where("rows > 1"), "firsts")
    alike, mixed = groups.where("texts = 1").select("hash", "first"), groups.where("texts > 1").select("hash")
    out = rows.join(alike, "hash", "left").withColumn("mask", F.col("mask") + 16 * late).drop("first")
    if mixed.isEmpty():
        return out
    # Different texts of one hash: their rows are told apart by the text itself.
    odd = (hashed(docs).join(mixed, "hash", "left_semi")
           .mapInArrow(_masks(["doc_id", "part", "hash", "text"]), "doc_id bigint, part string, hash bigint, text string, mask int")
           .join(first_ids(docs, mixed).drop("rows"), ["hash", "text"], "left").withColumn("mask", F.col("mask") + 16 * late))
    return out.join(mixed, "hash", "left_anti").unionByName(odd.select(*out.columns))


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part with arrays over the 32 masks: rows, those of good quality, those that are toxic.

    ``labels`` has doc_id, quality, toxic; sums add up, so any split of the rows gives the same.
    """
    own = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    cells = rows.join(own, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))

    def over_masks(name: str):
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(name))), F.lit(0)) for m in range(32)]).alias(name)

    return cells.groupBy("part").agg(over_masks("n"), over_masks("good"), over_masks("bad"))


def order_steps(part: str, n: np.ndarray, good: np.ndarray, bad: np.ndarray) -> pd.DataFrame:
    """The 600 rows of a part from its 32 counts."""
    masks = np.arange(32)
    fails = np.bitwise_count(masks)
    rows = []
    for order in permutations(range(5)):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            here, earlier = (masks & bit > 0) & (masks & before == 0), (masks & bit > 0) & (masks & before > 0)
            rows.append((part, "".join(FILTERS[k] for k in order), step, n[masks & (before | bit) == 0].sum(), n[here].sum(),
                         n[earlier].sum(), n[bit], good[here].sum(), bad[here].sum(),
                         # Each of a row's filters is the first of them in as many orders as any other.
                         (n[masks & bit > 0] * (120 // fails[masks & bit > 0])).sum()))
            before |= bit
    return pd.DataFrame(rows, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                       "good_lost", "toxic_lost", "shapley"])


def _steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part, *counts in frame[["part", "n", "good", "bad"]].itertuples(index=False):
            yield order_steps(part, *(np.asarray(x, np.int64) for x in counts))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows by part, order and step; ``docs`` has doc_id, text, lang."""
    rows = later_copies(docs, scratch_table(flagged(docs), "flags"))
    return mask_counts(rows, labels).mapInPandas(
        _steps, "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
                "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by language."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(documents(spark, sf_dir).select("doc_id", "text", "lang"), labels)


OP12_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           [w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS words
    FROM documents
), marks AS (
    SELECT doc_id, part,
           CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
    FROM texts
), known AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
    FROM labels GROUP BY doc_id
), cells AS (
    SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad
    FROM marks LEFT JOIN known USING (doc_id) GROUP BY part, mask
), letters AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
           [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit,
           coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier
    FROM orders, range(1, 6) AS r(step)
), gone AS (
    SELECT part, filter_order, step, bit,
           coalesce(sum(n) FILTER (WHERE mask & (earlier | bit) = 0), 0) AS kept,
           coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0), 0) AS removed,
           coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & earlier > 0), 0) AS redundant,
           coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
           coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0), 0) AS good_lost,
           coalesce(sum(bad) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0), 0) AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM gone
"""
