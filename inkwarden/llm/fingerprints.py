"""Document fingerprints by winnowing.

Every run of ``K`` code points has a rolling hash; of each window of ``WINDOW`` consecutive hashes the smallest is
kept, of equal ones the rightmost, together with its position.  So any passage of at least ``WINDOW + K - 1`` code
points that two texts share gives both a common mark, and passages shorter than ``K`` give none.  A text with fewer
than ``WINDOW`` runs is one window; a text shorter than ``K`` has one mark, of all of it; an empty text has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, column_texts, documents, mix

K, WINDOW = 16, 32
BASE = 0x100000001B3


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` values: run lengths are doubled, then joined to ``k``."""
    done, hashes, size = None, points.astype(np.uint64), 1
    joined = 0
    while True:
        if k & size:
            if done is None:
                done = hashes
            else:
                power = np.uint64(pow(BASE, size, 1 << 64))
                n = len(points) - joined - size + 1
                done = done[:n] * power + hashes[joined:joined + n]
            joined += size
        if joined == k:
            return mix(done)
        step = np.uint64(pow(BASE, size, 1 << 64))
        hashes = hashes[:-size] * step + hashes[size:]
        size *= 2


def smallest(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of every ``window`` neighbours, by doubling."""
    out, size = keys, 1
    while size * 2 <= window:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:len(keys) - window + 1], out[window - size:]) if window > size else out


def marks(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (unsigned 32-bit) and positions of the marks of a text, in order of position."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    if len(points) < k:
        whole = rolling(np.append(points, len(points)), len(points) + 1)
        return (whole >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)
    low = np.uint64(0xFFFFFFFF)
    hashes = rolling(points, k)
    keys = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    best = smallest(keys, min(window, len(keys)))
    best = best[np.concatenate([[True], best[1:] != best[:-1]])]
    return (best >> np.uint64(32)).astype(np.uint32), (low - (best & low)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the distinct hashes; two empty fingerprints are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def written(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits a mark, in order of position."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with ``hashes`` and ``positions`` (array<bigint>) of the marks of ``text`` (null: none).

    Columns of these names that ``docs`` has already are replaced.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1000):
            found = [marks(x, k, window) for x in column_texts(batch)]
            own = [batch.column(i) for i in range(batch.num_columns)]
            whole = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array([h.astype(np.int64) for h, _ in found], whole), pa.array([p for _, p in found], whole)],
                [*batch.schema.names, "hashes", "positions"])

    kept = docs.drop("hashes", "positions")
    shape = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema),
                       "hashes array<bigint>", "positions array<bigint>"])
    return kept.mapInArrow(rows, shape)


def with_following(docs: DataFrame, parts: int) -> DataFrame:
    """Texts in ``parts`` ranges of doc_id: columns part, guest, doc_id, text, sorted within each part.

    The last row of each part is a ``guest``: the first row of the next part (of the first part, after the last
    one).  So every row's follower stands behind it, and the texts are shuffled once.  The cut points are
    quantiles of doc_id; only they and the numbers of the parts pass through the driver.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    docs = docs.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(set(docs.agg(F.percentile_approx("key", shares or [0.5], max(10000, 20 * parts))).first()[0] or []))

    @F.pandas_udf("int")
    def part_of(keys):
        import pandas as pd
        return pd.Series(np.searchsorted(np.array(cuts, np.int64), keys.to_numpy(), "right").astype(np.int32))

    docs = docs.withColumn("part", part_of("key"))
    firsts = docs.groupBy("part").agg(F.min("key").alias("key"))
    firsts = docs.sparkSession.createDataFrame(firsts.collect() or [], "part int, key bigint")  # one row a part
    numbers = sorted(r["part"] for r in firsts.collect())
    before = [(p, numbers[i - 1]) for i, p in enumerate(numbers)]
    before = docs.sparkSession.createDataFrame(before, "part int, host int")
    guests = (docs.select("key", "doc_id", "text").join(F.broadcast(firsts), "key")
              .groupBy("part", "key", "doc_id").agg(F.min("text").alias("text")).join(F.broadcast(before), "part")
              .select(F.col("host").alias("part"), F.lit(True).alias("guest"), "key", "doc_id", "text"))
    own = docs.select("part", F.lit(False).alias("guest"), "key", "doc_id", "text")
    return (own.union(guests).repartition("part").sortWithinPartitions("part", "guest", "key", "text")
            .select("part", "guest", "doc_id", "text"))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in chunks(batches, 1000):
        rows = []
        for part, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hashes, _ = marks(text)
            if last is not None and last[0] == part:
                _, own_id, own_text, own_hashes = last
                swapped = len(own_text) // 4
                edited = own_text[:len(own_text) - swapped] + text[:swapped]
                other = marks(edited)[0] if swapped else own_hashes
                rows.append((own_id, len(own_text), hashlib.sha256(edited.encode()).hexdigest(), written(own_hashes),
                             written(other), likeness(own_hashes, other), likeness(own_hashes, hashes)))
            last = None if guest else (part, doc_id, text, hashes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def compare_with_following(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of the text whose last quarter is taken over from the next document.

    Order is by doc_id, a null one first, rows of one doc_id by text; after the last comes the first.
    """
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_following(docs, parts).mapInArrow(
        _edited, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                 "edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return compare_with_following(documents(spark, sf_dir))
