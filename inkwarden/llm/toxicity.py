"""Toxicity of a text: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, lower case.  Features of a text are its distinct words, their stems (the
first four and five bytes), pairs of neighbouring words and pairs with one word between them, each hashed into
``2**bits`` coordinates.  Every
coordinate has its own learning rate; the L1 term leaves few weights other than zero, and only those travel to
the tasks.  A score depends on the text alone, so equal texts get equal scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, chunks, column_texts, crc_mod, documents, mix, release_memory, sample_share

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Multipliers that tell words, neighbours and skip-grams apart.
KINDS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
STEMS = (4, 5)


@dataclass
class Weights:
    """Non-zero weights in ascending order of their coordinate; ``bias`` is None without training rows."""

    bits: int = 20
    places: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    values: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    bias: float | None = None


def features(words: list[bytes], table: WordHashes, bits: int) -> list[tuple[int, np.ndarray]]:
    """Coordinates of a row of words: (reach, places), where place i belongs to words i to i + reach."""
    shift, hashes = np.uint64(64 - bits), table.of(words)
    left = hashes * KINDS[1]
    out = [(0, mix(hashes * KINDS[0])), (1, mix(left[:-1] + hashes[1:])), (2, mix(left[:-2] * KINDS[2] + hashes[2:]))]
    out += [(0, mix(table.of([w[:n] for w in words]) * KINDS[2] + np.uint64(n))) for n in STEMS]
    return [(reach, (x >> shift).astype(np.uint32)) for reach, x in out]


def ftrl(rows: list[np.ndarray], labels: np.ndarray, *, bits: int = 20, alpha: float = 1.0, beta: float = 1.0,
         l1: float = 8.0, l2: float = 0.1, epochs: int = 3, weight: float = 2.0, seed: int = 3) -> Weights:
    """Online training, one text at a time; coordinate ``2**bits`` is the bias, free of the L1 term.

    Toxic texts, the rarer kind, count ``weight`` times.
    """
    if not len(rows):
        return Weights(bits)
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    rng, end = np.random.default_rng(seed), np.uint32(1 << bits)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        limit = np.where(at == end, 0.0, l1)
        return np.where(np.abs(zi) <= limit, 0.0, -(zi - np.sign(zi) * limit) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = np.append(rows[i], end)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[i]
            g *= weight if labels[i] else 1.0
            old = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - old) / alpha * w
    used = np.flatnonzero(n[:-1]).astype(np.uint32)
    w = weights(used)
    return Weights(bits, used[w != 0], w[w != 0].astype(np.float32), float(weights(np.array([end]))[0]))


def _featurise(bits: int):
    """Distinct coordinates of each sampled text, little-endian unsigned 32-bit."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes(200_000)
        for batch in chunks(batches, 500, size=2_000_000):
            data = [np.unique(np.concatenate([p for _, p in features(WORD.findall(x.lower().encode()), table, bits)]))
                    .tobytes() for x in column_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(data, pa.binary())], ["label", "places"])

    return rows


def bounded_choice(sizes: list[tuple], budget: int) -> list[tuple]:
    """Of rows (id, label, bytes), in the order of a hash of the id, those that fit in ``budget`` bytes together.

    A row that does not fit is passed over, so one very long text does not end the choice.
    """
    out, used = [], 0
    for row in sorted(sizes, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0])):
        if used + row[2] <= budget:
            out.append(row)
            used += row[2]
    return out


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 10000, sample_bytes: int = 1 << 26, bits: int = 20,
          **options) -> Weights:
    """Weights from texts of ``docs`` (doc_id, text) whose ``doc_id`` has a ``label`` 0 or 1 in ``labels``.

    The fit takes about ``sample_rows`` labelled rows (all, if fewer), chosen by a hash of doc_id, and of these as many
    as have ``sample_bytes`` of text together; that bounds what reaches the driver, about two bytes of coordinates for
    each byte of text.  All rows of a chosen doc_id are taken.  Of several labels of a document the largest counts.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "label")
    picked = sample_share(known, sample_rows, "doc_id").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sizes = (docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))
             .join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.sum(F.col("size") + 64).alias("size")))
    chosen = bounded_choice([tuple(r) for r in sizes.select("doc_id", "label", "size").collect()], sample_bytes)
    chosen = docs.sparkSession.createDataFrame([r[:2] for r in chosen], "doc_id bigint, label int")
    got = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
           .mapInArrow(_featurise(bits), "label int, places binary").toArrow())
    # The rows stay where Arrow put them; their order depends on their content alone.
    rows = [np.frombuffer(x.as_buffer(), np.uint32) for x in got.column("places")]
    label = got.column("label").to_numpy()
    order = sorted(range(len(rows)), key=lambda i: (label[i], rows[i][:16].tobytes(), zlib.crc32(rows[i]), len(rows[i])))
    out = ftrl([rows[i] for i in order], label[order], bits=bits, **options)
    del got, rows
    release_memory()
    return out


def _score(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Weights = model.value
        table, used = WordHashes(200_000), np.zeros(1 << m.bits, bool)
        used[m.places] = True
        for batch in chunks(batches, 1000, size=2_000_000):
            words = [WORD.findall(x.lower().encode()) for x in column_texts(batch)]
            lengths = np.array([len(w) for w in words], np.int64)
            owner = np.repeat(np.arange(len(words)), lengths)
            found = []
            for reach, places in features([w for part in words for w in part], table, m.bits):
                first, last = owner[:len(places)], owner[reach:]
                at = np.flatnonzero(used[places] & (first == last))
                found.append(first[at].astype(np.uint64) << np.uint64(32) | places[at])
            hits = np.unique(np.concatenate(found))
            who, place = (hits >> np.uint64(32)).astype(np.int64), (hits & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            total = np.bincount(who, m.values[np.searchsorted(m.places, place)], len(words)) if len(hits) \
                else np.zeros(len(words))
            score = np.zeros(len(words)) if m.bias is None else 1 / (1 + np.exp(-np.clip(total + m.bias, -40, 40)))
            own = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(score), pa.array(np.where(score >= 0.5, 1, 0).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"])

    return rows


def score(docs: DataFrame, model: Weights) -> DataFrame:
    """The rows of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null and empty texts get the score of a text without features; without training rows every score is 0.
    Columns of these names that ``docs`` has already are replaced.
    """
    kept = docs.drop("score", "predicted")
    shape = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema),
                       "score double", "predicted int"])
    return kept.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), shape)


def train_on_labels(spark, docs: DataFrame, sf_dir: str, **options) -> Weights:
    """Weights from table ``labels``, without the fold whose crc32(doc_id) modulo 5 is 0."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").where(crc_mod("doc_id", 5) != 0)
    return train(docs, labels.select("doc_id", F.col("toxic").alias("label")), **options)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = (crc_mod("doc_id", 5) == 0).alias("held_out")
    return score(docs, train_on_labels(spark, docs, sf_dir)).select("doc_id", held_out, "score", "predicted")
