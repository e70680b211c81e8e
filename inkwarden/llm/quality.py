"""Quality of a text: random-indexing word vectors pooled per document, then a small two-layer network.

Tokens are runs of letters and digits (case kept) and runs of other visible characters.  Each token falls into
one of ``BUCKETS`` buckets; a bucket has a sparse random index vector.  The context vector of a bucket is the sum
of the index vectors of the tokens up to ``REACH`` places away, over all documents: every task adds up its own
matrix, and blocks of those matrices are added in two rounds.  A document is the mean of its tokens' unit context
vectors, their spread, and the share of tokens that are new in it.  A network with one hidden layer, trained on a
bounded sample of labelled rows, gives a logit; a temperature fitted on a part kept apart calibrates it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, chunks, column_texts, crc_mod, documents, ends_of, mix, sample_share

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
BUCKETS, DIM, NONZERO, REACH = 1 << 14, 24, 2, 2
BLOCK = 256
#: Tokens whose vectors are added at once, so that they stay in a core's cache.
POOLED = 512


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every bucket's index vector."""
    h = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def tokens(texts: list[str], table: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens of all texts, one text after the other, and the number of tokens of each."""
    words = [TOKEN.findall(x.encode()) for x in texts]
    hashes = table.of([w for part in words for w in part])
    return (hashes >> np.uint64(50)).astype(np.int64), np.array([len(w) for w in words], np.int64)


def add_contexts(total: np.ndarray, buckets: np.ndarray, lengths: np.ndarray) -> None:
    places, signs = index_vectors()
    owner = np.repeat(np.arange(len(lengths)), lengths)
    for gap in range(1, REACH + 1):
        near = owner[gap:] == owner[:-gap]
        a, b = buckets[:-gap][near], buckets[gap:][near]
        for k in range(NONZERO):
            for word, other in ((a, b), (b, a)):
                total += np.bincount(word * DIM + places[other, k], signs[other, k], BUCKETS * DIM)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, table = np.zeros(BUCKETS * DIM), WordHashes()
    for batch in chunks(batches, 2000, size=4_000_000):
        add_contexts(total, *tokens(column_texts(batch), table))
    yield from _blocks(dict(enumerate(total.reshape(-1, BLOCK * DIM))))


def _blocks(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    rows = [(k, zlib.crc32(zlib.compress(v.tobytes(), 1)) & 15, zlib.compress(v.tobytes(), 1))
            for k, v in found.items() if v.any()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                      pa.array([r[2] for r in rows], pa.binary())], ["block", "salt", "part"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the parts of each block as they arrive; memory holds one sum per block."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            values = np.frombuffer(zlib.decompress(part))
            found[k] = found[k] + values if k in found else values
    yield from _blocks(found)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors (BUCKETS, DIM), counted over all texts of ``docs``; sums of whole numbers, so exact."""
    shape = "block int, salt int, part binary"
    parts = docs.select("text").mapInArrow(_contexts, shape)
    once = parts.repartition("block", "salt").mapInArrow(_added, shape)
    total = np.zeros((BUCKETS // BLOCK, BLOCK * DIM))
    for row in once.repartition("block").mapInArrow(_added, shape).toLocalIterator():
        total[row["block"]] += np.frombuffer(zlib.decompress(row["part"]))
    total = total.reshape(BUCKETS, DIM)
    return (total / np.maximum(1e-9, np.linalg.norm(total, axis=1, keepdims=True))).astype(np.float32)


def with_squares(vectors: np.ndarray) -> np.ndarray:
    """The vectors and, beside each, the squares of its entries; doubles, so sums need no conversion."""
    return np.hstack([vectors, vectors * vectors]).astype(np.float64)


def pooled(texts: list[str], squared: np.ndarray, table: WordHashes) -> np.ndarray:
    """(texts, 2 * DIM + 2): mean and spread of the token vectors (of :func:`with_squares`), share of new tokens, log of the length."""
    buckets, lengths = tokens(texts, table)
    total, kinds = np.zeros((len(texts), squared.shape[1])), np.zeros((len(texts), 1), np.int64)
    seen = np.zeros(BUCKETS, np.int64)
    ends = ends_of(lengths)
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        own = buckets[a:b]
        for start in range(0, len(own), POOLED):
            total[i] += squared[own[start:start + POOLED]].sum(axis=0)
        # Each of a text's buckets holds the place of one of its tokens, so the tokens that find their own place are the kinds.
        place = np.arange(a, b)
        seen[own] = place
        kinds[i] = np.count_nonzero(seen[own] == place)
    count = np.maximum(1, lengths)[:, None]
    mean, spread = np.hsplit(total / count, 2)
    return np.hstack([mean, np.sqrt(np.maximum(0, spread - mean * mean)), kinds / count, np.log1p(lengths)[:, None] / 10])


@dataclass
class Model:
    """Standardisation, two layers and the temperature; ``temperature`` is None without training rows."""

    vectors: np.ndarray
    middle: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float | None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.middle) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.temperature is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, *, hidden: int = 16, steps: int = 1500, batch: int = 256,
        rate: float = 0.01, decay: float = 1e-4, apart: float = 0.2, seed: int = 11) -> Model:
    """Adam on the cross entropy; the share ``apart`` of the rows only chooses the temperature."""
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    model = Model(vectors, x.mean(axis=0) if len(x) else np.zeros(n), x.std(axis=0) + 1e-6 if len(x) else np.ones(n),
                  rng.standard_normal((n, hidden)) / np.sqrt(n), np.zeros(hidden), rng.standard_normal(hidden) * 0.1,
                  0.0, None)
    if not len(x):
        return model
    order = rng.permutation(len(x))
    cut = int(len(x) * apart)
    held, own = order[:cut], order[cut:]
    params = [model.w1, model.b1, model.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    xs = (x - model.middle) / model.scale
    for step in range(1, steps + 1):
        at = own[rng.integers(0, len(own), min(batch, len(own)))]
        a = np.tanh(xs[at] @ params[0] + params[1])
        d = (1 / (1 + np.exp(-np.clip(a @ params[2] + params[3][0], -40, 40))) - y[at]) / len(at)
        back = d[:, None] * params[2] * (1 - a * a)
        for p, g, m, v in zip(params, [xs[at].T @ back, back.sum(axis=0), a.T @ d, np.array([d.sum()])], first, second,
                              strict=True):
            g = g + decay * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    model.b2 = float(params[3][0])
    logit, label = (model.logits(x[held]), y[held]) if cut else (np.zeros(1), np.zeros(1))
    loss = lambda t: np.logaddexp(0, np.where(label == 1, -logit, logit) / t).mean()
    model.temperature = float(min(np.geomspace(0.3, 10, 60), key=loss)) if cut else 1.0
    return model


def _pool(vectors):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, squared = WordHashes(), with_squares(vectors.value)
        for batch in chunks(batches, 500, size=2_000_000):
            x = pooled(column_texts(batch), squared, table)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())],
                                             ["label", "x"])

    return rows


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 10000, **options) -> Model:
    """A model from texts of ``docs`` (doc_id, text) whose ``doc_id`` has a ``label`` 0 or 1 in ``labels``.

    Word vectors cover all texts.  The network takes about ``sample_rows`` labelled rows (all, if fewer), chosen
    by a hash of doc_id; that bound also bounds the broadcast of their labels.
    """
    vectors = word_vectors(docs)
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "label")
    picked = sample_share(known, sample_rows, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    got = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", F.col("label").cast("int"))
           .mapInArrow(_pool(shared), "label int, x binary").toPandas().sort_values(["label", "x"]))
    x = np.array([np.frombuffer(r) for r in got["x"]]).reshape(-1, 2 * DIM + 2)
    return fit(vectors, x, got["label"].to_numpy(), **options)


def _score(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, squared = WordHashes(), with_squares(model.value.vectors)
        for batch in chunks(batches, 500, size=2_000_000):
            p = model.value.probabilities(pooled(column_texts(batch), squared, table))
            own = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(p), pa.array(np.where(p >= 0.3, 1, 0).astype(np.int32))],
                                             [*batch.schema.names, "score", "predicted"])

    return rows


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.3 on).

    Null and empty texts are scored as a text without tokens; without training rows every score is 0.
    Columns of these names that ``docs`` has already are replaced.
    """
    kept = docs.drop("score", "predicted")
    shape = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema),
                       "score double", "predicted int"])
    return kept.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), shape)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned without the fold whose crc32(doc_id) modulo 5 is 0."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").where(crc_mod("doc_id", 5) != 0)
    model = train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    held_out = (crc_mod("doc_id", 5) == 0).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", "predicted")
