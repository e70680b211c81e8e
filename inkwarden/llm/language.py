"""Language of a text: a bidirectional gated recurrent network over bytes that labels every position.

The UTF-8 bytes of a text are cut into segments of ``SEGMENT`` bytes; each starts with a zero state in both
directions, so a text of any length is read whole and in parallel.  At each position the two states give one
probability per language; a document's probabilities are the means over all its bytes that are not ASCII
punctuation, digits or white space.  Gates and candidates use ``x / (1 + |x|)`` (for gates moved to 0..1).
Training is back-propagation through time in numpy over a bounded sample of labelled segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, column_texts, crc_mod, documents, ends_of, sums

SEGMENT = 64
#: Bytes that say nothing about a language: ASCII other than letters, and the padding.
WORDY = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


@dataclass
class Network:
    """``embed`` (2, 3h, 256) holds the input side of both directions with biases, ``back`` (2, 3h, h) the
    recurrent side, ``out`` (classes, 2h) and ``bias`` the position classifier."""

    langs: list[str]
    embed: np.ndarray
    back: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.back, self.out, self.bias]


def segments_of(data: bytes) -> np.ndarray:
    """Rows of SEGMENT bytes, the last one padded with zeros."""
    rows = -(-len(data) // SEGMENT)
    padded = np.zeros(rows * SEGMENT, np.uint8)
    padded[:len(data)] = np.frombuffer(data, np.uint8)
    return padded.reshape(rows, SEGMENT)


def states(net: Network, rows: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (SEGMENT, 2h, rows) of both directions; ``keep`` takes what training needs."""
    n, h = len(rows), net.back.shape[2]
    cols = np.ascontiguousarray(rows.T).astype(np.intp)
    hidden = np.zeros((2, h, n), np.float32)
    x, u = np.empty((2, 3 * h, n), np.float32), np.empty((2, 3 * h, n), np.float32)
    wide, narrow = np.empty((2, 2 * h, n), np.float32), np.empty((2, h, n), np.float32)
    out = np.empty((SEGMENT, 2 * h, n), np.float32)
    for t in range(SEGMENT):
        np.take(net.embed[0], cols[t], axis=1, out=x[0], mode="clip")
        np.take(net.embed[1], cols[SEGMENT - 1 - t], axis=1, out=x[1], mode="clip")
        np.matmul(net.back, hidden, out=u)
        if keep is not None:
            keep.append([hidden.copy(), u[:, 2 * h:].copy()])
        a, b = x[:, :2 * h], u[:, 2 * h:]
        a += u[:, :2 * h]
        np.abs(a, out=wide)
        wide += 1
        a /= wide
        a *= 0.5
        a += 0.5
        b *= a[:, h:]
        b += x[:, 2 * h:]
        np.abs(b, out=narrow)
        narrow += 1
        if keep is not None:
            keep[-1] += [a.copy(), wide.copy(), narrow.copy()]
        b /= narrow
        if keep is not None:
            keep[-1].append(b.copy())
        b -= hidden
        b *= a[:, :h]
        hidden += b
        out[t, :h] = hidden[0]
        out[SEGMENT - 1 - t, h:] = hidden[1]
    return out


def position_probabilities(net: Network, rows: np.ndarray) -> np.ndarray:
    """(SEGMENT, classes, rows): the label probabilities of every position."""
    p = np.matmul(net.out, states(net, rows))
    p += net.bias[:, None]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def gradients(net: Network, rows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy over all wordy positions, by back-propagation through time."""
    n, h = len(rows), net.back.shape[2]
    keep: list = []
    hid = states(net, rows, keep)
    p = np.matmul(net.out, hid) + net.bias[:, None]
    p = np.exp(p - p.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    weight = WORDY[rows].T.astype(np.float32)
    p[:, target, np.arange(n)] -= 1
    p *= (weight / max(1.0, weight.sum()))[:, None]
    g_out, g_bias = np.tensordot(p, hid, ([0, 2], [0, 2])), p.sum(axis=(0, 2))
    g_hid = np.matmul(net.out.T, p)
    g_embed, g_back = np.zeros_like(net.embed), np.zeros_like(net.back)
    carry = np.zeros((2, h, n), np.float32)
    for t in range(SEGMENT - 1, -1, -1):
        before, uc, gates, wide, narrow, c = keep[t]
        carry[0] += g_hid[t, :h]
        carry[1] += g_hid[SEGMENT - 1 - t, h:]
        z, r = gates[:, :h], gates[:, h:]
        d_c = carry * z / narrow ** 2
        d_gate = np.concatenate([carry * (c - before), d_c * uc], axis=1) * 0.5 / wide ** 2
        d_u = np.concatenate([d_gate, d_c * r], axis=1)
        d_x = np.concatenate([d_gate, d_c], axis=1)
        g_back += np.matmul(d_u, before.transpose(0, 2, 1))
        for way, col in ((0, rows[:, t]), (1, rows[:, SEGMENT - 1 - t])):
            hot = np.zeros((n, 256), np.float32)
            hot[np.arange(n), col] = 1
            g_embed[way] += d_x[way] @ hot
        carry = carry * (1 - z) + np.matmul(net.back.transpose(0, 2, 1), d_u)
    return [g_embed, g_back, g_out, g_bias]


def fit(rows: np.ndarray, target: np.ndarray, langs: list[str], *, hidden: int = 8, steps: int = 400,
        batch: int = 128, rate: float = 0.03, seed: int = 5) -> Network:
    """Adam over segments (n, SEGMENT) with class numbers ``target``; every language is drawn equally often."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    net = Network(langs, small(2, 3 * hidden, 256), small(2, 3 * hidden, hidden), small(len(langs), 2 * hidden),
                  np.zeros(len(langs), np.float32))
    if len(langs) < 2 or not len(rows):
        return net
    share = 1 / np.bincount(target, minlength=len(langs))[target]
    share /= share.sum()
    first, second = [np.zeros_like(x) for x in net.arrays()], [np.zeros_like(x) for x in net.arrays()]
    for step in range(1, steps + 1):
        pick = rng.choice(len(rows), batch, p=share)
        now = rate * min(1, step / 20, 2 * (1 - step / (steps + 1)))
        for x, g, m, v in zip(net.arrays(), gradients(net, rows[pick], target[pick]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)
    return net


def _cut(segments: int):
    """Labelled segments of sampled rows, spread evenly over each whole text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, data = [], []
            for text, name in zip(column_texts(batch), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                for s in dict.fromkeys(np.linspace(0, max(0, len(raw) - SEGMENT), segments).astype(int).tolist()):
                    lang.append(name)
                    data.append(raw[s:s + SEGMENT].ljust(SEGMENT, b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(data, pa.binary())],
                                             ["lang", "segment"])

    return cut


def train(labelled: DataFrame, key: str = "doc_id", *, sample_rows: int = 4000, segments: int = 3,
          **options) -> Network:
    """A network from rows with a non-null ``lang``; without such rows it knows no language.

    The languages are all values of ``lang``.  The fit takes about ``sample_rows`` rows of each language (all,
    if fewer), chosen by a hash of the key, and at most ``segments`` segments of each; ``options`` go to ``fit``.
    """
    known = labelled.where(F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return fit(np.empty((0, SEGMENT), np.uint8), np.empty(0, int), langs, **options)
    slots = 1 << 30
    shares = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, sample_rows / len(langs) / counts[k]) * slots))])
    picked = known.where(F.pmod(F.xxhash64(F.lit(7), key), F.lit(slots)) < shares[F.col("lang")])
    got = picked.select("text", "lang").mapInArrow(_cut(segments), "lang string, segment binary").toArrow()
    order = {name: i for i, name in enumerate(langs)}
    target = np.array([order[x] for x in got["lang"].to_pylist()], int)
    rows = np.frombuffer(b"".join(got["segment"].to_pylist()), np.uint8).reshape(-1, SEGMENT)
    place = np.lexsort([*rows.T[::-1], target])  # the order of arrival does not matter
    return fit(rows[place], target[place], langs, **options)


def _label(net: Network, block: int = 2048):
    kinds = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("n_labelled", pa.int64())])

    def score(texts: list[str]) -> list[pa.Array]:
        data = [x.encode() for x in texts]
        rows = np.concatenate([np.empty((0, SEGMENT), np.uint8), *[segments_of(x) for x in data]])
        mass, wordy = np.empty((len(rows), len(net.langs))), WORDY[rows].sum(axis=1)
        for at in range(0, len(rows), block):
            part = rows[at:at + block]
            p = position_probabilities(net, part)
            p *= WORDY[part].T[:, None]
            mass[at:at + block] = p.sum(axis=0).T
        ends = ends_of(np.array([-(-len(x) // SEGMENT) for x in data], int))
        pooled, count = sums(mass, ends), sums(wordy, ends)
        pooled /= np.maximum(count, 1)[:, None]
        best = pooled.argmax(axis=1)
        said = [any(map(str.isalpha, x)) for x in texts]
        return [pa.array([net.langs[k] if ok else "und" for k, ok in zip(best, said, strict=True)], pa.string()),
                pa.array(np.where(said, np.clip(pooled[np.arange(len(best)), best], 0, 1), 0.0)),
                pa.array(count.astype(np.int64))]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1000, size=2_000_000):
            texts = column_texts(batch)
            if net.langs:
                added = score(texts)
            else:
                added = [pa.array(["und"] * len(texts), pa.string()), pa.array(np.zeros(len(texts))),
                         pa.array(np.zeros(len(texts), np.int64))]
            own = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(own + added, [*batch.schema.names, *kinds.names])

    return label


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs`` (with a column ``text``) and ``lang_pred``, ``score``, ``n_labelled`` (labelled positions).

    ``und`` with score 0 for a null or empty text, one without a letter, and for a network without languages.
    Equal texts get equal results; columns of these names that ``docs`` has already are replaced.
    """
    kept = docs.drop("lang_pred", "score", "n_labelled")
    shape = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema),
                       "lang_pred string", "score double", "n_labelled bigint"])
    return kept.mapInArrow(_label(net), shape)


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose crc32(doc_id) modulo 4 is not 2."""
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 4) == 2
    net = train(docs.where(~held_out).select("doc_id", "text", "lang"))
    scored = identify(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_labelled")
