"""Packing of token sequences along a space-filling curve.

A document's token counts are hashed into a short vector, projected to ``DIMS`` dimensions and placed on a Hilbert
curve; documents are range-sorted by that key, so similar ones become neighbours, and each range is cut into
sequences of ``LIMIT`` tokens along the curve.  What is left at the end of a range is laid out as sequences whose
lengths are powers of two (its binary digits), which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import chunks, column_texts, documents, scratch_table
from .encoders import encoding_of, tokenizer_file

LIMIT, DIMS, BITS, SLOTS = 2048, 3, 16, 256
END = 1
#: Fixed value: a token of the vocabulary that stands outside its ranks; a text may hold it.
END_OF_TEXT = "<|endoftext|>"


def projection() -> np.ndarray:
    """Fixed normal numbers (SLOTS, DIMS)."""
    return np.random.default_rng(17).standard_normal((SLOTS, DIMS))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dims): axes to transposed index, then bits interleaved."""
    x = points.astype(np.uint32).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(dims):
            high = (x[i] & np.uint32(q)) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, np.uint32(0))
            x[0] ^= swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> np.uint32(bit) & np.uint32(1)).astype(np.int64)
    return key


def curve_keys(rows: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of rows of token ids, by their hashed counts."""
    matrix = projection()
    counts = np.zeros((len(rows), SLOTS))
    for i, ids in enumerate(rows):
        slots = ids.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(24)
        counts[i] = np.bincount(slots, minlength=SLOTS)
    counts = np.sqrt(counts)
    counts /= np.maximum(1e-9, np.linalg.norm(counts, axis=1, keepdims=True))
    places = np.clip((counts @ matrix + 2) / 4, 0, 1) * ((1 << BITS) - 1)
    return hilbert_keys(places.astype(np.uint32))


def _encode(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(path, {END_OF_TEXT: 50256})
        if encoding.n_vocab > 1 << 16:
            raise ValueError("ids are kept in two bytes each")
        for batch in chunks(batches, 500, size=2_000_000):
            ids = [np.append(encoding.encode_to_numpy(x, allowed_special="all"), END).astype("<u2")
                   for x in column_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(curve_keys(ids)), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["doc_id", "key", "ids"])

    return rows


def tail_sizes(n: int) -> list[int]:
    """The powers of two that sum to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def lay(lengths: list[int], sizes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents laid one after the other until ``sizes`` are full."""
    out, doc, start = [], 0, 0
    for sequence, size in enumerate(sizes):
        offset = 0
        while offset < size:
            length = min(size - offset, lengths[doc] - start)
            out.append((doc, start, length, sequence, offset))
            offset, start = offset + length, start + length
            if start == lengths[doc]:
                doc, start = doc + 1, 0
    return out


PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, key bigint")


def _pack(limit: int):
    names = [c.split()[0] for c in PIECES.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[list] = []  # [doc_id, key, ids, start] of what stands in no full sequence yet

        def filled(sizes: list[int]) -> pa.RecordBatch:
            nonlocal sequence, waiting
            out, last = [], (0, 0)
            for d, at, length, number, offset in lay([len(x[2]) - x[3] for x in waiting], sizes):
                doc_id, key, ids, start = waiting[d]
                crc = zlib.crc32(ids[start + at:start + at + length].astype("<u4").tobytes())
                out.append((doc_id, start + at, length, crc, len(ids), sequence + number, offset, key))
                last = (d, at + length)
            sequence += len(sizes)
            if out:
                waiting[last[0]][3] += last[1]
                waiting = [x for x in waiting[last[0]:] if x[3] < len(x[2])]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names)

        for batch in batches:
            for doc_id, key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append([doc_id, key, np.frombuffer(raw, "<u2"), 0])
            yield filled([limit] * (sum(len(x[2]) - x[3] for x in waiting) // limit))
        yield filled(tail_sizes(sum(len(x[2]) - x[3] for x in waiting)))

    return rows


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text), in sequences of at most ``limit`` (a power of two) tokens.

    A document is its token ids and the id 1; a null text is empty, so it has that id alone.  Equal texts and
    rows of one doc_id are packed each for itself; an empty table gives no rows.  Encoded texts are written to a
    scratch table once, so neither sampling the key ranges nor a lost executor tokenises them again.
    """
    path = path or tokenizer_file("byte_bpe_50k.tiktoken")
    encoded = docs.select("doc_id", "text").mapInArrow(_encode(path), "doc_id bigint, key bigint, ids binary")
    encoded = scratch_table(encoded, "encoded")
    ordered = encoded.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return ordered.mapInArrow(_pack(limit), PIECES)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(documents(spark, sf_dir))
