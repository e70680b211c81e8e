"""Token counts of sections: whole documents are encoded once and tokens are joined to sections by their spans.

Sections tile a text: one ends after a line break or after a sentence mark, each with all white space behind it.
They are classed as headings, list or table rows, prose, or blank.  A token covers the characters of its bytes (one
that begins or ends inside a character covers that character); most sentences begin with a token that also holds
the space before them.  A token that crosses a boundary is allocated by
``rule``: ``first`` (the section of its first character), ``most`` (the section with most of its characters, the
earlier of equals) or ``share`` (to each section by its part of the characters).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, column_texts, documents
from .encoders import encoding_of, tokenizer_file

RULES = ("first", "most", "share")
BOUND = re.compile(r"[.!?]\s+|\n\s*")
ROW = re.compile(r"\s*(?:[-*+\u2022]\s|\d+[.)]\s)|[^\n]*\|")
KINDS = ("blank", "row", "heading", "prose")


def kind_of(line: str) -> str:
    """Kind of a line: blank; a list item or a line with a column bar; a heading, which has 60 characters at most
    and no sentence mark at its end; or prose."""
    bare = line.strip()
    if not bare:
        return "blank"
    if ROW.match(line):
        return "row"
    return "heading" if len(bare) <= 60 and bare[-1] not in ".,;:!?" else "prose"


def sections(text: str) -> tuple[list[str], np.ndarray]:
    """Kinds of the sections of a text and their bounds (one more than kinds); none for an empty text."""
    bounds = [0, *(m.end() for m in BOUND.finditer(text))]
    if bounds[-1] < len(text):
        bounds.append(len(text))
    return [kind_of(text[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], np.array(bounds, np.int64)


def token_spans(text: str, byte_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of every token, from the bytes that each one stands for."""
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(byte_lengths)
    if len(raw) == len(text):
        return ends - byte_lengths, ends
    place = np.cumsum((raw & 0xC0) != 0x80) - 1
    return place[ends - byte_lengths], place[ends - 1] + 1


def allocate(first: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens allocated to each section, and those that cross a boundary and touch it."""
    n = len(bounds) - 1
    left = np.searchsorted(bounds, first, "right") - 1
    right = np.searchsorted(bounds, end - 1, "right") - 1
    whole = left == right
    out = np.bincount(left[whole], minlength=n).astype(float)
    first, end, left, right = first[~whole], end[~whole], left[~whole], right[~whole]
    # One row for each section that a crossing token touches.
    many = right - left + 1
    token = np.repeat(np.arange(len(many)), many)
    section = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many) + left[token]
    inside = np.minimum(end[token], bounds[section + 1]) - np.maximum(first[token], bounds[section])
    if rule == "share":
        out += np.bincount(section, inside / (end - first)[token], n)
    elif rule == "first":
        out += np.bincount(left, minlength=n)
    elif len(token):
        order = np.lexsort((section, -inside, token))
        chosen = order[np.concatenate([[True], np.diff(token[order]) > 0])]
        out += np.bincount(section[chosen], minlength=n)
    return out, np.bincount(section, minlength=n)


COLUMNS = ("doc_id bigint, section int, kind string, start bigint, `end` bigint, tokens double, "
           "crossing bigint, doc_tokens bigint")


def _count(path: str, rule: str):
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    names = [c.split()[0].strip("`") for c in COLUMNS.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(path)
        sizes = np.array([len(encoding.decode_single_token_bytes(i)) for i in range(encoding.n_vocab)], np.int64)
        for batch in chunks(batches, 1000):
            out = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), column_texts(batch), strict=True):
                kinds, bounds = sections(text)
                ids = encoding.encode_to_numpy(text, disallowed_special=())
                if not kinds:
                    continue
                tokens, crossing = allocate(*token_spans(text, sizes[ids]), bounds, rule)
                k = len(kinds)
                for column, values in zip(out, ([doc_id] * k, range(k), kinds, bounds[:-1].tolist(), bounds[1:].tolist(),
                                                tokens.tolist(), crossing.tolist(), [len(ids)] * k), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return rows


def section_tokens(docs: DataFrame, path: str | None = None, rule: str = "most") -> DataFrame:
    """One row per section of every row of ``docs`` (doc_id, text): its span and its tokens by ``rule``.

    The tokens of a document's sections add up to its ``doc_tokens``.  A null or empty text has no sections;
    repeated rows are counted each for itself.  No rows are shuffled.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = path or tokenizer_file("byte_bpe_50k.tiktoken")
    return docs.select("doc_id", "text").mapInArrow(_count(path, rule), COLUMNS)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of all sections of all documents."""
    return section_tokens(documents(spark, sf_dir))
