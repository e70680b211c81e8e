"""Terms of many texts at once: words come as arrays from the text expressions; Arrow numbers them and numpy counts words and pairs.

A term is a word or a pair of neighbouring words that stay after the stop words, as in :func:`functions.text.terms`.  In a
task a term is one number, made of the numbers of its words, so counting sorts numbers; strings are built once a term.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms and words a task keeps before it passes its sums on, and rows that leave it together.
TERMS, WORDS, ROWS = 1_500_000, 1_000_000, 100_000


def _numbered(lists: pa.Array, stop: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and word number of all words of a list array but the stop words, and the words by number."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    known, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    kept = ~pc.is_in(known, value_set=pa.array(stop, known.type)).to_numpy(zero_copy_only=False)[ids]
    return np.repeat(np.arange(len(lists)), lengths)[kept], ids[kept], known


def _codes(owner: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and term number of all words and pairs: a word's own number, pairs above 2^32; numbers below 0 have no term."""
    ids = ids.astype(np.int64)
    single = ids >= 0
    pair = (owner[1:] == owner[:-1]) & single[1:] & single[:-1]
    return (np.concatenate([owner[single], owner[1:][pair]]),
            np.concatenate([ids[single], (ids[:-1][pair] + 1 << 32) | ids[1:][pair]]))


def _starts(changes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], changes])) if len(changes) else np.zeros(1, np.int64)


def _texts(codes: np.ndarray, words: pa.Array) -> pa.Array:
    """The terms of numbers; words first, as the numbers are sorted."""
    n = int(np.searchsorted(codes, 1 << 32))
    second = words.take(pa.array(codes & 0xFFFFFFFF))
    pairs = pc.binary_join_element_wise(words.take(pa.array((codes[n:] >> 32) - 1)), second.slice(n), " ")
    return pa.concat_arrays([second.slice(0, n), pairs])


def _bits(values: np.ndarray) -> int:
    """Bits of the greatest of some numbers, none of them negative."""
    return int(values.max()).bit_length() if len(values) else 0


def _dense(code: np.ndarray, bits: int) -> np.ndarray:
    """Term numbers whose word numbers have at most ``bits`` bits, with nothing between the two words; in the same order."""
    return code >> 32 << bits | code & 0xFFFFFFFF


class _Sums:
    """Documents and occurrences by (term, group) of a task, as sorted numbers; all of them leave when they are many."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.groups: dict[object, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, lists: pa.Array, groups: list | None, stop: list[str]) -> None:
        owner, ids, known = _numbered(lists, stop)
        place = np.fromiter((self.words.setdefault(w, len(self.words)) for w in known.to_pylist()), np.int64, len(known))
        self.count(owner, place[ids], groups)

    def count(self, owner: np.ndarray, ids: np.ndarray, groups: list | None) -> None:
        """Adds words by row and by their number in ``words``."""
        owner, code = _codes(owner, ids)
        if not len(code):
            return
        group = np.zeros(int(owner.max()) + 1, np.int64)
        if groups is not None:
            group = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in groups), np.int64, len(groups))
        # Rows stay in order within a term and group, so documents are counted where the row changes.
        word, place, row = len(self.words).bit_length(), _bits(group), _bits(owner)
        if 2 * word + 1 + place + row <= 63:  # One number holds all three: numbers are sorted much faster than their order is.
            key = np.sort((_dense(code, word) << place | group[owner]) << row | owner)
            pair = key >> row
            at, other = _starts(pair[1:] != pair[:-1]), key[1:] != key[:-1]
            pair = pair[at]
            code, own = pair >> place, pair & (1 << place) - 1
            code = code >> word << 32 | code & (1 << word) - 1
        else:
            order = np.lexsort((group[owner], code))
            code, owner = code[order], owner[order]
            own = group[owner]
            new = (code[1:] != code[:-1]) | (own[1:] != own[:-1])
            at, other = _starts(new), new | (owner[1:] != owner[:-1])
            code, own = code[at], own[at]
        rows = np.add.reduceat(np.concatenate([[1], other.astype(np.int64)]), at)
        self.parts.append((code, own, rows, np.diff(np.append(at, len(other) + 1))))
        self.size += len(at)

    def merge(self) -> None:
        if len(self.parts) < 2:
            return
        code, group, rows, total = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        word, place = len(self.words).bit_length(), _bits(group)
        # The parts are sorted runs, which a stable sort only merges.
        packed = 2 * word + 1 + place <= 63
        order = np.argsort(_dense(code, word) << place | group, kind="stable") if packed else np.lexsort((group, code))
        code, group = code[order], group[order]
        at = _starts((code[1:] != code[:-1]) | (group[1:] != group[:-1]))
        self.parts = [(code[at], group[at], np.add.reduceat(rows[order], at), np.add.reduceat(total[order], at))]
        self.size = len(at)

    def drained(self) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Groups by number; numbers of terms, sorted, and of their groups, documents and occurrences; only words are kept."""
        self.merge()
        found, groups = self.parts[0] if self.parts else (np.zeros(0, np.int64),) * 4, list(self.groups)
        self.groups, self.parts, self.size = {}, [], 0
        return groups, *found

    def leave(self) -> Iterator[tuple[pa.Array, list, np.ndarray, np.ndarray]]:
        """Terms, their groups, documents and occurrences; nothing is kept."""
        groups, code, group, rows, total = self.drained()
        words, self.words = pa.array(list(self.words), pa.string()), {}
        for a in range(0, len(code), ROWS):
            part = slice(a, a + ROWS)
            yield _texts(code[part], words), [groups[g] for g in group[part]] if groups else [], rows[part], total[part]


def _statistics(stop: list[str], group: str | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kind = _Sums(), None

        def sent():
            for term, groups, df, total in sums.leave():
                own = [pa.array(groups, kind)] if group else []
                yield pa.RecordBatch.from_arrays([*own, term, pa.array(df), pa.array(total)], [*([group] if group else []), "term", "df", "total"])

        for batch in batches:
            if group:
                kind = batch.column(group).type
            sums.add(batch.column("words"), batch.column(group).to_pylist() if group else None, stop)
            if sums.size > TERMS:
                sums.merge()
            if sums.size > TERMS // 2 or len(sums.words) > WORDS:
                yield from sent()
        yield from sent()

    return rows


def statistics(docs: DataFrame, words: Column, stop_words: list[str], group: str | None = None) -> DataFrame:
    """``(term, df, total)``, or by ``group`` too: documents with the term, and all its occurrences; ``words`` as of
    :func:`functions.text.term_words`.

    A task adds up its documents and sends one row a term (bounded by TERMS, then it starts anew), so no text is shuffled.
    """
    own = [group] if group else []
    shape = ", ".join([*(f"`{g}` {docs.schema[g].dataType.simpleString()}" for g in own), "term string", "df bigint", "total bigint"])
    found = docs.select(*own, words.alias("words")).mapInArrow(_statistics(list(stop_words), group), shape)
    # A task's terms differ already: a sum before the shuffle would only fill memory.
    return found.repartition(*own, "term").groupBy(*own, "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Values, sorted by row, as a list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def _in_rows(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and count of each cell, sorted by both."""
    bits = _bits(code)
    if len(code) and bits + _bits(owner) <= 63:
        key = np.sort(owner.astype(np.int64) << bits | code)
        at = _starts(key[1:] != key[:-1])
        return key[at] >> bits, key[at] & (1 << bits) - 1, np.diff(np.append(at, len(key)))
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    if not len(code):
        return owner, code, np.zeros(0, np.int64)
    at = _starts((owner[1:] != owner[:-1]) | (code[1:] != code[:-1]))
    return owner[at], code[at], np.diff(np.append(at, len(code)))


def counted(words: Column, stop_words: list[str]) -> Column:
    """``array<struct<term, tf>>``, each term of a text once."""
    stop = list(stop_words)

    @F.arrow_udf("array<struct<term:string,tf:bigint>>")
    def counts(lists: pa.Array) -> pa.Array:
        owner, ids, known = _numbered(lists, stop)
        owner, code, tf = _in_rows(*_codes(owner, ids))
        order = np.argsort(code, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        term = _texts(code[order], known).take(pa.array(back))
        return _lists(owner, len(lists), pa.StructArray.from_arrays([term, pa.array(tf)], ["term", "tf"]))

    return counts(words)


class Index:
    """The terms of a bounded vocabulary by number; goes to the tasks as a broadcast."""

    def __init__(self, terms: list[str]):
        self.terms = terms

    @cached_property
    def _tables(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words of the terms, and all terms as sorted numbers with their places."""
        words: dict[str, int] = {}
        found: dict[int, int] = {}
        for place, term in enumerate(self.terms):
            own = [words.setdefault(w, len(words)) for w in (term or "").split(" ")]
            if len(own) <= 2:
                found[own[0] if len(own) == 1 else (own[0] + 1 << 32) | own[1]] = place
        code = np.array(sorted(found), np.int64)
        return pa.array(list(words), pa.string()), code, np.array([found[c] for c in code.tolist()], np.int64)

    def __getstate__(self):
        return {"terms": self.terms}

    def cells(self, lists: pa.Array, stop: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term's place and count of all known terms, sorted by both."""
        return self.placed(*_numbered(lists, stop))

    def placed(self, owner: np.ndarray, ids: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of words by row and number; ``known`` are the words by number."""
        words, codes, places = self._tables
        # A word of no known term keeps its neighbours apart.
        number = pc.fill_null(pc.index_in(known, value_set=words.cast(known.type)), -1).to_numpy(zero_copy_only=False)
        owner, code = _codes(owner, number[ids])
        if not len(codes):
            return owner[:0], code[:0], code[:0]
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = codes[at] == code
        return _in_rows(owner[hit], places[at[hit]])


def known_counts(sent, words: Column, stop_words: list[str]) -> Column:
    """``struct<ids, tf>``: the places of a text's known terms, ascending, and their counts; ``sent`` is a broadcast :class:`Index`."""
    stop = list(stop_words)

    @F.arrow_udf("struct<ids:array<int>,tf:array<double>>")
    def counts(lists: pa.Array) -> pa.Array:
        owner, place, tf = sent.value.cells(lists, stop)
        n = len(lists)
        return pa.StructArray.from_arrays([_lists(owner, n, pa.array(place.astype(np.int32))), _lists(owner, n, pa.array(tf.astype(float)))],
                                          ["ids", "tf"])

    return counts(words)


class Weighted(Index):
    """An index with the idf of each term, and with coefficients for contributions."""

    def __init__(self, terms: list[str], idf: list[float], coef: list[float] | None = None):
        super().__init__(terms)
        self.idf, self.coef = np.array(idf, float), None if coef is None else np.array(coef, float)

    def __getstate__(self):
        return {"terms": self.terms, "idf": self.idf, "coef": self.coef}

    @cached_property
    def _names(self) -> pa.Array:
        return pa.array(self.terms, pa.string())

    def weights(self, lists: pa.Array, stop: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term's place and TF-IDF of all known terms: sublinear counts, unit length a row."""
        owner, place, tf = self.cells(lists, stop)
        x = (1 + np.log(tf)) * self.idf[place]
        length = np.sqrt(np.bincount(owner, x * x, len(lists)))
        return owner, place, x / np.where(length > 0, length, 1)[owner]


def weights(sent, words: Column, stop_words: list[str]) -> Column:
    """``struct<indices, weights>`` of the known terms of a text; ``sent`` is a broadcast :class:`Weighted`."""
    stop = list(stop_words)

    @F.arrow_udf("struct<indices:array<int>,weights:array<double>>")
    def placed(lists: pa.Array) -> pa.Array:
        owner, place, x = sent.value.weights(lists, stop)
        n = len(lists)
        return pa.StructArray.from_arrays([_lists(owner, n, pa.array(place.astype(np.int32))), _lists(owner, n, pa.array(x))],
                                          ["indices", "weights"])

    return placed(words)


def named_weights(sent, words: Column, stop_words: list[str], name: str, scaled: bool = False) -> Column:
    """``array<struct<name, term>>`` of the known terms of a text, the weight times the coefficient if ``scaled``."""
    stop = list(stop_words)

    @F.arrow_udf(f"array<struct<{name}:double,term:string>>")
    def placed(lists: pa.Array) -> pa.Array:
        table: Weighted = sent.value
        owner, place, x = table.weights(lists, stop)
        values = x * table.coef[place] if scaled else x
        return _lists(owner, len(lists), pa.StructArray.from_arrays([pa.array(values), table._names.take(pa.array(place))], [name, "term"]))

    return placed(words)
