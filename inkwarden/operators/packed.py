"""Rows of words packed by the thousand, for jobs that read the same texts many times.

A chunk is one row: ``kept``, the other columns of its rows, and as bytes the lengths and word numbers of each text and the
words by number.  Spark moves the bytes as they are and numpy reads them in place, so a pass costs arithmetic on numbers, not
a conversion a word.  Statistics of terms, vocabularies and features are made from chunks, of all views (a text and its
stop words) in one pass; sums of terms travel by hash of the term, as packed tables too.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import written
from . import cells

#: Rows and words of a chunk (one row at least), and parts in which the terms of a view are added up.
ROWS, WORDS, BUCKETS = 1000, 1 << 20, 128

View = tuple[int, tuple[str, ...]]
_CHUNK = "lengths binary, ids binary, offsets binary, letters binary"


def _slices(batch: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
    lengths = sum(pc.fill_null(pc.list_value_length(batch.column(t)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
    start = 0
    while start < batch.num_rows:
        ends = np.cumsum(lengths[start:start + ROWS])
        rows = max(1, int(np.searchsorted(ends, WORDS, "right")))
        yield batch.slice(start, rows)
        start += rows


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(texts: list[str], kept: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, texts):
                lists = [part.column(t) for t in texts]
                lengths = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists]).astype(np.int32)
                coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
                known = coded.dictionary.cast(pa.string())
                _, offsets, letters = known.buffers()
                offsets = np.frombuffer(offsets, np.int32, len(known) + 1) if len(known) else np.zeros(1, np.int32)
                ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
                own = pa.StructArray.from_arrays([part.column(c) for c in kept], kept)
                data = [lengths.tobytes(), ids.tobytes(), offsets.tobytes(), letters.to_pybytes()[:offsets[-1]] if letters else b""]
                yield pa.RecordBatch.from_arrays([_listed(own), *(pa.array([x], pa.binary()) for x in data)],
                                                 ["kept", "lengths", "ids", "offsets", "letters"])

    return rows


def pack(rows: DataFrame, texts: list[str]) -> DataFrame:
    """``rows`` as chunks, written and read again.  ``texts`` name arrays of words, as of :func:`functions.text.term_words`;
    the other columns are kept.  Terms are counted where ``trained`` holds, by ``group`` (a string)."""
    kept = [c for c in rows.columns if c not in texts]
    shape = f"kept array<{rows.select(*kept).schema.simpleString()}>, {_CHUNK}"
    return written(rows.select(*kept, *texts).mapInArrow(_packed(texts, kept), shape))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, list[np.ndarray], list[np.ndarray], pa.Array]]:
    """The kept columns, the lengths and the word numbers of each text, and the words of each chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            kept = batch.column("kept")[i].values
            lengths, ids, offsets, letters = (batch.column(c)[i].as_buffer() for c in ("lengths", "ids", "offsets", "letters"))
            known = pa.StringArray.from_buffers(offsets.size // 4 - 1, offsets, letters)
            lengths = np.frombuffer(lengths, np.int32).reshape(-1, len(kept))
            ends = np.concatenate([[0], np.cumsum(lengths.sum(1, dtype=np.int64))])
            numbers = np.frombuffer(ids, np.int32)
            yield kept, list(lengths), [numbers[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], known


def _left(known: pa.Array, stop: tuple[str, ...]) -> np.ndarray:
    return ~pc.is_in(known, value_set=pa.array(list(stop), known.type)).to_numpy(zero_copy_only=False)


# ---------------------------------------------------------------- statistics


def _sent(table: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def _read(data) -> pa.Table:
    with pa.ipc.open_stream(data) as found:
        return found.read_all()


def _buckets(code: np.ndarray, own: np.ndarray, parts: int) -> np.ndarray:
    """The part of each term, by ``own``, the numbers made of the letters of its words."""
    mixed = own[code & 0xFFFFFFFF]
    pair = code >= 1 << 32
    mixed[pair] += own[(code[pair] >> 32) - 1] * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int16 if parts < 1 << 15 else np.int64)


def _texts(code: np.ndarray, words: pa.Array) -> pa.Array:
    """The terms of numbers in any order."""
    first = words.take(pa.array((code >> 32) - 1, mask=code < 1 << 32))
    return pc.binary_join_element_wise(first, words.take(pa.array(code & 0xFFFFFFFF)), " ", null_handling="skip")


class _Words:
    """The words of a task by number, for all views, with a number made of their letters."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.parts, self.letters = [pa.array([], pa.string())], [np.zeros(0, np.uint64)]

    def add(self, known: pa.Array) -> np.ndarray:
        before, words = len(self.places), known.to_pylist()
        places = np.fromiter((self.places.setdefault(w, len(self.places)) for w in words), np.int64, len(words))
        new = np.flatnonzero(places >= before)
        self.parts.append(known.take(pa.array(new)))
        self.letters.append(np.fromiter((zlib.crc32(words[i].encode()) for i in new.tolist()), np.uint64, len(new)))
        return places

    def whole(self) -> tuple[pa.Array, np.ndarray]:
        self.parts, self.letters = [pa.concat_arrays(self.parts)], [np.concatenate(self.letters)]
        return self.parts[0], self.letters[0]


def _counted(views: list[View], parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = _Words(), [cells._Sums() for _ in views]

        def leaving(v: int) -> Iterator[pa.RecordBatch]:
            groups, code, group, df, total = sums[v].drained()
            if not len(code):
                return
            known, letters = words.whole()
            part = _buckets(code, letters, parts)
            order = np.argsort(part, kind="stable")
            part, group = part[order], pa.array(groups, pa.string()).take(pa.array(group[order]))
            table = pa.RecordBatch.from_arrays([_texts(code[order], known), group, pa.array(df[order]), pa.array(total[order])],
                                               ["term", "group", "df", "total"])
            at = cells._starts(np.diff(part) != 0)
            sizes = np.diff(np.append(at, len(order)))
            data = [_sent(table.slice(a, n)) for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(at), pa.int32()), pa.array(part[at].astype(np.int32)),
                                              pa.array(data, pa.binary())], ["view", "part", "sums"])

        for kept, lengths, ids, known in _chunks(batches):
            trained, groups = kept.field("trained").to_numpy(zero_copy_only=False).astype(bool), kept.field("group").to_pylist()
            if len(words.places) > cells.WORDS:
                for v in range(len(views)):
                    yield from leaving(v)
                words = _Words()
            places = words.add(known)
            for v, (text, stop) in enumerate(views):
                held = np.repeat(trained, lengths[text]) & _left(known, stop)[ids[text]]
                sums[v].words = words.places
                sums[v].count(np.repeat(np.arange(len(kept)), lengths[text])[held], places[ids[text][held]], groups)
                if sums[v].size > cells.TERMS:
                    sums[v].merge()
                if sums[v].size > cells.TERMS // 2:
                    yield from leaving(v)
        for v in range(len(views)):
            yield from leaving(v)

    return rows


def _summed(least: int):
    """Sums by (term, group) of each part of a view, of the terms that ``least`` rows have."""
    def added(parts: list[pa.Table]) -> bytes:
        table = pa.concat_tables(parts).combine_chunks()
        term = table["term"].combine_chunks().dictionary_encode()
        term = pa.concat_arrays(term.chunks) if isinstance(term, pa.ChunkedArray) else term
        group = table["group"].combine_chunks()
        group = (pa.concat_arrays(group.chunks) if isinstance(group, pa.ChunkedArray) else group).dictionary_encode(null_encoding="encode")
        ids, own = term.indices.to_numpy(zero_copy_only=False), group.indices.to_numpy(zero_copy_only=False)
        df, total = table["df"].to_numpy(), table["total"].to_numpy()
        held = np.bincount(ids, df)[ids] >= least
        key, place = np.unique(ids[held].astype(np.int64) * len(group.dictionary) + own[held], return_inverse=True)
        out = [term.dictionary.take(pa.array(key // len(group.dictionary))), group.dictionary.take(pa.array(key % len(group.dictionary))),
               *(pa.array(np.bincount(place, x[held], len(key)).astype(np.int64)) for x in (df, total))]
        return _sent(pa.RecordBatch.from_arrays(out, ["term", "group", "df", "total"]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([added(parts)], pa.binary())], ["view", "sums"])

        for batch in batches:
            for view, part, data in zip(batch.column("view").to_pylist(), batch.column("part").to_pylist(), batch.column("sums"), strict=True):
                if key not in (None, (view, part)):
                    yield done()
                    parts = []
                key = view, part
                parts.append(_read(data.as_buffer()))
        if parts:
            yield done()

    return rows


def statistics(chunks: DataFrame, views: list[View], least: int = fixed.MIN_DOCUMENT_FREQUENCY) -> DataFrame:
    """``(view, sums)``: rows with a term and its occurrences by (term, group) of the trained rows, as packed tables that
    share no term; a term that fewer than ``least`` rows have is in no vocabulary and left out.  One pass for all views; written."""
    parts = max(BUCKETS, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")) // len(views))
    found = chunks.mapInArrow(_counted(views, parts), "view int, part int, sums binary")
    placed = found.repartition("view", "part").sortWithinPartitions("view", "part")
    return written(placed.mapInArrow(_summed(least), "view int, sums binary"))


# ---------------------------------------------------------------- vocabularies


def _by_fit(data, inside: Callable[[list], np.ndarray], sizes: np.ndarray, least: int, share: float):
    """Terms of a packed table, and by fit their rows, their occurrences, and whether they are frequent enough and not too common."""
    table = _read(data)
    term, group = (table[c].combine_chunks() for c in ("term", "group"))
    term, group = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in (term, group))
    term, group = term.dictionary_encode(), group.dictionary_encode(null_encoding="encode")
    ids, own = term.indices.to_numpy(zero_copy_only=False), group.indices.to_numpy(zero_copy_only=False)
    trains, n = inside(group.dictionary.to_pylist()), len(term.dictionary)
    sums = [np.array([np.bincount(ids, np.where(fit[own], table[c].to_numpy(), 0), n) for fit in trains]).reshape(len(trains), n).astype(np.int64)
            for c in ("df", "total")]
    return term.dictionary, *sums, (sums[0] >= least) & (sums[0] <= share * sizes[:, None])


def vocabularies(sums: DataFrame, inside: dict[int, Callable[[list], np.ndarray]], sizes: dict[int, np.ndarray],
                 least: int = fixed.MIN_DOCUMENT_FREQUENCY, share: float = fixed.MAX_DOCUMENT_SHARE,
                 most: int = fixed.MAX_VOCABULARY) -> dict[int, tuple[list[str], np.ndarray]]:
    """By view the terms of any of its fits, in order, and ``(fits, terms)`` the rows with them, 0 outside a fit's vocabulary.

    ``inside[view]`` says which of some groups each fit is trained on, ``sizes[view]`` how many rows that are.  The ``most`` used
    terms stay, ties in the order of the term: the occurrences of terms are counted first, so only terms from the last
    ones that stay, and of those no more than can, reach the driver.
    """
    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for view, data in zip(batch.column("view").to_pylist(), batch.column("sums"), strict=True):
                _, _, total, fits = _by_fit(data.as_buffer(), inside[view], sizes[view], least, share)
                for k in range(len(fits)):
                    value, n = np.unique(total[k][fits[k]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([view] * len(value), pa.int32()), pa.array([k] * len(value), pa.int32()),
                                                      pa.array(value), pa.array(n.astype(np.int64))], ["view", "fit", "total", "n"])

    counts = sums.mapInArrow(used, "view int, fit int, total bigint, n bigint").groupBy("view", "fit", "total").agg(F.sum("n").alias("n")).toPandas()
    # The fewest occurrences of a term that stays, and how many terms with so many do.
    last = {view: np.zeros((len(n), 2), np.int64) for view, n in sizes.items()}
    for (view, k), own in counts.sort_values("total", ascending=False).groupby(["view", "fit"]):
        ends = own["n"].cumsum().to_numpy()
        at = min(int(np.searchsorted(ends, most)), len(ends) - 1)
        last[view][k] = own["total"].iloc[at], min(most, ends[at]) - (ends[at - 1] if at else 0)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for view, data in zip(batch.column("view").to_pylist(), batch.column("sums"), strict=True):
                terms, df, total, fits = _by_fit(data.as_buffer(), inside[view], sizes[view], least, share)
                stays = np.where(fits & (total > last[view][:, :1]), df, 0)
                for k, (value, n) in enumerate(last[view]):
                    same = np.flatnonzero(fits[k] & (total[k] == value))
                    if len(same) > n:
                        order = pc.sort_indices(terms.take(pa.array(same))).to_numpy()
                        same = same[order[:n]]
                    stays[k, same] = -df[k, same]  # below 0: one of those with the fewest occurrences
                held = np.flatnonzero(stays.any(0))
                table = pa.RecordBatch.from_arrays([terms.take(pa.array(held)), *map(pa.array, stays[:, held])],
                                                   ["term", *(f"f{k}" for k in range(len(stays)))])
                yield pa.RecordBatch.from_arrays([pa.array([view], pa.int32()), pa.array([_sent(table)], pa.binary())], ["view", "sums"])

    parts: dict[int, list[pa.Table]] = {view: [] for view in sizes}
    for row in sums.mapInArrow(found, "view int, sums binary").toArrow().to_pylist():
        parts[row["view"]].append(_read(row["sums"]))
    out = {}
    for view, tables in parts.items():
        if not tables:
            out[view] = [], np.zeros((len(sizes[view]), 0), np.int64)
            continue
        table = pa.concat_tables(tables).combine_chunks().sort_by("term")
        df = np.array([table[f"f{k}"].to_numpy() for k in range(len(sizes[view]))]).reshape(len(sizes[view]), len(table))
        for k, (_, n) in enumerate(last[view]):
            df[k, np.flatnonzero(df[k] < 0)[n:]] = 0
        df = np.abs(df)
        held = df.any(0)
        out[view] = table["term"].filter(pa.array(held)).to_pylist(), df[:, held]
    return out


# ---------------------------------------------------------------- features


def lengths_of(base: np.ndarray, values: np.ndarray, ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the sum of its cells' ``base`` times the value of their term; ``starts`` are n + 1 offsets."""
    out, held = np.zeros(n), np.flatnonzero(np.diff(starts))
    if len(held):
        out[held] = np.add.reduceat(base * values[ids], starts[held])
    return out


_LOGS = 1 + np.log(np.maximum(np.arange(1 << 16), 1))


def base_of(tf: np.ndarray) -> np.ndarray:
    """``1 + log tf``; small counts are looked up."""
    return _LOGS[tf] if tf.dtype == np.uint16 else 1 + np.log(tf)


def _features(sent, views: list[View], weigh: Callable[[pa.StructArray], np.ndarray], kept_columns: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, idf, fits = sent.value
        for kept, lengths, ids, known in _chunks(batches):
            weights, n = weigh(kept), len(kept)
            trained = (weights != 0).any(0)
            order = np.argsort(~trained, kind="stable")  # Rows that no fit is trained on go last.
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            inverse, sizes, places, counts = np.zeros(weights.shape), [], [], []
            for v, (text, stop) in enumerate(views):
                left = _left(known, stop)[ids[text]]
                owner, place, tf = indexes[v].placed(np.repeat(rank, lengths[text])[left], ids[text][left], known)
                size = np.bincount(owner, minlength=n)
                starts = np.concatenate([[0], np.cumsum(size)])
                tf = tf.astype(np.uint16 if not len(tf) or tf.max() < 1 << 16 else np.int32)
                for k in fits[v]:
                    length = np.sqrt(lengths_of(base_of(tf) ** 2, idf[k] ** 2, place, starts, n))
                    inverse[k] = 1 / np.where(length > 0, length, 1)
                sizes.append(size.astype(np.int32))
                places.append(place.astype(np.int32).tobytes())
                counts.append(tf.tobytes())
            data = [np.concatenate(sizes).tobytes(), weights[:, order].tobytes(), inverse.tobytes()]
            own = pa.StructArray.from_arrays([kept.field(c) for c in kept_columns], kept_columns).take(pa.array(order))
            yield pa.RecordBatch.from_arrays(
                [_listed(own), pa.array([int(trained.sum())], pa.int32()), *(pa.array([x], pa.binary()) for x in data),
                 pa.array([places], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.binary()))],
                ["kept", "trained", "sizes", "weights", "inverse", "ids", "tf"])

    return rows


def features(chunks: DataFrame, views: list[View], terms: list[list[str]], idf: list[np.ndarray], fits: list[list[int]],
             weigh: Callable[[pa.StructArray], np.ndarray], kept: list[str]) -> DataFrame:
    """What the fits read, a chunk a row, written: the cells of each view (numbers of its ``terms`` and their counts) by row, the
    weights ``weigh`` gives each row in each fit, and one over the length of its TF-IDF there.

    ``idf`` has the idf of a fit's terms, 0 outside its vocabulary, ``fits`` the fits of each view; of the rows' columns ``kept`` stay.
    """
    sent = chunks.sparkSession.sparkContext.broadcast(([cells.Index(t) for t in terms], idf, fits))
    types = {f.name: f.dataType.simpleString() for f in chunks.schema["kept"].dataType.elementType.fields}
    shape = (f"kept array<struct<{','.join(f'{c}:{types[c]}' for c in kept)}>>, trained int, sizes binary, weights binary, inverse binary, "
             "ids array<binary>, tf array<binary>")
    return written(chunks.mapInArrow(_features(sent, views, weigh, kept), shape))


class Cells:
    """One view's cells of a chunk."""

    def __init__(self, sizes: np.ndarray, ids: np.ndarray, tf: np.ndarray):
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.ids, self.tf = ids, tf

    @cached_property
    def base(self) -> np.ndarray:
        return base_of(self.tf)

    def first(self, n: int) -> Cells:
        """Those of the first ``n`` rows."""
        return Cells(self.sizes[:n], self.ids[:self.starts[n]], self.tf[:self.starts[n]])

    def times(self, values: np.ndarray) -> np.ndarray:
        return lengths_of(self.base, values, self.ids, self.starts, len(self.sizes))

    def turned(self, values: np.ndarray, terms: int) -> np.ndarray:
        """By term the sum of its cells times the value of their row."""
        return np.bincount(self.ids, self.base * np.repeat(values, self.sizes), terms)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, int, np.ndarray, np.ndarray, list[Cells]]]:
    """Rows of :func:`features`: kept columns, trained rows (they come first), weights and inverse lengths by fit, cells by view."""
    for batch in batches:
        for i in range(batch.num_rows):
            kept, at = batch.column("kept")[i].values, {c: batch.column(c)[i] for c in batch.schema.names}
            n = len(kept)
            weights, inverse = (np.frombuffer(at[c].as_buffer(), float).reshape(-1, n) for c in ("weights", "inverse"))
            sizes = np.frombuffer(at["sizes"].as_buffer(), np.int32).reshape(-1, n)
            views = []
            for size, ids, tf in zip(sizes, at["ids"].values, at["tf"].values, strict=True):
                ids = np.frombuffer(ids.as_buffer(), np.int32)
                views.append(Cells(size, ids, np.frombuffer(tf.as_buffer(), np.uint16 if tf.as_buffer().size == 2 * len(ids) else np.int32)))
            yield kept, at["trained"].as_py(), weights, inverse, views
