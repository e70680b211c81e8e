"""Byte-level BPE with Spark's higher-order functions.

A text is split by the tokenizer's pattern.  A word's bytes are written as hexadecimal pieces; ``aggregate`` folds
merges over them: of all neighbouring pieces the pair with the lowest rank is joined, the leftmost of equals, until
none has a rank.  Ranks stand in a literal map, split into buckets by crc32, since Spark searches a map in order.
The most frequent distinct words of a bounded sample are folded beforehand and looked up in a second literal map;
all other words are folded where they stand, so the sample never changes a result.  Decoding joins the binary
pieces of the ids.

``encode_in_tasks`` is the same fold in numpy, over many words at once: each task keeps the ids of the distinct words it
has met.  The higher-order form is right but too slow for the limits of the check (see README), so the query takes this one.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, column_texts, documents, sample_share
from .encoders import ranks_of, tokenizer_file

BUCKETS = 1 << 14
#: Rank of a pair that is no token.
NONE = 1 << 30


def java_pattern(pattern: str) -> str:
    r"""The pattern for Java, whose ``\s`` knows ASCII white space only."""
    return pattern.replace(r"[^\s", r"[^\p{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def ascii_pattern(pattern: str) -> str:
    r"""The pattern for texts in ASCII and an engine without ``\p``: letters, digits and white space are written out."""
    for a, b in ((r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]"), (r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"), (r"\S", r"[^\t-\r ]"),
                 (r"\s", r"[\t-\r ]")):
        pattern = pattern.replace(a, b)
    return pattern


def bucketed(entries: dict[str, object], value: str) -> Column:
    """A literal array of maps; an entry stands in the map of its key's crc32."""
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for key, item in entries.items():
        maps[zlib.crc32(key.encode()) % BUCKETS][key] = item
    return F.from_json(F.lit(json.dumps(maps, ensure_ascii=False)), f"array<map<string,{value}>>")


def looked_up(maps: Column, key: Column) -> Column:
    return F.try_element_at(F.get(maps, (F.crc32(key.cast("binary")) % BUCKETS).cast("int")), key)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(word: Column, ranks: Column) -> Column:
    """Ids (array<int>) of one word by ranked merges."""
    rank = lambda piece: F.coalesce(looked_up(ranks, piece), F.lit(NONE))
    text = F.hex(word.cast("binary"))
    # The first and last piece are marks that no rank holds, so every merge has neighbours on both sides.
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.substr(text, i * 2 - 1, F.lit(2)))
    pieces = F.concat(F.array(F.lit("<")), bytes_, F.array(F.lit(">")))
    pairs = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1),
                                  lambda i: rank(F.concat(F.get(p, i - 1), F.get(p, i))))
    start = let(pieces, lambda p: F.struct(p.alias("p"), pairs(p).alias("r")))

    def step(state: Column) -> Column:
        p, r = state["p"], state["r"]

        def joined(at: Column) -> Column:  # 1-based place of the pair in r
            return let(F.concat(F.get(p, at - 1), F.get(p, at)), lambda piece: F.struct(
                F.concat(F.slice(p, F.lit(1), at - 1), F.array(piece), F.slice(p, at + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), at - 2),
                         F.array(rank(F.concat(F.get(p, at - 2), piece)), rank(F.concat(piece, F.get(p, at + 1)))),
                         F.slice(r, at + 2, F.size(r))).alias("r")))

        return let(F.array_min(r), lambda least: F.when(least == NONE, state).otherwise(
            let(F.array_position(r, least).cast("int"), joined)))

    done = F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), start, lambda state, _: step(state),
                       lambda state: F.slice(state["p"], F.lit(2), F.size(state["p"]) - 2))
    whole = looked_up(ranks, text)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(done, rank))


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def known_words(docs: DataFrame, ranks: Column, pattern: str, *, sample_rows: int = 20000,
                kept: int = 1 << 16) -> dict[str, list[int]]:
    """Ids of the ``kept`` most frequent words of about ``sample_rows`` texts: a bounded memory of folded words."""
    picked = sample_share(docs.select("doc_id"), sample_rows, "doc_id").distinct()
    sample = docs.join(F.broadcast(picked), "doc_id").select(F.explode(words_of(F.col("text"), pattern)).alias("word"))
    common = sample.groupBy("word").count().orderBy(F.desc("count"), "word").limit(kept).repartition("word")
    return {r["word"]: r["ids"] for r in common.select("word", folded(F.col("word"), ranks).alias("ids")).toLocalIterator()}


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, **memory) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) with ``ids`` (array<int>); a null or empty text has none.

    A column ``ids`` that ``docs`` has already is replaced.  Repeated rows stay; nothing is shuffled but the words of
    the sample.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    table = ranks_of(path or tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    ranks = bucketed({k.hex().upper(): v for k, v in table.items()}, "int")
    known = bucketed(known_words(docs, ranks, pattern, **memory), "array<int>")
    ids = F.flatten(F.transform(words_of(F.col("text"), pattern),
                                lambda w: F.coalesce(looked_up(known, w), folded(w, ranks))))
    return docs.withColumn("ids", ids)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The bytes of ids."""
    table = ranks_of(path or tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    pieces = [""] * (max(table.values()) + 1)
    for piece, rank in table.items():
        pieces[rank] = piece.hex().upper()
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""))


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: of all neighbouring pieces the pair with the lowest rank is joined, the leftmost of equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    pieces = [word[i:i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i:i + 2], NONE) for i in range(len(word) - 1)]
    while pairs:
        least = min(pairs)
        if least == NONE:
            break
        at = pairs.index(least)
        joined = pieces[at] + pieces[at + 1]
        pieces[at:at + 2] = [joined]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(pieces[at - 1] + joined, NONE)
        if at < len(pairs):
            pairs[at] = ranks.get(joined + pieces[at + 1], NONE)
    return [ranks[p] for p in pieces]


class Pairs:
    """The same fold over ids, for many words of one length at once.

    ``keys`` are the pairs of ids that make a token, ascending, each as one number, and ``joined`` the tokens they make;
    ``single`` has the ids of the 256 bytes, ``double`` those of all pairs of bytes, NONE where a pair is no token.
    """

    #: Fewer words of a length are folded one by one.
    FEW = 16

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, get = ranks, ranks.get
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.joined = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.double = np.array([get(bytes([i, j]), NONE) for i in range(256) for j in range(256)], np.int64)

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The token of each pair of ids, NONE where they make none."""
        if not len(self.keys):
            return np.full(len(first), NONE)
        keys = first << 32 | second
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.joined[at], NONE)

    def _folded(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and ids of the rows of ``raw``, words of two or more bytes; each round joins one pair of every row left."""
        left, ids = np.arange(len(raw)), self.single[raw]
        pairs = self.double[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]]
        while True:
            at = pairs.argmin(axis=1)
            least = pairs[np.arange(len(left)), at]
            done = least == NONE
            if done.any():
                yield left[done], ids[done]
                left, ids, pairs, at, least = (x[~done] for x in (left, ids, pairs, at, least))
            if not len(left):
                return
            rows, width = np.arange(len(left)), ids.shape[1] - 1
            ids[rows, at] = least
            place = np.arange(width)
            ids = np.take_along_axis(ids, place + (place > at[:, None]), axis=1)
            if width == 1:
                yield left, ids
                return
            pairs = np.take_along_axis(pairs, place[:-1] + (place[:-1] >= at[:, None]), axis=1)
            some = np.flatnonzero(at > 0)
            pairs[some, at[some] - 1] = self.of(ids[some, at[some] - 1], least[some])
            some = np.flatnonzero(at < width - 1)
            pairs[some, at[some]] = self.of(least[some], ids[some, at[some] + 1])

    def folds(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each of the words, as :func:`fold` gives them."""
        out: list[list[int]] = [[]] * len(words)
        lengths: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[i] = [whole]
            else:
                lengths.setdefault(len(word), []).append(i)
        for length, places in lengths.items():
            if len(places) < self.FEW or length < 2:
                for i in places:
                    out[i] = fold(words[i], self.ranks)
                continue
            raw = np.frombuffer(b"".join([words[i] for i in places]), np.uint8).reshape(-1, length)
            for at, ids in self._folded(raw):
                for i, own in zip(at.tolist(), ids.tolist(), strict=True):
                    out[places[i]] = own
        return out


class Words(dict):
    """Of distinct words the number of ids, the ids as text, and the bytes that the ids decode to.

    The words of some texts are learned together (:meth:`learn`).  At a bound all words become ``older`` and those before
    them are forgotten, so a task's memory stays bounded and a frequent word, which comes back from the older ones, is
    folded once.

    A run of one character can make a word of any length; its fold takes quadratic time in the length, so such
    words, over ``LONG`` bytes, are folded with a heap of pairs instead, and are not kept.
    """

    LONG = 256

    def __init__(self, pairs: Pairs, pieces: list[bytes], bound: int = 200_000):
        super().__init__()
        self.pairs, self.pieces, self.bound = pairs, pieces, bound
        self.names = [str(i) for i in range(len(pieces))]
        self.older: dict[str, tuple[int, str, bytes]] = {}

    def entry(self, ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), ",".join([self.names[i] for i in ids]), b"".join([self.pieces[i] for i in ids])

    def learn(self, texts: list[list[str]]) -> None:
        """Keeps all words of texts that have at most LONG bytes."""
        if len(self) >= self.bound:
            self.older = dict(self)
            self.clear()
        new, raws = [], []
        for word in set().union(*texts).difference(self):
            known = self.older.get(word)
            if known is not None:
                self[word] = known
                continue
            raw = word.encode()
            if len(raw) <= self.LONG:
                new.append(word)
                raws.append(raw)
        self.update(zip(new, map(self.entry, self.pairs.folds(raws)), strict=True))

    def __missing__(self, word: str) -> tuple[int, str, bytes]:
        raw = word.encode()
        return self.entry(fold(raw, self.pairs.ranks) if len(raw) <= self.LONG else fold_long(raw, self.pairs.ranks))


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same as ``fold`` with a heap: pairs leave it by rank, then place; stale ones are passed over."""
    import heapq

    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    piece = [word[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if piece[i] else n
        if j >= n or len(piece[i]) + len(piece[j]) != size:
            continue
        piece[i] += piece[j]
        piece[j] = b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(piece[a] + piece[b])) is not None:
                heapq.heappush(heap, (r, a, len(piece[a]) + len(piece[b])))
    return [ranks[p] for p in piece if p]


@lru_cache(maxsize=2)
def _table(path: str) -> tuple[Pairs, list[bytes]]:
    ranks = ranks_of(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return Pairs(ranks), pieces


def _digested(path: str, pattern: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pairs, pieces = _table(path)
        split, plain, words = regex.compile(pattern).findall, re.compile(ascii_pattern(pattern)).findall, Words(pairs, pieces)
        for batch in chunks(batches, 500, size=2_000_000):
            out, texts = [], [(plain if text.isascii() else split)(text) for text in column_texts(batch)]
            words.learn(texts)
            for text in texts:
                found = list(map(words.__getitem__, text))
                told = hashlib.sha256(",".join([x[1] for x in found]).encode()).hexdigest()
                out.append((sum([x[0] for x in found]), told, hashlib.sha256(b"".join([x[2] for x in found])).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()),
                 pa.array([r[2] for r in out], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows


def encode_in_tasks(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs`` (doc_id, text); null texts are empty."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = path or tokenizer_file("byte_bpe_multi_50k.tiktoken")
    return docs.select("doc_id", "text").mapInArrow(
        _digested(path, pattern), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def digests(docs: DataFrame) -> DataFrame:
    """The same columns by higher-order functions."""
    encoded = encode(docs.select("doc_id", "text"))
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids")), 256).alias("decoded_sha256"))


def op10_byte_pairs(spark, sf_dir: str) -> DataFrame:
    """Every document encoded, digested and decoded again."""
    return encode_in_tasks(documents(spark, sf_dir))
