"""A hidden Markov language model over words.

Tokens of a text (null: empty) are its runs of other than ASCII white space with A-Z in lower case, then one end.
Words are counted over all training texts.  The ``LISTED`` most frequent ones are emissions of their own; all others,
with what was never seen, are one more emission, within which a word of count c has the share
``(c + 1) / (N' + V' + 1)`` (N', V': tokens and words of that class).  So the model is a distribution over all words,
and with one state it is the unigram model ``(c + 1) / (N + V + 1)``.

Training is Baum-Welch: a task adds up the expected starts, transitions and emissions of its texts, cut into pieces of
``PIECE`` tokens that start from a distribution of their own; the tasks' counts are added in rounds, and only the
(emissions x states) sums reach the driver.  Every round reads all training texts.  Scores are exact: a piece of a text becomes the product of its transition and
emission matrices, all pieces of a batch at once, and the scaled forward vector passes through a text's pieces in
turn, so no length needs a cut.

Counts of the most frequent words travel to the tasks; tokens beyond them meet their counts in a join of (row, word)
pairs, in which no word has more than a small share of the rows.  Equal texts get equal scores up to rounding.  Empty
texts are one end.  Without training texts every word has probability 1 in both models, so all scores are 0 up to
rounding.  A null doc_id counts as the empty text for the fold; repeated rows are rows of their own; further columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, array_parts, chunks, crc_mod, documents, ends_of, scratch_table

#: The end of a text; no word holds white space.
END = b" "
STATES, LISTED, PIECE = 8, (1 << 15) - 1, 64
#: Words whose counts travel to the tasks, and the longest of them in bytes: together at most 16 MB.
KNOWN, LONGEST = 1 << 18, 64
#: Rounds that leave the start values, and those after them; all read all training texts.
FIRST_ROUNDS, ROUNDS = 10, 2
#: Pseudo-counts of the unigram shares in each state's emissions.
PRIOR = 300.0
#: Pieces handled at once, distinct words a task counts before it passes them on.
GROUP, DISTINCT = 1 << 14, 400_000


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


# Counts

def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    for batch in chunks(batches):
        for text in texts_of(batch):
            found.update(tokens_of(text))
            if len(found) >= DISTINCT:
                yield rows()
                found.clear()
    yield rows()


def count_words(docs: DataFrame) -> DataFrame:
    """Words of ``docs`` (text) with their counts: word, n."""
    return docs.select("text").mapInArrow(_counts, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words, falling by count; the first ``listed`` are emissions of their own, the others class ``listed``."""

    words: list[bytes]
    counts: np.ndarray
    listed: int
    tokens: int
    distinct: int

    @property
    def rest(self) -> int:
        """N' + V' + 1 of the class of all words that are not listed."""
        return self.tokens + self.distinct + 1 - int(self.counts[:self.listed].sum()) - self.listed

    def shares(self) -> np.ndarray:
        """Unigram probabilities of the emissions."""
        return np.append(self.counts[:self.listed] + 1, self.rest) / (self.tokens + self.distinct + 1)


def vocabulary(words: DataFrame, listed: int = LISTED, known: int = KNOWN) -> Vocabulary:
    """The most frequent words of a table (word, n), at most ``known`` of at most LONGEST bytes, all of a count or none.

    Counts are grouped by their logarithm first, so the threshold needs a few hundred rows and no sort.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    short = F.length("word") <= LONGEST
    levels = words.groupBy(level.alias("level")).agg(
        F.sum("n").alias("tokens"), F.count("*").alias("words"), F.count(F.when(short, 1)).alias("short")).collect()
    total, least = 0, None
    for row in sorted(levels, key=lambda r: -r["level"]):
        total += row["short"]
        if total > known:
            break
        least = row["level"]
    top = words.where(short & (level >= (least if least is not None else 1 << 20))).toArrow()
    order = sorted(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    return Vocabulary([w for w, _ in order], np.array([n for _, n in order], np.int64), min(listed, len(order)),
                      sum(r["tokens"] for r in levels), sum(r["words"] for r in levels))


def _encode(vocabulary, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        place = {w: i for i, w in enumerate(v.words)}
        weight = np.append(np.log10(v.counts + 1.0), 0.0)
        for batch in chunks(batches):
            words = [tokens_of(x) for x in texts_of(batch)]
            lengths = np.array([len(w) for w in words], np.int64)
            ends = ends_of(lengths)
            at = np.fromiter(map(place.get, itertools.chain.from_iterable(words), itertools.repeat(-1)), np.int64, ends[-1])
            emitted = np.where((at < 0) | (at >= v.listed), v.listed, at).astype(np.uint16)
            new, other = at < 0, np.where(at >= v.listed, weight[at], 0.0)
            missed, ends = new.tolist(), ends.tolist()
            rest = [Counter(itertools.compress(own, missed[a:b])) for own, a, b in zip(words, ends, ends[1:], strict=False)]

            def each(values: np.ndarray) -> np.ndarray:
                # Pairwise sums text by text (each has its end); differences of running sums would lose digits.
                return np.add.reduceat(values, ends[:-1]) if len(words) else values

            part = [pa.array(lengths), pa.array([emitted[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
                    pa.array(each((~new).astype(np.int64))), pa.array(each(weight[at])), pa.array(each(other)),
                    pa.array(each((emitted == v.listed).astype(np.int64))),
                    pa.array([list(c) for c in rest], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in rest], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *part],
                                             [*names, "n_tokens", "ids", "n_known", "logs", "rest_logs", "n_rest", "words", "times"])

    return rows


# The chain

@dataclass
class Chain:
    """``start`` (2, states): of texts, and of later pieces in training; ``move`` (states, states); ``emit`` (emissions, states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_chain(shares: np.ndarray, states: int, seed: int = 11) -> Chain:
    """Emissions near the unigram shares, each word leaning to a state of its own; states that tend to stay."""
    rng = np.random.default_rng(seed)
    emit = shares[:, None] * rng.gamma(1.0, size=(len(shares), states))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Chain(np.full((2, states), 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def pieces_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, number in its text, and length of each piece, text by text."""
    many = np.array([-(-len(x) // PIECE) for x in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), many)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    lengths = np.array([len(x) for x in texts], np.int64)
    return owner, number, np.minimum(PIECE, lengths[owner] - number * PIECE)


def grouped(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Owner, number, length and emissions (PIECE, pieces) of at most GROUP pieces at a time, in order."""
    owner, number, length = pieces_of(texts)
    flat = np.concatenate([*texts, np.zeros(PIECE, np.uint16)])
    first = ends_of(np.array([len(x) for x in texts], np.int64))[owner] + number * PIECE
    for a in range(0, len(owner), GROUP):
        part = slice(a, a + GROUP)
        yield owner[part], number[part], length[part], flat[first[part] + np.arange(PIECE)[:, None]]


def products(chain: Chain, number: np.ndarray, length: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's product of matrices, scaled, and the natural logarithm of its scale."""
    n, h = len(number), len(chain.move)
    order = np.argsort(-length, kind="stable")
    active = np.searchsorted(-length[order], -np.arange(PIECE), "left")
    cols = ids[:, order]
    out, scale = np.empty((n, h, h)), np.zeros(n)
    out[:] = np.where((number[order] == 0)[:, None, None], np.eye(h), chain.move)
    out *= chain.emit[cols[0]][:, None, :]
    for t in range(1, PIECE):
        k = active[t]
        if not k:
            break
        now = (out[:k].reshape(-1, h) @ chain.move).reshape(k, h, h)
        now *= chain.emit[cols[t, :k]][:, None, :]
        out[:k] = now
        if t % 8 == 0:
            top = out[:k].max(axis=(1, 2))
            out[:k] /= top[:, None, None]
            scale[:k] += np.log(top)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return out[back], scale[back]


def likelihoods(chain: Chain, texts: list[np.ndarray]) -> np.ndarray:
    """Natural logarithms of the texts' probabilities as sequences of emissions, by the scaled forward recursion."""
    forward, total = np.tile(chain.start[0], (len(texts), 1)), np.zeros(len(texts))
    for owner, number, length, ids in grouped(texts):
        matrix, scale = products(chain, number, length, ids)
        # The k-th pieces of all texts of this group pass on together.
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        order = np.argsort(rank, kind="stable")
        ends = np.searchsorted(rank[order], np.arange(rank.max() + 2))
        for a, b in zip(ends, ends[1:], strict=False):
            at = order[a:b]
            who = owner[at]
            now = np.einsum("ni,nij->nj", forward[who], matrix[at])
            size = now.sum(axis=1)
            forward[who] = now / size[:, None]
            total[who] += np.log(size) + scale[at]
    return total


def row_sums(x: np.ndarray) -> np.ndarray:
    """Sums of short rows, by neighbours: numpy's own order for eight numbers, without its cost of a call a row."""
    while x.shape[1] > 1 and x.shape[1] % 2 == 0:
        x = x[:, ::2] + x[:, 1::2]
    return x if x.shape[1] == 1 else x.sum(axis=1, keepdims=True)


def add_expected(chain: Chain, texts: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
    """Adds the expected counts of all pieces by the forward and backward recursions; returns their log-likelihood.

    The rows of a group stand by place in the piece, those of a place next to each other, so every step works in place.
    """
    h, total = len(chain.move), 0.0
    into, matrix, back = chain.emit.astype(np.float32), chain.move.astype(np.float32), chain.move.T.astype(np.float32).copy()
    for _, number, length, ids in grouped(texts):
        order = np.argsort(-length, kind="stable")
        active = np.searchsorted(-length[order], -np.arange(PIECE), "left")
        active = active[active > 0]
        cols, later, ends = ids[:, order], (number[order] > 0).astype(int), ends_of(active)
        at = [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]
        place = np.concatenate([cols[t, :k] for t, k in enumerate(active)]).astype(np.intp)
        e, forward, sizes = into[place], np.empty((len(place), h), np.float32), np.empty((len(place), 1), np.float32)
        now = chain.start[later].astype(np.float32)
        for t, k in enumerate(active):
            own, size = forward[at[t]], sizes[at[t]]
            np.multiply(now[:k] @ matrix if t else now, e[at[t]], out=own)
            size[:] = row_sums(own)
            own /= size
            now = own
        total += float(np.log(sizes).sum(dtype=float))
        e /= sizes
        behind = np.ones((len(order), h), np.float32)
        for t in range(len(active) - 1, -1, -1):
            # A piece that ends here has nothing behind it: its row is still 1.
            own, seen, rest = forward[at[t]], e[at[t]], behind[:active[t]]
            seen *= rest
            own *= rest
            if t:
                move += chain.move * (forward[at[t - 1]][:active[t]].T @ seen)
                np.matmul(seen, back, out=rest)
            else:
                np.add.at(start, later, own)
        # Turned once, the weights of a state stand together; each pass over a column of ``forward`` would read all of it.
        del e, sizes, own, seen, rest
        for j, weights in enumerate(np.ascontiguousarray(forward.T)):
            emit[:, j] += np.bincount(place, weights, len(emit))
    return total


#: Emissions that travel as one part.
ROWS = 4096


def _expected(chain):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Chain = chain.value
        start, move, emit = np.zeros_like(c.start), np.zeros_like(c.move), np.zeros_like(c.emit)
        likelihood = 0.0
        for batch in chunks(batches, text="ids"):
            likelihood += add_expected(c, [np.frombuffer(x, np.uint16) for x in batch.column("ids").to_pylist()], start, move, emit)
        if emit.any():
            yield from array_parts({-1: np.concatenate([[likelihood], start.reshape(-1), move.reshape(-1)])} |
                                   {k: emit[k * ROWS:(k + 1) * ROWS] for k in range(-(-len(emit) // ROWS))})

    return rows


def next_chain(chain: Chain, shares: np.ndarray, found: dict[int, np.ndarray], prior: float) -> Chain:
    """The chain of expected counts (of :func:`_expected`, added); a pseudo-count each for starts and moves."""
    h = len(chain.move)
    start, move = found[-1][1:1 + 2 * h].reshape(2, h) + 1, found[-1][1 + 2 * h:].reshape(h, h) + 1
    emit = np.concatenate([found[k].reshape(-1, h) for k in sorted(found) if k >= 0]) + prior * shares[:, None]
    return Chain(start / start.sum(axis=1, keepdims=True), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(encoded: DataFrame, vocabulary: Vocabulary, *, states: int = STATES, prior: float = PRIOR,
          first_rounds: int = FIRST_ROUNDS, rounds: int = ROUNDS) -> Chain:
    """Baum-Welch: ``first_rounds`` and ``rounds``, each over all rows of ``encoded`` (ids, written)."""
    shares = vocabulary.shares()
    chain = first_chain(shares, states)
    own = encoded.select("ids")
    for _ in range(first_rounds + rounds):
        sent = own.sparkSession.sparkContext.broadcast(chain)
        found = added(own.mapInArrow(_expected(sent), "block int, salt int, part binary"))
        if found:
            chain = next_chain(chain, shares, found, prior)
    return chain


def _score(chain):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text="ids"):
            texts = [np.frombuffer(x, np.uint16) for x in batch.column("ids").to_pylist()]
            forward = likelihoods(chain.value, texts) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(forward)], [*batch.schema.names[:-1], "forward"])

    return rows


@dataclass
class Model:
    vocabulary: Vocabulary
    words: DataFrame
    chain: Chain | None = None


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` (doc_id, held_out, text) with their emissions and sums, written, each with a number of its own."""
    names = ["row", "doc_id", "held_out"]
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    shape = ("row bigint, doc_id bigint, held_out boolean, n_tokens bigint, ids binary, n_known bigint, logs double, "
             "rest_logs double, n_rest bigint, words array<binary>, times array<bigint>")
    sent = docs.sparkSession.sparkContext.broadcast(model.vocabulary)
    return scratch_table(numbered.mapInArrow(_encode(sent, names), shape), "encoded")


def score(encoded: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of the rows of :func:`encode`."""
    v = model.vocabulary
    sent = encoded.sparkSession.sparkContext.broadcast(model.chain)
    plain = ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "rest_logs", "n_rest"]
    shape = ("row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, rest_logs double, "
             "n_rest bigint, forward double")
    scored = encoded.select(*plain, "ids").mapInArrow(_score(sent), shape)
    pairs = (encoded.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("pair"))
             .select("row", F.col("pair.words").alias("word"), F.col("pair.times").alias("times")))
    met = pairs.join(model.words, "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"), F.sum("times").alias("more_known"))
    logs, more = F.col("logs"), F.coalesce("more_logs", F.lit(0.0))
    base = logs + more - F.col("n_tokens") * math.log10(v.tokens + v.distinct + 1)
    own = F.col("forward") + F.col("rest_logs") + more - F.col("n_rest") * math.log10(v.rest)
    return scored.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), own.alias("score"))


def op11_hidden_markov(spark, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents; the fold whose crc32(doc_id) modulo 7 is 2 is left out of training."""
    docs = documents(spark, sf_dir).select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "text")
    words = scratch_table(count_words(docs.where(~F.col("held_out"))), "words")
    model = Model(vocabulary(words), words)
    encoded = encode(docs, model)
    model.chain = train(encoded.where(~F.col("held_out")), model.vocabulary)
    return score(encoded, model)
