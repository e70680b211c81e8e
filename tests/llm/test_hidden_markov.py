"""The language model against plain recursions in logarithms, and the query against plain counts."""

import itertools
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwarden.llm import hidden_markov as hm

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_forward(chain, ids):
    """Log-probability by the forward recursion, one token after the other."""
    now = np.log(chain.start[0]) + np.log(chain.emit[ids[0]])
    for k in ids[1:]:
        now = np.logaddexp.reduce(now[:, None] + np.log(chain.move), axis=0) + np.log(chain.emit[k])
    return float(np.logaddexp.reduce(now))


def some_chain(states, emissions, seed=0):
    rng = np.random.default_rng(seed)
    start, move, emit = rng.random((2, states)), rng.random((states, states)), rng.random((emissions, states)) ** 4 + 1e-6
    return hm.Chain(start / start.sum(axis=1, keepdims=True), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def some_texts(emissions, lengths, seed=1):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, emissions, n).astype(np.uint16) for n in lengths]


@pytest.mark.parametrize("group", [1, 3, hm.GROUP])
def test_likelihoods_of_all_lengths(monkeypatch, group):
    monkeypatch.setattr(hm, "GROUP", group)
    chain = some_chain(5, 30)
    texts = some_texts(30, [1, 2, 63, 64, 65, 128, 129, 700, 1, 3000])
    assert np.allclose(hm.likelihoods(chain, texts), [plain_forward(chain, x) for x in texts], rtol=1e-12)


def test_probabilities_of_all_short_texts_add_up():
    chain = some_chain(3, 4)
    every = [np.array(x, np.uint16) for x in itertools.product(range(4), repeat=5)]
    assert np.exp(hm.likelihoods(chain, every)).sum() == pytest.approx(1, rel=1e-12)


def test_expected_counts_of_all_paths():
    chain, texts = some_chain(2, 3), some_texts(3, [1, 4, 6])
    start, move, emit = np.zeros((2, 2)), np.zeros((2, 2)), np.zeros((3, 2))
    total = hm.add_expected(chain, texts, start, move, emit)
    s, m, e, logs = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), 0.0
    for ids in texts:
        paths = list(itertools.product(range(2), repeat=len(ids)))
        weight = np.array([chain.start[0][p[0]] * np.prod([chain.emit[k, j] for k, j in zip(ids, p, strict=True)]) *
                           np.prod([chain.move[a, b] for a, b in itertools.pairwise(p)]) for p in paths])
        logs += math.log(weight.sum())
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            s[p[0]] += w
            for a, b in itertools.pairwise(p):
                m[a, b] += w
            for k, j in zip(ids, p, strict=True):
                e[k, j] += w
    assert total == pytest.approx(logs, rel=1e-5)
    assert np.allclose(start[0], s, rtol=1e-4) and np.allclose(move, m, rtol=1e-4) and np.allclose(emit, e, rtol=1e-4)


def test_rounds_raise_the_likelihood():
    texts = some_texts(6, [40] * 30, 1) + [x % 3 for x in some_texts(6, [40] * 30, 2)]
    shares = np.bincount(np.concatenate(texts), minlength=6) / sum(map(len, texts))
    chain, last = hm.first_chain(shares, 2), -math.inf
    for _ in range(8):
        start, move, emit = np.zeros((2, 2)), np.zeros((2, 2)), np.zeros((6, 2))
        total = hm.add_expected(chain, texts, start, move, emit)
        assert total > last
        last = total
        chain = hm.next_chain(chain, shares, {-1: np.concatenate([[total], start.ravel(), move.ravel()]), 0: emit}, 1e-9)


def plain_query(rows):
    """doc_id -> base score, tokens, known tokens; and the number of training tokens."""
    texts = {i: [*WORD.findall(lowered(x)), " "] for i, x in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, words in texts.items() if not held[i] for w in words)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(words), sum(w in counts for w in words), n,
                math.fsum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)) for i, words in texts.items()}


def test_query(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    exact = plain_query([(r["doc_id"], r["text"]) for r in rows])
    got = hm.op11_hidden_markov(spark, DATA).toPandas().set_index("doc_id")
    assert len(got) == len(exact)
    for i, (held, tokens, known, n, base) in exact.items():
        r = got.loc[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-10)
    held = got[got["held_out"]]
    assert held["score"].sum() / held["n_tokens"].sum() > held["base_score"].sum() / held["n_tokens"].sum() + 0.1


def fitted(docs, listed, known, **options):
    words = hm.count_words(docs.where(~F.col("held_out")))
    model = hm.Model(hm.vocabulary(words, listed, known), words)
    encoded = hm.encode(docs, model)
    model.chain = hm.train(encoded.where(~F.col("held_out")), model.vocabulary, **options)
    return model, encoded


def test_one_state_is_the_unigram_model(spark, odd):
    docs = odd.withColumn("held_out", F.col("doc_id").isin(8, 10))
    model, encoded = fitted(docs, 3, 6, states=1, first_rounds=1, rounds=1)
    model.chain.emit[:, 0] = model.vocabulary.shares()
    rows = hm.score(encoded, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["score"] == pytest.approx(r["base_score"], rel=1e-9)


def test_scores_do_not_depend_on_the_words_that_travel(spark, odd):
    """Score = forward recursion over listed words and the class of the rest, times shares within the class."""
    docs = odd.withColumn("held_out", F.col("doc_id").isin(8, 10)).repartition(3)
    results = []
    for known in (4, 9, 1000):
        model, encoded = fitted(docs, 4, known, states=2, first_rounds=0, rounds=2)
        results.append(sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3))
                              for r in hm.score(encoded, model).collect()))
    assert results[0][0][:2] == results[1][0][:2] and [r[2:4] for r in results[0]] == [r[2:4] for r in results[2]]
    empty = {r[1:] for r in results[0] if r[0] in (1, 2, 3)}
    assert len(empty) == 1 and empty.pop()[0] == 1


def test_score_is_a_plain_recursion(spark, odd):
    docs = odd.withColumn("held_out", F.col("doc_id").isin(8, 10))
    model, encoded = fitted(docs, 5, 8, states=3, first_rounds=0, rounds=2)
    v = model.vocabulary
    counts = {r["word"]: r["n"] for r in model.words.collect()}
    place = {w: i for i, w in enumerate(v.words[:v.listed])}
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in hm.score(encoded, model).collect():
        if len(texts[r["doc_id"]] or "") > 10000:
            continue
        words = [w.encode() for w in [*WORD.findall(lowered(texts[r["doc_id"]])), " "]]
        exact = plain_forward(model.chain, [place.get(w, v.listed) for w in words]) / math.log(10)
        exact += sum(math.log10((counts.get(w, 0) + 1) / v.rest) for w in words if w not in place)
        assert r["score"] == pytest.approx(exact, rel=1e-9)


def test_no_training_rows(spark, odd, none):
    model, encoded = fitted(odd.withColumn("held_out", F.lit(True)), hm.LISTED, hm.KNOWN)
    for r in hm.score(encoded, model).collect():
        assert (r["base_score"], r["n_known"], r["train_tokens"]) == (0.0, 0, 0) and abs(r["score"]) < 1e-9
    model, encoded = fitted(none.withColumn("held_out", F.lit(True)), hm.LISTED, hm.KNOWN)
    assert hm.score(encoded, model).count() == 0


def test_first_rounds_read_all_rows(spark, odd):
    """With very many tokens in the vocabulary, too: each round's counts come from every row, not from a part of them."""
    docs = odd.withColumn("held_out", F.lit(False))
    words = hm.count_words(docs)
    v = hm.vocabulary(words, 5, 8)
    v.tokens += 10 ** 10
    encoded = hm.encode(docs, hm.Model(v, words))
    got = hm.train(encoded, v, states=2, first_rounds=2, rounds=0)
    texts = [np.frombuffer(r["ids"], np.uint16) for r in encoded.collect()]
    chain = hm.first_chain(v.shares(), 2)
    for _ in range(2):
        start, move, emit = np.zeros_like(chain.start), np.zeros_like(chain.move), np.zeros_like(chain.emit)
        hm.add_expected(chain, texts, start, move, emit)
        found = {-1: np.concatenate([[0.0], start.reshape(-1), move.reshape(-1)]), 0: emit}
        chain = hm.next_chain(chain, v.shares(), found, hm.PRIOR)
    assert np.allclose(got.move, chain.move, rtol=1e-4) and np.allclose(got.start, chain.start, rtol=1e-4)
    assert np.allclose(got.emit, chain.emit, rtol=1e-4)


def test_expected_counts_take_memory_by_tokens():
    """Short texts are not held at the length of a whole piece."""
    chain, texts = some_chain(8, 50), some_texts(50, [2] * hm.GROUP)
    start, move, emit = np.zeros((2, 8)), np.zeros((8, 8)), np.zeros((50, 8))
    tracemalloc.start()
    hm.add_expected(chain, texts, start, move, emit)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert emit.sum() == pytest.approx(2 * hm.GROUP, rel=1e-5)
    assert peak < hm.GROUP * hm.PIECE * 8 * 4
