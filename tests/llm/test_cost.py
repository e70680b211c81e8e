"""The inner steps of operators: same results as plain forms, bounded in memory and work."""

import random
import tracemalloc

import numpy as np

from inkwarden.llm import byte_pairs, jaccard, quality
from inkwarden.llm.common import WordHashes
from inkwarden.llm.encoders import tokenizer_file


def test_pooling_holds_no_vector_per_token():
    """A long text's token vectors are added in parts: a table of all of them took 20 times the memory."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((quality.BUCKETS, quality.DIM)).astype(np.float32)
    texts = ["", "one", "ab cd ab, ab!", " ".join(f"w{n}" for n in rng.integers(0, 3000, 100_000))]
    squared, table = quality.with_squares(vectors), WordHashes()
    quality.tokens(texts, table)
    tracemalloc.start()
    got = quality.pooled(texts, squared, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25_000_000
    for row, text in zip(got, texts, strict=True):
        own = quality.tokens([text], table)[0]
        x = vectors[own].astype(float) if len(own) else np.zeros((1, quality.DIM))
        wanted = [*x.mean(axis=0), *x.std(axis=0), len(set(own.tolist())) / max(1, len(own)), np.log1p(len(own)) / 10]
        np.testing.assert_allclose(row, wanted, atol=1e-3)


def test_many_words_are_folded_together():
    ranks = byte_pairs.ranks_of(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    pairs, draw = byte_pairs.Pairs(ranks), random.Random(3)
    words = [bytes(draw.choice(b"abestn\xc3\xa9 \xff0") for _ in range(draw.randint(1, 30))) for _ in range(3000)]
    words += [b"z" * 40, b"the", b" the", b"\xff", *[bytes([n]) for n in range(256)]]
    assert pairs.folds(words) == [byte_pairs.fold(w, ranks) for w in words]
    assert pairs.folds([]) == []


def test_frequent_words_are_folded_once(monkeypatch):
    """Words that come again and again stay when a task's memory of words is full; before, all were forgotten."""
    pairs, pieces = byte_pairs._table(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    folded, plain = [], byte_pairs.Pairs.folds
    monkeypatch.setattr(byte_pairs.Pairs, "folds", lambda self, raws: folded.extend(raws) or plain(self, raws))
    words = byte_pairs.Words(pairs, pieces, bound=50)
    long = "ab" * 200
    for n in range(40):
        text = ["qqzzv", "vvkkj", long, *[f"x{n}y{i}" for i in range(20)]]
        words.learn([text])
        for word in text:
            count, ids, raw = words[word]
            assert raw == word.encode() and count == len(ids.split(","))
        assert len(words) <= 50 + 22 and len(words.older) <= 50 + 22 and long not in words
    assert folded.count(b"qqzzv") == folded.count(b"vvkkj") == 1


def test_word_hashes_keep_no_object_a_word(monkeypatch):
    """Words are hashed where they stand in the bytes of the texts; runs and long texts are cut between words only."""
    texts = ["", "  ", "a", "A b\tc\x0bd\x0ce\rf\ng", "x\x1cy\x85z ü", "one two " * 400, "w" * 900, " lead and trail ", "q" * 300 + " " + "p" * 300]
    plain = [x.encode().lower().split() for x in texts]
    found = []
    for run in (16, 256, 1 << 17):
        monkeypatch.setattr(jaccard, "RUN_BYTES", run)
        hashes, counts = jaccard.word_hashes([x.encode().lower() for x in texts])
        assert counts.tolist() == [len(x) for x in plain]
        found.append(hashes.tolist())
    assert found[0] == found[1] == found[2]
    known = dict(zip([w for x in plain for w in x], found[0], strict=True))
    assert [known[w] for x in plain for w in x] == found[0] and len(set(known.values())) == len(known)
    for size in (4, 5):
        sets = jaccard.shingle_sets(texts, size)
        assert [len(x) for x in sets] == [len({tuple(y[i:i + size]) for i in range(max(1, len(y) - size + 1))}) if y else 0 for y in plain]
        for own, low in zip(sets, jaccard.shingle_sets(texts, size, low=True), strict=True):
            np.testing.assert_array_equal(own[jaccard.keys_of(own) < jaccard.LOW], low)


def test_term_sums_sort_numbers_not_their_order(monkeypatch):
    """Terms of a task are counted by sorting one number a term, place and row; numbers too large for it take the other way."""
    import pyarrow as pa

    from inkwarden.operators import cells

    draw = random.Random(9)
    texts = [[draw.choice("abcdefghij") * 2 for _ in range(draw.randint(0, 12))] for _ in range(60)]
    texts[3] = None
    groups = [n % 3 if n % 5 else None for n in range(60)]
    wanted: dict[tuple, list[int]] = {}
    for own, group in zip(texts, groups, strict=True):
        kept = [w for w in own or [] if w != "jj"]
        terms = [*kept, *map(" ".join, zip(kept, kept[1:], strict=False))]
        for term in set(terms):
            cell = wanted.setdefault((group, term), [0, 0])
            cell[0] += 1
            cell[1] += terms.count(term)
    batch = pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(texts, pa.list_(pa.string()))], ["g", "words"])
    sorts = []
    plain = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorts.append(len(keys[0])) or plain(keys))

    def found(rows: int) -> dict:
        out: dict[tuple, list[int]] = {}
        for part in cells._statistics(["jj"], "g")(iter([batch.slice(n, rows) for n in range(0, 60, rows)])):
            for g, term, df, total in zip(*(c.to_pylist() for c in part.columns), strict=True):
                assert (g, term) not in out
                out[g, term] = [df, total]
        return out

    assert found(60) == found(7) == wanted and not sorts
    monkeypatch.setattr(cells, "_bits", lambda values: 63)
    assert found(60) == found(7) == wanted and sorts


def test_cells_of_rows_sort_numbers():
    from inkwarden.operators import cells

    rng = np.random.default_rng(4)
    for most in (5, 1 << 40, 1 << 60):
        owner, code = rng.integers(0, 30, 2000), rng.integers(0, most, 2000)
        code[1000:] = code[:1000]
        values, count = np.unique(np.stack([owner, code]), axis=1, return_counts=True)
        for got, own in zip(cells._in_rows(owner, code), (*values, count), strict=True):
            np.testing.assert_array_equal(got, own)
    assert [len(x) for x in cells._in_rows(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0, 0]


def test_turned_weights_give_the_same_expected_counts():
    """The sums of each state are those of its column, bit by bit, whatever stands between."""
    from inkwarden.llm import hidden_markov as hm

    rng = np.random.default_rng(2)
    chain = hm.first_chain(np.full(50, 0.02), 8)
    texts = [rng.integers(0, 50, n).astype(np.uint16) for n in (1, 64, 65, 200, 3)]
    start, move, emit = np.zeros_like(chain.start), np.zeros_like(chain.move), np.zeros_like(chain.emit)
    hm.add_expected(chain, texts, start, move, emit)
    np.testing.assert_allclose(emit.sum(axis=1), np.bincount(np.concatenate(texts), minlength=50), rtol=1e-4)
    np.testing.assert_allclose([start.sum(), move.sum()], [9, 333 - 9], rtol=1e-4)
