"""Packed chunks of rows: terms counted for all views in one pass, vocabularies with ties, cells as plain counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwarden.operators import holdout, packed

WORDS = "amber birch cedar delta ember flint grove hazel ivory".split()


def _rows():
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, i % 5 != 0, "abc"[i % 3] if i % 7 else None, rng.choice(WORDS, 6).tolist(), rng.choice(WORDS[:5], 4).tolist()) for i in range(90)]
    return rows + [(900, 1, True, "a", None, []), (901, 0, True, "lone", [], ["zinc"] * 3), (902, 0, True, None, ["rare", "amber"], None)]


def _grams(words, stop):
    kept = [w for w in words or [] if w not in stop]
    return [*kept, *map(" ".join, zip(kept, kept[1:], strict=False))]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = spark.createDataFrame(_rows(), "id int, label int, trained boolean, group string, first array<string>, second array<string>")
    return packed.pack(rows.repartition(3), ["first", "second"])


VIEWS = [(0, ()), (0, ("amber", "cedar")), (1, ("birch",))]


def test_vocabularies_of_all_views_are_plain_counts(chunks, monkeypatch):
    monkeypatch.setattr(packed, "BUCKETS", 4)
    assert chunks.select(F.inline("kept")).count() == len(_rows())
    inside = lambda groups: np.array([[g != "a" for g in groups], [True for _ in groups]], bool).reshape(2, -1)
    sums = packed.statistics(chunks, VIEWS)
    trained = [r for r in _rows() if r[2]]
    sizes = np.array([sum(r[3] != "a" for r in trained), len(trained)])
    for most in (5, 11, 50_000):  # a limit cuts through terms that are used equally often
        found = packed.vocabularies(sums, dict.fromkeys(range(3), inside), dict.fromkeys(range(3), sizes), most=most)
        for v, (text, stop) in enumerate(VIEWS):
            want = []
            for k, own in enumerate(([r for r in trained if r[3] != "a"], trained)):
                df, total = {}, {}
                for r in own:
                    grams = _grams(r[4 + text], stop)
                    for g in grams:
                        total[g] = total.get(g, 0) + 1
                    for g in set(grams):
                        df[g] = df.get(g, 0) + 1
                kept = sorted((g for g in df if 3 <= df[g] <= 0.9 * sizes[k]), key=lambda g: (-total[g], g))[:most]
                want.append({g: df[g] for g in kept})
            terms, df = found[v]
            assert terms == sorted({g for own in want for g in own})
            assert [{t: int(n) for t, n in zip(terms, own, strict=True) if n} for own in df] == want


def test_cells_and_lengths(chunks):
    terms, idf = [WORDS, ["amber birch", "birch"]], [np.arange(1.0, 10.0), np.array([2.0, 0.0])]
    weigh = lambda kept: np.array([kept.field("id").to_numpy() % 3, np.zeros(len(kept))], float)
    table = packed.features(chunks, [(0, ()), (1, ())], terms, idf, [[0], [1]], weigh, ["id", "label"])
    seen, rows = 0, {r[0]: r for r in _rows()}
    for kept, trained, weights, inverse, cells in packed.unpacked(table.toArrow().to_batches()):
        ids = kept.field("id").to_pylist()
        assert [i % 3 > 0 for i in ids] == [place < trained for place in range(len(ids))] and weights[0].tolist() == [i % 3 for i in ids]
        for v, words in enumerate(terms):
            sums = cells[v].times(idf[v])
            for place, i in enumerate(ids):
                own = _grams(rows[i][4 + v], ())
                x = np.array([1 + np.log(own.count(w)) if w in own else 0.0 for w in words]) * idf[v]
                length = np.linalg.norm(x)
                assert np.isclose(sums[place], x.sum()) and np.isclose(inverse[v][place], 1 / length if length else 1.0)
        seen += len(ids)
    assert seen == len(rows)


def test_a_round_returns_the_terms_of_a_fits_own_view(chunks):
    terms = [["amber", "birch", "cedar"], ["delta"]]
    idf = [np.ones(3), np.ones(1)]
    table = packed.features(chunks, [(0, ()), (1, ())], terms, idf, [[0], [1]], lambda kept: np.ones((2, len(kept))), ["label"])
    fits = holdout.Fits([[0], [1]], idf, [np.zeros(3), np.zeros(1)], np.zeros(2))
    found = holdout.gradients(table, fits, [0, 1])
    assert {k: len(v) for k, v in found.items()} == {0: 5, 1: 3}
    labels = np.array([r[1] for r in _rows()])
    for k in (0, 1):
        assert np.isclose(found[k][-2], (0.5 - labels).sum()) and np.isclose(found[k][-1], len(labels) * np.log(2))
