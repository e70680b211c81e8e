"""Learned operators: held-out accuracy, gradients, and defined results for odd rows."""

import numpy as np
import pytest

from inkwarden.llm import language, quality, toxicity

DATA = "/root/testdata/sf0.01"


def auc(score, label):
    ranks = score.rank()
    ones = label.sum()
    return (ranks[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def joined(spark, frame, column):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", column)
    rows = frame.join(labels, "doc_id").toPandas()
    return rows[rows["held_out"]], rows


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    net = language.Network(["a", "b", "c"], *[rng.standard_normal(s) * 0.3 for s in ((2, 12, 256), (2, 12, 4), (3, 8), (3,))])
    rows, target = rng.integers(97, 122, (6, language.SEGMENT)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        p = language.position_probabilities(net, rows)
        return -np.log(p[:, target, np.arange(6)]).mean()

    for values, slopes in zip(net.arrays(), language.gradients(net, rows, target), strict=True):
        at = np.unravel_index(np.argmax(np.abs(slopes)), slopes.shape)
        values[at] += 0.01
        up = loss()
        values[at] -= 0.02
        down = loss()
        values[at] += 0.01
        assert (up - down) / 0.02 == pytest.approx(slopes[at], rel=0.02)


def test_language_query(spark):
    got = language.op9_language(spark, DATA)
    lang = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = got.join(lang, "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert len(rows) == 1000 and (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert rows["score"].between(0, 1).all()


def test_language_of_odd_rows(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    net = language.train(docs, sample_rows=400, steps=60)
    rows = {(r["doc_id"], r["text"]): r for r in language.identify(odd, net).collect()}
    for key, r in rows.items():
        if key[0] in (1, 2, 3, 4):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in net.langs
    assert rows[5, ODD_TEXT]["score"] == rows[6, ODD_TEXT]["score"] and rows[5, ODD_TEXT]["key"] == "x"
    assert language.identify(none, net).count() == 0
    nothing = language.train(none)
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}


ODD_TEXT = "one two three four five six seven eight"


def test_toxicity_query(spark):
    held, rows = joined(spark, toxicity.op6_toxicity(spark, DATA), "toxic")
    assert auc(held["score"], held["toxic"]) > 0.85
    assert (rows["predicted"] == (rows["score"] >= 0.5)).all()


def test_fit_takes_no_more_text_than_its_budget(spark, odd):
    rows = [(i, i % 2, 10 + i) for i in range(100)] + [(500, 1, 10**9)]
    some = toxicity.bounded_choice(rows, 1000)
    assert 700 < sum(r[2] for r in some) <= 1000 and (500, 1, 10**9) not in some
    assert toxicity.bounded_choice(rows[::-1], 1000) == some and len(toxicity.bounded_choice(rows, 2 * 10**9)) == 101
    labels = odd.select("doc_id", (odd.doc_id % 2).cast("int").alias("label"))
    whole = toxicity.train(odd, labels)
    small = toxicity.train(odd, labels, sample_bytes=2000)
    assert whole.bias is not None and small.bias is not None and toxicity.train(odd, labels, sample_bytes=0).bias is None


def test_ftrl_finds_the_words_that_matter():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(10, 5000, 60)).astype(np.uint32) for _ in range(600)]
    labels = np.arange(600) % 3 == 0
    rows = [np.append(r, np.uint32(3)) if y else r for r, y in zip(rows, labels, strict=True)]
    weights = toxicity.ftrl(rows, labels.astype(int), bits=13)
    assert weights.places[np.argmax(weights.values)] == 3 and len(weights.places) < 500


def test_quality_query(spark):
    held, rows = joined(spark, quality.op7_quality(spark, DATA), "quality")
    assert auc(held["score"], held["quality"]) > 0.95
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all()


def test_contexts_by_hand():
    total = np.zeros(quality.BUCKETS * quality.DIM)
    buckets, lengths = np.array([5, 9, 5, 7]), np.array([3, 1])
    quality.add_contexts(total, buckets, lengths)
    places, signs = quality.index_vectors()
    wanted = np.zeros((quality.BUCKETS, quality.DIM))
    for a, b in ((5, 9), (9, 5), (9, 5), (5, 9), (5, 5), (5, 5)):
        for k in range(quality.NONZERO):
            wanted[a, places[b, k]] += signs[b, k]
    assert (total.reshape(wanted.shape) == wanted).all()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_odd_rows(spark, odd, none, module):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, None), (None, 1), (7, 9)], "doc_id bigint, label int")
    model = module.train(docs, labels, sample_rows=200)
    rows = module.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["key"] == "x" for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert module.score(none, model).count() == 0
    empty = module.train(none, labels)
    assert {r["score"] for r in module.score(odd, empty).collect()} == {0.0}
