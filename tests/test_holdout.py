"""Every source of the table is held out, with its rates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwarden.operators import holdout as h

WORDS = "amber birch cedar delta ember flint grove hazel".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        label = int(i % 3 == 0)
        bad = rng.choice(WORDS[:4] if label else WORDS[4:], 6).tolist() + rng.choice(WORDS, 3).tolist()
        rows.append((i, " ".join([*bad, f"only{i % 5}"]), label, "vwxyz"[i % 5] if i % 11 else None, "test" if i % 4 == 0 else "train"))
    rows += [(900, None, 0, "x", "train"), (901, "", 1, "lone", "test"), (902, "delta", 0, "lone", "test"), (903, "delta", None, "x", "train")]
    return rows, spark.createDataFrame(rows, "id bigint, text string, label int, source string, split string").repartition(4)


def plain_fit(rows, held):
    """(train rows, vocabulary, scorer): newton steps on dense features."""
    train = [(t or "", y) for _, t, y, s, part in rows if y is not None and part == "train" and s != held]
    grams = lambda t: [*t.split(), *map(" ".join, zip(t.split(), t.split()[1:], strict=False))]
    df, total = {}, {}
    for t, _ in train:
        # A digit makes a run no word, and pairs are those of the words that stay.
        own = grams(" ".join(w for w in t.split() if w.isalpha()))
        for w in own:
            total[w] = total.get(w, 0) + 1
        for w in set(own):
            df[w] = df.get(w, 0) + 1
    vocab = sorted(w for w in df if df[w] >= 3 and df[w] <= 0.9 * len(train))
    idf = np.array([np.log((1 + len(train)) / (1 + df[w])) + 1 for w in vocab])

    def vector(t):
        own = grams(" ".join(w for w in (t or "").split() if w.isalpha()))
        x = np.array([1 + np.log(own.count(w)) if w in own else 0.0 for w in vocab]) * idf
        return x / (np.linalg.norm(x) or 1)

    X, y = np.array([[*vector(t), 1.0] for t, _ in train]), np.array([y for _, y in train])
    c = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    ridge = np.append(np.full(len(vocab), 1 / 4.0), 0.0)
    w = np.zeros(X.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ w))
        w -= np.linalg.solve((X * (c * p * (1 - p))[:, None]).T @ X + np.diag(ridge), X.T @ (c * (p - y)) + ridge * w)
    return len(train), vocab, lambda t: 1 / (1 + np.exp(-(np.append(vector(t), 1.0) @ w)))


def test_rates_of_all_sources(corpus):
    rows, frame = corpus
    got = {r["held_out"]: r for r in h.holdout_rates(frame, stop_words=[], rounds=60).collect()}
    assert sorted(got) == ["lone", "v", "w", "x", "y", "z"]
    for held, row in got.items():
        n, vocab, score = plain_fit(rows, held)
        unseen = np.array([score(t) for _, t, y, s, _ in rows if s == held and y == 0])
        caught = np.array([score(t) for _, t, y, _, part in rows if y == 1 and part == "test"])
        assert (row["n_train"], row["n_terms"], row["n_unseen_legit"]) == (n, len(vocab), len(unseen))
        for value, scores, at in ((row["fpr_05"], unseen, 0.5), (row["fpr_q"], unseen, 0.8), (row["recall_05"], caught, 0.5)):
            # A score within the optimiser's tolerance of the threshold may fall on either side.
            assert (scores >= at + 0.01).mean() - 1e-4 <= value <= (scores >= at - 0.01).mean() + 1e-4


def test_blocks_change_nothing(corpus, monkeypatch):
    _, frame = corpus
    whole = sorted(map(tuple, h.holdout_rates(frame, rounds=5).collect()))
    monkeypatch.setattr(h, "BLOCK", 2)
    assert sorted(map(tuple, h.holdout_rates(frame, rounds=5).collect())) == whole


def test_sources_that_cannot_be_held_out(corpus):
    _, frame = corpus
    one_class = frame.where((F.col("label") == 0) | (F.col("source") == "v")).where("source in ('v', 'w')")
    assert {r["held_out"] for r in h.holdout_rates(one_class, rounds=3).collect()} == {"w"}
    with pytest.raises(ValueError):
        h.holdout_rates(frame.limit(0))


def test_descent_finds_the_least_point():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((6, 6))
    a, goal = a @ a.T + np.eye(6), rng.standard_normal(6)
    run = h.descent(np.zeros(6), 100, least=1e-14)
    at = next(run)
    with pytest.raises(StopIteration) as end:
        while True:
            at = run.send((float((at - goal) @ a @ (at - goal)) / 2, a @ (at - goal)))
    assert np.allclose(end.value.value, goal, atol=1e-4)
