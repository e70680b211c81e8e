"""Training variants side by side against Newton steps on dense features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwarden.operators import variants as v

WORDS = "amber birch cedar delta ember flint grove hazel".split()


def _rows():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(260):
        label = int(i % 3 == 0)
        text = rng.choice(WORDS[:4] if label else WORDS[4:], 4).tolist() + rng.choice(WORDS, 4).tolist()
        rows.append((i, " ".join(text), " ".join(text[::-1]), label, "abc"[i % 3 if i % 4 else 2], i % 5 == 0, 3.0 if i % 7 == 0 else None))
    return rows + [(900, None, None, 1, "a", True, None), (901, "", "", 0, "a", False, 1.0), (902, "delta", "delta", None, "a", True, 1.0),
                   (903, "delta grove", "grove delta", 1, None, None, 1.0)]


def _plain(train, stop):
    """Scorer and number of terms of a fit on (text, label, weight)."""
    grams = lambda t: (lambda w: [*w, *map(" ".join, zip(w, w[1:], strict=False))])([x for x in (t or "").split() if x not in stop])
    df = {}
    for t, _, _ in train:
        for g in set(grams(t)):
            df[g] = df.get(g, 0) + 1
    vocab = sorted(g for g in df if 3 <= df[g] <= 0.9 * len(train))
    idf = np.array([np.log((1 + len(train)) / (1 + df[g])) + 1 for g in vocab])

    def vector(t):
        own = grams(t)
        x = np.array([1 + np.log(own.count(g)) if g in own else 0.0 for g in vocab]) * idf
        return np.append(x / (np.linalg.norm(x) or 1), 1.0)

    X, y = np.array([vector(t) for t, _, _ in train]), np.array([y for _, y, _ in train])
    c = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) * np.array([w for _, _, w in train])
    ridge = np.append(np.full(len(vocab), 1 / 4.0), 0.0)
    b = np.zeros(X.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-X @ b))
        b -= np.linalg.solve((X * (c * p * (1 - p))[:, None]).T @ X + np.diag(ridge + 1e-12), X.T @ (c * (p - y)) + ridge * b)
    return lambda t: 1 / (1 + np.exp(-(vector(t) @ b))), len(vocab)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(_rows(), "id bigint, text string, turned string, label int, source string, late boolean, w double").repartition(3)


def test_variants_equal_plain_fits(frame):
    early, late = ~F.col("late"), F.col("late")
    fits = [v.Variant("A", "text", early & (F.col("source") != "b"), ()), v.Variant("B", "text", early, ()),
            v.Variant("E", "text", early, ("amber",)), v.Variant("T", "turned", early, (), F.col("w")),
            v.Variant("lone", "text", F.col("id") == 3, ())]
    got = {(r["variant"], r["test_set"]): r for r in v.variant_rates(
        frame, fits, {"late": late, "some": F.col("source") == "b"}, {"mean": ("B", "T"), "none": ("B", "lone")}, rounds=80).collect()}
    assert {name for name, _ in got} == {"A", "B", "E", "T", "mean"} and len(got) == 10
    rows = [r for r in _rows() if r[3] is not None]
    trained = [r for r in rows if r[5] is False]
    plain = {"A": ([r for r in trained if r[4] is not None and r[4] != "b"], 1, (), False), "B": (trained, 1, (), False), "E": (trained, 1, ("amber",), False),
             "T": (trained, 2, (), True)}
    score = {}
    for name, (train, at, stop, weighted) in plain.items():
        one, n_terms = _plain([(r[at], r[3], (r[6] if r[6] is not None else 1.0) if weighted else 1.0) for r in train], stop)
        score[name] = {r[0]: one(r[at]) for r in rows}
        assert (got[name, "late"]["n_train"], got[name, "late"]["n_terms"]) == (len(train), n_terms), name
    logit = lambda p: np.log(p / (1 - p))
    score["mean"] = {i: 1 / (1 + np.exp(-(logit(score["B"][i]) + logit(score["T"][i])) / 2)) for i in score["B"]}
    for (name, test_set), r in got.items():
        tested = [x for x in rows if (x[5] if test_set == "late" else x[4] == "b")]
        legit, phish = (np.array([score[name][x[0]] for x in tested if x[3] == y]) for y in (0, 1))
        assert (r["n_legit"], r["n_phish"]) == (len(legit), len(phish))
        for at, key in ((0.5, "05"), (0.8, "q")):
            # A score on the edge may fall to either side.
            for rate, scores in ((f"fpr_{key}", legit), (f"recall_{key}", phish)):
                if not len(scores):
                    assert r[rate] is None
                    continue
                low, high = np.mean(scores >= at + 0.01), np.mean(scores >= at - 0.01)
                assert low - 1e-4 <= r[rate] <= high + 1e-4, (name, test_set, rate, r[rate], low, high)


def test_guards_and_choice(spark):
    rates = spark.createDataFrame([
        ("A", "val", 0.9, 1, 2, 0.1, 0.9), ("A", "new", 0.5, 1, 2, 0.2, 0.5), ("B", "val", 0.9, 1, 1, 0.1, 0.9), ("B", "new", 0.5, 1, 1, 0.2, 0.5),
        ("C", "val", 0.99, 0, 0, 0.0, 1.0), ("C", "new", 0.5, 0, 0, 0.0, 0.1), ("D", "val", 1.0, 0, 0, 0.0, 1.0)],
        "variant string, test_set string, f1_05 double, fp_q int, fp_05 int, fpr_05 double, recall_05 double")
    out = {r["variant"]: r for r in v.guarded(rates, "val", {"old": ("val", 0.2, None), "new": ("new", None, 0.4)}, ["A", "B", "C", "D"]).collect()}
    assert {k for k, r in out.items() if r["eligible"]} == {"A", "B"} and {k for k, r in out.items() if r["chosen"]} == {"B"}
    assert out["D"]["new_recall"] is None and out["C"]["new_recall"] == 0.1


def test_refused(frame):
    with pytest.raises(ValueError):
        v.variant_rates(frame.limit(0), [v.Variant("A", "text", F.lit(True))], {"all": F.lit(True)}, rounds=2)
    with pytest.raises(ValueError):
        v.variant_rates(frame, [], {"all": F.lit(True)})
