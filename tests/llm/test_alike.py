"""The pipeline's near duplicates against brute force at five words and four fifths."""

import re

import numpy as np
import pytest

from inkwarden.llm import jaccard, stages


def slow_firsts(texts, words=5, part=80):
    """Ids that a component of near duplicates keeps."""
    sets = []
    for _, t in texts:
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(own[k:k + words]) for k in range(max(1, len(own) - words + 1))} if own else set())
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= part * (len(sets[a]) + len(sets[b]) - common):
                label = [label[b] if x == label[a] else x for x in label]
    return sorted({min(i for (i, _), y in zip(texts, label, strict=True) if y == x) for x in label})


def corpus():
    """Copies with words appended or changed, so that similarities lie on both sides of 0.8 and of 0.85."""
    rng, texts = np.random.default_rng(12), []
    for length in (3, 5, 6, 12, 40, 100, 200):
        for _ in range(4):
            base = [f"w{x}" for x in rng.integers(0, 300, length)]
            texts.append(" ".join(base))
            for share in (0.1, 0.15, 0.2, 0.25):
                texts.append(" ".join(base + [f"a{x}" for x in rng.integers(0, 10**6, int(share * length))]))
            for share in (0.01, 0.02, 0.021, 0.03):
                words = list(base)
                for at in rng.choice(length, max(1, int(share * length)), replace=False):
                    words[at] = f"e{rng.integers(0, 10**6)}"
                texts.append(" ".join(words))
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]


def kept(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return sorted(r["doc_id"] for r in stages.keep_first_of_alike(spark, docs, "").collect())


def test_a_fifth_appended_is_a_duplicate(spark):
    base = [f"w{i}" for i in range(100)]
    assert kept(spark, [(1, " ".join(base)), (2, " ".join(base + [f"x{i}" for i in range(20)])),
                        (3, " ".join(base + [f"y{i}" for i in range(30)]))]) == [1, 3]


@pytest.mark.parametrize("large", [False, True])
def test_stage_against_brute_force(spark, monkeypatch, large):
    """Also with clusters too large for one task."""
    if large:
        monkeypatch.setattr(jaccard, "CLUSTER_SETS", 3)
        monkeypatch.setattr(jaccard, "BLOCK_SETS", 2)
    texts = corpus()
    assert slow_firsts(texts) != slow_firsts(texts, 4, 85)
    assert kept(spark, texts) == slow_firsts(texts)


def test_prefixes_keep_every_partner():
    rng, rule = np.random.default_rng(7), jaccard.Rule(5, 80)
    nothing = np.empty(0, np.uint64), np.empty(0, np.int64)
    met = 0
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 60, int(rng.integers(2, 60))).astype(np.uint64))
        b = a[rng.random(len(a)) > 0.12]
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 60, rng.integers(0, 3)).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 80 * (len(a) + len(b) - common) and len(a) != common:
            met += 1
            for boundary in (2, 10, 20, 30):
                assert len(np.intersect1d(jaccard.signatures(a, *nothing, boundary, rule), jaccard.signatures(b, *nothing, boundary, rule)))
    assert met > 50
