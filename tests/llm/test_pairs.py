"""Jaccard components, nearest neighbours and surrogates against brute force; the pipeline's stages."""

import math
import re

import numpy as np
import pytest
from compare import compare, connection

from inkwarden.llm import jaccard, neighbours, stages, surrogates

SMALL = "/root/testdata/sf0.001"


def sets_of(texts):
    out = []
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        runs = {tuple(words[k:k + 4]) for k in range(max(1, len(words) - 3))} if words else set()
        out.append((i, runs))
    return out


def slow_components(texts):
    sets = sets_of(texts)
    label = list(range(len(sets)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a][1] & sets[b][1])
            if common and 100 * common >= 85 * (len(sets[a][1]) + len(sets[b][1]) - common):
                label[root(a)] = root(b)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[m][0] for m in range(len(sets)) if root(m) == root(k) and sets[m][0] is not None]
        out.append((i, len(s), (min(ids) if ids else None) if s else i))
    return sorted(out, key=str)


def near_copies(seed, groups, size, length):
    """Groups of texts with few or many edits, so that links form stars, chains and near misses."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 400, length)]
        for _ in range(size):
            words = list(base)
            for at in rng.choice(length, rng.integers(0, max(1, length // 20) + 1), replace=False):
                words[at] = f"e{rng.integers(0, 10**6)}"
            if rng.random() < 0.3:
                base = words
            rows.append((len(rows), " ".join(words)))
    order = rng.permutation(len(rows))
    return [(int(order[i]), t) for i, t in rows]


@pytest.mark.parametrize("boundary", [None, 2, 60])
def test_components(spark, odd, none, boundary):
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(i + 100, t) for i, t in
            near_copies(3, 6, 12, 20) + [(i + 200, t) for i, t in near_copies(4, 4, 15, 60)] + [(i + 400, t) for i, t in near_copies(5, 8, 6, 8)]]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = sorted(map(tuple, jaccard.linked_components(docs, boundary).collect()), key=str)
    assert got == slow_components(texts)
    assert jaccard.linked_components(none, boundary).count() == 0


def test_hot_groups(spark, monkeypatch):
    """Frequent shingles listed, a cluster of several blocks: the result stays."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard, "CLUSTER_SETS", 40)
    texts = near_copies(9, 1, 150, 40) + [(1000 + i, t) for i, t in near_copies(9, 1, 3, 40)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard.linked_components(docs).collect()), key=str) == slow_components(texts)


def test_prefixes_keep_every_partner():
    """Any two sets with enough overlap share a signature, whichever side of the boundary they are on."""
    rng = np.random.default_rng(6)
    nothing = np.empty(0, np.uint64), np.empty(0, np.int64)
    for _ in range(300):
        n = int(rng.integers(2, 60))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = a[rng.random(len(a)) > 0.08]
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 60, rng.integers(0, 3)).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 85 * (len(a) + len(b) - common) and len(a) != common:
            for boundary in (2, 10, 20, 30):
                assert len(np.intersect1d(jaccard.signatures(a, *nothing, boundary), jaccard.signatures(b, *nothing, boundary)))


def test_component_labels(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    rows = jaccard.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()
    assert {r["node"]: r["label"] for r in rows} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_done_links_are_joined_no_more(spark, monkeypatch):
    """All links met all labels again in each round, so rows grew with links times rounds."""
    walk, made = np.random.default_rng(5).permutation(400).tolist(), []
    chain = list(zip(walk, walk[1:], strict=False))
    star = [(1000, 1001 + i) for i in range(400)] + [(2000 + i, 3000) for i in range(400)] + [(1400, 2000)]
    frame = spark.createDataFrame(chain + star + chain[:50] + [(b, a) for a, b in chain[:50]], "a bigint, b bigint")
    plain = type(frame).join

    def join(self, *args, **kwargs):
        out = plain(self, *args, **kwargs)
        made.append(out.count())
        return out

    monkeypatch.setattr(type(frame), "join", join)
    rows = jaccard.components(frame)
    assert {r["node"]: r["label"] for r in rows.collect()} == {
        **dict.fromkeys(range(400), 0), **dict.fromkeys([*range(1000, 1401), *range(2000, 2400), 3000], 1000)}
    assert sum(made) < 12 * 1200, made
    made.clear()
    assert jaccard.components(frame.limit(0)).count() == jaccard.components(frame.where("a = 7").selectExpr("a", "a AS b")).count() == 0


def slow_nearest(vectors, queries, k):
    out = []
    for q in queries:
        scored = sorted(((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(700)]
    rows += [(1000, None), (1001, [0.0] * 5), (1002, [1.0, None, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 5),
             (1004, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 5), (1005, [1.0, 2.0]), (1006, [3.0, 1.0]), (1007, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    queries = [i for i in good if i % 20 == 0 or i > 1000]
    asked = frame.where("vec_id % 20 = 0 OR vec_id > 1000")
    got = sorted(map(tuple, neighbours.nearest(frame, asked, 20, shard_rows=300, block_rows=10).drop("visited").collect()))
    assert got == sorted(slow_nearest(good, queries, 20))
    assert neighbours.nearest(frame.limit(0), asked.limit(0)).count() == 0


def test_relaxed_pruning_visits_less(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 6))
    points = np.repeat(centres, 100, axis=0) + rng.standard_normal((2000, 6)) * 0.05
    tree = neighbours.build(np.arange(2000), points, float(np.linalg.norm(points, axis=1).max()), 10)
    exact = neighbours.search(tree, np.arange(0, 2000, 50), points[::50], 10, 1.0)
    loose = neighbours.search(tree, np.arange(0, 2000, 50), points[::50], 10, 1.5)
    best = [set(np.argsort(-(points @ points[q]))[:11]) - {q} for q in range(0, 2000, 50)]
    recall = lambda r: np.mean([len(set(r[1][r[0] == i]) & b) / 10 for i, b in enumerate(best)])
    assert recall(exact) > 0.99 and recall(loose) >= 0.9 and loose[3] < exact[3] < 1


@pytest.mark.parametrize("name", ["op3_jaccard", "op4_neighbours"])
def test_queries_against_sql(spark, name):
    from inkwarden.llm import queries

    assert not compare(queries.QUERIES[name](spark, SMALL), connection(SMALL), queries.ORACLES[name])


PRIVATE = [
    (1, "Mr. John Smith and Mrs. Mary Jones met. JOHN@EXAMPLE.COM is john@example.com", 4),
    (2, "call (212) 555-0199 or +1 (212) 555-0199; 212.555.0199", 3),
    (3, "4111 1111 1111 1111 and 4111111111111111", 2),
    (4, "10.1.2.3 then 8.8.8.8, version 4.0. and 1.2.3.4.5", 2),
    (5, "Frau Müller, Господин Иван Петров, Κυρία Ελένη", 3),
    (6, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" 078-05-1120', 2),
    (7, None, 0), (8, "", 0), (9, "nothing here 12 345", 0), (9, "nothing here 12 345", 0), (None, "a@b.org", 1),
]


def test_surrogates(spark, none):
    docs = spark.createDataFrame([(i, t, "k") for i, t, _ in PRIVATE], "doc_id bigint, text string, kinds string")
    rows = surrogates.replace(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_replaced"]) for r in rows) == sorted((str(i), n) for i, _, n in PRIVATE)
    text = {r["doc_id"]: r["text"] for r in rows}
    assert text[7] is None and text[8] == "" and text[9] == "nothing here 12 345"
    loud, quiet = re.findall(r"\S+@\S+", text[1])
    assert loud == quiet.upper() and re.fullmatch(r"[a-z]{4}@[a-z]{7}\.example", quiet) and quiet != "john@example.example"
    assert re.match(r"Mr\. (?:%s) [A-Z][a-z]+ and Mrs\. (?:%s) " % tuple("|".join(surrogates.GIVEN["latin"][g]) for g in "mf"), text[1])
    digits = [re.sub(r"\D", "", x)[-10:] for x in re.split(r" or |; ", text[2])]
    assert len(set(digits)) == 1 and digits[0] != "2125550199" and "+1 (" in text[2]
    cards = [re.sub(" ", "", x) for x in text[3].split(" and ")]
    assert cards[0] == cards[1] != "4111111111111111" and luhn(cards[0])
    assert re.match(r"10\.\d+\.\d+\.\d+ then ", text[4]) and "1.2.3.4.5" in text[4] and "8.8.8.8" not in text[4]
    assert re.search(r"Господин [А-Я][а-я]+ [А-Я]", text[5]) and re.search(r"Κυρία [Α-Ω]", text[5])
    assert re.fullmatch(r'token = "[0-9a-f]{40}" \d{3}-\d{2}-\d{4}', text[6])
    assert surrogates.replace(none).count() == 0


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_collisions_end_in_distinct_surrogates(spark):
    """Thirty of a hundred two-digit values: nearly all first attempts clash with a value or each other."""
    known = spark.createDataFrame([("ssn", f"{i:02d}") for i in range(30)], "kind string, normal string")
    moved = {r["normal"]: r["attempt"] for r in surrogates.exceptions(known, "k").collect()}
    assert moved
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([("ssn", f"{i:02d}", moved.get(f"{i:02d}", 0)) for i in range(30)], "kind string, normal string, attempt int")
    made = [r[0] for r in rows.select(surrogates.surrogate(F.col("kind"), F.col("normal"), F.col("attempt"), "k")).collect()]
    assert len(set(made)) == 30 and not set(made) & {f"{i:02d}" for i in range(30)}


def test_exceptions_reach_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a 123-45-6789 b"), (2, "123-45-6789 and 999-99-9999")], "doc_id bigint, text string")
    plain = {r["doc_id"]: r["text"] for r in surrogates.replace(docs).collect()}
    moved = spark.createDataFrame([("ssn", "123456789", 1)], "kind string, normal string, attempt int")
    monkeypatch.setattr(surrogates, "exceptions", lambda known, key: moved)
    rows = {r["doc_id"]: r["text"] for r in surrogates.replace(docs).collect()}
    assert rows[1][2:13] == rows[2][:11] != plain[1][2:13] and rows[2][16:] == plain[2][16:]


def test_native_plan(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = surrogates.replace(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in stages.STAGES]
    assert names == [n for n, _ in corpus_pipeline.STAGES] and len(names) == 5
    seen = []
    for name, stage in stages.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.toPandas())
        if name != "packing":
            assert docs.columns == stages.COLUMNS
    language, civil, unique, private, packed = seen
    assert len(language) > 190 and set(civil["doc_id"]) <= set(language["doc_id"])
    texts = list(zip(civil["doc_id"], civil["text"], strict=True))
    assert sorted(unique["doc_id"]) == sorted(i for i, _, c in slow_components(texts) if i == c)
    assert sorted(private["doc_id"]) == sorted(unique["doc_id"])
    assert set(packed["doc_id"]) == set(private["doc_id"])


def test_stages_take_odd_and_empty_tables(spark, odd, none, tmp_path):
    for name, stage in stages.STAGES[2:]:
        assert stage(spark, none, SMALL).count() == 0
        rows = stage(spark, odd, SMALL)
        assert rows.count() > 0
    kept = [r["doc_id"] for r in stages.keep_first_of_alike(spark, odd, SMALL).collect()]
    assert sorted(map(str, kept)) == sorted(["1", "2", "3", "4", "5", "8", "9", "10", "None"])
    assert stages.keep_known_language(spark, none, SMALL).count() == 0
    assert stages.keep_civil(spark, none, SMALL).count() == 0
