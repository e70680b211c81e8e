"""Table jobs against brute force on small rows."""

import itertools
import math
import random
import re

import pytest
from inkwarden.functions import fixed
from inkwarden.operators import corpus, evaluate, model, ops, ordering, similarity
from inkwarden.plans import stream_queries
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


def test_exact_quantile(spark):
    values = [-5, 0, 3, 3, 3, 9, 2 ** 40, 17]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for q in (0.0, 0.3, 0.7, 1.0):
        place = (len(values) - 1) * q
        low, high = sorted(values)[math.floor(place)], sorted(values)[math.ceil(place)]
        got = ordering.exact_quantile(df, "v", q).first()[0]
        assert got == pytest.approx(low + (high - low) * (place - math.floor(place)))


def test_roc_auc_counts_ties_half(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(80)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg))
    df = spark.createDataFrame(rows, "label int, score double")
    assert evaluate.roc_auc(df).first()["roc_auc"] == pytest.approx(round(wins / len(pos) / len(neg), 4))


def test_similar_pairs_equal_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(4) for j in range(5)]
    # One text is copied many times: a third of all rows.
    texts = [" ".join(rng.sample(vocabulary, rng.randint(2, 9))) for _ in range(40)] + ["wa same copied text"] * 20
    frozen = [" ".join(rng.sample(vocabulary, rng.randint(2, 9))) for _ in range(15)] + ["wa same copied text"]
    left = spark.createDataFrame(list(enumerate(texts)), "a int, text string")
    right = spark.createDataFrame(list(enumerate(frozen)), "b int, text string")
    expected = set()
    for (i, x), (j, y) in itertools.product(enumerate(texts), enumerate(frozen)):
        s, t = set(x.split()), set(y.split())
        if len(s & t) / len(s | t) >= 0.4:
            expected.add((i, j))
    got = similarity.similar_pairs(left, right, "a", "b")
    assert {(r.a, r.b) for r in got.collect()} == expected


def test_first_copy_wins(spark):
    rows = [(1, 0, "x" * 30), (0, 5, "x" * 30), (0, 7, "y" * 30), (0, 1, "short")]
    df = spark.createDataFrame(rows, "rank int, row int, text string")
    kept = corpus.drop_near_duplicates(df, "rank", "row").collect()
    assert {(r["rank"], r["row"]) for r in kept} == {(0, 5), (0, 7)}


def _entries(spark, n=40):
    return spark.createDataFrame([(s, f"e{s % 3}", "m1" if s % 3 else "é") for s in range(n)],
                                 "seq bigint, event string, mailbox string")


@pytest.fixture(scope="module")
def chain(spark):
    built = ops.build_audit_chain(_entries(spark), ["mailbox"], "seq", ["seq", "event", "mailbox"], 16)
    rows = built.collect()
    return spark.createDataFrame(rows, built.schema)


def _verify(lines):
    found = ops.verify_audit_chain(lines, ["mailbox", "file_no"], ["seq", "event", "mailbox"])
    return {(r.mailbox, r.file_no): (r.ok, r.problem) for r in found.collect()}


def test_intact_chain(chain):
    assert all(ok for ok, _ in _verify(chain).values())


def test_edited_entry_is_found(chain):
    edited = chain.withColumn("event", F.when(F.col("seq") == 4, "changed").otherwise(F.col("event")))
    bad = {k: v for k, v in _verify(edited).items() if not v[0]}
    assert list(bad) == [("m1", 0)] and "contents were modified" in bad[("m1", 0)][1]


def test_missing_entry_is_found(chain):
    from pyspark.sql import Window as W

    left = chain.where("seq <> 4").withColumn(
        "line_no", F.row_number().over(W.partitionBy("mailbox", "file_no").orderBy("seq")))
    bad = {k: v for k, v in _verify(left).items() if not v[0]}
    assert list(bad) == [("m1", 0)] and "chain broken" in bad[("m1", 0)][1]


@pytest.mark.parametrize("loss,problem", [
    (None, ""), ("line", "file 0 does not end as sealed"), ("file", "file 1 is missing"), ("all", "the seals do not end as noted"),
    ("seal", "the seals do not end as noted"), ("edit", "file 1 line 1: contents were modified"), ("swap", "seal line 1: contents were modified")])
def test_sealed_logs(spark, chain, loss, problem):
    fields = ["seq", "event", "mailbox"]
    seals = ops.seal_audit_files(chain, ["mailbox"])
    seals = spark.createDataFrame(seals.collect(), seals.schema)
    heads = ops.audit_heads(seals, ["mailbox"])
    lines, own = chain, F.col("mailbox") == "m1"
    if loss == "line":
        lines = chain.where(~(own & (F.col("seq") == 14)))
    if loss == "file":
        lines = chain.where(~(own & (F.col("file_no") == 1)))
    if loss in ("all", "seal"):
        seals = seals.where(~(own & (F.col("file_no") == 2)))
        lines = lines.where(~(own & (F.col("file_no") == 2))) if loss == "all" else lines
    if loss == "edit":
        lines = chain.withColumn("event", F.when(own & (F.col("seq") == 16), "x").otherwise(F.col("event")))
    if loss == "swap":
        seals = seals.withColumn("rows", F.when(own & (F.col("file_no") == 0), 9).otherwise(F.col("rows")))
    found = {r.mailbox: (r.ok, r.problem) for r in ops.verify_audit_log(lines, seals, heads, ["mailbox"], fields).collect()}
    assert found == {"m1": (problem == "", problem), "\u00e9": (True, "")}


def test_the_size_of_a_file_changes_nothing_that_is_found(spark):
    for size in (1, 7, 1000):
        built = ops.build_audit_chain(_entries(spark), ["mailbox"], "seq", ["seq", "event", "mailbox"], size)
        seals = ops.seal_audit_files(built, ["mailbox"])
        heads = ops.audit_heads(seals, ["mailbox"])
        bad = ops.verify_audit_log(built.where("seq <> 20"), seals, heads, ["mailbox"], ["seq", "event", "mailbox"])
        assert {r.mailbox for r in bad.where("NOT ok").collect()} == {"m1"}


def test_ids_of_one_second_stay_apart(spark):
    from inkwarden.sources.stores import incident_id

    ids = spark.range(1_000_000).select(incident_id(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("id")).alias("i"))
    assert ids.distinct().count() == 1_000_000


def test_bursts_equal_brute_force(spark):
    rng = random.Random(9)
    # One key holds most hits.
    hits = [(i, "hot" if rng.random() < 0.7 else f"k{i % 4}", rng.randint(0, 600)) for i in range(300)]
    df = spark.createDataFrame(hits, "hit int, key string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.hit: r.in_window for r in ops.bursts(df, ["key"], "ts", 5).collect()}
    for i, key, s in hits:
        assert got[i] == sum(k == key and s - 60 <= t <= s for _, k, t in hits)


def test_admission_equals_brute_force(spark):
    got = {r.hit_id: r.admitted for r in stream_queries.admitted_hits(spark, SF_DIR).collect()}
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").select(
        "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect()
    # Hits are handled in their order of arrival: by third of the ids, then by time.
    top, recent = max(r.event_id for r in events) + 1, {}
    third = lambda r: next(i for i in range(3) if r.event_id < top * (i + 1) // 3)
    for r in sorted(events, key=lambda r: (third(r), r.us, r.event_id)):
        key = r.user_id % 50
        times = [t for t in recent.get(key, []) if r.us - t <= 3600 * 10 ** 6]
        admitted = len(times) < 2
        recent[key] = times + [r.us] * admitted
        assert got.pop(r.event_id) == admitted
    assert not got


# ---------------------------------------------------------------- text model


def _terms(text, stop):
    kept = [w for w in re.findall(r"\b[a-z]{2,}\b", text.lower()) if w not in stop]
    return kept + [f"{a} {b}" for a, b in zip(kept, kept[1:], strict=False)]


TEXTS = ["claim your prize money now", "the meeting notes of the project team", "prize money prize",
         "team meeting on monday", "", "claim the team prize"]


def test_scores_equal_brute_force(spark):
    table = {"prize": (1.5, 2.0), "prize money": (1.9, 1.0), "team": (1.2, -1.5), "meeting": (1.4, -0.5)}
    fitted = model.TextModel(spark.createDataFrame(
        [(t, i, c) for t, (i, c) in table.items()], "term string, idf double, coef double"), 0.25)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {r.id: r for r in model.predict(docs, fitted, "id", "text").collect()}
    for i, text in enumerate(TEXTS):
        found = [t for t in _terms(text, fixed.CORPUS_STOP_WORDS) if t in table]
        w = {t: (1 + math.log(found.count(t))) * table[t][0] for t in found}
        length = math.sqrt(sum(x * x for x in w.values())) or 1.0
        parts = {t: x / length * table[t][1] for t, x in w.items()}
        assert got[i].probability == pytest.approx(1 / (1 + math.exp(-sum(parts.values()) - 0.25)))
        best = sorted((t for t in parts if parts[t] > 0), key=lambda t: (-parts[t], t))
        assert [t.term for t in got[i].top] == best


def test_scoring_does_not_shuffle(spark):
    fitted = model.TextModel(spark.createDataFrame([("prize", 1.0, 1.0)], "term string, idf double, coef double"), 0.0)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    plan = model.predict(docs, fitted, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_term_statistics(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {r.term: (r.df, r.total) for r in model.term_statistics(docs, "text", ["the", "of", "on"]).collect()}
    lists = [_terms(t, ["the", "of", "on"]) for t in TEXTS]
    assert got == {t: (sum(t in found for found in lists), sum(found.count(t) for found in lists))
                   for t in set(itertools.chain(*lists))}


def test_training_separates(spark):
    rows = [(i, "win prize money today" if i % 2 else "project meeting notes attached", i % 2) for i in range(20)]
    fitted = model.train(spark.createDataFrame(rows, "id int, text string, label int"), max_iterations=20)
    coef = {r.term: r.coef for r in fitted.terms.collect()}
    assert coef["prize"] > 0 > coef["meeting"]


def test_oversized_or_empty_model_is_refused(spark):
    empty = spark.createDataFrame([], "term string, idf double, coef double")
    with pytest.raises(ValueError):
        model.TextModel(empty, 0.0).lookup


def test_changed_model_is_refused(spark):
    terms = spark.createDataFrame([("prize", 1.0, 1.0), ("team", 1.0, -1.0)], "term string, idf double, coef double")
    known = model.fingerprint(terms).first()["fingerprint"]
    assert model.verify_fingerprint(terms.orderBy(F.desc("term")), known).count() == 2
    with pytest.raises(ValueError):
        model.verify_fingerprint(terms.withColumn("coef", F.col("coef") * 1.0001), known)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_without_a_shuffle(spark):
    from inkwarden.operators import model

    docs = spark.createDataFrame([(1, "red red blue"), (2, ""), (3, None), (4, "green")], "id int, text string")
    found = model.term_counts(docs, "id", "text", [])
    assert {(r.id, r.term): r.tf for r in found.collect() if " " not in r.term} == {(1, "red"): 2, (1, "blue"): 1, (4, "green"): 1}
    assert "Exchange" not in _plan(found)


def test_model_scoring_reads_vectors_without_json(spark):
    from inkwarden.operators import model

    rows = spark.createDataFrame([(i, f"alpha beta word{i % 5} gamma" if i % 2 else "delta epsilon zeta", i % 2) for i in range(40)],
                                 "id int, text string, label int")
    fitted = model.train(rows, max_iterations=5)
    scored = model.predict(rows, fitted, "id", "text")
    assert "to_json" not in _plan(scored).lower() and scored.count() == 40


def test_splits_shuffle_no_text(spark):
    rows = [(i, f"text {i}", i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, text string, label int")
    parts = corpus.stratified_split(df, "id")
    counts = {(r["label"], r["split"]): r["count"] for r in parts.groupBy("label", "split").count().collect()}
    assert counts == {(label, split): n for label in range(3) for split, n in (("test", 20), ("train", 80))}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        # The boundaries are broadcast by their bound, not because the table happens to be small.
        plan = _plan(corpus.stratified_split(df, "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    with pytest.raises(ValueError):
        corpus.stratified_split(spark.range(25_000).select("id", F.floor(F.col("id") / 2).alias("label")), "id", test_share=0.5)


def test_workers_get_the_package(tmp_path):
    """A session started outside the repository, whose workers cannot import the package by themselves."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from inkwarden.session import local_session, ship_package
from inkwarden.operators import ops
spark = local_session("2", **{{"spark.driver.memory": "1g"}})
ship_package(spark)
rows = spark.createDataFrame([(i, "e", "m") for i in range(9)], "seq bigint, event string, mailbox string")
print("LINES", ops.build_audit_chain(rows, ["mailbox"], "seq", ["seq", "event", "mailbox"], 4).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "LINES 9" in done.stdout, done.stderr[-2000:]


def test_mails_of_one_file_are_many_tasks(spark):
    """A table of few bytes is one split; the rules on it run in as many tasks as the session shuffles into, on the same rows."""
    from inkwarden.plans import inputs

    rows = inputs.mail_columns(spark, "/root/testdata/sf0.01")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert inputs.table(spark, "/root/testdata/sf0.01", "customer").rdd.getNumPartitions() < n == rows.rdd.getNumPartitions()
    assert rows.count() == inputs.table(spark, "/root/testdata/sf0.01", "customer").count()


def test_models_travel_outside_the_plan(spark):
    """A vocabulary of many terms is no part of the plan, however often its numbers are used; null texts have no terms."""
    words = [a + b + c for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"]
    fitted = model.TextModel(spark.createDataFrame([(w, 1.0, 0.5) for w in words], "term string, idf double, coef double"), 0.0)
    docs = spark.createDataFrame([(1, "aku bku aku"), (2, None), (3, "")], "id int, text string")
    scored = model.predict(docs, fitted, "id", "text")
    assert "bku" not in scored._jdf.queryExecution().toString()
    got = {r.id: [t.term for t in r.top] for r in scored.collect()}
    assert got == {1: ["aku", "bku"], 2: [], 3: []}


def test_blended_lists_are_bound_once(spark):
    """Sorting both lists again for each of their terms takes a plan that names them several times."""
    parts = spark.createDataFrame([([(0.4, "a"), (0.2, "b")], [(0.3, "b"), (0.1, "c")])],
                                  "x array<struct<contribution:double,term:string>>, y array<struct<contribution:double,term:string>>")
    best = lambda name: model.best_terms(F.col(name), 15)
    out = parts.select(model.blended_top(best("x"), best("y")).alias("top"))
    assert [t.term for t in out.first().top] == ["b", "a", "c"]
    assert out._jdf.queryExecution().analyzed().toString().count("array_sort") <= 3
