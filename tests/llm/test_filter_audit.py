"""The audit against a walk over all orders, its SQL, and colliding hashes."""

from collections import Counter, defaultdict
from itertools import permutations

import compare
import pytest
from pyspark.sql import functions as F

from inkwarden.llm import filter_audit as fa

DATA = "/root/testdata/sf0.01"


def plain(docs, labels):
    """Applies each order row by row."""
    first, known, parts = {}, defaultdict(lambda: (0, 0)), defaultdict(list)
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, good, bad in labels:
        if i is not None:
            known[i] = (max(known[i][0], good == 1), max(known[i][1], bad == 1))
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
                 "E": i is not None and text in first and first[text] < i}
        parts[lang or ""].append(({k for k, v in fails.items() if v}, *(known[i] if i is not None else (0, 0))))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in rows)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in rows),
                                                   sum(r[1] for r in gone), sum(r[2] for r in gone)]
                shapley[f] += len(gone)
        for key in out:
            if key[0] == part:
                out[key] = out[key][:6] + [shapley[key[1][key[2] - 1]]]
    return out


def got(frame):
    rows = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in frame.collect()}
    assert frame.count() == len(rows)
    return rows


TEXTS = [None, "", " \t\n ", "ABC def", "a # b", "word " * 200, " ".join(f"w{i}" for i in range(150)), "É" * 40 + " AB",
         " ".join(f"W{i}" for i in range(120)) + " $", "x\x1fy z q", "long " + "text" * 60000]


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(i, TEXTS[i % len(TEXTS)], [None, "", "en", "fr"][i % 4]) for i in range(90)]
    docs += [(None, "", "en"), (None, "a # b", None), (7, TEXTS[7], "fr"), (7, "another", "fr"), (200, "only once", "de"), (-5, "a # b", "de")]
    labels = [(i, i % 3 % 2, i % 2) for i in range(0, 90, 2)] + [(4, 1, None), (None, 1, 1), (7, None, 1), (500, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumns(
        {"mask": F.lit(9), "hash": F.lit("x"), "part": F.lit(3), "first": F.lit(0)})
    return docs, labels, frame.repartition(5), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_odd_rows_in_all_orders(rows):
    docs, labels, frame, marks = rows
    assert got(fa.audit(frame, marks)) == plain(docs, labels)


def test_colliding_hashes_are_told_apart_by_text(rows, monkeypatch):
    docs, labels, frame, marks = rows
    hashed = fa.hashed
    monkeypatch.setattr(fa, "hashed", lambda d: hashed(d).withColumn("hash", (F.length("text") % 3).cast("bigint")))
    assert got(fa.audit(frame, marks)) == plain(docs, labels)


def test_sketch_clears_texts_that_occur_once(spark, monkeypatch):
    monkeypatch.setattr(fa, "SHARD", 1 << 12)
    hashes = spark.range(40000).select(F.xxhash64("id").alias("hash"))
    twice = spark.range(0, 40000, 400).select(F.xxhash64("id").alias("hash"))
    hot = spark.range(30000).select(F.xxhash64(F.lit(-1)).alias("hash"))
    left = [r["hash"] for r in fa.possible_repeats(hashes.union(twice).union(hot).repartition(7), 70100).collect()]
    must = {r["hash"] for r in twice.union(hot.limit(1)).collect()}
    assert must <= set(left) and len(left) == len(set(left)) < len(must) + 400


def test_empty_tables(rows):
    _, _, frame, marks = rows
    assert fa.audit(frame.limit(0), marks).count() == 0
    assert len(got(fa.audit(frame, marks.limit(0)))) == 600 * 4


def test_query_equals_its_sql(spark):
    assert compare.compare(fa.op12_filter_audit(spark, DATA), compare.connection(DATA), fa.OP12_SQL) == ""
