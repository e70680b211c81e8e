"""Admission by blocks of moments against one list per key."""

import random

import pytest
from inkwarden.operators import admission
from inkwarden.session import work_folder
from inkwarden.streaming import poll, stateful
from pyspark.sql import functions as F

SECOND = 1_000_000


def brute(batches, limit, seconds):
    recent, out = {}, {}
    for rows in batches:
        for key, us, hit in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
            times = [t for t in recent.get(key, []) if us - t <= seconds * SECOND]
            out[hit] = len(times) < limit
            recent[key] = times + [us] * out[hit]
        out |= {r[2]: False for r in rows if r[1] is None}
    return out


def hits(seed, n, span):
    """A third of all hits is of one client, a part of these of one moment; some have no client, some no time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        key = "hot" if kind < 0.4 else None if kind < 0.5 else rng.choice("abcdefgh")
        us = span // 2 if kind < 0.1 else None if 0.97 < kind else rng.randrange(span) // 1000 * 1000
        rows.append((key, us, i))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "client string, us bigint, hit_id bigint").withColumn("ts", F.timestamp_micros("us"))


@pytest.mark.parametrize(("limit", "seconds", "block"), [(1, 5, 512), (3, 1, 4), (5, 40, 7), (200, 60, 512)])
def test_admission_of_a_table(spark, monkeypatch, limit, seconds, block):
    monkeypatch.setattr(admission, "BLOCK", block)
    rows = hits(limit, 1500, 120 * SECOND)
    got = admission.admit(table(spark, rows).repartition(6), "client", "ts", limit, seconds).collect()
    assert len(got) == len(rows)
    assert {r.hit_id: r.admitted for r in got} == brute([rows], limit, seconds)
    assert {r.hit_id: r.key for r in got} == {r[2]: r[0] for r in rows}


def test_admission_goes_on_over_late_and_empty_batches(spark):
    parts = [hits(1, 300, 60 * SECOND), [], [(k, u, h + 1000) for k, u, h in hits(2, 300, 30 * SECOND)],
             [(k, None if u is None else u + 60 * SECOND, h + 2000) for k, u, h in hits(3, 300, 60 * SECOND)]]
    state, got = None, {}
    for rows in parts:
        batch = admission.timed_hits(table(spark, rows), "client", "ts")
        found = admission.admissions(batch, 3, 10, state).collect()
        again = spark.createDataFrame(found, admission.ADMISSIONS)
        state = again.where("recent is not null").select("key", "recent")
        assert all(len(r.recent) <= 3 for r in state.collect())
        got |= {r.hit_id: r.admitted for r in admission.decisions(batch, again, 3).collect()}
    assert got == brute(parts, 3, 10)


def test_the_ordered_pass_skips_what_cannot_be_admitted(spark):
    """One client with 200,000 moments: the pass reads blocks, and few rows leave it."""
    flood = spark.range(0, 200_000, 1, 8).select(F.lit("hot").alias("key"), F.col("id").alias("hit_id"),
                                                 (F.col("id") * 1000).alias("us"))
    found = admission.admissions(flood, 2, 10).where("us is not null").orderBy("us").collect()
    expected = [us for start in range(0, 200_000_000, 10_001_000) for us in (start, start + 1000)]
    # Two are admitted at once, then each as soon as its time has passed.
    assert [r.us for r in found] == [us for us in expected if us < 200_000_000]


def test_a_batch_that_runs_again_changes_nothing(spark, monkeypatch):
    folder = work_folder(spark)
    rows = hits(9, 200, 60 * SECOND)
    table(spark, rows).write.parquet(f"{folder}/in")
    start = lambda: stateful.admission_stream(
        spark.readStream.schema("client string, us bigint, hit_id bigint, ts timestamp").parquet(f"{folder}/in"),
        "client", "ts", 3, f"{folder}/ledger", f"{folder}/checkpoint", 10)

    def dies(ledger, batch, at):
        raise RuntimeError("lost before it was published")

    with monkeypatch.context() as broken:
        broken.setattr(poll.Ledger, "publish", dies)
        with pytest.raises(Exception, match="lost before"):
            start().awaitTermination()
    ledger = poll.Ledger(spark, f"{folder}/ledger")
    assert ledger.last() == -1 and ledger.table("decisions").count() == 0
    start().awaitTermination()
    start().awaitTermination()
    got = ledger.table("decisions").collect()
    assert len(got) == len(rows) and {r.hit_id: r.admitted for r in got} == brute([rows], 3, 10)


def test_a_limit_below_one_is_refused(spark):
    with pytest.raises(ValueError, match="at least 1"):
        admission.admit(table(spark, []), "client", "ts", 0)


def test_an_empty_table(spark):
    assert admission.admit(table(spark, []), "client", "ts", 2).count() == 0
