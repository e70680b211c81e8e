"""The streamed audit log with seals, and bursts of hot moments."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from inkwarden.operators import ops
from inkwarden.streaming import poll, stateful

FIELDS = ["event", "seq"]


def _run(spark, tmp_path, schema):
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    stateful.sealed_log_stream(stream, ["box"], "seq", FIELDS, f"{tmp_path}/ledger", f"{tmp_path}/checkpoint", 10).awaitTermination()


def test_a_batch_that_dies_runs_again(spark, tmp_path, monkeypatch):
    rows = spark.range(90).select(F.when(F.col("id") % 3 != 0, "hot").otherwise("cold").alias("box"), F.col("id").alias("seq"), F.lit("scanned").alias("event"))
    publish = poll.Ledger.publish
    for i in range(3):
        rows.where(F.floor(F.col("seq") / 30) == i).write.mode("append").parquet(f"{tmp_path}/in")
        if i == 1:
            def dies(ledger, batch, at):
                raise OSError("gone before publishing")

            monkeypatch.setattr(poll.Ledger, "publish", dies)
            with pytest.raises(StreamingQueryException):
                _run(spark, tmp_path, rows.schema)
            assert poll.Ledger(spark, f"{tmp_path}/ledger").table("audit").count() == 30
            monkeypatch.setattr(poll.Ledger, "publish", publish)
        _run(spark, tmp_path, rows.schema)
    ledger = poll.Ledger(spark, f"{tmp_path}/ledger")
    lines, seals, heads = stateful.sealed_log(ledger)
    assert ledger.last() == 2 and lines.select("seq").distinct().count() == lines.count() == 90
    checked = {r["box"]: (r["ok"], r["files"]) for r in ops.verify_audit_log(lines, seals, heads, ["box"], FIELDS).collect()}
    assert checked == {"hot": (True, 9), "cold": (True, 9)}
    # A whole file with its seal goes: only the noted end shows it.
    end = seals.where("box = 'hot'").agg(F.max("file_no")).first()[0]
    kept = lambda df: df.where((F.col("box") != "hot") | (F.col("file_no") != end))
    lost = ops.verify_audit_log(kept(lines), kept(seals), heads, ["box"], FIELDS)
    assert {r["box"]: r["problem"] for r in lost.collect()} == {"hot": "the seals do not end as noted", "cold": ""}
    # No state but one row a chain.
    assert heads.count() == 2


def test_bursts_with_hot_moments_nulls_and_odd_times(spark):
    times = [0, 1, 1, 1, 937_499, 937_500, 937_501, 59_999_999, 60_000_000, 60_000_001, 60_937_500, 120_000_000, 120_000_001, -1, -60_000_001, None]
    hits = [(k, t) for k in ("a", None) for t in times * 2] + [("hot", 5)] * 20_000
    rows = spark.createDataFrame(hits, "client string, us bigint").withColumn("ts", F.timestamp_micros("us")).withColumn("_count", F.lit(1))
    got = ops.bursts(rows, ["client"], "ts", limit=3)
    assert got.columns == ["client", "us", "ts", "_count", "in_window", "burst"]
    own = [t for t in times * 2 if t is not None]
    found = got.groupBy("client", "us").agg(F.min("in_window").alias("low"), F.max("in_window").alias("high"), F.count("*").alias("n"), F.max("burst").alias("burst"))
    for r in found.collect():
        if r["us"] is None:
            want = 0
        elif r["client"] == "hot":
            want = 20_000
            assert r["n"] == 20_000
        else:
            want = sum(r["us"] - 60_000_000 <= t <= r["us"] for t in own)
        assert (r["low"], r["high"], r["burst"]) == (want, want, want > 3), r
    assert ops.bursts(rows.limit(0), ["client"], "ts", limit=3).count() == 0
