"""What the verification of audit logs shuffles, and that blocks of lines find what a join of all lines found."""

import pytest
from pyspark.sql import functions as F

from inkwarden.operators import ops
from inkwarden.streaming import poll

FIELDS = ["event", "seq"]


@pytest.fixture(scope="module")
def lines(spark):
    rows = spark.range(60).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("box"), F.col("id").alias("seq"), F.lit("scanned").alias("event"))
    built = ops.build_audit_chain(rows, ["box"], "seq", FIELDS, 1000)
    return spark.createDataFrame(built.collect(), built.schema)


def _found(lines):
    return {r["box"]: (r["ok"], r["checked"], r["problem"]) for r in ops.verify_audit_chain(lines, ["box", "file_no"], FIELDS).collect()}


@pytest.mark.parametrize("block", [1, 4, 1 << 16])
def test_lines_meet_the_one_before_in_blocks(spark, lines, block, monkeypatch):
    monkeypatch.setattr(ops, "BLOCK_LINES", block, raising=False)
    whole = {"hot": (True, 40, ""), "cold": (True, 20, "")}
    assert _found(lines) == whole
    for line in (4, 5, 8):
        gone = lines.where((F.col("box") != "hot") | (F.col("line_no") != line))
        assert _found(gone) == whole | {"hot": (False, line, f"line {line + 1}: chain broken (line missing or reordered)")}
        edited = lines.withColumn("event", F.when((F.col("box") == "hot") & (F.col("line_no") == line), "x").otherwise(F.col("event")))
        assert _found(edited) == whole | {"hot": (False, line - 1, f"line {line}: contents were modified")}
        # A line that comes twice is met by the next one twice; another hash on its number breaks the chain.
        twice = lines.unionByName(lines.where((F.col("box") == "hot") & (F.col("line_no") == line)))
        assert _found(twice) == whole | {"hot": (True, 42, "")}
        other = lines.unionByName(lines.where((F.col("box") == "hot") & (F.col("line_no") == line)).withColumn("hash", F.sha2("hash", 256)))
        assert _found(other)["hot"] == (False, line - 1, f"line {line}: contents were modified")
        bare = lines.withColumn("hash", F.when((F.col("box") != "hot") | (F.col("line_no") != line), F.col("hash")))
        assert _found(bare)["hot"] == (False, line - 1, f"line {line} is not a valid audit entry")
        short = lines.withColumn("hash", F.when((F.col("box") == "hot") & (F.col("line_no") == line), F.lit("no digest")).otherwise(F.col("hash")))
        assert _found(short)["hot"] == (False, line - 1, f"line {line}: contents were modified")


def test_no_text_of_a_line_is_shuffled(spark, lines, tmp_path):
    lines.write.parquet(f"{tmp_path}/lines")
    stored = spark.read.parquet(f"{tmp_path}/lines")
    plan = ops.verify_audit_chain(stored, ["box", "file_no"], FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_ledger_tables_are_written_small(spark, lines, tmp_path):
    ledger = poll.Ledger(spark, f"{tmp_path}/ledger")
    assert ledger.stage("audit", lines, 0).count() == 60
    assert all(".zstd." in str(p) for p in (tmp_path / "ledger").rglob("part-*.parquet"))
