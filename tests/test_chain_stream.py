"""The audit chain as a stream: equal to the batch chain, with few state rows for many short files."""

from pyspark.sql import functions as F

from inkwarden.operators import ops
from inkwarden.streaming import stateful

FIELDS = ["event", "seq"]


def test_many_short_files_share_state_rows(spark, tmp_path):
    box = F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.lit(2**60) + F.col("id") % 50)
    rows = spark.range(1200).select(box.cast("bigint").alias("box"), F.when(F.col("id") % 7 == 0, "two \"marks\"").alias("desk"),
                                    F.col("id").alias("seq"), F.lit("scanned").alias("event"))
    for low, high in ((0, 450), (450, 451), (451, 1200)):  # files go on over batches
        rows.where((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stateful.chain_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), ["box", "desk"], "seq", FIELDS, 300, parts=4)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
            "checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = ops.build_audit_chain(rows, ["box", "desk"], "seq", FIELDS, 300)
    assert got.columns == ["box", "desk", "file_no", "seq", "prev", "hash"]
    assert got.schema["box"].dataType == rows.schema["box"].dataType
    names = rows.select("box", "desk", F.floor(F.col("seq") / 300).alias("file_no"), "seq")
    links = names.join(want.select("seq", "prev", "hash"), "seq").select(*got.columns)
    assert sorted(got.collect(), key=lambda r: r["seq"]) == sorted(links.collect(), key=lambda r: r["seq"])
    files = names.select("box", "desk", "file_no").distinct().count()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]
    assert files > 300 and 0 < states <= 4 * 4
