"""Patterns over texts with very many repetitions: none may recurse once for each of them."""

from pyspark.sql import functions as F

from inkwarden.functions import fixed, urls
from inkwarden.operators.ingest import route_kind
from inkwarden.sources.dims import load_dims


def test_routes_of_many_header_lines(spark):
    texts = {"many": "X-Line: 1\r\n" * 100_000, "two": "A: b\nC: d\nrest", "one": "A: b\nrest", "open": "A: b\nC: d", "long": "A:" + "x" * 1_000_000}
    rows = spark.createDataFrame(list(texts.items()), "id string, text string")
    got = {r["id"]: r["route"] for r in rows.select("id", route_kind(F.lit("email"), F.col("text")).alias("route")).collect()}
    assert got == {"many": "raw_email", "two": "raw_email", "one": "text", "open": "text", "long": "text"}


def test_bucket_hosts(spark):
    """As the stated pattern decides, and on a host of 100,000 labels."""
    hosts = ["s3.amazonaws.com", "a.s3.amazonaws.com", "a.s3-eu-west-1.amazonaws.com", "s3.eu.b.amazonaws.com", "s3.amazonaws.com.x.org",
             "s3x.amazonaws.com", "xs3.amazonaws.com", "s3..amazonaws.com", "s3.amazonaws.com.amazonaws.com", "s3-amazonaws.com", "s3.a.amazonaws.org"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select(
        "host", F.regexp_like("host", F.lit(urls._BUCKET_HOST)).alias("own"), F.regexp_like("host", F.lit(fixed.BUCKET_HOST)).alias("stated"))
    for r in rows.collect():
        assert r["own"] == r["stated"], r["host"]
    long = spark.createDataFrame([("s3." + "a." * 100_000 + "amazonaws.com",)], "host string")
    assert long.select(F.regexp_like("host", F.lit(urls._BUCKET_HOST))).first()[0]


def test_brand_files_with_many_domains(spark, tmp_path):
    path = tmp_path / "brands.json"
    path.write_text('{"acme": [' + ", ".join(f'"acme{i}.com"' for i in range(10_000)) + "]}")
    try:
        load_dims(spark, str(path))
    except ValueError as error:
        assert "more than fifty" in str(error)
    else:
        raise AssertionError("ten thousand domains are too many")
