"""Reference dimensions: brand extension files and public suffix lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.domains import DEFAULT, Dims, normalise_host, registered_domain

_HOST = r"^(?=.{4,253}$)(?:[a-z0-9-]{1,63}\.)+[a-z]{2,63}$"
_MAX_BYTES = 256 * 1024


def extra_brand_violations(brands: DataFrame) -> DataFrame:
    """``(brand, problem)`` rows of an extension ``(brand, domains, clean)``; empty when valid."""
    size = F.coalesce(F.size("domains"), F.lit(0))
    bad_host = F.exists("clean", lambda d: d.isNull() | ~F.regexp_like(d, F.lit(_HOST)))
    problem = (F.when(~F.regexp_like("brand", F.lit(r"^[a-z0-9]{2,40}$")), "its name is not 2 to 40 lower-case letters and digits")
               .when((size < 1) | (size > fixed.MAX_EXTRA_DOMAINS), "it has no domain, or more than fifty")
               .when(bad_host | (F.size(F.array_distinct("clean")) != size), "a domain is no registered name, or is there twice"))
    return brands.select("brand", problem.alias("problem")).where(F.col("problem").isNotNull())


def load_dims(spark: SparkSession, extra_brands: str | None = None, base: Dims = DEFAULT) -> Dims:
    """Brands, extended by a JSON file ``{"brand": ["domain", ...]}``; invalid files fail."""
    if extra_brands is None:
        return base
    files = spark.read.format("binaryFile").load(extra_brands)
    if files.where(F.col("length") > _MAX_BYTES).count():
        raise ValueError(f"{extra_brands}: more than {_MAX_BYTES} bytes of brand data")
    text = files.select(F.decode("content", "UTF-8").alias("json"))
    parsed = text.select(F.from_json("json", "map<string,string>").alias("m"),
                         F.regexp_like("json", F.lit(r"^\s*\{")).alias("is_object"))
    if parsed.where(F.col("m").isNull() | ~F.col("is_object")).count():
        raise ValueError(f"{extra_brands}: no JSON object that maps brands to lists")
    rows = parsed.select(F.explode("m").alias("brand", "value"))
    strings = rows.select("brand", F.when(F.regexp_like("value", F.lit(
        r"^\s*+\[(?:\s*+\"[^\"]*+\"\s*+,?)*+\s*+\]\s*+$")), F.from_json("value", "array<string>")).alias("domains"))
    cleaned = strings.withColumn("clean", F.transform(
        "domains", lambda d: registered_domain(normalise_host(d), base)))
    found = cleaned.limit(fixed.MAX_EXTRA_BRANDS + 1).collect()
    if len(found) > fixed.MAX_EXTRA_BRANDS:
        raise ValueError(f"{extra_brands}: more than {fixed.MAX_EXTRA_BRANDS} brands")
    problem = extra_brand_violations(cleaned).first()
    if problem is not None:
        raise ValueError(f"{extra_brands}, entry {problem['brand']!r}: {problem['problem']}")
    return base.with_brands({r["brand"]: list(dict.fromkeys(r["clean"])) for r in found})


def load_suffixes(spark: SparkSession, path: str, base: Dims = DEFAULT) -> Dims:
    """A full public suffix list (one rule per line, ``//`` comments, ``*.`` and ``!`` rules).

    Only the first part of such a list (up to the private section) is used.
    """
    rules = spark.read.text(path).select(F.trim("value").alias("rule")).where(
        (F.col("rule") != "") & ~F.startswith("rule", F.lit("//")))
    rows = [r["rule"] for r in rules.limit(20_001).collect()]
    if len(rows) > 20_000:
        raise ValueError("public suffix list has too many rules")
    plain = [r for r in rows if r[0] not in "!*"]
    return Dims(base.brands, base.phrases, tuple(dict.fromkeys([*plain, "bank.in"])),
                tuple(r[2:] for r in rows if r.startswith("*.")),
                tuple(r[1:] for r in rows if r.startswith("!")))


def brand_tables(spark: SparkSession, dims: Dims = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The brand data as tables: ``(brand, brand_rank, domain)`` and ``(…, phrase)``."""
    domains = [(b, i, d) for i, (b, ds) in enumerate(dims.brands.items()) for d in ds]
    phrases = [(b, i, p) for i, b in enumerate(dims.brands) for p in dims.phrases_of(b)]
    return (spark.createDataFrame(domains, "brand string, brand_rank int, domain string"),
            spark.createDataFrame(phrases, "brand string, brand_rank int, phrase string"))
