"""Tables the scoring jobs write: incidents, quarantine records, audit, caches, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.ops import audit_tail, latest_versions


def incident_id(created: Column, key: Column) -> Column:
    """``YYYYMMDDTHHMMSSZ-`` and 32 hexadecimal digits: sortable by time, derived from the message key.

    128 bits keep the ids of any number of messages of one second apart.
    """
    return F.concat(F.date_format(created, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"),
                    F.left(F.sha2(key.cast("string"), 256), F.lit(32)))


def valid_incident_id(value: Column) -> Column:
    return F.regexp_like(value, F.lit(r"^[0-9]{8}T[0-9]{6}Z-[0-9a-f]{32}$"))


def write_incidents(verdicts: DataFrame, path: str, created: Column, mode: str = "append") -> None:
    """Reports of everything that was not delivered; bodies are not part of a report."""
    flagged = verdicts.where(F.col("action") != "deliver")
    reports = (flagged.withColumn("created_at", created)
               .withColumn("incident_id", incident_id(F.col("created_at"), F.col("msg_id")))
               .withColumn("date", F.to_date("created_at")))
    reports.write.mode(mode).partitionBy("date").parquet(path)


def recent_incidents(reports: DataFrame, limit: int = 100) -> DataFrame:
    return reports.orderBy(F.desc("incident_id")).limit(limit)


def incident(reports: DataFrame, wanted: str) -> DataFrame:
    """One report; the day in the id prunes the partitions."""
    rows = reports.where((F.col("incident_id") == wanted) & valid_incident_id(F.lit(wanted)))
    if "date" in reports.columns and len(wanted) >= 8 and wanted[:8].isdigit():
        day = f"{wanted[:4]}-{wanted[4:6]}-{wanted[6:8]}"
        rows = rows.where(F.col("date") == F.lit(day).cast("date"))
    return rows


def upsert_quarantine(records: DataFrame, path: str) -> None:
    """Append new versions; readers keep the latest one."""
    records.where(valid_incident_id(F.col("incident_id"))).write.mode("append").parquet(path)


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    return latest_versions(spark.read.parquet(path))


AUDIT_SCHEMA = "seq bigint, ts string, event string, action_taken string, prev string, hash string"


def parse_audit_lines(lines: DataFrame, schema: str = AUDIT_SCHEMA, column: str = "value") -> DataFrame:
    """JSON lines to audit rows; lines that are not JSON objects are dropped."""
    parsed = lines.select("*", F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}).alias("_e"))
    usable = F.regexp_like(column, F.lit(r"^\s*\{.*\}\s*$")) & (
        F.coalesce("_e.event", "_e.hash").isNotNull())
    return parsed.where(usable).select("_e.*")


def read_audit_tail(spark: SparkSession, path: str, limit: int = fixed.AUDIT_TAIL) -> DataFrame:
    return audit_tail(parse_audit_lines(spark.read.text(path)), limit)


def signature(files: DataFrame, version: int = 2) -> str:
    """Version, file count and total size of a folder listing (``path, length``)."""
    row = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
    return f"v{version}-{row['n']}-{row['b']}"


def prepared_corpus(spark: SparkSession, files: DataFrame, build, cache: str,
                    version: int = 2) -> DataFrame:
    """``build()`` stored once per folder signature; neither an empty cache nor half of one is trusted.

    After the rows a second table gets their number; the cache counts only if that table is there and agrees.
    """
    path = f"{cache.rstrip('/')}/{signature(files, version)}"
    try:
        stored = spark.read.parquet(f"{path}/rows")
        written = spark.read.parquet(f"{path}/written").first()
        if written and written["n"] and stored.count() == written["n"]:
            return stored
    except Exception as error:  # noqa: BLE001 - no cache yet, or an unreadable one
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    build().write.mode("overwrite").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    stored.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/written")
    return stored


def write_metrics(metrics: DataFrame, path: str, model: str, normaliser: str, test_set: str) -> None:
    """Metric columns of one row to long rows ``(model, normaliser, test_set, metric, value)``."""
    names = metrics.columns
    pairs = F.explode(F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names])))
    long = metrics.select(F.lit(model).alias("model"), F.lit(normaliser).alias("normaliser"),
                          F.lit(test_set).alias("test_set"), pairs.alias("metric", "value"),
                          F.current_timestamp().alias("recorded_at"))
    long.write.mode("append").parquet(path)
