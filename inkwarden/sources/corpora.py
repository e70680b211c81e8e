"""Labelled corpora and evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

CURATED_SCHEMA = "id bigint, split string, label int, category string, text string"


def _path_exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.format("binaryFile").load(path).limit(1).select("path").isEmpty()
    except Exception as error:  # noqa: BLE001 - Spark reports a missing path in several ways
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def read_corpus(spark: SparkSession, folder: str, columns: list[str],
                sources: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Labelled CSV files in one scan: ``source, rank, <columns>, label``.

    ``columns`` is the header of the files (all strings, blanks stay empty strings, broken
    lines are dropped).  Each file keeps only the rows with its wanted label text; the few
    sources are matched by file name.  A missing file is an error.
    """
    wanted = sources or fixed.EMAIL_CORPUS_FILES
    paths = [f"{folder.rstrip('/')}/{name}" for name in wanted]
    for path in paths:
        if not _path_exists(spark, path):
            raise FileNotFoundError(path)
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = (spark.read.schema(schema).option("header", "true").option("mode", "DROPMALFORMED")
            .option("multiLine", "true").option("quote", '"').option("escape", '"')
            .option("emptyValue", "").option("nullValue", "\u0000").csv(paths))
    tagged = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns],
                         F.concat(F.col("_metadata.file_path"), F.lit("/")).alias("_path"))
    source = F.lit(None).cast("string")
    rank, match, label = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for place, (file, (text, number)) in enumerate(wanted.items(), 1):
        here = F.contains("_path", F.lit(f"/{file}/"))
        source, rank, match, label = (F.when(here, F.lit(v)).otherwise(c) for v, c in (
            (file, source), (place, rank), (text, match), (number, label)))
    kept = tagged.select("*", source.alias("source"), match.alias("_match"), rank.alias("rank"),
                         label.alias("_label")).drop("_path")
    kept = kept.where(F.trim("label") == F.col("_match"))
    return kept.drop("label", "_match").withColumnRenamed("_label", "label")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``label, text`` without header and without quoting: a stray quote stays in its row."""
    return (spark.read.schema("label string, text string").option("sep", "\t").option("quote", "")
            .option("escape", "").option("mode", "PERMISSIVE").csv(path))


def read_curated(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "test"),
                 schema: str = CURATED_SCHEMA) -> DataFrame:
    """Evaluation rows; a value outside the allowed splits or labels fails the read."""
    rows = (spark.read.schema(schema).option("header", "true").option("multiLine", "true")
            .option("quote", '"').option("escape", '"').csv(path))
    bad = ~F.col("split").isin(list(splits)) | ~F.col("label").isin(0, 1) | F.col("label").isNull()
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(
        F.lit("split or label outside its domain in row "), F.col("id").cast("string")))
    ).otherwise(F.col("label"))
    return rows.withColumn("label", checked.cast("int"))
