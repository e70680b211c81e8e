"""Stages of the corpus pipeline; each takes (spark, docs, sf_dir) and works on all rows of ``docs``.

All but the last return the columns of ``documents``.  Extra columns of ``docs`` are dropped; an empty table gives
an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard, language, packing, surrogates, toxicity
from .common import crc_mod, scratch_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language has a lower mean probability is rejected.
LEAST_CERTAIN = 0.4
#: Near duplicates share four fifths of their runs of five words; op3 has other values of its own.
ALIKE = jaccard.Rule(words=5, part=80)


def bounded_batches(spark) -> None:
    """Arrow batches of 1,000 rows, where the session has the default of 10,000.

    Stages pass whole texts to Python workers; batches ten times as large stand in the memory of both sides.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def keep_known_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no learned language: null, empty or letterless texts, and uncertain ones."""
    bounded_batches(spark)
    net = language.train(docs.where(crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    judged = language.identify(docs.select(*COLUMNS), net)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_CERTAIN)).select(*COLUMNS)


def keep_civil(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity is 0.5 or more; null and empty texts have that of a text without words.

    Equal texts are kept or rejected together.
    """
    bounded_batches(spark)
    model = toxicity.train_on_labels(spark, docs, sf_dir)
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def keep_first_of_alike(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of every component of near duplicates, the document with the smallest doc_id.

    Rows without a doc_id stay.  If rows share a doc_id, it stays if any of them is the first of its component, and
    then as its smallest row only.
    """
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    parts = jaccard.linked_components(docs.select("doc_id", "text"), rule=ALIKE).where(F.col("doc_id").isNotNull())
    later = (parts.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
             .where(~F.col("first")).select("doc_id"))
    kept = docs.join(scratch_table(later, "later"), "doc_id", "left_anti").select(*COLUMNS)
    doubled = scratch_table(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"), "doubled")
    if doubled.isEmpty():
        return kept
    rest = F.struct(*[c for c in COLUMNS if c != "doc_id"])
    once = kept.join(doubled, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(rest).alias("rest")).select("doc_id", "rest.*")
    return kept.join(doubled, "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def replace_private(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; ``n_chars`` follows the new text and is null for a null text."""
    out = surrogates.replace(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences along the Hilbert curve; null and empty texts are their end alone, repeated rows have pieces each."""
    bounded_batches(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("language", keep_known_language), ("toxicity", keep_civil), ("near_duplicates", keep_first_of_alike),
          ("surrogates", replace_private), ("packing", pack)]
