"""Registered queries: sources and sinks, fed with files written from the given tables.

Each run writes below a new folder of the shared work area and reads its own files back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.domains import DEFAULT
from ..operators import evaluate
from ..session import work_folder
from ..sources import corpora, dims, messages, stores
from . import inputs
from . import oracle as o

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return add


def write_message_files(spark, sf_dir, folder: str) -> None:
    """One file per frozen text; the text writer makes one folder per message."""
    rows = inputs.table(spark, sf_dir, "benchmark").select(
        "item_id", F.concat(F.lit("From: a@example.com\nTo: b@example.org\nSubject: item "),
                            F.col("item_id").cast("string"), F.lit("\n\n"), "text").alias("value"))
    rows.repartition("item_id").write.partitionBy("item_id").text(folder)


@register("message_files", """SELECT item_id, octet_length(encode('From: a@example.com' || chr(10) || 'To: b@example.org' || chr(10) || 'Subject: item ' || item_id || chr(10) || chr(10) || text)) + 1 AS length,
    octet_length(encode('From: a@example.com' || chr(10) || 'To: b@example.org' || chr(10) || 'Subject: item ' || item_id || chr(10) || chr(10) || text)) + 1 > 300 AS oversized FROM benchmark""")
def message_files(spark, sf_dir):
    """Binary files with a size guard; oversized ones keep their row without content."""
    folder = work_folder(spark)
    write_message_files(spark, sf_dir, folder)
    rows = messages.read_messages(spark, folder, max_bytes=300, pattern="*.txt")
    number = F.regexp_extract("path", r"item_id=([0-9]+)", 1).cast("bigint")
    return rows.select(number.alias("item_id"), "length", F.col("content").isNull().alias("oversized"))


_CORPUS_SQL = """SELECT source, rank, label, md5(subject) AS subject_md5, md5(body) AS body_md5 FROM (
  SELECT 'even.csv' AS source, 1 AS rank, 1 AS label, 'Subject "' || lang || '", ' || doc_id AS subject, text AS body, doc_id % 4 = 0 AS keep FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT 'odd.csv', 2, 0, 'Subject "' || lang || '", ' || doc_id, text, doc_id % 4 = 1 FROM documents WHERE doc_id % 2 = 1) WHERE keep"""


@register("labelled_corpus", _CORPUS_SQL)
def labelled_corpus(spark, sf_dir):
    """Quoted multi-line CSV files, one wanted label text per file."""
    folder = work_folder(spark)
    rows = inputs.table(spark, sf_dir, "documents").select(
        F.concat(F.lit('Subject "'), "lang", F.lit('", '), F.col("doc_id").cast("string")).alias("subject"),
        F.col("text").alias("body"), F.when(F.col("doc_id") % 4 < 2, " 1").otherwise("0").alias("label"),
        F.when(F.col("doc_id") % 2 == 0, "even.csv").otherwise("odd.csv").alias("file"))
    for name in ("even.csv", "odd.csv"):
        rows.where(F.col("file") == name).drop("file").write.option("header", "true").option(
            "escape", '"').option("ignoreLeadingWhiteSpace", "false").csv(f"{folder}/{name}")
    found = corpora.read_corpus(spark, folder, ["subject", "body", "label"],
                                {"even.csv": ("1", 1), "odd.csv": ("1", 0)})
    return found.select("source", "rank", "label", F.md5("subject").alias("subject_md5"), F.md5("body").alias("body_md5"))


@register("unquoted_rows", """SELECT CASE WHEN turn % 2 = 0 THEN 'ham' ELSE 'spam' END AS label, md5('said "hi ' || replace(replace(replace(text, chr(10), ' '), chr(9), ' '), chr(13), ' ')) AS text_md5 FROM conversations""")
def unquoted_rows(spark, sf_dir):
    """Tab-separated rows with stray quotes: none may merge."""
    folder = work_folder(spark)
    plain = F.translate("text", "\n\t\r", "   ")
    inputs.table(spark, sf_dir, "conversations").select(F.concat_ws(
        "\t", F.when(F.col("turn") % 2 == 0, "ham").otherwise("spam"), F.concat(F.lit('said "hi '), plain)
    ).alias("value")).write.text(folder)
    return corpora.read_tsv(spark, folder).select("label", F.md5("text").alias("text_md5"))


@register("curated_rows", """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, quality AS label, lang AS category, md5(text) AS text_md5
  FROM labels JOIN documents USING (doc_id)""")
def curated_rows(spark, sf_dir):
    folder = work_folder(spark)
    rows = inputs.table(spark, sf_dir, "labels").join(inputs.table(spark, sf_dir, "documents"), "doc_id")
    rows.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split"),
                F.col("quality").alias("label"), F.col("lang").alias("category"), "text").write.option(
        "header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option(
        "ignoreTrailingWhiteSpace", "false").csv(folder)
    found = corpora.read_curated(spark, folder)
    return found.select("id", "split", "label", "category", F.md5("text").alias("text_md5"))


@register("brand_dimension_hits", f"""WITH {inputs.URLS_SQL}, {o.url_ctes('urls', 'page_id')}
  SELECT brand, brand_rank::INT AS brand_rank, count(*) AS urls FROM ud JOIN (SELECT * FROM {o.BRAND_DOMAINS}
    UNION ALL SELECT 'examplecorp', {len(DEFAULT.brands)}, d FROM (VALUES ('example.com'), ('example.net')) x(d)) USING (domain) WHERE kind = 'name' GROUP BY ALL""")
def brand_dimension_hits(spark, sf_dir):
    """Brands extended by a file; the small dimension joins the registered domains."""
    from .link_queries import named_hosts

    folder = work_folder(spark)
    spark.createDataFrame([('{"examplecorp": ["www.example.com", "example.net"]}',)], "value string").coalesce(
        1).write.text(folder)
    extended = dims.load_dims(spark, f"{folder}/part-*")
    domains, _phrases = dims.brand_tables(spark, extended)
    counts = named_hosts(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(domains), "domain").groupBy("brand", "brand_rank").agg(F.sum("n").alias("urls"))


@register("incident_reports", f"""WITH {inputs.SMS_SQL}, f AS (SELECT msg_id, p_sms AS score, CASE WHEN p_sms >= 0.8 THEN 'quarantine' WHEN p_sms >= 0.5 THEN 'review' ELSE 'deliver' END AS action,
    '20240101T000000Z-' || left(sha256(msg_id::VARCHAR), 32) AS incident_id FROM sms)
  SELECT incident_id, msg_id, score, action FROM f WHERE action <> 'deliver' ORDER BY incident_id DESC LIMIT 100""")
def incident_reports(spark, sf_dir):
    """Verdicts written as reports (delivered ones are not), read back newest first."""
    folder = work_folder(spark)
    rows = inputs.sms(spark, sf_dir).select("msg_id", F.col("p_sms").alias("score")).withColumn(
        "action", F.when(F.col("score") >= 0.8, "quarantine").when(F.col("score") >= 0.5, "review").otherwise("deliver"))
    stores.write_incidents(rows, folder, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return stores.recent_incidents(spark.read.parquet(folder)).select("incident_id", "msg_id", "score", "action")


@register("stored_quarantine", f"WITH {inputs.RECORDS_SQL} SELECT incident_id, version, restored_at IS NOT NULL AS restored FROM records")
def stored_quarantine(spark, sf_dir):
    """Record versions appended in two writes, current version read back."""
    folder = work_folder(spark)
    versions = inputs.record_versions(spark, sf_dir)
    stores.upsert_quarantine(versions.where("version < 3"), folder)
    stores.upsert_quarantine(versions.where("version = 3"), folder)
    return stores.quarantined(spark, folder).select(
        "incident_id", "version", F.col("restored_at").isNotNull().alias("restored"))


@register("prepared_corpus", """SELECT lang, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang""")
def prepared_corpus(spark, sf_dir):
    """A corpus built once per signature of its files, then read from the cache."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/documents.parquet").select("path", "length")
    cache = work_folder(spark)
    build = lambda: inputs.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    stores.prepared_corpus(spark, files, build, cache)
    again = stores.prepared_corpus(spark, files, build, cache)
    return again.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))


@register("stored_metrics", f"""WITH {inputs.SCORED_SQL}, s AS (SELECT label, coalesce(score, 1.0) AS sc FROM scored)
  , c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (sc >= 0.5 AND label = 1)::DOUBLE AS tp, count(*) FILTER (sc >= 0.5 AND label <> 1)::DOUBLE AS fp,
    count(*) FILTER (sc < 0.5 AND label <> 1)::DOUBLE AS tn, count(*) FILTER (sc < 0.5 AND label = 1)::DOUBLE AS fn FROM s),
  r AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS q, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f, fp / nullif(fp + tn, 0) AS a FROM c)
  SELECT 'email' AS model, 'test' AS test_set, unnest(['n', 'tp', 'fp', 'tn', 'fn', 'precision', 'recall', 'f1', 'false_positive_rate']) AS metric,
    unnest([n, tp, fp, tn, fn, round(coalesce(p, 0), 4), round(coalesce(q, 0), 4), round(coalesce(f, 0), 4), round(coalesce(a, 0), 4)]) AS value FROM r""")
def stored_metrics(spark, sf_dir):
    folder = work_folder(spark)
    scored = inputs.scored(spark, sf_dir).withColumn("score", F.coalesce("score", F.lit(1.0)))
    stores.write_metrics(evaluate.threshold_metrics(scored), folder, "email", "email", "test")
    return spark.read.parquet(folder).select("model", "test_set", "metric", "value")
