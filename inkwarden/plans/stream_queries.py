"""Registered queries: streams over the given tables, compared with their batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import admission, ops
from ..operators.fusion import decide
from ..session import work_folder
from ..sources import messages
from ..streaming import scoring as continuous
from ..streaming import poll, stateful
from . import inputs, scoring
from .fusion_queries import ORACLES as FUSION_SQL
from .operations_queries import CHAIN_FIELDS, CHAIN_SQL, ROWS_PER_FILE
from .source_queries import write_message_files

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return add


def _message_files(spark, sf_dir, folder: str, files: int = 4) -> DataFrame:
    """Text messages as a folder of files, so that they arrive over several batches."""
    inputs.sms(spark, sf_dir).repartition(files, "msg_id").write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option(
        "maxFilesPerTrigger", 1).parquet(folder)


def _verdicts(batch: DataFrame) -> DataFrame:
    scored = scoring.score_sms(inputs.spread(batch), F.col("p_sms"), F.col("p_email"))
    label, action = decide(F.round("score", 9))
    return scored.select("msg_id", F.round("score", 6).alias("score"), label.alias("label"), action.alias("action"))


@register("streamed_verdicts", FUSION_SQL["sms_verdicts"])
def streamed_verdicts(spark, sf_dir):
    """Continuous scoring in several batches; the result equals the batch plan."""
    folder = work_folder(spark)
    stream = _message_files(spark, sf_dir, f"{folder}/in")
    continuous.run_scoring(stream, _verdicts, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return continuous.scored_rows(spark, f"{folder}/out")


@register("restarted_stream", f"WITH {inputs.SMS_SQL} SELECT msg_id, length(text)::INT AS chars FROM sms")
def restarted_stream(spark, sf_dir):
    """Two runs on one checkpoint: the second run reads nothing again, no row comes twice."""
    folder = work_folder(spark)
    measure = lambda batch: batch.select("msg_id", F.length("text").alias("chars"))
    for _ in range(2):
        stream = _message_files(spark, sf_dir, f"{folder}/in") if _ == 0 else spark.readStream.schema(
            spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        continuous.run_scoring(stream, measure, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return continuous.scored_rows(spark, f"{folder}/out")


@register("stream_without_released", f"""WITH {inputs.SMS_SQL} SELECT msg_id, sha256(text) AS content_sha256 FROM sms
  WHERE sha256(text) NOT IN (SELECT sha256(text) FROM sms WHERE sender = '61200')""")
def stream_without_released(spark, sf_dir):
    """The released set is read inside each batch."""
    folder = work_folder(spark)
    stream = continuous.with_content_hash(_message_files(spark, sf_dir, f"{folder}/in"), "text")
    released = lambda: inputs.sms(spark, sf_dir).where("sender = '61200'").select(
        F.sha2("text", 256).alias("content_sha256")).distinct()
    keep = lambda batch: batch.select("msg_id", "content_sha256")
    continuous.run_scoring(stream, keep, f"{folder}/out", f"{folder}/checkpoint", released).awaitTermination()
    return continuous.scored_rows(spark, f"{folder}/out")


@register("streamed_message_files", """SELECT item_id, 'a@example.com' AS from_address, 'item ' || item_id AS subject FROM benchmark""")
def streamed_message_files(spark, sf_dir):
    """New message files as a stream, parsed per batch."""
    from ..operators.ingest import parse_messages

    folder = work_folder(spark)
    write_message_files(spark, sf_dir, f"{folder}/in")
    number = F.regexp_extract("path", r"item_id=([0-9]+)", 1).cast("bigint")
    stream = messages.stream_messages(spark, f"{folder}/in", pattern="*.txt", batch_cap=100).withColumn("item_id", number)

    def parsed(batch: DataFrame) -> DataFrame:
        return parse_messages(batch.drop("path", "length")).select("item_id", "from_address", "subject")

    continuous.run_scoring(stream, parsed, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return continuous.scored_rows(spark, f"{folder}/out")


def _arriving(spark, table: DataFrame, order: str, folder: str, build, arrivals: int = 3) -> DataFrame:
    """Run a stream once per arrival: each third of the table (by ``order``) is written, then
    processed from the checkpoint of the run before."""
    top = table.agg(F.max(order)).first()[0] + 1
    for i in range(arrivals):
        low, high = top * i // arrivals, top * (i + 1) // arrivals
        part = table.where((F.col(order) >= low) & (F.col(order) < high))
        inputs.spread(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(table.schema).parquet(f"{folder}/in")
        build(stream).writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@register("streamed_audit_chain", f"WITH RECURSIVE {CHAIN_SQL} SELECT mailbox, file_no, seq, prev, hash FROM chain")
def streamed_audit_chain(spark, sf_dir):
    """The audit chain built over several batches with keyed state."""
    build = lambda stream: stateful.chain_stream(
        stream, ["mailbox"], "seq", CHAIN_FIELDS, ROWS_PER_FILE)
    return _arriving(spark, inputs.audit(spark, sf_dir), "seq", work_folder(spark), build)


# Three arrivals; each one's files are numbered by its batch and the range of seq.
_STREAMED_FILES = f"""WITH {inputs.AUDIT_SQL}, top AS (SELECT max(seq) + 1 AS top FROM audit),
  a AS (SELECT mailbox, seq, (SELECT count(*) FROM range(1, 3) r(j) WHERE seq >= top * j // 3) * {2 ** 32} + seq // {ROWS_PER_FILE} AS file_no
    FROM audit, top),
  m AS (SELECT mailbox, count(*) AS lines, min(file_no) AS first, count(DISTINCT file_no) AS n, mailbox % 4 AS loss FROM a GROUP BY mailbox)"""


def _sealed_stream(spark, sf_dir) -> poll.Ledger:
    """The audit log as a stream that is stopped and started twice."""
    rows, folder = inputs.audit(spark, sf_dir), work_folder(spark)
    top = rows.agg(F.max("seq")).first()[0] + 1
    for i in range(3):
        low, high = top * i // 3, top * (i + 1) // 3
        rows.where((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        stateful.sealed_log_stream(stream, ["mailbox"], "seq", CHAIN_FIELDS, f"{folder}/ledger", f"{folder}/checkpoint",
                                   ROWS_PER_FILE).awaitTermination()
    return poll.Ledger(spark, f"{folder}/ledger")


@register("sealed_stream", f"""{_STREAMED_FILES}
  SELECT mailbox, lines, n AS files, n AS seals, true AS ok, loss = 3 AS ok_after_loss,
    CASE loss WHEN 0 THEN 'file ' || first || ' does not end as sealed' WHEN 1 THEN 'file ' || first || ' is missing'
      WHEN 2 THEN 'the seals do not end as noted' ELSE '' END AS problem FROM m""")
def sealed_stream(spark, sf_dir):
    """The streamed log of each mailbox verified as it is, and after losses of lines, files and seals."""
    from .operations_queries import with_losses

    lines, seals, heads = stateful.sealed_log(_sealed_stream(spark, sf_dir))
    verify = lambda a, b: ops.verify_audit_log(a, b, heads, ["mailbox"], CHAIN_FIELDS)
    counted = lines.groupBy("mailbox").agg(F.count("*").alias("lines"))
    lost = verify(*with_losses(lines, seals)).select("mailbox", F.col("ok").alias("ok_after_loss"), "problem")
    return (verify(lines, seals).select("mailbox", "files", "ok").join(counted, "mailbox")
            .join(heads.select("mailbox", "seals"), "mailbox").join(lost, "mailbox"))


_CLIENT_HITS = """h AS (SELECT event_id AS hit_id, 'c' || (user_id % 50) AS key, epoch_us(ts) AS us FROM events)"""


def _hits(spark, sf_dir) -> DataFrame:
    return inputs.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("hit_id"),
        F.concat(F.lit("c"), (F.col("user_id") % 50).cast("string")).alias("client"),
        F.col("ts").cast("timestamp").alias("ts"))


def _admitted_sql(arrivals: int) -> str:
    """One hit a step and key, in order of arrival, with the list of admitted times that still count."""
    return f"""WITH RECURSIVE {_CLIENT_HITS},
  n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY arrival, us, hit_id) AS i FROM (SELECT h.*,
    (SELECT count(*) FROM range(1, {arrivals}) r(j) WHERE hit_id >= top * j // {arrivals}) AS arrival
    FROM h, (SELECT max(hit_id) + 1 AS top FROM h))),
  w AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS hit_id, NULL::BOOLEAN AS admitted, []::BIGINT[] AS recent FROM n GROUP BY key
    UNION ALL SELECT key, i, hit_id, len(kept) < 2, CASE WHEN len(kept) < 2 THEN list_append(kept, us) ELSE kept END
    FROM (SELECT n.key, n.i, n.hit_id, n.us, list_filter(w.recent, lambda t: n.us - t <= 3600000000) AS kept
      FROM w JOIN n ON n.key = w.key AND n.i = w.i + 1))
  SELECT key, hit_id, admitted FROM w WHERE i > 0"""


@register("admitted_hits", _admitted_sql(3))
def admitted_hits(spark, sf_dir):
    """Exact admission counting per client over a stream that is stopped and started twice."""
    hits, folder = _hits(spark, sf_dir), work_folder(spark)
    top = hits.agg(F.max("hit_id")).first()[0] + 1
    for i in range(3):
        low, high = top * i // 3, top * (i + 1) // 3
        hits.where((F.col("hit_id") >= low) & (F.col("hit_id") < high)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(hits.schema).parquet(f"{folder}/in")
        stateful.admission_stream(stream, "client", "ts", 2, f"{folder}/ledger", f"{folder}/checkpoint", 3600).awaitTermination()
    return poll.Ledger(spark, f"{folder}/ledger").table("decisions").drop("batch")


@register("admitted_table", _admitted_sql(1))
def admitted_table(spark, sf_dir):
    """The same over the whole table at once, by time."""
    return admission.admit(_hits(spark, sf_dir), "client", "ts", limit=2, seconds=3600)


@register("unreadable_messages_reviewed", f"""WITH {inputs.SMS_SQL} SELECT msg_id, CASE WHEN msg_id % 3 = 0 THEN 'unparseable' ELSE 'ok' END AS status,
    msg_id % 3 <> 0 AS analysed, CASE WHEN msg_id % 3 = 0 THEN 'review' END AS forced FROM sms""")
def unreadable_messages_reviewed(spark, sf_dir):
    """Broken rows never stop a batch; they end in review."""
    rows = inputs.sms(spark, sf_dir).select("msg_id", F.when(F.col("msg_id") % 3 == 0, F.lit(b"\n \n")).otherwise(
        F.concat(F.lit("From: a@b.example\n\n").cast("binary"), F.col("text").cast("binary"), F.lit(b"\xff\xfe\x00"))).alias("content"))
    scored = scoring.score_emails(rows, 0.5)
    system = F.get(F.transform("reasons", lambda r: r.code), F.lit(0))
    return scored.select(
        "msg_id", F.when(~F.col("analysed"), system).otherwise("ok").alias("status"), "analysed",
        F.when(~F.col("analysed"), F.col("action")).alias("forced"))




# ---------------------------------------------------------------- the poll job

# A third of all messages lies in mailbox 0; every 41st message has vanished, every tenth cannot be moved.
_POLLS, _FILE_ROWS, _POLLED_AT = 3, 2000, "2024-02-0{} 08:00:00"
POLLED_SQL = f"""v AS ({FUSION_SQL["sms_verdicts"]}),
  {inputs.SMS_SQL},
  box AS (SELECT msg_id AS uid, CASE WHEN msg_id % 3 = 0 THEN 0 ELSE msg_id % 7 END AS mailbox, sender,
    least(msg_id * {_POLLS} // (SELECT max(msg_id) + 1 FROM sms), {_POLLS - 1}) AS poll FROM sms WHERE msg_id > 0),
  ev AS (SELECT box.*, CASE WHEN uid % 41 = 0 THEN 'vanished' WHEN sender = '61200' THEN 'skipped_released' ELSE 'scanned' END AS event,
    v.score, v.action FROM box JOIN v ON v.msg_id = uid),
  polled AS (SELECT mailbox, uid, poll, event, CASE WHEN event = 'scanned' THEN round(score, 4) END AS score,
    CASE WHEN event <> 'scanned' THEN NULL WHEN action = 'quarantine' AND uid % 10 = 0 THEN 'quarantine_failed' WHEN action = 'quarantine' THEN 'quarantined'
      WHEN action = 'review' THEN 'flagged_for_review' ELSE 'delivered' END AS action_taken FROM ev)"""


def _polled(spark, sf_dir) -> poll.Ledger:
    """Three polls while mail arrives.  The second dies after all its tables were written, with other verdicts than
    the one that follows: nothing of it may be seen."""
    uid = F.col("msg_id")
    rows = inputs.sms(spark, sf_dir).where("msg_id > 0")
    top = inputs.sms(spark, sf_dir).agg(F.max("msg_id")).first()[0] + 1
    listing = rows.select(
        F.when(uid % 3 == 0, F.lit(0)).otherwise(uid % 7).cast("bigint").alias("mailbox"), F.lit(7).cast("bigint").alias("uidvalidity"),
        uid.cast("bigint").alias("uid"), F.concat(F.lit("<"), uid.cast("string"), F.lit("@m.example>")).alias("message_id"),
        F.sha2("text", 256).alias("content_sha256"), F.when(uid % 41 != 0, F.col("text")).alias("content"),
        "text", "sender", "p_sms", "p_email",
        F.least(F.floor(uid * _POLLS / F.lit(top)), F.lit(_POLLS - 1)).alias("_poll"))
    # Released are the messages of one sender, known by their hashes.
    released = lambda: rows.where("sender = '61200'").select(F.sha2("text", 256).alias("content_sha256"))

    def score(batch: DataFrame) -> DataFrame:
        return _verdicts(batch).select("msg_id", "score", "action")

    ledger = poll.Ledger(spark, f"{work_folder(spark)}/ledger")
    for number in range(_POLLS):
        arrived = listing.where(F.col("_poll") <= number).drop("_poll")
        options = {"released": released, "moved": lambda: F.col("uid") % 10 != 0, "backfill": None, "limit": None,
                   "rows_per_file": _FILE_ROWS}
        if number == 1:
            alarm = lambda batch: batch.select("msg_id", F.lit(1.0).alias("score"), F.lit("quarantine").alias("action"))
            poll.stage_poll(ledger, arrived, alarm, _POLLED_AT.format(9), **options)
        poll.poll_once(ledger, arrived, score, _POLLED_AT.format(number + 1), **options)
    return ledger


@register("polled_messages", f"""WITH {POLLED_SQL}
  SELECT mailbox, uid, poll::INT AS batch, event, score, action_taken, CASE WHEN action_taken <> 'delivered'
    THEN '2024020' || (poll + 1) || 'T080000Z-' || left(sha256(mailbox || '/7/' || uid), 32) END AS incident_id FROM polled""")
def polled_messages(spark, sf_dir):
    """Every message of three polls, one of them aborted and run again: what was done with it, and its incident."""
    return _polled(spark, sf_dir).table("outcomes").select(
        "mailbox", "uid", F.col("batch").cast("int").alias("batch"), "event", "score", "action_taken", "incident_id")


@register("polled_mailboxes", f"""WITH {POLLED_SQL},
  fl AS (SELECT mailbox, poll, uid // {_FILE_ROWS} AS part FROM polled UNION SELECT mailbox, min(poll), 0 FROM polled GROUP BY mailbox),
  fs AS (SELECT mailbox, count(*) AS files FROM fl GROUP BY mailbox)
  SELECT mailbox, max(uid) AS last_uid, count(*) FILTER (event = 'scanned') AS scanned, count(*) FILTER (event <> 'scanned') AS skipped,
    count(*) FILTER (action_taken <> 'delivered') AS incidents, count(*) FILTER (action_taken = 'quarantined') AS records,
    count(*) + 1 AS audit_lines, any_value(files) AS files, TRUE AS ok FROM polled JOIN fs USING (mailbox) GROUP BY mailbox""")
def polled_mailboxes(spark, sf_dir):
    """Cursor, counts of all tables and the verified audit log per mailbox after the polls."""
    ledger = _polled(spark, sf_dir)
    count = lambda name, rows: rows.groupBy("mailbox").agg(F.count("*").alias(name))
    seen = poll.poll_counts(ledger).groupBy("mailbox").agg(F.sum("scanned").alias("scanned"), F.sum("skipped").alias("skipped"))
    out = ledger.snapshot("cursors", poll.CURSORS).select("mailbox", "last_uid").join(seen, "mailbox", "left")
    for name, table in (("incidents", "incidents"), ("records", "records"), ("audit_lines", "audit")):
        out = out.join(count(name, ledger.table(table)), "mailbox", "left")
    checked = poll.verify_polls(ledger).select("mailbox", "files", "ok")
    return out.na.fill(0).join(checked, "mailbox", "left")


# Requests on every quarantined message: started by two people at once; then restored, failed or neither; a second
# batch starts the failed again and restores it, and tries what is over or stale.
_REQUESTS = [  # name, batch, remainders of uid by 4, base version, event, by, minute
    ("a", 0, [0, 1, 2], 1, "started", "ann", 2), ("b", 0, [0, 1, 2, 3], 1, "started", "bob", 1),
    ("c", 0, [0], 2, "restored", "bob", 3), ("d", 0, [1], 2, "failed", "bob", 3), ("e", 0, [2], 1, "restored", "eve", 0),
    ("f", 1, [0], 3, "started", "ann", 5), ("g", 1, [1], 3, "started", "ann", 5), ("h", 1, [1], 4, "restored", "ann", 6),
    ("i", 1, [0, 1, 2, 3], 1, "started", "eve", 4)]


@register("restored_records", f"""WITH {inputs.SMS_SQL}, q AS (SELECT msg_id AS uid FROM sms WHERE p_sms >= 0.8 AND msg_id > 0)
  SELECT '20240201T080000Z-' || left(sha256(uid % 5 || '/7/' || uid), 32) AS incident_id,
    CASE uid % 4 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 2 END AS version, CASE WHEN uid % 4 < 2 THEN 'restored' ELSE 'restoring' END AS status,
    CASE uid % 4 WHEN 0 THEN 'bob' WHEN 1 THEN 'ann' END AS restored_by,
    CASE uid % 4 WHEN 0 THEN '03' WHEN 1 THEN '06' END AS restored_minute,
    CASE uid % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END::BIGINT AS conflicts, TRUE AS log_ok FROM q""")
def restored_records(spark, sf_dir):
    """Every quarantined message after two batches of restore requests: version, state, who and when, lost requests."""
    rows = inputs.sms(spark, sf_dir).where("msg_id > 0").select(
        (F.col("msg_id") % 5).cast("bigint").alias("mailbox"), F.lit(7).cast("bigint").alias("uidvalidity"),
        F.col("msg_id").cast("bigint").alias("uid"), F.lit("").alias("message_id"),
        F.sha2("text", 256).alias("content_sha256"), F.col("text").alias("content"), "p_sms")
    score = lambda batch: batch.select("msg_id", F.col("p_sms").alias("score"), F.when(
        F.col("p_sms") >= 0.8, "quarantine").otherwise("deliver").alias("action"))
    ledger = poll.Ledger(spark, f"{work_folder(spark)}/ledger")
    poll.poll_once(ledger, rows, score, _POLLED_AT.format(1), backfill=None, limit=None)
    held = ledger.table("records")
    for batch in (0, 1):
        kinds = F.array(*[F.struct(
            F.lit(name).alias("name"), F.array(*map(F.lit, rest)).alias("rest"), F.lit(base).alias("base_version"),
            F.lit(event).alias("event"), F.lit(by).alias("by"), F.lit(f"2024-02-02 08:{minute:02d}:00").alias("at"))
            for name, when, rest, base, event, by, minute in _REQUESTS if when == batch])
        asked = held.withColumn("k", F.explode(kinds)).where(
            F.array_contains("k.rest", (F.col("source_uid") % 4).cast("int"))).select(
            F.concat("k.name", F.lit("-"), "incident_id").alias("request_id"), "incident_id", "k.base_version", "k.event", "k.by", "k.at")
        poll.restore(ledger, asked, _POLLED_AT.format(2 + batch))
    lost = ledger.table("restores").groupBy("incident_id").agg(F.count_if(F.col("outcome") == "conflict").alias("conflicts"))
    checked = poll.verify_polls(ledger).select("mailbox", F.col("ok").alias("log_ok"))
    return poll.current_records(ledger).join(lost, "incident_id").join(checked, "mailbox").select(
        "incident_id", "version", "status", "restored_by", F.date_format("restored_at", "mm").alias("restored_minute"), "conflicts", "log_ok")
