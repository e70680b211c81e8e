"""The poll job: new messages of many mailboxes to verdicts, incidents, records, audit log and cursors.

Each poll is one batch of a ledger.  All tables of a batch are written first, each below its own ``batch=N``
folder; one small row per batch is written last and publishes them together.  Readers see published batches only, so
a poll that dies anywhere leaves nothing behind: the next one takes the same number, the same cursors and therefore
the same messages, and overwrites what was left.  One poll job runs per ledger at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..operators import ops
from ..sources.stores import incident_id

IDENTITY = ["mailbox", "uidvalidity", "uid", "message_id", "content_sha256"]
#: Fields of an audit entry; those an event has no value for are null.
AUDIT_KINDS = {"action": "string", "action_taken": "string", "backfill": "int", "by": "string", "content_sha256": "string",
               "event": "string", "incident_id": "string", "previous_uidvalidity": "bigint", "score": "double",
               "seq": "bigint", "start_after_uid": "bigint", "ts": "string", "uid": "bigint", "uidvalidity": "bigint"}
AUDIT_FIELDS = list(AUDIT_KINDS)
RECORD = ["incident_id", "version", "quarantined_at", "mailbox", "source_uid", "source_uidvalidity", "message_id",
          "content_sha256", "score", "restore_started_at", "restored_at", "restored_by"]
CURSORS = "mailbox bigint, uidvalidity bigint, last_uid bigint, seals bigint, head string"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or nothing if it was never written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


class Ledger:
    """Tables that grow by whole batches.  ``folder`` is shared by driver and executors."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def last(self) -> int:
        """Number of the last published batch, -1 before the first."""
        published = _stored(self.spark, f"{self.folder}/published")
        found = None if published is None else published.agg(F.max("batch").alias("n")).first()["n"]
        return -1 if found is None else int(found)

    def stage(self, table: str, rows: DataFrame, batch: int) -> DataFrame:
        """Writes the rows of an unpublished batch and returns them as stored: half of a digest in hex is air."""
        path = f"{self.folder}/{table}/batch={batch}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def publish(self, batch: int, at: str) -> None:
        """Makes a staged batch visible.  A number is published once, and numbers leave no gap."""
        if batch != self.last() + 1:
            raise ValueError(f"batch {batch} is not the next one of this ledger")
        self.spark.range(1).select(F.lit(at).alias("at")).write.mode("overwrite").parquet(
            f"{self.folder}/published/batch={batch}")

    def table(self, name: str) -> DataFrame | None:
        """Rows of all published batches, with ``batch``.  Numbers leave no gap, so the last one bounds them and
        the scan skips the folder of an unpublished batch."""
        rows = _stored(self.spark, f"{self.folder}/{name}")
        return None if rows is None else rows.where(F.col("batch") <= self.last())

    def snapshot(self, name: str, schema: str) -> DataFrame:
        """Rows of the last published batch alone, for tables that each batch writes whole."""
        rows = _stored(self.spark, f"{self.folder}/{name}")
        if rows is None:
            return self.spark.createDataFrame([], schema)
        return rows.where(F.col("batch") == self.last()).drop("batch")


def _starts(messages: DataFrame, saved: DataFrame, backfill: int | None) -> DataFrame:
    """Cursors of the listed mailboxes; with ``backfill=None`` a new folder starts before its first message."""
    starts = ops.starting_cursors(messages, saved, backfill or 0)
    if backfill is not None:
        return starts
    return starts.withColumn("last_uid", F.when(F.col("reset"), F.lit(0)).otherwise(F.col("last_uid")).cast("bigint"))


def _log(ledger: Ledger, batch: int, entries: DataFrame, saved: DataFrame, moment: Column, rows_per_file: int) -> DataFrame:
    """Stages the audit lines of a batch and their seals; ``mailbox, _seals, _head`` of the mailboxes that got any."""
    fields = [F.lit(None).cast(kind).alias(name) for name, kind in AUDIT_KINDS.items() if name not in entries.columns]
    stamp = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # A uid has 32 bits, so a number made of batch and range of uids grows with both.
    file_no = F.lit(batch).cast("bigint") * 2 ** 32 + F.floor(F.col("seq") / rows_per_file)
    whole = entries.select("*", *fields).withColumn("ts", stamp).withColumn("file_no", file_no)
    lines = ledger.stage("audit", ops.link_files(whole, ["mailbox"], "seq", AUDIT_FIELDS), batch)
    ends = saved.select("mailbox", "head", "seals").where("head is not null")
    seals = ledger.stage("seals", ops.seal_audit_files(lines, ["mailbox"], ends), batch)
    return ops.audit_heads(seals, ["mailbox"]).withColumnsRenamed({"seals": "_seals", "head": "_head"})


def released_here(ledger: Ledger) -> DataFrame | None:
    """Hashes of the ledger's records that someone released or is releasing."""
    versions = ledger.table("records")
    return None if versions is None else ops.released_hashes(ops.latest_versions(versions.select(*RECORD)))


def stage_poll(ledger: Ledger, messages: DataFrame, score: Callable[[DataFrame], DataFrame], at: str,
               released: Callable[[], DataFrame] | None = None, quarantine_mode: bool = True,
               moved: Callable[[], Column] | None = None, backfill: int | None = 0,
               limit: int | None = fixed.MAX_PER_BATCH, rows_per_file: int = 4096) -> int:
    """Writes all tables of the next batch without publishing them; returns its number.

    ``messages``: ``mailbox, uidvalidity, uid, message_id, content_sha256``, ``content`` (null: vanished) and what
    ``score`` needs; one validity per mailbox.  ``score`` gets them with the identity as the struct ``msg_id`` and
    returns ``msg_id, score, action``.  ``moved`` is the outcome of the mailbox's move, an expression on the identity.
    Content that was released in this ledger is never quarantined again, nor what ``released`` gives, which is called
    after the messages are known.
    At most ``limit`` messages per mailbox are taken, oldest first (``None``: all).

    Tables: ``outcomes`` (each message taken), ``incidents``, ``records`` (version 1), ``audit`` (hash chains, one
    file per mailbox, batch and range of uids), ``seals`` (one chain per mailbox over its files) and ``cursors`` (of all
    mailboxes, with the last seal).  Messages are scored once; the other tables are made from the written outcomes.
    """
    batch = ledger.last() + 1
    saved = ledger.snapshot("cursors", CURSORS)
    moment = F.lit(at).cast("timestamp")
    # The cursors are written before they are used: they come from the listing, which may grow meanwhile.
    starts = ledger.stage("starts", _starts(messages, saved, backfill).select(
        "mailbox", F.col("uidvalidity").cast("bigint").alias("uidvalidity"),
        F.col("last_uid").cast("bigint").alias("last_uid"), "reset"), batch)
    if limit is None:
        taken = messages.join(starts.select("mailbox", "last_uid"), "mailbox").where("uid > last_uid").drop("last_uid")
    else:
        taken = ops.incremental_batch(messages, starts, limit=limit)

    keys = {name: F.col(name).cast("bigint") for name in IDENTITY[:3]}
    taken = taken.withColumns(keys).withColumn("_event", F.when(F.col("content").isNull(), "vanished"))
    sets = [found.select("content_sha256") for found in (released_here(ledger), released and released()) if found is not None]
    if sets:
        known = functools.reduce(DataFrame.unionByName, sets).distinct().withColumn("_released", F.lit(True))
        taken = taken.join(known, "content_sha256", "left").withColumn(
            "_event", F.coalesce("_event", F.when(F.col("_released"), "skipped_released"))).drop("_released")
    identity = taken.withColumn("msg_id", F.struct(*IDENTITY))
    none = F.lit(None)
    skipped = identity.where("_event is not null").select(
        "msg_id", F.col("_event").alias("event"), none.cast("double").alias("score"), none.cast("string").alias("action"))
    scanned = score(identity.where("_event is null").drop("_event")).select(
        "msg_id", F.lit("scanned").alias("event"), F.round(F.col("score"), 4).alias("score"), "action")
    rows = skipped.unionByName(scanned).select("msg_id.*", "event", "score", "action")
    happened = ops.action_taken(F.col("action"), quarantine_mode, None if moved is None else moved())
    rows = rows.withColumn("action_taken", F.when(F.col("event") == "scanned", happened))
    name = F.concat_ws("/", "mailbox", "uidvalidity", "uid")
    flagged = (F.col("event") == "scanned") & (F.col("action_taken") != "delivered")
    outcomes = ledger.stage("outcomes", rows.withColumn("at", moment).withColumn(
        "incident_id", F.when(flagged, incident_id(moment, name))), batch)

    ledger.stage("incidents", outcomes.where("incident_id is not null").drop("event"), batch)
    ledger.stage("records", outcomes.where("action_taken = 'quarantined'").select(
        "incident_id", F.lit(1).alias("version"), F.col("at").alias("quarantined_at"), "mailbox",
        F.col("uid").alias("source_uid"), F.col("uidvalidity").alias("source_uidvalidity"), "message_id",
        "content_sha256", "score", none.cast("timestamp").alias("restore_started_at"),
        none.cast("timestamp").alias("restored_at"), none.cast("string").alias("restored_by")), batch)

    entries = outcomes.select("mailbox", F.col("uid").alias("seq"), *[
        F.col(c) for c in ("uid", "uidvalidity", "event", "score", "action", "action_taken", "incident_id", "content_sha256")])
    before = saved.select("mailbox", F.col("uidvalidity").alias("previous_uidvalidity"))
    resets = starts.where("reset").join(before, "mailbox", "left").select(
        "mailbox", F.lit(0).cast("bigint").alias("seq"), "uidvalidity", F.lit("cursor_reset").alias("event"),
        F.col("last_uid").alias("start_after_uid"), "previous_uidvalidity", F.lit(backfill).cast("int").alias("backfill"))
    heads = _log(ledger, batch, entries.unionByName(resets, allowMissingColumns=True), saved, moment, rows_per_file)
    newest = outcomes.groupBy("mailbox").agg(F.max("uid").alias("_newest"))
    here = starts.join(newest, "mailbox", "left").select(
        "mailbox", F.col("uidvalidity").alias("_validity"), F.coalesce("_newest", "last_uid").alias("_uid"))
    ledger.stage("cursors", saved.join(here, "mailbox", "full").join(heads, "mailbox", "left").select(
        "mailbox", F.coalesce("_validity", "uidvalidity").alias("uidvalidity"),
        F.coalesce("_uid", "last_uid").alias("last_uid"), F.coalesce("_seals", "seals").alias("seals"),
        F.coalesce("_head", "head").alias("head")), batch)
    return batch


def poll_once(ledger: Ledger, messages: DataFrame, score: Callable[[DataFrame], DataFrame], at: str, **options) -> int:
    """One poll: all tables of the next batch, then the row that publishes them (see ``stage_poll``)."""
    batch = stage_poll(ledger, messages, score, at, **options)
    ledger.publish(batch, at)
    return batch


def poll_counts(ledger: Ledger) -> DataFrame:
    """Per published batch and mailbox: scanned, quarantined, would_quarantine, flagged_for_review, skipped."""
    outcomes = ledger.table("outcomes")
    taken = F.when(F.col("event") == "scanned", F.col("action_taken")).otherwise("skipped")
    return ops.batch_counts(outcomes.withColumn("action_taken", taken), ["batch", "mailbox"])


def verify_polls(ledger: Ledger) -> DataFrame:
    """Per mailbox ``ok, files, problem`` of the published audit log against its seals and the cursors' last seal."""
    heads = ledger.snapshot("cursors", CURSORS).where("head is not null").select("mailbox", "seals", "head")
    return ops.verify_audit_log(ledger.table("audit").drop("batch"), ledger.table("seals").drop("batch"), heads,
                                ["mailbox"], AUDIT_FIELDS)


# ---------------------------------------------------------------- restores


def stage_restores(ledger: Ledger, requests: DataFrame, at: str, rows_per_file: int = 4096) -> int:
    """Applies restore requests to the ledger's records as its next, unpublished batch; returns its number.

    ``requests``: ``request_id`` (unique), ``incident_id, base_version, event`` (started, restored, failed), ``by``,
    ``at``.  A request is a compare-and-set: it makes version ``base_version + 1`` and holds only against the newest
    version.  A held record can be started; one being restored can be restored, which ends it, or fail, which holds it
    again.  Of several valid requests on one version the earliest wins (then the smaller id), the others conflict.  One
    batch may hold a whole chain of requests.

    Tables: ``restores`` (each request with ``outcome``: applied, conflict or unknown), the new versions in ``records``,
    and audit lines of restores and failures on the mailbox's chain.
    """
    batch = ledger.last() + 1
    versions, saved = ledger.table("records"), ledger.snapshot("cursors", CURSORS)
    if versions is None:
        raise ValueError("this ledger has no records yet")
    asked = requests.select("request_id", "incident_id", F.col("base_version").cast("int").alias("base_version"), "event",
                            "by", F.col("at").cast("timestamp").alias("at"))
    wanted = versions.join(asked.select("incident_id").distinct(), "incident_id", "left_semi")
    current = ops.latest_versions(wanted.select(*RECORD))
    state = current.select("incident_id", "version", ops.record_status().alias("_status"))
    known = asked.join(state, "incident_id", "left")
    # Held and restoring alternate from version to version, so a version's number tells which events are valid on it.
    step = F.col("base_version") - F.col("version")
    held = (step % 2 == 0) == (F.col("_status") == "held")
    fits = F.when(held, F.col("event") == "started").otherwise(F.col("event").isin("restored", "failed"))
    valid = known.where((step >= 0) & (F.col("_status") != "restored") & fits)
    first = valid.groupBy("incident_id", "base_version").agg(
        F.min_by(F.struct("request_id", "event", "by", "at", "version"), F.struct("at", "request_id")).alias("_w"))
    in_order = W.partitionBy("incident_id").orderBy("base_version")
    ended = F.max(F.col("_w.event") == "restored").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    place = F.row_number().over(in_order) - 1
    chain = first.withColumns({"_place": place, "_ended": F.coalesce(ended, F.lit(False))}).where(
        (F.col("base_version") == F.col("_w.version") + F.col("_place")) & ~F.col("_ended"))
    won = chain.select(F.col("_w.request_id").alias("request_id"), F.lit(True).alias("_won"))
    outcome = F.when(F.col("_status").isNull(), "unknown").when(F.col("_won"), "applied").otherwise("conflict")
    outcomes = ledger.stage("restores", known.join(won, "request_id", "left").select(*asked.columns, outcome.alias("outcome")), batch)

    applied = outcomes.where("outcome = 'applied'")
    changed = applied.join(current.drop("version", "restore_started_at", "restored_at", "restored_by"), "incident_id")
    done = F.col("event") == "restored"
    ledger.stage("records", changed.withColumns({
        "version": F.col("base_version") + 1, "restore_started_at": F.when(F.col("event") == "started", F.col("at")),
        "restored_at": F.when(done, F.col("at")), "restored_by": F.when(done, F.col("by"))}).select(
        *RECORD), batch)

    moment = F.lit(at).cast("timestamp")
    seq = F.row_number().over(W.partitionBy("mailbox").orderBy("at", "incident_id", "base_version")).cast("bigint")
    entries = changed.where("event <> 'started'").select(
        "mailbox", seq.alias("seq"), F.when(F.col("event") == "failed", "restore_failed").otherwise("restored").alias("event"),
        "incident_id", "content_sha256", "by")
    heads = _log(ledger, batch, entries, saved, moment, rows_per_file)
    ledger.stage("cursors", saved.join(heads, "mailbox", "left").select(
        "mailbox", "uidvalidity", "last_uid", F.coalesce("_seals", "seals").alias("seals"),
        F.coalesce("_head", "head").alias("head")), batch)
    return batch


def restore(ledger: Ledger, requests: DataFrame, at: str, **options) -> int:
    """Applies restore requests and publishes their outcome as one batch (see ``stage_restores``)."""
    batch = stage_restores(ledger, requests, at, **options)
    ledger.publish(batch, at)
    return batch


def current_records(ledger: Ledger) -> DataFrame:
    """The newest version of each record, with ``status``: held, restoring or restored."""
    newest = ops.latest_versions(ledger.table("records").select(*RECORD))
    return newest.withColumn("status", ops.record_status())
