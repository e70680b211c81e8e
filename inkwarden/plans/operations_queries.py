"""Registered queries: quarantine, audit and mailbox operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import ops
from ..sources import stores
from . import inputs

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return add


def _events(spark, sf_dir):
    return inputs.table(spark, sf_dir, "events")


@register("actions_taken", """WITH a AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'quarantine' WHEN 'click' THEN 'review' ELSE 'deliver' END AS action,
    user_id % 2 = 0 AS q, event_id % 10 <> 0 AS moved, event_type = 'signup' AS skip FROM events),
  t AS (SELECT q, CASE WHEN skip THEN 'skipped' WHEN action = 'quarantine' AND q AND NOT moved THEN 'quarantine_failed' WHEN action = 'quarantine' AND q THEN 'quarantined'
    WHEN action = 'quarantine' THEN 'would_quarantine' WHEN action = 'review' THEN 'flagged_for_review' ELSE 'delivered' END AS taken FROM a)
  SELECT q AS quarantine_mode, count(*) FILTER (taken <> 'skipped') AS scanned, count(*) FILTER (taken = 'quarantined') AS quarantined,
    count(*) FILTER (taken = 'would_quarantine') AS would_quarantine, count(*) FILTER (taken IN ('flagged_for_review', 'quarantine_failed')) AS flagged_for_review,
    count(*) FILTER (taken = 'skipped') AS skipped FROM t GROUP BY q""")
def actions_taken(spark, sf_dir):
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "quarantine").when(kind == "click", "review").otherwise("deliver")
    mode = F.col("user_id") % 2 == 0
    taken = F.when(kind == "signup", "skipped").otherwise(
        ops.action_taken(action, mode, F.col("event_id") % 10 != 0))
    rows = _events(spark, sf_dir).select(mode.alias("quarantine_mode"), taken.alias("action_taken"))
    return ops.batch_counts(rows, ["quarantine_mode"])


@register("audit_tail", f"WITH {inputs.AUDIT_SQL} SELECT seq, ts, event, action_taken FROM audit ORDER BY seq DESC LIMIT {fixed.AUDIT_TAIL}")
def audit_tail(spark, sf_dir):
    lines = inputs.audit(spark, sf_dir).select(
        F.to_json(F.struct("seq", "ts", "event", "action_taken")).alias("value"))
    return ops.audit_tail(stores.parse_audit_lines(lines)).select("seq", "ts", "event", "action_taken")


@register("kpis", f"""WITH {inputs.AUDIT_SQL}, {inputs.RECORDS_SQL}
  SELECT (SELECT count(*) FROM (SELECT * FROM audit ORDER BY seq DESC LIMIT {fixed.AUDIT_TAIL}) WHERE event = 'scanned') AS scanned,
    count(*) AS quarantined, count(restored_at) AS restored, count(*) - count(restored_at) AS held FROM records""")
def kpis(spark, sf_dir):
    records = ops.latest_versions(inputs.record_versions(spark, sf_dir))
    return ops.kpis(inputs.audit(spark, sf_dir), records)


_STATUS = "CASE WHEN restored_at IS NOT NULL THEN 'restored' WHEN restore_started_at IS NOT NULL THEN 'restoring' ELSE 'held' END"


@register("quarantine_records", f"WITH {inputs.RECORDS_SQL} SELECT incident_id, version, content_sha256, score, {_STATUS} AS status FROM records")
def quarantine_records(spark, sf_dir):
    records = ops.latest_versions(inputs.record_versions(spark, sf_dir))
    return records.select("incident_id", "version", "content_sha256", "score", ops.record_status().alias("status"))


@register("quarantine_reasons", f"""WITH {inputs.RECORDS_SQL}, {inputs.REPORTS_SQL}
  SELECT r.incident_id, coalesce(p.kind, 'email') AS kind, {_STATUS} AS status,
    coalesce(array_to_string(list_transform(p.reasons, lambda x: x.code), ','), '') AS codes
  FROM records r LEFT JOIN reports p USING (incident_id)""")
def quarantine_reasons(spark, sf_dir):
    rows = ops.quarantine_rows(ops.latest_versions(inputs.record_versions(spark, sf_dir)), inputs.reports(spark, sf_dir))
    return rows.select("incident_id", "kind", "status", F.coalesce(F.array_join(
        F.transform("reasons", lambda r: r.code), ","), F.lit("")).alias("codes"))


@register("quarantine_listing", f"""WITH {inputs.RECORDS_SQL}, {inputs.REPORTS_SQL}, n AS (SELECT * FROM records ORDER BY incident_id DESC LIMIT 200)
  SELECT r.incident_id, coalesce(p.kind, 'email') AS kind, {_STATUS} AS status, score FROM n r LEFT JOIN reports p USING (incident_id)""")
def quarantine_listing(spark, sf_dir):
    records = ops.latest_versions(inputs.record_versions(spark, sf_dir))
    return ops.quarantine_listing(records, inputs.reports(spark, sf_dir)).select(
        "incident_id", "kind", "status", "score")


_HUMAN = """CASE code WHEN 'dmarc_fail' THEN 'DMARC fail' WHEN 'url_ip_host' THEN 'URL IP host' WHEN 'att_html' THEN 'Attachment HTML'
    WHEN 'spf_softfail' THEN 'SPF softfail' ELSE 'Verified sender' END"""
_AGE = """CASE WHEN s < 45 THEN 'just now' WHEN s < 60 THEN round(s)::BIGINT || ' second' || CASE WHEN round(s) = 1 THEN '' ELSE 's' END || ' ago'
    WHEN s / 60 < 60 THEN round(s / 60)::BIGINT || ' minute' || CASE WHEN round(s / 60) = 1 THEN '' ELSE 's' END || ' ago'
    WHEN s / 3600 < 24 THEN round(s / 3600)::BIGINT || ' hour' || CASE WHEN round(s / 3600) = 1 THEN '' ELSE 's' END || ' ago'
    WHEN s / 86400 < 7 THEN round(s / 86400)::BIGINT || ' day' || CASE WHEN round(s / 86400) = 1 THEN '' ELSE 's' END || ' ago'
    WHEN s / 604800 < 4.35 THEN round(s / 604800)::BIGINT || ' week' || CASE WHEN round(s / 604800) = 1 THEN '' ELSE 's' END || ' ago'
    ELSE round(s / 604800 / 4.35)::BIGINT || ' month' || CASE WHEN round(s / 604800 / 4.35) = 1 THEN '' ELSE 's' END || ' ago' END"""


@register("dashboard", f"""WITH {inputs.RECORDS_SQL}, {inputs.REPORTS_SQL}, n AS (SELECT r.*, coalesce(p.kind, 'email') AS kind, coalesce(p.reasons, []) AS reasons, {_STATUS} AS status FROM records r LEFT JOIN reports p USING (incident_id)),
  x AS (SELECT *, round(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(quarantined_at)) AS s FROM n WHERE {_STATUS} <> 'restored'),
  c0 AS (SELECT incident_id, string_agg({_HUMAN.replace('code', 'z.code')} || ' ' || (CASE WHEN z.weight > 0 THEN '+' WHEN z.weight < 0 THEN '−' ELSE '±' END)
      || printf('%.1f', abs(z.weight)) || ' ' || (CASE WHEN z.weight > 0 THEN 'phishing' WHEN z.weight < 0 THEN 'safe' ELSE 'neutral' END) || ' '
      || (CASE WHEN abs(z.weight) >= 2 THEN 'strong' WHEN abs(z.weight) >= 1 THEN 'medium' ELSE 'weak' END), '; ' ORDER BY i) AS signals
    FROM (SELECT incident_id, unnest(reasons[1:3]) AS z, generate_subscripts(reasons[1:3], 1) AS i FROM x) GROUP BY incident_id),
  c AS (SELECT x.incident_id, coalesce(signals, '') AS signals FROM x LEFT JOIN c0 USING (incident_id))
  SELECT incident_id, kind, status, CASE WHEN score >= 0.999 THEN '>99.9%' WHEN score <= 0.001 THEN '<0.1%' ELSE printf('%.1f', score * 100) || '%' END AS percent,
    strftime(quarantined_at, '%Y-%m-%d %H:%M') || ' UTC' AS time, {_AGE} AS age, signals,
    CASE WHEN len(reasons) > 3 THEN '+' || (len(reasons) - 3) || ' more' ELSE '' END AS more FROM x JOIN c USING (incident_id)""")
def dashboard(spark, sf_dir):
    records = ops.latest_versions(inputs.record_versions(spark, sf_dir))
    rows = ops.quarantine_rows(records, inputs.reports(spark, sf_dir))
    return ops.dashboard(rows, "held", F.lit("2024-01-31 00:00:00").cast("timestamp"))


@register("status_counts", f"""WITH {inputs.RECORDS_SQL} SELECT count(*) - count(restored_at) AS held, count(restored_at) AS restored, count(*) AS "all" FROM records""")
def status_counts(spark, sf_dir):
    records = ops.latest_versions(inputs.record_versions(spark, sf_dir))
    return ops.status_counts(records.withColumn("status", ops.record_status()))


@register("released_hashes", f"WITH {inputs.RECORDS_SQL} SELECT DISTINCT content_sha256 FROM records WHERE restored_at IS NOT NULL OR restore_started_at IS NOT NULL")
def released_hashes(spark, sf_dir):
    return ops.released_hashes(ops.latest_versions(inputs.record_versions(spark, sf_dir)))


@register("unreleased_messages", f"""WITH {inputs.RECORDS_SQL}, rel AS (SELECT content_sha256 FROM records WHERE restored_at IS NOT NULL OR restore_started_at IS NOT NULL)
  SELECT event_id, user_id FROM events WHERE sha256(user_id::VARCHAR) NOT IN (SELECT content_sha256 FROM rel)""")
def unreleased_messages(spark, sf_dir):
    released = ops.released_hashes(ops.latest_versions(inputs.record_versions(spark, sf_dir)))
    rows = _events(spark, sf_dir).withColumn("content_sha256", F.sha2(F.col("user_id").cast("string"), 256))
    return ops.without_released(rows, released).select("event_id", "user_id")


_RESTORE_SQL = """rev AS (SELECT 'i' || user_id AS incident_id, event_id AS version, CASE event_type WHEN 'click' THEN 'started' WHEN 'error' THEN 'failed'
    WHEN 'signup' THEN CASE WHEN event_id % 20 = 0 THEN 'restored' ELSE 'started' END END AS event FROM events WHERE event_type IN ('click', 'error', 'signup')),
  fr AS (SELECT incident_id, min(version) AS v FROM rev WHERE event = 'restored' GROUP BY incident_id),
  ro AS (SELECT rev.*, CASE WHEN version > v THEN 'conflict' ELSE 'applied' END AS outcome FROM rev LEFT JOIN fr USING (incident_id))"""


def _restore_events(spark, sf_dir):
    kind = F.col("event_type")
    event = F.when(kind == "click", "started").when(kind == "error", "failed").when(
        kind == "signup", F.when(F.col("event_id") % 20 == 0, "restored").otherwise("started"))
    return _events(spark, sf_dir).select(
        F.concat(F.lit("i"), F.col("user_id").cast("string")).alias("incident_id"),
        F.col("event_id").alias("version"), event.alias("event")).where("event is not null")


@register("restore_transitions", f"WITH {_RESTORE_SQL} SELECT incident_id, version, event, outcome FROM ro")
def restore_transitions(spark, sf_dir):
    return ops.restore_transitions(_restore_events(spark, sf_dir))


@register("restore_states", f"""WITH {_RESTORE_SQL} SELECT incident_id, CASE arg_max(event, version) WHEN 'restored' THEN 'restored' WHEN 'started' THEN 'restoring' ELSE 'held' END AS state
  FROM ro WHERE outcome = 'applied' GROUP BY incident_id""")
def restore_states(spark, sf_dir):
    return ops.restore_states(_restore_events(spark, sf_dir))


@register("reconciled_messages", """WITH st AS (SELECT event_id AS uid, (user_id % 3) AS uidvalidity, '<' || user_id || '@x>' AS message_id, sha256((event_id % 500)::VARCHAR) AS content_sha256 FROM events),
  rc AS (SELECT 'r' || event_id AS incident_id, user_id % 3 AS quarantine_uidvalidity, CASE WHEN event_id % 4 = 0 THEN event_id ELSE event_id + 1 END AS quarantine_uid,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE '<' || user_id || '@x>' END AS message_id, sha256((event_id % 500)::VARCHAR) AS content_sha256 FROM events WHERE event_type = 'purchase'),
  m AS (SELECT incident_id, 1 AS priority, uid FROM rc JOIN st ON st.uidvalidity = rc.quarantine_uidvalidity AND st.uid = rc.quarantine_uid AND st.content_sha256 = rc.content_sha256
    UNION ALL SELECT incident_id, 2, min(uid) FROM rc JOIN st ON rc.message_id <> '' AND st.message_id = rc.message_id AND st.content_sha256 = rc.content_sha256 GROUP BY incident_id)
  SELECT incident_id, arg_min(uid, priority) AS found_uid, min(priority)::INT AS priority FROM m GROUP BY incident_id""")
def reconciled_messages(spark, sf_dir):
    k, u = F.col("event_id"), F.col("user_id")
    digest = F.sha2((k % 500).cast("string"), 256)
    ident = F.concat(F.lit("<"), u.cast("string"), F.lit("@x>"))
    stored = _events(spark, sf_dir).select(k.alias("uid"), (u % 3).alias("uidvalidity"),
                                           ident.alias("message_id"), digest.alias("content_sha256"))
    records = _events(spark, sf_dir).where("event_type = 'purchase'").select(
        F.concat(F.lit("r"), k.cast("string")).alias("incident_id"), (u % 3).alias("quarantine_uidvalidity"),
        F.when(k % 4 == 0, k).otherwise(k + 1).alias("quarantine_uid"),
        F.when(k % 5 == 0, "").otherwise(ident).alias("message_id"), digest.alias("content_sha256"))
    return ops.reconcile(records, stored)


# ---------------------------------------------------------------- audit chain

CHAIN_FIELDS = ["action_taken", "event", "seq", "ts", "uid"]
ROWS_PER_FILE = 4096
CHAIN_SQL = f"""{inputs.AUDIT_SQL}, num AS (SELECT mailbox, seq // {ROWS_PER_FILE} AS file_no, seq,
    row_number() OVER (PARTITION BY mailbox, seq // {ROWS_PER_FILE} ORDER BY seq) AS line_no,
    '{{"action_taken":' || CASE WHEN action_taken IS NULL THEN 'null' ELSE '"' || action_taken || '"' END || ',"event":"' || event || '","prev":"' AS head,
    '","seq":' || seq || ',"ts":"' || ts || '","uid":' || uid || '}}' AS tail FROM audit),
  chain AS (SELECT mailbox, file_no, seq, line_no, '{fixed.GENESIS}' AS prev, sha256(head || '{fixed.GENESIS}' || tail) AS hash FROM num WHERE line_no = 1
    UNION ALL SELECT n.mailbox, n.file_no, n.seq, n.line_no, c.hash, sha256(n.head || c.hash || n.tail)
    FROM chain c JOIN num n ON n.mailbox = c.mailbox AND n.file_no = c.file_no AND n.line_no = c.line_no + 1)"""


def chained(spark, sf_dir):
    return ops.build_audit_chain(inputs.audit(spark, sf_dir), ["mailbox"], "seq", CHAIN_FIELDS, ROWS_PER_FILE)


@register("audit_chain", f"WITH RECURSIVE {CHAIN_SQL} SELECT mailbox, file_no, line_no::INT AS line_no, seq, prev, hash FROM chain")
def audit_chain(spark, sf_dir):
    return chained(spark, sf_dir).select("mailbox", "file_no", "line_no", "seq", "prev", "hash")


@register("verified_chains", f"""WITH RECURSIVE {CHAIN_SQL},
  st AS (SELECT mailbox, file_no, line_no, prev, hash, seq % 997 = 5 AS edited, seq % 1499 = 7 AS cut FROM chain),
  rn AS (SELECT mailbox, file_no, prev, hash, edited, row_number() OVER (PARTITION BY mailbox, file_no ORDER BY line_no) AS n FROM st WHERE NOT cut),
  pb AS (SELECT *, CASE WHEN prev <> CASE WHEN n = 1 THEN '{fixed.GENESIS}' ELSE lag(hash) OVER (PARTITION BY mailbox, file_no ORDER BY n) END
      THEN ': chain broken (line missing or reordered)' WHEN edited THEN ': contents were modified' END AS p FROM rn),
  ag AS (SELECT mailbox, file_no, count(*) AS lines, min(n) FILTER (p IS NOT NULL) AS f, arg_min(p, n) FILTER (p IS NOT NULL) AS p FROM pb GROUP BY ALL)
  SELECT mailbox, file_no, f IS NULL AS ok, CASE WHEN f IS NULL THEN lines ELSE f - 1 END AS checked,
    CASE WHEN f IS NULL THEN '' ELSE 'line ' || f || p END AS problem FROM ag""")
def verified_chains(spark, sf_dir):
    """Some lines edited, some removed; the log is read again with its own line numbers."""
    from pyspark.sql import Window as W

    rows = chained(spark, sf_dir).where("seq % 1499 <> 7").withColumn(
        "uid", F.when(F.col("seq") % 997 == 5, F.col("uid") + 1).otherwise(F.col("uid")))
    # A file holds at most 4,096 rows, so numbering its lines is a bounded window.
    lines = rows.withColumn("line_no", F.row_number().over(
        W.partitionBy("mailbox", "file_no").orderBy("seq")))
    return ops.verify_audit_chain(lines, ["mailbox", "file_no"], CHAIN_FIELDS)


SEALS_SQL = f"""{CHAIN_SQL},
  ends AS (SELECT mailbox, file_no, count(*) AS n_rows, arg_max(hash, line_no) AS last, row_number() OVER (PARTITION BY mailbox ORDER BY file_no) AS seal_no
    FROM chain GROUP BY mailbox, file_no),
  seals AS (SELECT mailbox, file_no, n_rows, last, seal_no, '{fixed.GENESIS}' AS prev,
      sha256('{{"file_no":' || file_no || ',"last":"' || last || '","prev":"{fixed.GENESIS}","rows":' || n_rows || '}}') AS hash FROM ends WHERE seal_no = 1
    UNION ALL SELECT e.mailbox, e.file_no, e.n_rows, e.last, e.seal_no, s.hash,
      sha256('{{"file_no":' || e.file_no || ',"last":"' || e.last || '","prev":"' || s.hash || '","rows":' || e.n_rows || '}}')
    FROM seals s JOIN ends e ON e.mailbox = s.mailbox AND e.seal_no = s.seal_no + 1)"""


@register("sealed_audit_files", f"""WITH RECURSIVE {SEALS_SQL}
  SELECT mailbox, file_no, n_rows AS "rows", last, seal_no::INT AS seal_no, prev, hash FROM seals""")
def sealed_audit_files(spark, sf_dir):
    return ops.seal_audit_files(chained(spark, sf_dir), ["mailbox"])


# Mailboxes lose the last line of their first file, their first file, the last file with its seal, or nothing.
_LOSS = 4


@register("verified_audit_logs", f"""WITH {inputs.AUDIT_SQL},
  f AS (SELECT mailbox, seq // {ROWS_PER_FILE} AS file_no FROM audit GROUP BY ALL),
  m AS (SELECT mailbox, min(file_no) AS a, count(*) AS n, mailbox % {_LOSS} AS loss FROM f GROUP BY mailbox)
  SELECT mailbox, loss = 3 AS ok, CASE WHEN loss = 2 THEN n - 1 ELSE n END AS files,
    CASE loss WHEN 0 THEN 'file ' || a || ' does not end as sealed' WHEN 1 THEN 'file ' || a || ' is missing'
      WHEN 2 THEN 'the seals do not end as noted' ELSE '' END AS problem FROM m""")
def verified_audit_logs(spark, sf_dir):
    """Lines, files and seals removed after sealing; the heads were kept apart."""
    lines = chained(spark, sf_dir)
    seals = ops.seal_audit_files(lines, ["mailbox"])
    return ops.verify_audit_log(*with_losses(lines, seals), ops.audit_heads(seals, ["mailbox"]), ["mailbox"], CHAIN_FIELDS)


def with_losses(lines, seals):
    """Lines and seals of a log after each mailbox lost what its remainder says."""
    loss = F.col("mailbox") % _LOSS
    # The first file and its last line: the least of pairs whose second part falls as lines grow.
    ends = lines.groupBy("mailbox").agg(F.min(F.when(F.col("file_no").isNotNull(), F.struct("file_no", (-F.col("line_no")).alias("line")))).alias("_a"),
                                        F.max("file_no").alias("_end")).select("mailbox", F.col("_a.file_no").alias("_first"), (-F.col("_a.line")).alias("_last_line"), "_end")
    known = lines.join(ends, "mailbox")
    gone = (((loss == 0) & (F.col("file_no") == F.col("_first")) & (F.col("line_no") == F.col("_last_line")))
            | ((loss == 1) & (F.col("file_no") == F.col("_first"))) | ((loss == 2) & (F.col("file_no") == F.col("_end"))))
    left = seals.join(ends, "mailbox").where(~((loss == 2) & (F.col("file_no") == F.col("_end"))))
    return known.where(~gone), left.drop("_first", "_last_line", "_end")


@register("bursts", """WITH w AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id % 5 ORDER BY ts RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events)
  SELECT event_id, user_id, in_window, in_window > 3 AS burst FROM w""")
def bursts(spark, sf_dir):
    """Sliding ten-minute counts over five very busy keys."""
    rows = _events(spark, sf_dir).withColumn("client", F.col("user_id") % 5)
    return ops.bursts(rows, ["client"], "ts", limit=3, seconds=600).select(
        "event_id", "user_id", "in_window", "burst")


@register("backfill_selection", """WITH r AS (SELECT user_id AS mailbox, event_id AS uid, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
  SELECT mailbox, uid FROM r WHERE k <= 20""")
def backfill_selection(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("mailbox"), F.col("event_id").alias("uid"))
    return ops.backfill_selection(rows, 20)


_CURSOR_SQL = """ms AS (SELECT user_id AS mailbox, event_id AS uid, 7 AS uidvalidity FROM events),
  sv AS (SELECT DISTINCT user_id AS mailbox, CASE WHEN user_id % 4 = 0 THEN 6 ELSE 7 END AS uidvalidity, 500 + user_id AS last_uid FROM events WHERE user_id % 3 <> 0),
  rk AS (SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY uid DESC) AS k FROM ms),
  nw AS (SELECT mailbox, coalesce(max(CASE WHEN k = 31 THEN uid END), 0) AS start FROM rk GROUP BY mailbox),
  cu AS (SELECT nw.mailbox, 7 AS uidvalidity, CASE WHEN sv.uidvalidity = 7 THEN sv.last_uid ELSE start END AS last_uid,
    coalesce(sv.uidvalidity, 0) <> 7 AS reset FROM nw LEFT JOIN sv USING (mailbox))"""


def _cursors(spark, sf_dir):
    u = F.col("user_id")
    messages = _events(spark, sf_dir).select(u.alias("mailbox"), F.col("event_id").alias("uid"), F.lit(7).alias("uidvalidity"))
    saved = _events(spark, sf_dir).where("user_id % 3 <> 0").select(
        u.alias("mailbox"), F.when(u % 4 == 0, 6).otherwise(7).alias("uidvalidity"), (u + 500).alias("last_uid")).distinct()
    return messages, ops.starting_cursors(messages, saved, backfill=30)


@register("starting_cursors", f"WITH {_CURSOR_SQL} SELECT mailbox, uidvalidity::INT AS uidvalidity, last_uid, reset FROM cu")
def starting_cursors(spark, sf_dir):
    return _cursors(spark, sf_dir)[1]


@register("incremental_batches", f"""WITH {_CURSOR_SQL}, b AS (SELECT ms.mailbox, uid, row_number() OVER (PARTITION BY ms.mailbox ORDER BY uid) AS k FROM ms JOIN cu USING (mailbox) WHERE uid > last_uid)
  SELECT mailbox, uid FROM b WHERE k <= 200""")
def incremental_batches(spark, sf_dir):
    messages, cursors = _cursors(spark, sf_dir)
    return ops.incremental_batch(messages, cursors).select("mailbox", "uid")


@register("advanced_cursors", f"""WITH {_CURSOR_SQL}, b AS (SELECT ms.mailbox, uid, row_number() OVER (PARTITION BY ms.mailbox ORDER BY uid) AS k FROM ms JOIN cu USING (mailbox) WHERE uid > last_uid)
  SELECT mailbox, max(uid) AS last_uid FROM b WHERE k <= 200 GROUP BY mailbox""")
def advanced_cursors(spark, sf_dir):
    messages, cursors = _cursors(spark, sf_dir)
    return ops.advanced_cursors(ops.incremental_batch(messages, cursors))


