"""Inputs the registered queries derive from the given tables, for both engines.

The tables hold no mail headers, brand names or risky URLs, so every row gets some from a
short list, chosen by arithmetic on its key.  Each derivation keeps all rows and all text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import literals
from .oracle import sql_list


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in the splits that the session's file settings give."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The same rows dealt over the session's shuffle partitions.

    For narrow rows on which rules of milliseconds a row follow: a scan is split by bytes, so a table of some megabytes with
    a million rows would be a handful of tasks, and one file of a stream a single one.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pick(values: list[str], number: Column) -> Column:
    return F.get(literals(values), (number % len(values)).cast("int"))


def pick_sql(values: list[str], number: str) -> str:
    return f"{sql_list(values)}[(({number}) % {len(values)})::INT + 1]"


# ---------------------------------------------------------------- URLs

# Hosts by what a rule should see in them, as (scheme, host, path); {p} stands for the path of the page's own URL.
_PLAIN_HOSTS = [("https://", "www.amazon.in", "/login"), ("www.", "example.com", ""), ("https://", "docs.google.com", "/forms"),
                ("https://", "mail.paypal.co.uk", ""), ("https://", "applebees.com", ""), ("https://", "tomato.in", "")]
_NUMBER_HOSTS = [("http://", "198.51.100.23", ""), ("http://", "3325256727", ""), ("http://", "0xc6.7", ""), ("http://", "0306.0.0.9", ""),
                 ("http://", "[2001:db8::5]", ""), ("http://", "[::7", "")]
_BRAND_HOSTS = [("https://", "paypa1-desk.com", ""), ("https://", "paypal.com.members.quay.test", ""), ("https://", "sbi-card-forms.in", ""),
                ("https://", "rnicrosoft.com", ""), ("https://", "paypall.com", "/account/confirm"), ("https://", "quay.test", "/sbi/kyc/start"),
                ("https://", "xn--pypal-4ve.test", ""), ("https://paypal.com@", "quay.test", "")]
_HOSTED = [("https://", "bit.ly", ""), ("https://", "boats.netlify.app", ""), ("https://", "reports.s3.amazonaws.com", "/verify")]
_ODD_SHAPES = [("https://", "quay.xyz", ""), ("https://", "f.g.h.i.j.example.com", ""), ("https://", "example.com:8081", ""),
               ("https://", "example.com:70000", ""), ("javascript:", "void(0)", ""), ("https://", "fair.example.co.uk", "/" + "long-part/" * 12 + "end")]
URL_FORMS = ["{u}"] + [scheme + host + path + "{p}" for scheme, host, path in
                       _BRAND_HOSTS + _NUMBER_HOSTS + _HOSTED + _ODD_SHAPES + _PLAIN_HOSTS]


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url``: each page's URL in one of the forms above."""
    path = F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1)
    form = pick(URL_FORMS, F.col("page_id"))
    url = F.replace(F.replace(form, F.lit("{u}"), F.col("url")), F.lit("{p}"), path)
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


URLS_SQL = f"""urls AS (
  SELECT page_id, replace(replace({pick_sql(URL_FORMS, 'page_id')}, '{{u}}', url), '{{p}}',
    regexp_extract(url, '^https?://[^/]+(/.*)$', 1)) AS url FROM pages)"""

# ---------------------------------------------------------------- text messages

# By what a message asks for: nothing, a link of a brand or beside it, a call, an answer, a letter.
SMS_ENDINGS = [
    " The library closes early on Friday.",
    " A PayPal transfer waits for you: open https://paypa1-desk.com/login this evening.",
    " The SBI card form is ready at sbi-card-forms.in/start today",
    " Amazon left the parcel with the porter. Where: https://amzn.in/d/3kQ8vTz",
    " For the boiler visit ring 98450 17263 before noon",
    " Reply STOP to leave this list",
    " An ICICI statement is kept at http://192.0.2.7/s?n=4, for a week.",
    " Questions go to help@example.org and forms are at www.example.org/forms.",
    " Tide tables: t.me/tide_tables or a.co/d/m4x.",
    " HDFC Bank branch hours change in spring",
    " Photos are at https://bit.ly/2wHdRn5 and https://bit.ly/2wHdRn5",
    " Text WIN to 56161 for a PhonePe voucher",
]
SMS_SENDERS = ["JD-UNIONB-P", "+44 7700 900461", "54321", "courier.desk@example.net", "", "METRO", "{sender}", "07700900461"]


def sms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``msg_id, text, sender, p_sms, p_email`` from all conversation turns."""
    key = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        key.alias("msg_id"),
        F.concat("text", pick(SMS_ENDINGS, F.col("conv_id") + F.col("turn") * 5)).alias("text"),
        pick(SMS_SENDERS, F.col("conv_id")).alias("sender"),
        (((key * 31) % 97 + 1) / F.lit(100.0)).alias("p_sms"),
        (((key * 17) % 89 + 5) / F.lit(100.0)).alias("p_email"))


SMS_SQL = f"""sms AS (
  SELECT conv_id * 1000 + turn AS msg_id, text || {pick_sql(SMS_ENDINGS, 'conv_id + turn * 5')} AS text,
    {pick_sql(SMS_SENDERS, 'conv_id')} AS sender,
    (((conv_id * 1000 + turn) * 31) % 97 + 1) / 100.0::DOUBLE AS p_sms,
    (((conv_id * 1000 + turn) * 17) % 89 + 5) / 100.0::DOUBLE AS p_email FROM conversations)"""

# ---------------------------------------------------------------- parsed mail columns

DISPLAYS = ["PayPal Billing Desk", "Noor treasurer@elmcourt.example", "Payroll Team", "Riverside Gazette",
            "Google Accounts", "India Post Parcels", "Garden Club", "Help Desk", "Amazon", "Swiggy", "Ines"]
ADDRESSES = ["billing@paypal-desk.test", "noor.desk@gmail.com", "payroll@elmcourt.test", "gazette@example.com",
             "accounts.crew@gmail.com", "slips@indiapost-track.top", "", "desk@garden.onmicrosoft.com",
             "shipment@amazon.in", "orders@mail.swiggy.in", "receipts@paypal.com", "post@xn--pypal-4ve.com",
             "x@y.example.co.uk"]
REPLIES = ["", "claims@gmail.com", "desk@example.org", "", "gazette@example.com", "", "y@freemail.test"]
RETURNS = ["", "return@post.test", "return@amazonses.com", "gazette@example.com", "", "r@paypal.com"]


def auth_results(server: str, **methods: str) -> str:
    """An authentication header: a server and its results, with what each method was applied to."""
    about = {"dkim": " header.i=@c.example", "spf": " smtp.mailfrom=c", "dmarc": " header.from=c"}
    return "; ".join([server, *(f"{method}={result}{about[method]}" for method, result in methods.items())])


_TRUSTED, _OTHER = "mx.google.com", "relay.quay.test"
AUTH_TOP = [
    auth_results(_TRUSTED, dkim="pass", spf="pass", dmarc="pass"),
    auth_results(_TRUSTED, dkim="fail", spf="softfail (not listed there)", dmarc="fail (p=NONE)"),
    auth_results(_OTHER, dkim="pass", spf="pass", dmarc="pass"),
    "",
    auth_results(f"{_TRUSTED} 1", spf="fail (a note says dmarc=pass)"),
    f"{_TRUSTED}; dkim=none; " + auth_results("dkim=pass header.i=@d.example", dmarc="pass"),
    auth_results(_OTHER, dmarc="fail", spf="permerror"),
]
AUTH_LOWER = ["", "; ".join([_TRUSTED, *(f"{m}=pass" for m in ("dkim", "spf", "dmarc"))]), "", f"{_OTHER}; spf=pass", ""]
SPF_HEADERS = ["", "pass (listed there)", "softfail (not sure)", "fail", ""]


def mail_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header columns of one mail per customer (see the lists above)."""
    k = F.col("c_custkey")
    top, lower, spf = pick(AUTH_TOP, k), pick(AUTH_LOWER, k), pick(SPF_HEADERS, k)
    listed = lambda c: F.filter(F.array(c), lambda v: v != "")
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(
        k.alias("msg_id"), pick(DISPLAYS, k).alias("from_display"),
        pick(ADDRESSES, k).alias("from_address"), listed(pick(REPLIES, k)).alias("reply_to"),
        pick(RETURNS, k).alias("return_path"), (k % 13).cast("int").alias("recipient_count"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("<"), k.cast("string"), F.lit("@x>"))).alias("message_id"),
        F.when(top == "", F.array().cast("array<string>")).otherwise(
            F.concat(F.array(top), listed(lower))).alias("authentication_results"),
        listed(spf).alias("received_spf"), F.col("c_name"))


MAIL_SQL = f"""mail AS (
  SELECT c_custkey AS msg_id, c_name, {pick_sql(DISPLAYS, 'c_custkey')} AS from_display,
    {pick_sql(ADDRESSES, 'c_custkey')} AS from_address, {pick_sql(REPLIES, 'c_custkey')} AS reply_to,
    {pick_sql(RETURNS, 'c_custkey')} AS return_path, (c_custkey % 13)::INT AS recipient_count,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '<' || c_custkey || '@x>' END AS message_id,
    {pick_sql(AUTH_TOP, 'c_custkey')} AS auth_top,
    CASE WHEN {pick_sql(AUTH_TOP, 'c_custkey')} = '' THEN '' ELSE {pick_sql(AUTH_LOWER, 'c_custkey')} END AS auth_lower,
    {pick_sql(SPF_HEADERS, 'c_custkey')} AS received_spf FROM customer)"""

# ---------------------------------------------------------------- raw mail


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation-style mail rows, one per conversation turn (whole text as body)."""
    key = F.col("conv_id") * 1000 + F.col("turn")
    address = F.regexp_replace(pick(ADDRESSES, key), "^$", "someone@example.org")
    return table(spark, sf_dir, "conversations").select(
        key.alias("id"), pick(DISPLAYS, key).alias("from_display"), address.alias("from_address"),
        F.when(key % 3 == 0, "pass").otherwise("fail").alias("dmarc"),
        pick(REPLIES, key).alias("reply_to"),
        F.concat(F.lit("Message "), key.cast("string"), F.lit(" from "), "role").alias("subject"),
        F.concat("text", pick(SMS_ENDINGS, key)).alias("body"))


EVAL_SQL = f"""evals AS (
  SELECT conv_id * 1000 + turn AS id, {pick_sql(DISPLAYS, 'conv_id * 1000 + turn')} AS from_display,
    CASE WHEN {pick_sql(ADDRESSES, 'conv_id * 1000 + turn')} = '' THEN 'someone@example.org'
         ELSE {pick_sql(ADDRESSES, 'conv_id * 1000 + turn')} END AS from_address,
    CASE WHEN (conv_id * 1000 + turn) % 3 = 0 THEN 'pass' ELSE 'fail' END AS dmarc,
    {pick_sql(REPLIES, 'conv_id * 1000 + turn')} AS reply_to,
    'Message ' || (conv_id * 1000 + turn) || ' from ' || role AS subject,
    text || {pick_sql(SMS_ENDINGS, 'conv_id * 1000 + turn')} AS body FROM conversations)"""


def raw_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``msg_id, content``: the evaluation rows as raw messages."""
    from ..operators.ingest import assemble_messages

    return assemble_messages(eval_rows(spark, sf_dir)).select(F.col("id").alias("msg_id"), "content")


RAW_SQL = f"""{EVAL_SQL},
raw AS (
  SELECT id AS msg_id, concat_ws(chr(13) || chr(10),
    'Authentication-Results: mx.google.com; dkim=' || dmarc || ' header.i=@' || d || '; spf=' || dmarc
      || ' smtp.mailfrom=' || from_address || '; dmarc=' || dmarc || ' header.from=' || d,
    'From: "' || from_display || '" <' || from_address || '>', 'To: user@example.org',
    'Subject: ' || subject, 'Message-ID: <' || id || '@' || d || '>', 'Date: Thu, 08 Oct 2026 10:00:00 +0530',
    CASE WHEN reply_to <> '' THEN 'Reply-To: ' || reply_to END, 'MIME-Version: 1.0',
    'Content-Type: text/plain; charset=utf-8', '', body) AS content
  FROM (SELECT *, string_split(from_address, '@')[-1] AS d FROM evals))"""

# ---------------------------------------------------------------- scored rows


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score, an action and an analysed flag by arithmetic."""
    k = F.col("doc_id")
    joined = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    score = ((k * 37) % 101) / F.lit(101.0)
    return joined.select(
        "doc_id", "source", F.col("lang").alias("category"), F.col("quality").alias("label"),
        F.when(k % 29 != 0, score).alias("score"), (k % 29 != 0).alias("analysed"),
        F.when(k % 29 == 0, "review").when(score >= 0.8, "quarantine")
        .when(score >= 0.5, "review").otherwise("deliver").alias("action"),
        F.when(k % 29 != 0, ((k * 53) % 103) / F.lit(103.0)).alias("text_probability"))


SCORED_SQL = """scored AS (
  SELECT doc_id, source, lang AS category, quality AS label,
    CASE WHEN doc_id % 29 <> 0 THEN ((doc_id * 37) % 101) / 101.0::DOUBLE END AS score,
    doc_id % 29 <> 0 AS analysed,
    CASE WHEN doc_id % 29 = 0 THEN 'review' WHEN ((doc_id * 37) % 101) / 101.0::DOUBLE >= 0.8 THEN 'quarantine'
      WHEN ((doc_id * 37) % 101) / 101.0::DOUBLE >= 0.5 THEN 'review' ELSE 'deliver' END AS action,
    CASE WHEN doc_id % 29 <> 0 THEN ((doc_id * 53) % 103) / 103.0::DOUBLE END AS text_probability
  FROM labels JOIN documents USING (doc_id))"""

# ---------------------------------------------------------------- operations tables


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit entries from the events: ``seq, ts, event, action_taken, mailbox, uid``."""
    kind = F.col("event_type")
    event = F.when(kind == "error", "restored").when(kind == "signup", "web_scan").otherwise("scanned")
    taken = F.when(kind == "purchase", "quarantined").when(kind == "view", "delivered").when(
        kind == "click", "flagged_for_review")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        event.alias("event"), taken.alias("action_taken"), F.col("user_id").alias("mailbox"),
        F.col("event_id").alias("uid"))


AUDIT_SQL = """audit AS (
  SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts,
    CASE event_type WHEN 'error' THEN 'restored' WHEN 'signup' THEN 'web_scan' ELSE 'scanned' END AS event,
    CASE event_type WHEN 'purchase' THEN 'quarantined' WHEN 'view' THEN 'delivered'
      WHEN 'click' THEN 'flagged_for_review' END AS action_taken,
    user_id AS mailbox, event_id AS uid FROM events)"""


def record_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantine record versions: each purchase quarantines, some are restored later."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    key = F.col("event_id")
    base = rows.select(
        F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"),
                 F.md5(key.cast("string"))).alias("incident_id"),
        key.alias("n"), F.col("ts").alias("quarantined_at"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("content_sha256"),
        F.round(F.lit(0.8) + F.col("value") / 1000.0 % 0.2, 4).alias("score"),
        F.explode(F.when(key % 7 == 0, F.array(F.lit(1), F.lit(2), F.lit(3)))
                  .when(key % 11 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("version"))
    return base.select(
        "incident_id", "version", "n", "quarantined_at", "content_sha256", "score",
        F.when(F.col("version") == 2, F.lit("started")).alias("restore_started_at"),
        F.when(F.col("version") == 3, F.lit("done")).alias("restored_at"))


RECORDS_SQL = """versions AS (
  SELECT strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || left(md5(event_id::VARCHAR), 32) AS incident_id,
    unnest(CASE WHEN event_id % 7 = 0 THEN [1, 2, 3] WHEN event_id % 11 = 0 THEN [1, 2] ELSE [1] END) AS version,
    event_id AS n, ts AS quarantined_at, sha256(user_id::VARCHAR) AS content_sha256,
    round(0.8 + value / 1000.0 % 0.2, 4) AS score FROM events WHERE event_type = 'purchase'),
version_rows AS (
  SELECT *, CASE WHEN version = 2 THEN 'started' END AS restore_started_at,
    CASE WHEN version = 3 THEN 'done' END AS restored_at FROM versions),
records AS (
  SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY version DESC) AS r
    FROM version_rows) WHERE r = 1)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident reports of the records that have one, with up to five reasons."""
    # Codes and weights used as sample reasons.
    codes = ["dmarc_fail", "url_ip_host", "att_html", "spf_softfail", "verified_sender"]
    weights = ["2.4", "1.2", "0.3", "-0.5", "-2.0"]
    rows = table(spark, sf_dir, "events").where((F.col("event_type") == "purchase") & (F.col("event_id") % 5 != 0))
    reasons = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 5).cast("int")), lambda i: F.struct(
        F.lit("link").alias("source"), pick(codes, F.col("event_id") + i).alias("code"),
        F.lit("sample").alias("detail"),
        pick(weights, F.col("event_id") + i).cast("double").alias("weight")))
    return rows.select(
        F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"),
                 F.md5(F.col("event_id").cast("string"))).alias("incident_id"),
        F.when(F.col("event_id") % 3 == 0, "sms").otherwise("email").alias("kind"), reasons.alias("reasons"))


REPORTS_SQL = """reports AS (
  SELECT strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || left(md5(event_id::VARCHAR), 32) AS incident_id,
    CASE WHEN event_id % 3 = 0 THEN 'sms' ELSE 'email' END AS kind,
    list_transform(range(0, event_id % 5 + 1), lambda i: {
      'code': ['dmarc_fail', 'url_ip_host', 'att_html', 'spf_softfail', 'verified_sender'][((event_id + i) % 5)::INT + 1],
      'weight': [2.4, 1.2, 0.3, -0.5, -2.0][((event_id + i) % 5)::INT + 1]::DOUBLE}) AS reasons
  FROM events WHERE event_type = 'purchase' AND event_id % 5 <> 0)"""

