"""Registered queries: raw mail, header rules, sender evidence of text messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, mail
from ..functions.core import exploded
from ..functions.findings import first_wins
from ..functions.sms import contact_channels, sender_kind, sms_report
from ..functions.urls import text_link_reports
from ..operators import features, fusion, headers, ingest, links
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


# ---------------------------------------------------------------- raw mail

_LINES = f"""WITH {inputs.RAW_SQL}, hl AS (SELECT msg_id, unnest(string_split(string_split(content, chr(13) || chr(10) || chr(13) || chr(10))[1], chr(13) || chr(10))) AS line,
  generate_subscripts(string_split(string_split(content, chr(13) || chr(10) || chr(13) || chr(10))[1], chr(13) || chr(10)), 1) AS p FROM raw)"""


@register("header_rows", f"""{_LINES} SELECT msg_id, (p - 1)::INT AS pos, lower(string_split(line, ':')[1]) AS name,
  ltrim(substr(line, instr(line, ':') + 1)) AS value FROM hl""")
def header_rows(spark, sf_dir):
    return ingest.explode_headers(inputs.raw_mail(spark, sf_dir))


@register("guarded_messages", f"""WITH {inputs.RAW_SQL} SELECT msg_id, CASE WHEN msg_id % 50 = 0 THEN 'unparseable'
  WHEN octet_length(encode(content)) > 900 THEN 'limit_exceeded' ELSE 'ok' END AS status FROM raw""")
def guarded_messages(spark, sf_dir):
    rows = inputs.raw_mail(spark, sf_dir).withColumn("content", F.when(
        F.col("msg_id") % 50 == 0, F.lit(b" \n")).otherwise(F.col("content")))
    return rows.select("msg_id", mail.guard(F.col("content"), max_bytes=900).alias("status"))


@register("message_addresses", f"""WITH {inputs.EVAL_SQL} SELECT id AS msg_id, from_display, from_address, reply_to,
  'user@example.org' AS recipients, 1 AS recipient_count, subject,
  '<' || id || '@' || string_split(from_address, '@')[-1] || '>' AS message_id FROM evals""")
def message_addresses(spark, sf_dir):
    parsed = ingest.parse_messages(inputs.raw_mail(spark, sf_dir))
    return parsed.select("msg_id", "from_display", "from_address",
                         F.array_join("reply_to", ",").alias("reply_to"),
                         F.array_join("to", ",").alias("recipients"), "recipient_count", "subject", "message_id")


def _multipart(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    safe = F.replace("text", F.lit("<"), F.lit(" "))
    content = F.concat(
        F.lit("From: a@example.com\r\nContent-Type: multipart/mixed; boundary=\"outer\"\r\n\r\npreamble\r\n--outer\r\n"),
        F.lit("Content-Type: multipart/alternative; boundary=inner\r\n\r\n--inner\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"),
        "text", F.lit("\r\n--inner\r\nContent-Type: text/html; charset=\"utf-8\"\r\nContent-Transfer-Encoding: base64\r\n\r\n"),
        F.base64(F.encode(F.concat(F.lit("<p>"), safe, F.lit("</p>")), "UTF-8")),
        F.lit("\r\n--inner--\r\n--outer\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=\"a.pdf\"\r\n\r\nxyz\r\n--outer--\r\n"))
    return rows.select(key.alias("msg_id"), F.encode(content, "UTF-8").alias("content"))


@register("message_parts", """WITH t AS (SELECT conv_id * 1000 + turn AS msg_id, text FROM conversations)
  SELECT msg_id, 0 AS part, 'text/plain' AS content_type, '' AS filename, '' AS disposition, md5(replace(text, chr(13), chr(10))) AS text_md5 FROM t
  UNION ALL SELECT msg_id, 1, 'text/html', '', '', md5('<p>' || replace(text, '<', ' ') || '</p>') FROM t
  UNION ALL SELECT msg_id, 2, 'application/pdf', 'a.pdf', 'attachment', NULL FROM t""")
def message_parts(spark, sf_dir):
    """A nested multipart message per conversation turn, taken apart again."""
    parts = ingest.explode_parts(_multipart(spark, sf_dir))
    return parts.select("msg_id", "part", "content_type", "filename", "disposition", F.md5("text").alias("text_md5"))


@register("text_budget", """WITH p AS (SELECT conv_id AS msg_id, turn AS part, text,
    greatest(600 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS room FROM conversations)
  SELECT msg_id, part, substr(text, 1, room::INT) AS text, length(text) > room AS truncated FROM p""")
def text_budget(spark, sf_dir):
    parts = inputs.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("msg_id"), F.col("turn").alias("part"), "text")
    return ingest.apply_text_budget(parts, budget=600).select("msg_id", "part", "text", "truncated")


@register("assembled_messages", f"WITH {inputs.RAW_SQL} SELECT msg_id, content FROM raw")
def assembled_messages(spark, sf_dir):
    rows = inputs.eval_rows(spark, sf_dir)
    passed = ingest.assemble_messages(rows)
    return passed.select(F.col("id").alias("msg_id"), F.decode("content", "UTF-8").alias("content"))


@register("routed_messages", f"""WITH {inputs.RAW_SQL}, r AS (SELECT msg_id, CASE WHEN msg_id % 4 = 0 THEN 'sms' ELSE 'email' END AS kind,
    CASE WHEN msg_id % 4 = 1 THEN content ELSE 'plain text ' || msg_id END AS text FROM raw)
  SELECT msg_id, CASE WHEN kind = 'sms' THEN 'sms' WHEN msg_id % 4 = 1 THEN 'raw_email' ELSE 'text' END AS route FROM r""")
def routed_messages(spark, sf_dir):
    rows = inputs.raw_mail(spark, sf_dir)
    kind = F.when(F.col("msg_id") % 4 == 0, "sms").otherwise("email")
    text = F.when(F.col("msg_id") % 4 == 1, F.decode("content", "UTF-8")).otherwise(
        F.concat(F.lit("plain text "), F.col("msg_id").cast("string")))
    return rows.select("msg_id", ingest.route_kind(kind, text).alias("route"))


@register("message_identity", f"""WITH {inputs.RAW_SQL} SELECT msg_id, sha256(content) AS content_sha256,
  regexp_extract(content, 'Message-ID: (<[^<>\\s]+>)', 1) AS message_id FROM raw""")
def message_identity(spark, sf_dir):
    return ingest.with_identity(inputs.raw_mail(spark, sf_dir)).select("msg_id", "content_sha256", "message_id")


# ---------------------------------------------------------------- header rules

_HEADERS = f"WITH {inputs.MAIL_SQL}, {o.header_ctes('mail')}"
_AUTH_CODES = ["auth_unverified", "forged_auth_header", "dmarc_fail", "spf_fail", "spf_softfail", "dkim_fail"]
_RECIPIENT_CODES = ["bulk_recipients", "undisclosed_recipients", "missing_message_id"]


def _codes(names):
    return ", ".join(f"'{n}'" for n in names)


@register("auth_results", f"""{_HEADERS} SELECT msg_id, coalesce(t_spf, '') AS spf, coalesce(t_dkim, '') AS dkim,
  coalesce(t_dmarc, '') AS dmarc, top_server AS server FROM ha WHERE auth_top <> ''""")
def auth_results(spark, sf_dir):
    top = F.get("authentication_results", F.lit(0))
    rows = inputs.mail_columns(spark, sf_dir).withColumn("a", headers.parse_auth_results(top)).where(
        F.size("authentication_results") > 0)
    return rows.select("msg_id", *[F.coalesce(f"a.{m}", F.lit("")).alias(m) for m in headers.METHODS], "a.server")


def _ruled(spark, sf_dir):
    return headers.with_header_findings(inputs.mail_columns(spark, sf_dir))


@register("auth_findings", f"""{_HEADERS} SELECT msg_id, spf, dkim, dmarc, auth_source,
  coalesce(string_agg(hf.code, ',' ORDER BY ord), '') AS codes FROM ha LEFT JOIN
  (SELECT * FROM hf WHERE code IN ({_codes(_AUTH_CODES)})) hf USING (msg_id) GROUP BY ALL""")
def auth_findings(spark, sf_dir):
    rows = headers.with_authentication(inputs.mail_columns(spark, sf_dir))
    found = first_wins(F.array_compact(F.array(*headers.authentication_details())), fixed.HEADER_WEIGHTS)
    return rows.withColumn("f", found).select(
        "msg_id", "spf", "dkim", "dmarc", "auth_source",
        F.array_join(F.transform("f", lambda f: f.code), ",").alias("codes"))


@register("forged_headers", f"{_HEADERS} SELECT msg_id, auth_source, forged FROM ha")
def forged_headers(spark, sf_dir):
    return headers.with_authentication(inputs.mail_columns(spark, sf_dir)).select(
        "msg_id", "auth_source", "forged")


@register("sender_findings", f"""{_HEADERS} SELECT msg_id, code, detail FROM hf
  WHERE code NOT IN ({_codes(_AUTH_CODES + _RECIPIENT_CODES)})""")
def sender_findings(spark, sf_dir):
    rows = headers.with_sender_domains(inputs.mail_columns(spark, sf_dir))
    found = F.array_compact(F.array(*headers.sender_details()))
    return exploded(rows, ["msg_id"], found)


@register("recipient_findings", f"{_HEADERS} SELECT msg_id, code, detail FROM hf WHERE code IN ({_codes(_RECIPIENT_CODES)})")
def recipient_findings(spark, sf_dir):
    return exploded(inputs.mail_columns(spark, sf_dir), ["msg_id"],
                    F.array_compact(F.array(*headers.recipient_details())))


# ---------------------------------------------------------------- headers with one link each

_FORMS = [f.replace("{u}", "https://news.example.com/x").replace("{p}", "/x") for f in inputs.URL_FORMS]
WITH_LINKS = f"""{_HEADERS}, mlinks AS (SELECT msg_id, {inputs.pick_sql(_FORMS, 'msg_id * 7')} AS url FROM mail),
  {o.url_ctes('mlinks', 'msg_id')}, lf AS (SELECT msg_id, ord, code FROM uf), {o.trust_ctes()}"""


def with_links(spark, sf_dir):
    """Customers' mails with one link each, all rule columns computed."""
    link = F.struct(inputs.pick(_FORMS, F.col("msg_id") * 7).alias("href"), F.lit("").alias("text"),
                    F.lit("text").alias("source"))
    rows = inputs.mail_columns(spark, sf_dir).withColumn("links", F.array(link)).withColumn(
        "attachments", F.array().cast("array<struct<filename:string,content_type:string,size:bigint>>"))
    return links.with_link_findings(headers.with_header_findings(rows))


@register("email_trust_credits", f"{WITH_LINKS} SELECT msg_id, code, weight FROM tr")
def email_trust_credits(spark, sf_dir):
    return exploded(with_links(spark, sf_dir), ["msg_id"], fusion.email_trust()).select(
        "msg_id", "code", "weight")


def _pivot_sql():
    header = ", ".join(f"coalesce(max(CASE WHEN hf.code = '{c}' THEN 1.0 END), 0)::DOUBLE AS hdr_{c}"
                       for c in fixed.HEADER_WEIGHTS)
    link = ", ".join(f"coalesce(max(CASE WHEN lf.code = '{c}' THEN 1.0 END), 0)::DOUBLE AS lnk_{c}"
                     for c in fixed.LINK_WEIGHTS)
    return f"""{WITH_LINKS}, hx AS (SELECT msg_id, {header} FROM mail LEFT JOIN hf USING (msg_id) GROUP BY msg_id),
  lx AS (SELECT msg_id, {link} FROM mail LEFT JOIN lf USING (msg_id) GROUP BY msg_id),
  hr AS (SELECT msg_id, least(1.0, sum(weight)) AS r FROM (SELECT DISTINCT msg_id, code FROM hf) JOIN {o.weights(fixed.HEADER_WEIGHTS)} USING (code) GROUP BY msg_id),
  lr AS (SELECT msg_id, least(1.0, sum(weight)) AS r FROM lf JOIN {o.weights(fixed.LINK_WEIGHTS)} USING (code) GROUP BY msg_id)
  SELECT hx.*, lx.* EXCLUDE (msg_id), (ha.auth_source = 'trusted')::INT::DOUBLE AS hdr_auth_trusted,
    round(coalesce(hr.r, 0), 3)::DOUBLE AS hdr_risk, round(coalesce(lr.r, 0), 3)::DOUBLE AS lnk_risk,
    1.0::DOUBLE AS lnk_url_count, (ud.domain <> '' AND ux.usable)::INT::DOUBLE AS lnk_domain_count
  FROM hx JOIN lx USING (msg_id) JOIN ha USING (msg_id) JOIN ud USING (msg_id) JOIN ux USING (msg_id)
  LEFT JOIN hr USING (msg_id) LEFT JOIN lr USING (msg_id)"""


@register("feature_matrix", _pivot_sql())
def feature_matrix(spark, sf_dir):
    return features.feature_matrix(with_links(spark, sf_dir))


# ---------------------------------------------------------------- text messages


@register("sender_kinds", f"""WITH {inputs.SMS_SQL} SELECT msg_id, sender, CASE WHEN sender = '' THEN 'none'
  WHEN contains(sender, '@') THEN 'email' WHEN regexp_matches(regexp_replace(sender, '[\\s().-]', '', 'g'), '^\\+?\\d{{8,15}}$') THEN 'phone'
  WHEN regexp_matches(sender, '^\\d{{3,7}}$') THEN 'short_code' WHEN regexp_matches(sender, '^[A-Za-z0-9 _-]{{2,20}}$') THEN 'alphanumeric'
  ELSE 'other' END AS sender_kind FROM sms""")
def sender_kinds(spark, sf_dir):
    return inputs.sms(spark, sf_dir).select("msg_id", "sender", sender_kind(F.col("sender")).alias("sender_kind"))


_REPORTS = f"""WITH {inputs.SMS_SQL}, e AS (SELECT *, conv_id + turn * 5 AS n FROM (SELECT conv_id, turn, conv_id * 1000 + turn AS msg_id FROM conversations)),
  k AS (SELECT msg_id, n % {len(inputs.SMS_ENDINGS)} AS ending FROM e)"""


@register("sms_contact_channels", f"""{_REPORTS} SELECT msg_id, CASE ending WHEN 0 THEN '' WHEN 1 THEN 'link' WHEN 2 THEN 'link'
  WHEN 3 THEN 'link' WHEN 4 THEN 'phone_number' WHEN 5 THEN 'reply' WHEN 6 THEN 'link' WHEN 7 THEN 'link,email_address'
  WHEN 8 THEN 'link' WHEN 9 THEN '' WHEN 10 THEN 'link' ELSE 'reply' END || CASE WHEN regexp_matches(text, '[a-z]@[a-z]') AND ending <> 7
  THEN '?' ELSE '' END AS channels FROM k JOIN sms USING (msg_id)""")
def sms_contact_channels(spark, sf_dir):
    rows = inputs.sms(spark, sf_dir)
    found = contact_channels(F.col("text"), F.size(text_link_reports("text")))
    return rows.select("msg_id", F.array_join(found, ",").alias("channels"))


def _reported(spark, sf_dir):
    rows = inputs.sms(spark, sf_dir).withColumn("r", text_link_reports("text"))
    return rows.withColumn("s", sms_report(F.col("text"), F.col("sender"), F.col("r")))


_KIND = ("CASE WHEN contains(sender, '@') THEN 'email' WHEN regexp_matches(regexp_replace(sender, '[\\s().-]', '', 'g'), "
         "'^\\+?\\d{8,15}$') THEN 'phone' ELSE '' END")
_NAMES = ("CASE ending WHEN 1 THEN 'paypal' WHEN 2 THEN 'sbi' WHEN 3 THEN 'amazon' WHEN 6 THEN 'icici' "
          "WHEN 9 THEN 'hdfc' WHEN 11 THEN 'phonepe' ELSE '' END")
_OUTSIDE = ("CASE ending WHEN 1 THEN 'paypa1-desk.com' WHEN 2 THEN 'sbi-card-forms.in' WHEN 6 THEN '192.0.2.7' ELSE '' END")


@register("sms_findings", f"""{_REPORTS}, f AS (SELECT msg_id, {_KIND} AS kind, {_NAMES} AS brand, {_OUTSIDE} AS outside FROM k JOIN sms USING (msg_id))
  SELECT msg_id, 'sender_phone_claims_brand' AS code, 'Message names ' || brand || ' but was sent from a personal phone number' AS detail FROM f WHERE kind = 'phone' AND brand <> ''
  UNION ALL SELECT msg_id, 'sender_email_address', 'Sent from an email address (iMessage/RCS), not a phone or business ID' FROM f WHERE kind = 'email'
  UNION ALL SELECT msg_id, 'sms_brand_link_mismatch', 'Message names ' || brand || ' but links to ' || outside FROM f WHERE outside <> ''""")
def sms_findings(spark, sf_dir):
    return exploded(_reported(spark, sf_dir), ["msg_id"], F.col("s.findings")).select("msg_id", "code", "detail")


@register("sms_trust_credits", f"""{_REPORTS}, f AS (SELECT msg_id, ending, {_KIND} AS kind, {_NAMES} AS brand FROM k JOIN sms USING (msg_id))
  SELECT msg_id, 'sms_aligned_links' AS code, -1.0::DOUBLE AS weight FROM f WHERE ending = 3
  UNION ALL SELECT msg_id, 'sms_no_contact_channel', -1.0 FROM f WHERE ending IN (0, 9) AND kind <> 'email' AND NOT (kind = 'phone' AND brand <> '')""")
def sms_trust_credits(spark, sf_dir):
    return exploded(_reported(spark, sf_dir), ["msg_id"], fusion.sms_trust(F.col("s"))).select(
        "msg_id", "code", "weight")
