"""Registered queries: evidence fusion and end-to-end scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.core import exploded, literals
from ..operators import fusion
from . import inputs, scoring
from . import oracle as o
from .mail_queries import WITH_LINKS, with_links
from .text_queries import table_model

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return add


_P_SQL = "((msg_id * 13) % 91 + 2) / 100.0::DOUBLE"
_FUSED = f"{WITH_LINKS}, {o.fusion_ctes(_P_SQL, 'mail')}"


def _probability():
    return ((F.col("msg_id") * 13) % 91 + 2) / F.lit(100.0)


def _fused(spark, sf_dir):
    """Mails with one link each and a given wording probability, fused."""
    rows = with_links(spark, sf_dir).withColumn("probability", _probability())
    wording = fusion.text_reason(F.col("probability"), F.lit(10), F.array().cast("array<string>"))
    rows = rows.withColumn("wording", wording).withColumn("text_weight", F.col("wording.weight"))
    rows = rows.withColumn("reasons", F.concat(
        F.array("wording"), fusion.layer_reasons("header", F.col("header_findings")),
        fusion.layer_reasons("link", F.col("link_findings")), fusion.email_trust()))
    return rows


@register("layer_weights", f"{_FUSED} SELECT msg_id, source, code, round(weight, 6) AS weight FROM layer")
def layer_weights(spark, sf_dir):
    rows = with_links(spark, sf_dir)
    both = F.concat(fusion.layer_reasons("header", F.col("header_findings")),
                    fusion.layer_reasons("link", F.col("link_findings")))
    return exploded(rows, ["msg_id"], both).select("msg_id", "source", "code", F.round("weight", 6).alias("weight"))


@register("text_reasons", f"""WITH {inputs.SMS_SQL}, t AS (SELECT msg_id, p_email AS p, msg_id % 7 AS tokens FROM sms)
  SELECT msg_id, round(greatest(least({o.logit('p')}, 4.0), -4.0), 6) AS weight,
    CASE WHEN tokens < 3 THEN 'Too little readable text to judge the wording'
      WHEN p >= 0.5 THEN 'Wording resembles phishing (' || round(p * 100)::INT || '%); strongest words: ''kyc'', ''otp'''
      ELSE 'Wording resembles legitimate messages (' || round((1 - p) * 100)::INT || '% legitimate)' END AS detail FROM t""")
def text_reasons(spark, sf_dir):
    reason = fusion.text_reason(F.col("p_email"), F.col("msg_id") % 7, literals(["kyc", "otp"]))
    return inputs.sms(spark, sf_dir).withColumn("r", reason).select(
        "msg_id", F.round("r.weight", 6).alias("weight"), "r.detail")


@register("fused_scores", f"""{_FUSED} SELECT msg_id, round(score, 6) AS score, {o.label_of('round(score, 9)')} AS label,
  {o.action_of('round(score, 9)')} AS action FROM fu""")
def fused_scores(spark, sf_dir):
    rows = fusion.fuse(_fused(spark, sf_dir))
    label, action = fusion.decide(F.round("score", 9))
    return rows.select("msg_id", F.round("score", 6).alias("score"), label.alias("label"), action.alias("action"))


@register("ordered_reasons", f"""{_FUSED}, r AS (SELECT msg_id, code, weight, row_number() OVER (
    PARTITION BY msg_id ORDER BY -abs(weight), ord) AS n FROM rs)
  SELECT msg_id, (n - 1)::INT AS pos, code, round(weight, 6) AS weight,
    CASE WHEN round(abs(weight), 9) >= 2 THEN 'strong' WHEN round(abs(weight), 9) >= 1 THEN 'medium' ELSE 'weak' END AS strength FROM r""")
def ordered_reasons(spark, sf_dir):
    rows = exploded(fusion.fuse(_fused(spark, sf_dir)), ["msg_id"], F.col("reasons"), "pos")
    return rows.select("msg_id", "pos", "code", F.round("weight", 6).alias("weight"),
                       fusion.strength(F.round("weight", 9)).alias("strength"))


@register("verdict_components", f"""{_FUSED}, hk AS (SELECT msg_id, least(1.0, sum(weight)) AS r FROM hw GROUP BY msg_id),
  lk AS (SELECT msg_id, least(1.0, sum(weight)) AS r FROM lw GROUP BY msg_id)
  SELECT msg_id, round(coalesce(hk.r, 0), 3)::DOUBLE AS header_risk, round(coalesce(lk.r, 0), 3)::DOUBLE AS link_risk,
    round(credit, 3)::DOUBLE AS trust_credit, round(total, 3) AS total_logit, round(text_weight, 3) AS text_logit,
    round({_P_SQL}, 4) AS text_probability FROM fu LEFT JOIN hk USING (msg_id) LEFT JOIN lk USING (msg_id)""")
def verdict_components(spark, sf_dir):
    rows = fusion.fuse(_fused(spark, sf_dir))
    return rows.select(
        "msg_id", F.round("header_risk", 3).alias("header_risk"), F.round("link_risk", 3).alias("link_risk"),
        F.round("trust_credit", 3).alias("trust_credit"), F.round("total_logit", 3).alias("total_logit"),
        F.round("text_weight", 3).alias("text_logit"), F.round("probability", 4).alias("text_probability"))


@register("fail_safe_verdicts", f"""{_FUSED}, s AS (SELECT *, CASE WHEN msg_id % 17 = 0 THEN 'limit_exceeded' WHEN msg_id % 19 = 0 THEN 'unparseable' ELSE 'ok' END AS status,
    CASE WHEN msg_id % 3 = 0 THEN 'too_many_parts' WHEN msg_id % 5 = 0 THEN 'unknown_charset' ELSE '' END AS defect FROM fu)
  SELECT msg_id, CASE WHEN status = 'ok' THEN round(score, 6) END AS score,
    CASE WHEN status <> 'ok' THEN 'unknown' WHEN defect = 'too_many_parts' AND {o.action_of('score')} = 'deliver' THEN 'suspicious' ELSE {o.label_of('score')} END AS label,
    CASE WHEN status <> 'ok' OR (defect = 'too_many_parts' AND {o.action_of('score')} = 'deliver') THEN 'review' ELSE {o.action_of('score')} END AS action,
    status = 'ok' AS analysed, CASE WHEN status <> 'ok' THEN status WHEN defect = 'too_many_parts' AND {o.action_of('score')} = 'deliver'
      THEN codes || ',partial_analysis' ELSE codes END AS codes FROM s""")
def fail_safe_verdicts(spark, sf_dir):
    status = F.when(F.col("msg_id") % 17 == 0, "limit_exceeded").when(
        F.col("msg_id") % 19 == 0, "unparseable").otherwise("ok")
    defects = F.when(F.col("msg_id") % 3 == 0, F.array(F.lit("too_many_parts"))).when(
        F.col("msg_id") % 5 == 0, F.array(F.lit("unknown_charset"))).otherwise(F.array().cast("array<string>"))
    rows = fusion.fuse(_fused(spark, sf_dir)).withColumn("status", status).withColumn("defects", defects)
    return fusion.fail_safe(rows).select(
        "msg_id", F.round("score", 6).alias("score"), "label", "action", "analysed",
        F.array_join(F.transform("reasons", lambda r: r.code), ",").alias("codes"))


# ---------------------------------------------------------------- end to end

_URL_PATTERN = "(?i)\\b(?:https?://|www\\.)[^\\s<>\"''()\\[\\]{}]+"
_EMAIL_LINKS = f"""elinks AS (SELECT DISTINCT msg_id, url FROM (SELECT id AS msg_id, unnest(list_transform(
    regexp_extract_all(body, '{_URL_PATTERN}', 0), lambda u: rtrim(u, '.,;:!?'))) AS url FROM evals)),
  xlinks AS (SELECT msg_id * 1000 + row_number() OVER (PARTITION BY msg_id) AS k, url FROM elinks)"""
def _emails(p: str) -> str:
    """Tables of mail verdicts, with the wording probability ``p``."""
    return f"""WITH {inputs.EVAL_SQL}, mail AS (SELECT id AS msg_id, from_display, from_address, reply_to, '' AS return_path,
    1 AS recipient_count, '<x>' AS message_id, '' AS auth_lower, '' AS received_spf,
    'mx.google.com; dkim=' || dmarc || '; spf=' || dmarc || '; dmarc=' || dmarc AS auth_top FROM evals),
  {o.header_ctes('mail')}, {_EMAIL_LINKS}, {o.url_ctes('xlinks', 'k')},
  lf AS (SELECT (k // 1000)::BIGINT AS msg_id, min(ord) AS ord, code FROM uf GROUP BY ALL),
  ldom AS (SELECT (k // 1000)::BIGINT AS msg_id, domain FROM ud),
  {o.trust_ctes('ldom')}, {o.fusion_ctes(p, 'mail')}"""


@register("email_verdicts", f"""{_emails(_P_SQL)} SELECT msg_id, round(score, 6) AS score, {o.label_of('round(score, 9)')} AS label,
  {o.action_of('round(score, 9)')} AS action, len(string_split(codes, ','))::INT AS reasons FROM fu""")
def email_verdicts(spark, sf_dir):
    """Raw messages to verdicts with a given wording probability."""
    rows = inputs.raw_mail(spark, sf_dir)
    scored = scoring.score_emails(rows, _probability())
    label, action = fusion.decide(F.round("score", 9))
    return scored.select("msg_id", F.round("score", 6).alias("score"), label.alias("label"),
                         action.alias("action"), F.size("reasons").alias("reasons"))


@register("email_verdicts_with_model")
def email_verdicts_with_model(spark, sf_dir):
    """The same with a term model; its probabilities have their own comparison."""
    scored = scoring.score_emails(inputs.raw_mail(spark, sf_dir), table_model(spark, sf_dir))
    return scored.select("msg_id", F.round("score", 6).alias("score"), "label", "action", "summary")


_TEXTS = f"""WITH {inputs.SMS_SQL}, x AS (SELECT DISTINCT msg_id, url FROM (SELECT msg_id, unnest(list_transform(
    regexp_extract_all(text, '{_URL_PATTERN}', 0), lambda u: rtrim(u, '.,;:!?'))) AS url FROM sms)),
  b AS (SELECT msg_id, unnest(CASE ending WHEN 2 THEN ['sbi-card-forms.in/start'] WHEN 8 THEN ['t.me/tide_tables', 'a.co/d/m4x'] ELSE [] END) AS url
    FROM (SELECT conv_id * 1000 + turn AS msg_id, (conv_id + turn * 5) % {len(inputs.SMS_ENDINGS)} AS ending FROM conversations)),
  xlinks AS (SELECT msg_id * 1000 + 2 * row_number() OVER (PARTITION BY msg_id) AS k, url FROM x
    UNION ALL SELECT msg_id * 1000 + 501 + 2 * row_number() OVER (PARTITION BY msg_id), 'http://' || url FROM b),
  {o.url_ctes('xlinks', 'k')},
  lcodes AS (SELECT DISTINCT (k // 1000)::BIGINT AS msg_id, code FROM uf WHERE NOT (code = 'url_http_only' AND k % 1000 >= 501 AND k % 2 = 1))"""


@register("text_verdicts", f"""{_TEXTS}, l AS (SELECT msg_id, sum(weight) AS t FROM lcodes JOIN {o.weights(fixed.LINK_WEIGHTS)} USING (code) GROUP BY msg_id),
  s AS (SELECT msg_id, {o.sigmoid(f"greatest(least({o.logit('p_email')}, 4.0), -4.0) + least(coalesce(t, 0), 1.0) * 4.0")} AS score FROM sms LEFT JOIN l USING (msg_id))
  SELECT msg_id, round(score, 6) AS score, {o.label_of('round(score, 9)')} AS label, {o.action_of('round(score, 9)')} AS action FROM s""")
def text_verdicts(spark, sf_dir):
    scored = scoring.score_texts(inputs.sms(spark, sf_dir), F.col("p_email"))
    label, action = fusion.decide(F.round("score", 9))
    return scored.select("msg_id", F.round("score", 6).alias("score"), label.alias("label"), action.alias("action"))


_SMS_EVIDENCE = f"""{_TEXTS},
  e AS (SELECT msg_id, p_sms, p_email, CASE WHEN contains(sender, '@') THEN 'email' WHEN regexp_matches(regexp_replace(sender, '[\\s().-]', '', 'g'), '^\\+?\\d{{8,15}}$') THEN 'phone' ELSE '' END AS kind,
    (SELECT (conv_id + turn * 5) % {len(inputs.SMS_ENDINGS)} FROM conversations c WHERE c.conv_id * 1000 + c.turn = sms.msg_id) AS ending FROM sms),
  sf AS (SELECT msg_id, 'sender' AS layer, 'sender_phone_claims_brand' AS code, 0.35::DOUBLE AS weight FROM e WHERE kind = 'phone' AND ending IN (1, 2, 3, 6, 9, 11)
    UNION ALL SELECT msg_id, 'sender', 'sender_email_address', 0.25 FROM e WHERE kind = 'email'
    UNION ALL SELECT msg_id, 'link', 'sms_brand_link_mismatch', 0.30 FROM e WHERE ending IN (1, 2, 6)
    UNION ALL SELECT msg_id, 'link', code, weight FROM lcodes JOIN {o.weights(fixed.LINK_WEIGHTS)} USING (code)),
  lay AS (SELECT msg_id, layer, least(sum(weight), 1.0) * 4.0 AS w FROM sf GROUP BY ALL),
  cr AS (SELECT msg_id, -1.0 AS w FROM e WHERE ending = 3
    UNION ALL SELECT msg_id, -1.0 FROM e WHERE ending IN (0, 9) AND kind <> 'email' AND NOT (kind = 'phone' AND ending = 9)),
  tot AS (SELECT msg_id, sum(w) AS w FROM (SELECT msg_id, w FROM lay UNION ALL SELECT msg_id, w FROM cr) GROUP BY msg_id),
  s AS (SELECT e.msg_id, {o.sigmoid(f"greatest(least(({o.logit('p_sms')} + {o.logit('p_email')}) / 2, 4.0), -4.0) + coalesce(w, 0)")} AS score FROM e LEFT JOIN tot USING (msg_id))"""


@register("sms_verdicts", f"""{_SMS_EVIDENCE} SELECT msg_id, round(score, 6) AS score, {o.label_of('round(score, 9)')} AS label,
  {o.action_of('round(score, 9)')} AS action FROM s""")
def sms_verdicts(spark, sf_dir):
    scored = scoring.score_sms(inputs.sms(spark, sf_dir), F.col("p_sms"), F.col("p_email"))
    label, action = fusion.decide(F.round("score", 9))
    return scored.select("msg_id", F.round("score", 6).alias("score"), label.alias("label"), action.alias("action"))


@register("sms_verdicts_with_models")
def sms_verdicts_with_models(spark, sf_dir):
    first, second = table_model(spark, sf_dir), table_model(spark, sf_dir, -0.5)
    scored = scoring.score_sms(inputs.sms(spark, sf_dir), first, second)
    return scored.select("msg_id", F.round("score", 6).alias("score"), "label", "action", "summary")


_ROUTED_P = "((msg_id * 17) % 89 + 5) / 100.0::DOUBLE"
_ROUTED_COLUMNS = f"msg_id, round(score, 6) AS score, {o.label_of('round(score, 9)')} AS label, {o.action_of('round(score, 9)')} AS action"
#: Each route as its own query gives it, on the rows that take it.
_ROUTED_SQL = f"""SELECT msg_id, 'raw_email' AS route, NULL::VARCHAR AS refusal, score, label, action
    FROM ({_emails(_ROUTED_P)} SELECT {_ROUTED_COLUMNS} FROM fu) WHERE msg_id % 7 IN (1, 3)
  UNION ALL SELECT msg_id, 'text', NULL, score, label, action FROM ({ORACLES["text_verdicts"]}) WHERE msg_id % 7 IN (2, 6)
  UNION ALL SELECT msg_id, 'sms', NULL, score, label, action FROM ({ORACLES["sms_verdicts"]}) WHERE msg_id % 7 = 0
  UNION ALL SELECT msg_id, 'refused', CASE WHEN msg_id % 7 = 4 THEN 'empty' ELSE 'sms_too_long' END, NULL, NULL, NULL
    FROM (SELECT conv_id * 1000 + turn AS msg_id FROM conversations) WHERE msg_id % 7 IN (4, 5)"""


@register("routed_verdicts", _ROUTED_SQL)
def routed_verdicts(spark, sf_dir):
    """Message files, pasted mails, plain texts, text messages and what is refused, in one table."""
    way, none = F.col("msg_id") % 7, F.lit(None)
    texts = inputs.sms(spark, sf_dir).where(~way.isin(1, 3)).select(
        "msg_id", F.when(way.isin(0, 5), "sms").when(way == 2, "email").alias("kind"),
        F.when(way == 4, " \u00a0\n").when(way == 5, F.rpad("text", fixed.MAX_SMS_CHARS + 1, ".")).otherwise(F.col("text")).alias("text"),
        "sender", none.cast("binary").alias("content"))
    mails = inputs.raw_mail(spark, sf_dir).where(way.isin(1, 3)).select(
        "msg_id", F.when(way == 3, "sms").otherwise("email").alias("kind"),
        F.when(way == 1, F.decode("content", "UTF-8")).alias("text"), none.cast("string").alias("sender"),
        F.when(way == 3, F.col("content")).alias("content"))
    p_email, p_sms = (F.col("msg_id") * 17) % 89 + 5, (F.col("msg_id") * 31) % 97 + 1
    scored = scoring.score_routed(texts.unionByName(mails), p_email / F.lit(100.0), p_sms / F.lit(100.0))
    label, action = fusion.decide(F.round("score", 9))
    known = F.col("score").isNotNull()
    return scored.select("msg_id", "route", "refusal", F.round("score", 6).alias("score"),
                         F.when(known, label).alias("label"), F.when(known, action).alias("action"))
