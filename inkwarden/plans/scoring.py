"""End-to-end scoring plans: raw mail, text messages and plain texts to verdict rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.core import clean_line
from ..functions.domains import DEFAULT, Dims
from ..functions.findings import risk
from ..functions.sms import sms_report
from ..functions.text import model_input, normalise, readable_tokens
from ..functions.urls import link_findings, text_link_reports
from ..operators import fusion
from ..operators.headers import with_header_findings
from ..operators.ingest import parse_messages, refusal, route_kind
from ..operators.links import with_link_findings
from ..operators.model import TextModel, blended_top, with_prediction

VERDICT = ["msg_id", "kind", "score", "label", "action", "analysed", "reasons", "components", "summary"]


def _with_probability(df: DataFrame, name: str, text: str, model: TextModel | float | Column,
                      k: int) -> DataFrame:
    """Adds ``<name>_p`` and ``<name>_top`` from a model, or from a given probability."""
    if isinstance(model, TextModel):
        return with_prediction(df, model, text, name, k)
    value = model if isinstance(model, Column) else F.lit(float(model))
    empty = F.array().cast("array<struct<contribution:double,term:string>>")
    return df.withColumn(f"{name}_p", value).withColumn(f"{name}_top", empty)


def _components(**extra: Column) -> Column:
    parts = {"text_probability": F.round("probability", 4), "text_logit": F.round("text_weight", 3),
             "header_risk": F.round("header_risk", 3), "link_risk": F.round("link_risk", 3),
             "trust_credit": F.round("trust_credit", 3), "total_logit": F.round("total_logit", 3),
             **extra}
    items: list[Column] = []
    for name, value in parts.items():
        items += [F.lit(name), value.cast("double")]
    return F.create_map(*items)


def score_parsed_emails(parsed: DataFrame, model: TextModel | float | Column,
                        trusted_id: str = "mx.google.com",
                        threshold: float = fixed.QUARANTINE_THRESHOLD,
                        dims: Dims = DEFAULT) -> DataFrame:
    """Verdicts of parsed messages.

    The rule layers and the text model are projections of the message row: no shuffle at all.
    """
    text = model_input(F.col("subject"), F.col("text_body"), F.col("html_text"))
    staged = parsed.withColumn("model_text", text)
    staged = _with_probability(staged, "email", "model_text", model, fixed.TOP_TERMS)
    tokens = readable_tokens(normalise(F.col("model_text"), "email"))
    ruled = with_link_findings(with_header_findings(staged, trusted_id, dims), dims)
    ruled = (ruled.withColumn("probability", F.col("email_p")).withColumn("tokens", tokens)
             .withColumn("wording", fusion.text_reason(
                 F.col("probability"), F.col("tokens"), F.transform("email_top", lambda t: t.term)))
             .withColumn("text_weight", F.col("wording.weight")))
    ruled = ruled.withColumn("reasons", F.concat(
        F.array("wording"), fusion.layer_reasons("header", F.col("header_findings")),
        fusion.layer_reasons("link", F.col("link_findings")), fusion.email_trust(dims)))
    scored = fusion.fail_safe(fusion.fuse(ruled, threshold))
    summary = F.to_json(F.struct(
        F.col("from_address").alias("from"), "from_display",
        clean_line(F.col("subject"), fixed.MAX_SUBJECT).alias("subject"),
        F.col("recipient_count").alias("recipients"), F.size("links").alias("links"),
        F.size("attachments").alias("attachments"),
        F.struct("spf", "dkim", "dmarc", F.col("auth_source").alias("source")).alias("auth"),
        "truncated"))
    done = scored.withColumn("kind", F.lit("email")).withColumn("components", F.when(
        F.col("analysed"), _components()))
    return done.withColumn("summary", F.when(F.col("analysed"), summary)).select(*VERDICT)


def score_emails(messages: DataFrame, model: TextModel | float | Column,
                 max_bytes: int = fixed.MAX_MESSAGE_BYTES, **options) -> DataFrame:
    """``msg_id, content`` to verdicts."""
    return score_parsed_emails(parse_messages(messages, max_bytes), model, **options)


def _cut_text(df: DataFrame) -> DataFrame:
    return (df.withColumn("full_length", F.length("text"))
            .withColumn("truncated", F.col("full_length") > fixed.MAX_SMS_CHARS)
            .withColumn("text", F.replace(F.left("text", F.lit(fixed.MAX_SMS_CHARS)),
                                          F.lit("\u0000"), F.lit(" "))))


def _text_summary(*extra: Column) -> Column:
    domains = F.slice(F.array_sort(F.array_distinct(F.filter(
        F.transform("url_reports", lambda r: r.domain), lambda d: d != ""))), 1, 10)
    return F.to_json(F.struct(F.length("text").alias("characters"),
                              F.size("url_reports").alias("links"), "truncated",
                              domains.alias("link_domains"), *extra))


def _ready(df: DataFrame) -> DataFrame:
    return (df.withColumn("status", F.lit("ok")).withColumn("analysed", F.lit(True))
            .withColumn("header_risk", F.lit(0.0)))


def score_texts(messages: DataFrame, model: TextModel | float | Column,
                threshold: float = fixed.QUARANTINE_THRESHOLD, dims: Dims = DEFAULT,
                kind: str = "text") -> DataFrame:
    """``msg_id, text`` to verdicts: the email model and the link rules."""
    staged = _with_probability(_cut_text(messages), "email", "text", model, fixed.TOP_TERMS)
    staged = _ready(staged).withColumn("url_reports", text_link_reports("text", dims))
    staged = (staged.withColumn("link_findings", link_findings(F.col("url_reports")))
              .withColumn("link_risk", risk(F.col("link_findings")))
              .withColumn("probability", F.col("email_p"))
              .withColumn("wording", fusion.text_reason(
                  F.col("probability"), readable_tokens(normalise(F.col("text"), "email")),
                  F.transform("email_top", lambda t: t.term)))
              .withColumn("text_weight", F.col("wording.weight"))
              .withColumn("reasons", F.concat(
                  F.array("wording"), fusion.layer_reasons("link", F.col("link_findings")))))
    scored = fusion.fuse(staged, threshold)
    return (scored.withColumn("kind", F.lit(kind)).withColumn("components", _components())
            .withColumn("summary", _text_summary()).select(*VERDICT))


def score_sms(messages: DataFrame, sms_model: TextModel | float | Column,
              email_model: TextModel | float | Column,
              threshold: float = fixed.QUARANTINE_THRESHOLD, dims: Dims = DEFAULT,
              variant: str = "S2") -> DataFrame:
    """``msg_id, text, sender`` to verdicts: two models, link rules and sender evidence.

    ``variant`` switches evidence off for experiments: S0 without sender and brand rules,
    S1 without the credits, S2 with everything.
    """
    wide = 3 * fixed.TOP_TERMS
    staged = _cut_text(messages)
    staged = _with_probability(staged, "sms", "text", sms_model, wide)
    staged = _with_probability(staged, "email", "text", email_model, wide)
    staged = _ready(staged).withColumn("url_reports", text_link_reports("text", dims))
    staged = (staged.withColumn("sms", sms_report(F.col("text"), F.col("sender"), F.col("url_reports"), dims))
              .withColumn("url_findings", link_findings(F.col("url_reports")))
              .withColumn("probability", fusion.blend(F.col("sms_p"), F.col("email_p")))
              .withColumn("blended", blended_top(F.col("sms_top"), F.col("email_top")))
              .withColumn("wording", fusion.text_reason(
                  F.col("probability"), readable_tokens(normalise(F.col("text"), "sms")),
                  F.transform("blended", lambda t: t.term)))
              .withColumn("text_weight", F.col("wording.weight")))
    is_sender = lambda f: F.startswith(f.code, F.lit("sender_"))
    rules = F.col("sms.findings") if variant != "S0" else F.filter("sms.findings", lambda f: F.lit(False))
    staged = (staged.withColumn("sender_findings", F.filter(rules, is_sender))
              .withColumn("link_findings", F.concat("url_findings", F.filter(rules, lambda f: ~is_sender(f))))
              .withColumn("link_risk", risk(F.col("link_findings")))
              .withColumn("sender_risk", risk(F.col("sender_findings"))))
    credits = fusion.sms_trust(F.col("sms")) if variant == "S2" else F.array().cast(fusion.REASONS_TYPE)
    staged = staged.withColumn("reasons", F.concat(
        F.array("wording"), fusion.layer_reasons("sender", F.col("sender_findings")), credits,
        fusion.layer_reasons("link", F.col("link_findings"))))
    scored = fusion.fuse(staged, threshold)
    components = _components(sender_risk=F.col("sender_risk"),
                             sms_model_probability=F.round("sms_p", 4),
                             email_model_probability=F.round("email_p", 4))
    summary = _text_summary(F.col("sender"), F.col("sms.sender_kind"), F.col("sms.brands"),
                            F.col("sms.contact_channels"))
    return (scored.withColumn("kind", F.lit("sms")).withColumn("components", components)
            .withColumn("summary", summary).select(*VERDICT))


def score_routed(messages: DataFrame, email_model: TextModel | float | Column, sms_model: TextModel | float | Column,
                 threshold: float = fixed.QUARANTINE_THRESHOLD, dims: Dims = DEFAULT, trusted_id: str = "mx.google.com",
                 max_bytes: int = fixed.MAX_MESSAGE_BYTES) -> DataFrame:
    """One table of mixed submissions to verdicts in one schema, with ``route`` and ``refusal``.

    ``messages``: ``msg_id, kind`` (email or sms; null: email), ``text, sender, content`` (the bytes of a message
    file, or null).  A file is scored as mail whatever its kind; of the rest, text messages go to their own models and
    rules, texts with a mail's header lines are scored as mail, others as plain text.  What cannot be scored (see
    ``refusal``) has the route ``refused`` and no verdict, so every row of the table comes back once.

    The routes are filtered projections, put side by side: a row is parsed by its own route only and nothing is
    shuffled; the table is scanned once a route.  Extra columns are dropped.
    """
    kind, text = F.coalesce("kind", F.lit("email")), F.coalesce("text", F.lit(""))
    filed = F.coalesce(F.length("content") > 0, F.lit(False))
    reason = F.when(~filed, refusal(kind, text))
    rows = messages.select("msg_id", text.alias("text"), F.coalesce("sender", F.lit("")).alias("sender"), "content",
                           reason.alias("refusal"), F.when(reason.isNotNull(), "refused").when(filed, "raw_email")
                           .otherwise(route_kind(kind, text)).alias("route"))
    of = lambda route: rows.where(F.col("route") == route)
    mail = of("raw_email").select("msg_id", F.when(F.length("content") > 0, F.col("content"))
                                  .otherwise(F.encode("text", "UTF-8")).alias("content"))
    scored = {
        "raw_email": score_emails(mail, email_model, max_bytes, trusted_id=trusted_id, threshold=threshold, dims=dims),
        "sms": score_sms(of("sms").select("msg_id", "text", "sender"), sms_model, email_model, threshold, dims),
        "text": score_texts(of("text").select("msg_id", "text"), email_model, threshold, dims, kind="email")}
    none = F.lit(None).cast("string")
    out = of("refused").select("msg_id", "route", "refusal")
    for route, verdicts in scored.items():
        out = out.unionByName(verdicts.withColumns({"route": F.lit(route), "refusal": none}), allowMissingColumns=True)
    return out.select(*VERDICT, "route", "refusal")
