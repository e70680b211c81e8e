"""Evidence fusion in log-odds: reasons, credits, score, label, action, fail-safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.core import let, literals, logit, one_of, reused, sigmoid
from ..functions.domains import DEFAULT, Dims, official_brand
from ..functions.findings import total_weight
from .headers import disqualified

REASONS_TYPE = "array<struct<source:string,code:string,detail:string,weight:double>>"


def reason(source: str, code: Column, detail: Column, weight: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), code.alias("code"), detail.alias("detail"),
                    weight.cast("double").alias("weight"))


def layer_reasons(source: str, findings: Column) -> Column:
    """Findings as log-odds; a layer contributes at most the rule scale in total."""
    scale = F.lit(fixed.RULE_SCALE) / F.greatest(total_weight(findings), F.lit(1.0))
    return let(scale, lambda k: F.transform(
        findings, lambda f: reason(source, f.code, f.detail, f.weight * k)))


def blend(p_first: Column, p_second: Column) -> Column:
    """Two probabilities averaged in log-odds."""
    return sigmoid((logit(p_first) + logit(p_second)) / 2)


def text_reason(probability: Column, tokens: Column, top_terms: Column) -> Column:
    """The wording's clipped log-odds with one of three explanations."""
    weight = F.least(F.greatest(logit(probability), F.lit(-fixed.TEXT_CLIP)), F.lit(fixed.TEXT_CLIP))
    quoted = F.array_join(F.transform(top_terms, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")
    percent = lambda p: F.concat(F.format_number(p * 100, 0), F.lit("%"))
    phishing = F.concat(
        F.lit("Wording resembles phishing ("), percent(probability), F.lit(")"),
        F.when(quoted != "", F.concat(F.lit("; strongest words: "), quoted)).otherwise(""))
    legitimate = F.concat(F.lit("Wording resembles legitimate messages ("),
                          percent(1 - probability), F.lit(" legitimate)"))
    detail = (F.when(tokens < fixed.MIN_READABLE_TOKENS,
                     "Too little readable text to judge the wording")
              .when(probability >= 0.5, phishing).otherwise(legitimate))
    return reason("text", F.lit("text_model"), detail, weight)


@reused
def email_trust(dims: Dims = DEFAULT) -> Column:
    """Credits of a verified official sender; needs the header and link columns."""
    domain = F.col("from_domain")
    brand = official_brand(domain, dims)
    verified = ((F.col("auth_source") == "trusted") & (F.col("dmarc") == "pass")
                & ~disqualified(F.col("header_findings")) & (domain != "")
                & ~one_of(domain, fixed.FREEMAIL_DOMAINS) & brand.isNotNull())
    link_domains = F.array_distinct(F.filter(
        F.transform("url_reports", lambda r: r.domain), lambda d: d != ""))
    owned = F.flatten(F.transform(F.filter(dims.brand_rows(), lambda b: b.brand == brand),
                                  lambda b: b.domains))
    allowed = F.concat(owned, literals(fixed.MAILING_PROVIDERS))
    aligned = (F.size("link_findings") == 0) & (F.size(F.array_except(link_domains, allowed)) == 0)
    sender_credit = reason("trust", F.lit("verified_sender"), F.concat(
        F.lit("Verified sender: "), domain,
        F.lit(" passed DMARC at your mail provider and is an official "), brand, F.lit(" domain")),
        F.lit(-fixed.VERIFIED_SENDER_CREDIT))
    links_credit = reason("trust", F.lit("aligned_links"), F.when(
        F.size(link_domains) > 0, F.concat(F.lit("All links stay on official "), brand, F.lit(" domains"))
        ).otherwise("No links to click"), F.lit(-fixed.ALIGNED_LINKS_CREDIT))
    return F.when(verified, F.array_compact(F.array(
        sender_credit, F.when(aligned, links_credit)))).otherwise(F.array().cast(REASONS_TYPE))


def sms_trust(sms: Column) -> Column:
    """Small credits for what a scam needs and a genuine alert often lacks."""
    aligned = reason("trust", F.lit("sms_aligned_links"), F.concat(
        F.lit("All links stay on official "), F.array_join(sms.brands, ", "), F.lit(" domains")),
        F.lit(-fixed.SMS_ALIGNED_LINKS_CREDIT))
    quiet = reason("trust", F.lit("sms_no_contact_channel"), F.lit(
        "Nothing to act on: no link, phone number, email address or reply request"),
        F.lit(-fixed.SMS_NO_CONTACT_CREDIT))
    return F.array_compact(F.array(
        F.when(sms.aligned_links, aligned),
        F.when((F.size(sms.contact_channels) == 0) & (F.size(sms.findings) == 0), quiet)))


def strength(weight: Column) -> Column:
    size = F.abs(weight)
    return F.when(size >= 2, "strong").when(size >= 1, "medium").otherwise("weak")


def ordered_reasons(reasons: Column) -> Column:
    """Descending absolute weight, stable in the given order, with a strength label."""
    keyed = F.transform(reasons, lambda r, i: F.struct(
        (-F.abs(r.weight)).alias("k"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(
        x.r.source.alias("source"), x.r.code.alias("code"), x.r.detail.alias("detail"),
        x.r.weight.alias("weight"), strength(x.r.weight).alias("strength")))


def decide(score: Column, threshold: float = fixed.QUARANTINE_THRESHOLD) -> tuple[Column, Column]:
    """Label and action of a score."""
    if not 0.5 <= threshold <= 1.0:
        raise ValueError("the quarantine threshold must lie between 0.5 and 1.0")
    label = (F.when(score >= threshold, "phishing")
             .when(score >= fixed.REVIEW_THRESHOLD, "suspicious").otherwise("legitimate"))
    action = (F.when(score >= threshold, "quarantine")
              .when(score >= fixed.REVIEW_THRESHOLD, "review").otherwise("deliver"))
    return label, action


def fuse(df: DataFrame, threshold: float = fixed.QUARANTINE_THRESHOLD) -> DataFrame:
    """Score from the ``reasons`` column; sets label, action and the component columns."""
    total = F.aggregate("reasons", F.lit(0.0), lambda acc, r: acc + r.weight)
    credit = F.aggregate(F.filter("reasons", lambda r: r.source == "trust"), F.lit(0.0),
                         lambda acc, r: acc - r.weight)
    scored = (df.withColumn("total_logit", total).withColumn("trust_credit", credit)
              .withColumn("score", sigmoid(F.col("total_logit"))))
    label, action = decide(F.col("score"), threshold)
    return (scored.withColumn("label", label).withColumn("action", action)
            .withColumn("reasons", ordered_reasons(F.col("reasons"))))


def fail_safe(df: DataFrame) -> DataFrame:
    """Override for messages that were not analysed, or only in part.

    Needs ``status`` (``ok`` or a guard code) and ``defects``.
    """
    details = F.when(F.col("status") == "limit_exceeded",
                     "Message exceeds a safety limit; needs manual review").when(
        F.col("status") == "unparseable",
        "Message could not be parsed as an email; needs manual review").otherwise(
        "Analysis failed; needs manual review")
    system = lambda code, detail: F.struct(
        F.lit("system").alias("source"), code.alias("code"), detail.alias("detail"),
        F.lit(0.0).alias("weight"), F.lit("weak").alias("strength"))
    analysed = F.col("status") == "ok"
    partial = F.array_intersect("defects", literals(fixed.PARTIAL_DEFECTS))
    held = analysed & (F.size(partial) > 0) & (F.col("action") == "deliver")
    note = system(F.lit("partial_analysis"), F.concat(
        F.lit("Part of the message was not analysed ("), F.array_join(partial, ", "),
        F.lit("); needs review")))
    return (df.withColumn("held", held).withColumn("analysed", analysed)
            .withColumn("reasons", F.when(~analysed, F.array(system(F.col("status"), details)))
                        .when(F.col("held"), F.concat("reasons", F.array(note)))
                        .otherwise(F.col("reasons")))
            .withColumn("score", F.when(F.col("analysed"), F.col("score")))
            .withColumn("label", F.when(~F.col("analysed"), "unknown")
                        .when(F.col("held"), "suspicious").otherwise(F.col("label")))
            .withColumn("action", F.when(~F.col("analysed") | F.col("held"), "review")
                        .otherwise(F.col("action"))).drop("held"))
