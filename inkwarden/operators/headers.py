"""Header rules on parsed messages: authentication, sender and recipient findings.

All rules are column expressions on the message row, so the layer is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.core import let, literals, one_of, reused
from ..functions.domains import (DEFAULT, Dims, claimed_brands, domain_of, lookalike_brand,
                                 official_brand, padded_words)
from ..functions.findings import codes_of, detail_if, first_wins, risk, total_weight

METHODS = ("spf", "dkim", "dmarc")


def server_id(value: Column) -> Column:
    """First token of an authentication header: the server that wrote it."""
    return F.lower(F.substring_index(F.trim(F.substring_index(value, ";", 1)), " ", 1))


def parse_auth_results(value: Column) -> Column:
    """``struct<server, spf, dkim, dmarc>``; comments are ignored, a method not named is NULL."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\([^()]*\)", " "), r"\([^()]*\)", " ")
    claims = F.regexp_extract_all(
        plain, F.lit(r"(?i)(?<![\w.-])(?:spf|dkim|dmarc)\s*=\s*[a-z]+"), F.lit(0))

    def summary(found: Column) -> Column:
        def of(method: str) -> Column:
            mine = F.transform(
                F.filter(found, lambda c: F.startswith(F.lower(c), F.lit(method))),
                lambda c: F.lower(F.regexp_extract(c, r"=\s*([A-Za-z]+)", 1)))
            return let(mine, lambda m: F.when(F.array_contains(m, "pass"), "pass")
                       .when(F.array_contains(m, "fail"), "fail").otherwise(F.get(m, F.lit(0))))
        return F.struct(server_id(value).alias("server"), *[of(m).alias(m) for m in METHODS])

    return let(claims, summary)


def with_authentication(parsed: DataFrame, trusted_id: str = "mx.google.com") -> DataFrame:
    """Columns ``spf, dkim, dmarc, auth_source, forged`` from the header lists."""
    trusted_id = trusted_id.lower()
    results = F.transform("authentication_results", parse_auth_results)
    spf_word = F.lower(F.substring_index(F.get("received_spf", F.lit(0)), " ", 1))
    spf_word = F.when(F.regexp_like(spf_word, F.lit(r"^\p{L}+$")), spf_word)

    def judged(rows: Column) -> Column:
        top = F.get(rows, F.lit(0))
        trusted = F.coalesce(top.server == trusted_id, F.lit(False))
        effective = {m: top[m] for m in METHODS}
        effective["spf"] = F.when(F.size(rows) > 0, F.coalesce(top.spf, spf_word))
        shown = {m: F.when((v == "pass") & ~trusted, "unverified").otherwise(F.coalesce(v, F.lit("none")))
                 for m, v in effective.items()}
        denied = lambda r, m: ((F.coalesce(r[m], F.lit("")) == "pass")
                               & (F.coalesce(effective[m], F.lit("")) != "pass"))
        forged = F.exists(F.slice(rows, F.lit(2), F.size(rows)), lambda r: (r.server == trusted_id) & (
            denied(r, "spf") | denied(r, "dkim") | denied(r, "dmarc")))
        source = F.when(F.size(rows) == 0, "missing").when(trusted, "trusted").otherwise("untrusted")
        return F.struct(*[v.alias(m) for m, v in shown.items()], source.alias("auth_source"),
                        forged.alias("forged"))

    return parsed.withColumn("auth", let(results, judged)).select(
        *parsed.columns, "auth.spf", "auth.dkim", "auth.dmarc", "auth.auth_source", "auth.forged")


def authentication_details(trusted_id: str = "mx.google.com") -> list[Column]:
    col = F.col
    return [
        detail_if("auth_unverified", col("auth_source") == "missing",
                  F.lit("No Authentication-Results header (origin unverifiable)")),
        detail_if("auth_unverified", col("auth_source") == "untrusted",
                  F.lit(f"Top Authentication-Results not from {trusted_id.lower()}")),
        detail_if("forged_auth_header", col("forged"), F.lit(
            f"A lower header falsely claims {trusted_id.lower()} passed this message")),
        detail_if("dmarc_fail", col("dmarc") == "fail", F.lit(
            "DMARC failed: the From domain did not authorise this sender")),
        detail_if("spf_fail", one_of(col("spf"), ["fail", "permerror"]), F.lit(
            "SPF failed: sending server not allowed for this domain")),
        detail_if("spf_softfail", col("spf") == "softfail", F.lit(
            "SPF soft-failed: sending server probably not authorised")),
        detail_if("dkim_fail", one_of(col("dkim"), ["fail", "permerror"]), F.lit(
            "DKIM signature invalid: message may have been altered")),
    ]


def with_sender_domains(parsed: DataFrame, dims: Dims = DEFAULT) -> DataFrame:
    """Domain columns the sender rules share."""
    return (parsed.withColumn("from_domain", domain_of("from_address", dims))
            .withColumn("return_domain", domain_of("return_path", dims))
            .withColumn("reply_domains", _reply_domains(dims)))


@reused
def _reply_domains(dims: Dims) -> Column:
    return F.filter(F.transform("reply_to", lambda r: domain_of(r, dims)), lambda d: d != "")


def sender_details(dims: Dims = DEFAULT) -> list[Column]:
    """Details of the sender rules; needs the columns of :func:`with_sender_domains`."""
    domain, display = F.col("from_domain"), F.col("from_display")
    present = domain != ""
    host = F.substring_index("from_address", "@", -1)
    free = one_of(domain, fixed.FREEMAIL_DOMAINS)

    imitated = lookalike_brand(domain, dims)
    claimed = F.get(F.filter(claimed_brands(display, dims), lambda b: (
        ~F.array_contains(b.domains, domain)) | free), F.lit(0)).brand
    other = F.get(F.filter(F.regexp_extract_all(display, F.lit(fixed.ADDRESS), F.lit(0)),
                           lambda a: domain_of(F.lower(a), dims) != domain), F.lit(0))
    role = let(padded_words(display), lambda w: F.exists(
        literals(f" {p} " for p in fixed.ROLE_PHRASES), lambda p: F.contains(w, p)))
    reply = F.get(F.filter("reply_domains", lambda d: d != domain), F.lit(0))
    returned = F.col("return_domain")

    def found(code: str, value: Column, detail) -> Column:
        return let(F.when(present, value), lambda v: detail_if(code, v.isNotNull(), detail(v)))

    return [
        detail_if("missing_from", ~present, F.lit("No valid From address")),
        detail_if("punycode_sender_domain", present & F.regexp_like(host, F.lit(r"(?:^|\.)xn--")),
                  F.concat(F.lit("Sender domain uses punycode: "), host)),
        found("lookalike_sender_domain", imitated, lambda v: F.concat(
            F.lit("Sender domain "), domain, F.lit(" imitates "), v,
            F.lit(" but is not an official domain"))),
        found("display_name_brand_spoof", claimed, lambda v: F.concat(
            F.lit("Display name claims '"), v, F.lit("' but the address is @"), domain)),
        found("display_name_other_email", other, lambda v: F.concat(
            F.lit("Display name shows a different address ("), v, F.lit(") than the real sender"))),
        detail_if("freemail_impersonation", present & free & role, F.concat(
            F.lit("Display name claims an official role but is sent from free mail (@"),
            domain, F.lit(")"))),
        found("reply_to_mismatch", reply, lambda v: F.concat(
            F.lit("Replies go to @"), v, F.lit(", not the sender's domain @"), domain)),
        found("reply_to_freemail", F.when(one_of(reply, fixed.FREEMAIL_DOMAINS) & ~free, reply),
              lambda v: F.concat(F.lit("Replies are redirected to free mail @"), v)),
        detail_if("return_path_mismatch",
                  present & (returned != "") & (returned != domain)
                  & official_brand(domain, dims).isNull(),
                  F.concat(F.lit("Bounce address @"), returned, F.lit(" differs from sender @"), domain)),
    ]


def recipient_details() -> list[Column]:
    count = F.col("recipient_count")
    return [
        detail_if("bulk_recipients", count >= fixed.BULK_RECIPIENTS, F.concat(
            F.lit("Sent to "), count.cast("string"), F.lit(" visible recipients"))),
        detail_if("undisclosed_recipients", count == 0, F.lit(
            "No visible recipients (hidden BCC mass mailing)")),
        detail_if("missing_message_id", F.col("message_id") == "", F.lit("Message-ID header missing")),
    ]


def with_header_findings(parsed: DataFrame, trusted_id: str = "mx.google.com",
                         dims: Dims = DEFAULT) -> DataFrame:
    """Adds authentication columns, ``from_domain``, ``header_findings`` and ``header_risk``."""
    staged = with_sender_domains(with_authentication(parsed, trusted_id), dims)
    return (staged.withColumn("header_findings", _header_findings(dims, trusted_id))
            .withColumn("header_risk", risk(F.col("header_findings"))))


@reused
def _header_findings(dims: Dims, trusted_id: str) -> Column:
    return first_wins(F.array_compact(F.array(
        *authentication_details(trusted_id), *sender_details(dims), *recipient_details())),
        fixed.HEADER_WEIGHTS)


def disqualified(findings: Column) -> Column:
    return F.arrays_overlap(codes_of(findings), literals(fixed.DISQUALIFYING_CODES))


__all__ = ["server_id", "parse_auth_results", "with_authentication", "with_header_findings",
           "authentication_details", "sender_details", "recipient_details",
           "with_sender_domains", "disqualified", "total_weight"]
