"""Link and attachment rules on parsed messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.core import let, one_of, reused
from ..functions.domains import (DEFAULT, Dims, claimed_brands, decode_punycode, normalise_host,
                                 registered_domain)
from ..functions.findings import detail_if, first_wins, risk
from ..functions.urls import code_words, url_report

_SHOWN = r"(?i)(?:https?://)?((?:[a-z0-9-]{1,63}\.){1,10}[a-z]{2,24})(?![a-z0-9-])"
_RTLO = "‮"


def shown_domain(text: Column, dims: Dims = DEFAULT) -> Column:
    """Registered domain that a link's visible text claims to lead to, ``''`` if none."""
    return let(F.regexp_extract(text, _SHOWN, 1), lambda m: F.when(m == "", "").otherwise(
        registered_domain(normalise_host(decode_punycode(m)), dims)))


def link_text_detail(text: Column, domain: Column, sender_domain: Column,
                     dims: Dims = DEFAULT) -> Column:
    """Mismatch of shown and real target, else brand mismatch, as ``struct<code, detail>``."""
    relayed = one_of(domain, fixed.MAILING_PROVIDERS)

    def judged(shown: Column) -> Column:
        mismatch = (shown != "") & (shown != domain) & ~(relayed & (shown == sender_domain))
        foreign = F.get(F.filter(claimed_brands(text, dims), lambda b: (
            ~(relayed & F.array_contains(b.domains, sender_domain))
            & ~F.array_contains(b.domains, domain))), F.lit(0)).brand
        return F.when(mismatch, F.struct(
            F.lit("link_text_mismatch").alias("code"),
            F.concat(F.lit("Link text shows "), shown, F.lit(" but actually goes to "), domain)
            .alias("detail"))).otherwise(let(foreign, lambda b: detail_if(
                "link_text_brand_mismatch", b.isNotNull(),
                F.concat(F.lit("Link text mentions "), b, F.lit(" but goes to "), domain))))

    return let(shown_domain(text, dims), judged)


def attachment_codes(filename: Column, content_type: Column) -> Column:
    """Risk codes of one attachment, by its final extension."""
    name = F.rtrim(F.trim(F.lower(filename)), F.lit("."))

    def judged(n: Column) -> Column:
        clean = F.replace(n, F.lit(_RTLO), F.lit(""))
        dotted = F.contains(clean, F.lit("."))
        ext = F.when(dotted, F.substring_index(clean, ".", -1)).otherwise("")
        two_dots = F.length(clean) - F.length(F.replace(clean, F.lit("."), F.lit(""))) >= 2
        inner = F.when(two_dots, F.substring_index(F.substring_index(clean, ".", -2), ".", 1))
        kind = (F.when(one_of(ext, fixed.EXECUTABLE_EXTENSIONS), "att_executable")
                .when(one_of(ext, fixed.HTML_EXTENSIONS)
                      | ((ext == "") & content_type.isin("text/html", "image/svg+xml")), "att_html")
                .when(one_of(ext, fixed.MACRO_EXTENSIONS), "att_macro")
                .when(one_of(ext, fixed.ARCHIVE_EXTENSIONS), "att_archive"))
        double = (one_of(F.coalesce(inner, F.lit("")), fixed.DOCUMENT_EXTENSIONS)
                  & ~one_of(ext, fixed.DOCUMENT_EXTENSIONS))
        return F.array_compact(F.array(
            F.when(F.contains(n, F.lit(_RTLO)), "att_rtlo_filename"), kind,
            F.when(double, "att_double_extension")))

    return let(name, judged)


def with_link_findings(parsed: DataFrame, dims: Dims = DEFAULT) -> DataFrame:
    """Adds ``url_reports``, ``link_findings`` and ``link_risk``; needs ``from_domain``.

    The first 100 links are checked; they are bounded arrays of the message row, so the
    layer needs neither an explode nor a shuffle.
    """
    return (parsed.withColumn("url_reports", _checked_links(dims))
            .withColumn("link_findings", _link_findings(dims))
            .withColumn("link_risk", risk(F.col("link_findings"))))


@reused
def _checked_links(dims: Dims) -> Column:
    checked = F.slice("links", 1, fixed.MAX_URLS_CHECKED)
    return F.transform(checked, lambda k: let(url_report(k.href, dims), lambda r: F.struct(
        r.url.alias("url"), r.host.alias("host"), r.domain.alias("domain"), r.codes.alias("codes"),
        k.text.alias("text"), k.source.alias("source"))))


@reused
def _link_findings(dims: Dims) -> Column:
    def per_link(r: Column) -> Column:
        where = F.when(r.host != "", r.host).otherwise(F.left(r.url, F.lit(80)))
        own = F.transform(r.codes, lambda c: F.struct(
            c.alias("code"), F.concat(code_words(c), F.lit(": "), where).alias("detail")))
        shown = F.when((r.source == "html") & (r.domain != ""),
                       link_text_detail(r.text, r.domain, F.col("from_domain"), dims))
        form = detail_if("form_in_email", r.source == "form", F.concat(
            F.lit("Email contains a form that submits to "), where))
        return F.concat(own, F.array_compact(F.array(shown, form)))

    def per_attachment(a: Column) -> Column:
        named = F.when(a.filename != "", a.filename).otherwise(a.content_type)
        return F.transform(attachment_codes(a.filename, a.content_type), lambda c: F.struct(
            c.alias("code"), F.concat(F.lit("Risky attachment: "), named).alias("detail")))

    details = F.concat(F.flatten(F.transform("url_reports", per_link)),
                       F.flatten(F.transform("attachments", per_attachment)))
    return first_wins(details, fixed.LINK_WEIGHTS)
