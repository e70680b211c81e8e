"""Lexical URL rules as one expression per URL.  Nothing is fetched or resolved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .core import codes_array, let, literals, one_of, reused, strip, url_unquote
from .domains import (DEFAULT, Dims, claimed_brands, is_ip, is_ipv6, is_obfuscated_ip,
                      lookalike_brand, normalise_host, official_brand, registered_name)

BIDI = r"[\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff]"
#: ``fixed.BUCKET_HOST`` without a repetition that recurses over the labels of a long host.
_BUCKET_HOST = r"(?:^|\.)s3[.-](?:(?!amazonaws\.com$)[a-z0-9-]++\.)*+amazonaws\.com$"
_LEADING = "".join(map(chr, range(33)))


@reused
def split_url(url: Column) -> Column:
    """Parts of a URL: scheme, netloc, host, port, path, query and how it was written."""

    def parts(v: Column) -> Column:
        rest = F.regexp_replace(v.full, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
        scheme = F.lower(F.regexp_extract(v.full, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        netloc = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
        before_fragment = F.substring_index(F.regexp_replace(rest, r"^//[^/?#]*", ""), "#", 1)
        return F.struct(v.url.alias("url"), v.added.alias("scheme_added"), scheme.alias("scheme"),
                        netloc.alias("netloc"),
                        F.substring_index(before_fragment, "?", 1).alias("path"),
                        F.regexp_extract(before_fragment, r"(?s)^[^?]*\?(.*)$", 1).alias("query"))

    def host_and_port(p: Column) -> Column:
        location = F.substring_index(p.netloc, "@", -1)
        inside = F.regexp_extract(location, r"\[([^\]]*)", 1)
        has_open, has_close = F.contains(p.netloc, F.lit("[")), F.contains(p.netloc, F.lit("]"))
        bracketed = F.contains(location, F.lit("["))
        well_formed = (F.regexp_like(location, F.lit(r"^\[[^\]]*\](?::.*)?$"))
                       & (is_ipv6(inside) | F.regexp_like(inside, F.lit(r"^[vV][0-9a-fA-F]+\..+$"))))
        malformed = (has_open != has_close) | (has_open & has_close & ~well_formed)
        host = F.when(bracketed, inside).otherwise(F.substring_index(location, ":", 1))
        port = F.when(bracketed, F.regexp_extract(location, r"\]:(.*)$", 1)).otherwise(
            F.regexp_extract(location, r"^[^:]*:(.*)$", 1))
        return F.struct(
            p.url.alias("url"), p.scheme_added.alias("scheme_added"), p.scheme.alias("scheme"),
            p.netloc.alias("netloc"), F.contains(p.netloc, F.lit("@")).alias("has_userinfo"),
            F.when(malformed, "").otherwise(normalise_host(url_unquote(F.lower(host)))).alias("host"),
            port.alias("port"), p.path.alias("path"), p.query.alias("query"),
            malformed.alias("malformed"))

    def written(u: Column) -> Column:
        trimmed = strip(u)
        added = F.startswith(F.lower(trimmed), F.lit("www."))
        full = F.ltrim(trimmed, F.lit(_LEADING))
        for character in "\t\r\n":
            full = F.replace(full, F.lit(character), F.lit(""))
        return F.struct(u.alias("url"), added.alias("added"),
                        F.when(added, F.concat(F.lit("http://"), full)).otherwise(full).alias("full"))

    return let(let(let(url, written), parts), host_and_port)


def host_class(host: Column) -> Column:
    """``ip``, ``obfuscated_ip``, ``name`` or ``none`` for a normalised host."""
    return (F.when(host == "", "none").when(is_obfuscated_ip(host), "obfuscated_ip")
            .when(is_ip(host), "ip").otherwise("name"))


def nonstandard_port(port: Column) -> Column:
    """A port other than none, 80 or 443; unusable port text counts as well."""
    number = F.regexp_extract(port, r"^0*([0-9]{1,5})$", 1)
    return (port != "") & ~number.isin("80", "443")


def is_cloud_content(host: Column, path: Column) -> Column:
    """User-uploaded content on a big cloud."""
    owners = {".".join(c.split(".")[-2:]) for c in fixed.CLOUD_USER_CONTENT}
    owners |= {"amazonaws.com", "google.com"}
    listed = F.exists(literals(fixed.CLOUD_USER_CONTENT),
                      lambda c: (host == c) | F.endswith(host, F.concat(F.lit("."), c)))
    forms = (host == "docs.google.com") & F.startswith(path, F.lit("/forms"))
    return (one_of(F.substring_index(host, ".", -2), sorted(owners))
            & (F.regexp_like(host, F.lit(_BUCKET_HOST)) | listed | forms))


@reused
def url_report(url: Column, dims: Dims = DEFAULT) -> Column:
    """``struct<url, host, domain, codes>`` for one URL."""

    def result(p: Column, host: Column, domain: Column, codes: Column) -> Column:
        return F.struct(p.url.alias("url"), host.alias("host"), domain.alias("domain"),
                        codes.alias("codes"))

    def with_domain(p: Column) -> Column:
        kind = host_class(p.host)
        domain = F.when(kind == "name", registered_name(p.host, dims)).otherwise(p.host)
        return F.struct(p.alias("p"), kind.alias("kind"), domain.alias("domain"))

    def with_brand(d: Column) -> Column:
        cloud = is_cloud_content(d.p.host, d.p.path)
        return F.struct(d.p.alias("p"), d.kind.alias("kind"), d.domain.alias("domain"),
                        F.when(d.kind == "name", lookalike_brand(d.domain, dims)).alias("lookalike"),
                        ((d.kind == "name") & cloud).alias("cloud"))

    def codes(d: Column) -> Column:
        p, host, domain = d.p, d.p.host, d.domain
        named = d.kind == "name"
        international = ~F.regexp_like(host, F.lit(r"^[\u0000-\u007f]*$"))
        broken_label = international & F.regexp_like(host, F.lit(r"\.\.|^\.|[^.]{64}"))
        punycode = (F.regexp_like(host, F.lit(r"(?:^|\.)xn--")) | international) & ~broken_label
        subdomain = F.when(F.endswith(host, domain),
                           F.left(host, F.length(host) - F.length(domain))).otherwise(host)
        foreign = F.exists(
            claimed_brands(F.concat_ws(" ", subdomain, url_unquote(p.path)), dims),
            lambda b: ~F.array_contains(b.domains, domain))
        words = F.split(F.lower(url_unquote(F.concat_ws(" ", p.path, p.query))), r"[^a-z0-9-]+")
        owned = official_brand(domain, dims).isNotNull() & ~d.cloud
        dots = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
        return codes_array(
            ("url_obfuscated_host", F.regexp_like(p.url, F.lit(BIDI))),
            ("url_at_symbol", p.has_userinfo),
            ("url_obfuscated_host", F.regexp_like(p.netloc, F.lit(r"[\\%]"))),
            ("url_malformed", host == ""),
            ("url_obfuscated_ip", d.kind == "obfuscated_ip"),
            ("url_ip_host", d.kind == "ip"),
            ("url_malformed", named & broken_label),
            ("url_punycode", named & punycode),
            ("url_lookalike_domain", named & d.lookalike.isNotNull()),
            ("url_brand_outside_domain", named & d.lookalike.isNull() & foreign),
            ("url_shortener", named & one_of(domain, fixed.SHORTENERS)),
            ("url_free_hosting", named & one_of(domain, fixed.FREE_HOSTING)),
            ("url_cloud_user_content", d.cloud),
            ("url_risky_tld", named & one_of(F.substring_index(host, ".", -1), fixed.RISKY_TLDS)),
            ("url_many_subdomains", named & (dots(host) - dots(domain) >= 4)),
            ("url_http_only", (host != "") & (p.scheme == "http") & ~p.scheme_added),
            ("url_nonstandard_port", (host != "") & nonstandard_port(p.port)),
            ("url_credential_words", (host != "") & ~owned
             & F.arrays_overlap(words, literals(fixed.CREDENTIAL_WORDS))),
            ("url_long", (host != "") & (F.length(p.url) > 100)),
        )

    def judged(p: Column) -> Column:
        blank = F.lit("")
        no_codes = F.array().cast("array<string>")
        full = let(let(with_domain(p), with_brand),
                   lambda d: result(d.p, d.p.host, d.domain, F.array_distinct(codes(d))))
        return (F.when(p.malformed, result(p, blank, blank, F.array(F.lit("url_malformed"))))
                .when(one_of(p.scheme, fixed.DANGEROUS_SCHEMES),
                      result(p, blank, blank, F.array(F.lit("url_dangerous_scheme"))))
                .when(~p.scheme.isin("http", "https"), result(p, blank, blank, no_codes))
                .otherwise(full))

    return let(split_url(url), judged)


def url_reports(urls: Column, dims: Dims = DEFAULT) -> Column:
    return F.transform(urls, lambda u: url_report(u, dims))


def code_words(code: Column) -> Column:
    """``url_ip_host`` to ``Ip host``."""
    plain = F.lower(F.replace(F.regexp_replace(code, "^url_", ""), F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.left(plain, F.lit(1))), F.substr(plain, F.lit(2)))


def extract_urls(text: Column, limit: int = fixed.MAX_LINKS) -> Column:
    """URLs written in a text, in order, without trailing punctuation."""
    found = F.regexp_extract_all(text, F.lit(fixed.URL_IN_TEXT), F.lit(0))
    return F.transform(F.slice(found, 1, limit), lambda u: F.rtrim(u, F.lit(".,;:!?")))


@reused
def extract_bare_domains(text: Column, dims: Dims = DEFAULT,
                         limit: int = fixed.MAX_BARE_DOMAINS) -> Column:
    """Domains written without a scheme, distinct, in order, checked against the suffixes."""
    from .domains import suffix_labels

    scanned = F.left(text, F.lit(2 * fixed.MAX_SMS_CHARS))
    hits = F.regexp_extract_all(scanned, F.lit(fixed.BARE_DOMAIN), F.lit(0))

    def split_hit(hit: Column) -> Column:
        host = F.lower(F.regexp_extract(hit, r"^([^/]*)", 1))
        path = F.regexp_extract(hit, r"(/.*)$", 1)
        return F.struct(host.alias("host"), path.alias("path"),
                        F.split(host, r"\.").alias("labels"))

    def usable(h: Column) -> Column:
        def named(n: Column) -> Column:
            name = F.get(h.labels, F.size(h.labels) - n - 1)
            return ((n > 0) & (n < F.size(h.labels))
                    & ((F.length(name) >= 2) | (h.path != "")))
        return (~F.startswith(h.host, F.lit("www."))
                & F.coalesce(let(suffix_labels(h.labels, dims), named), F.lit(False)))

    kept = F.filter(F.transform(hits, split_hit), usable)
    written = F.transform(kept, lambda h: F.concat(h.host, F.rtrim(h.path, F.lit(".,;:!?)"))))
    return F.slice(F.array_distinct(written), 1, limit)


@reused
def text_link_reports(text: Column, dims: Dims = DEFAULT) -> Column:
    """Reports of the URLs and bare domains of a free text, in that order."""
    def target(written: Column, bare: bool) -> Column:
        url = F.concat(F.lit("http://"), written) if bare else written
        return F.struct(written.alias("written"), url.alias("url"), F.lit(bare).alias("bare"))

    targets = F.concat(F.transform(extract_urls(text), lambda u: target(u, False)),
                       F.transform(extract_bare_domains(text, dims), lambda d: target(d, True)))

    def judged(t: Column) -> Column:
        # No scheme was written with a bare domain, so it cannot be missing encryption.
        return let(url_report(t.url, dims), lambda r: F.struct(
            t.written.alias("url"), r.host.alias("host"), r.domain.alias("domain"),
            F.when(t.bare, F.array_remove(r.codes, "url_http_only")).otherwise(r.codes).alias("codes")))

    return F.transform(targets, judged)


def link_findings(reports: Column) -> Column:
    """First-wins ``array<struct<code, weight, detail>>`` over URL reports in order."""
    from .findings import first_wins

    def per_url(r: Column) -> Column:
        where = F.when(r.host != "", r.host).otherwise(F.left(r.url, F.lit(80)))
        return F.transform(r.codes, lambda c: F.struct(
            c.alias("code"), F.concat(code_words(c), F.lit(": "), where).alias("detail")))

    return first_wins(F.flatten(F.transform(reports, per_url)), fixed.LINK_WEIGHTS)
