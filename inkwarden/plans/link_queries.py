"""Registered queries: URLs, domains, brands, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.core import exploded, one_of
from ..functions.domains import (brands_in_text, lookalike_brand, normalise_host, official_brand,
                                 registered_domain)
from ..functions.html import html_links, html_text
from ..functions.mail import merged_links
from ..functions.urls import (extract_bare_domains, host_class, is_cloud_content, link_findings,
                              split_url, text_link_reports, url_report)
from ..operators import fusion, links
from ..operators.features import first_wins_rows, layer_risk
from ..operators.ingest import extract_url_rows
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


_URLS = f"WITH {inputs.URLS_SQL}, {o.url_ctes('urls', 'page_id')}"


@register("url_parts", f"""{_URLS} SELECT page_id, scheme, host, port, path, query, has_userinfo,
  added AS scheme_added, malformed, kind AS host_class FROM uk""")
def url_parts(spark, sf_dir):
    parts = inputs.urls(spark, sf_dir).withColumn("p", split_url("url"))
    return parts.select("page_id", "p.scheme", "p.host", "p.port", "p.path", "p.query",
                        "p.has_userinfo", "p.scheme_added", "p.malformed",
                        host_class(F.col("p.host")).alias("host_class"))


@register("registered_domains", f"""WITH hosts AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) || (CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.co.uk'
    WHEN 2 THEN '.bank.in' ELSE '.test' END) AS host FROM pages)
  SELECT page_id, host, {o.registered('host')} AS domain FROM hosts""")
def registered_domains(spark, sf_dir):
    tail = F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 4 == 1, ".co.uk").when(
        F.col("page_id") % 4 == 2, ".bank.in").otherwise(".test")
    host = F.concat(F.regexp_extract("url", r"^https?://([^/]+)", 1), tail)
    return inputs.table(spark, sf_dir, "pages").select("page_id", host.alias("host")).withColumn(
        "domain", registered_domain(normalise_host(F.col("host"))))


def named_hosts(spark, sf_dir):
    """``page_id, host, path, domain`` of the URLs whose host is a name."""
    rows = inputs.urls(spark, sf_dir).withColumn("p", split_url("url"))
    host = F.when(host_class(F.col("p.host")) == "name", F.struct(
        F.col("p.host").alias("host"), F.col("p.path").alias("path"),
        registered_domain(F.col("p.host")).alias("domain")))
    return exploded(rows, ["page_id"], F.array_compact(F.array(host)))


@register("official_brands", f"""{_URLS} SELECT page_id, d.domain,
  (SELECT arg_min(b.brand, b.brand_rank) FROM {o.BRAND_DOMAINS} b WHERE b.domain = d.domain) AS brand
  FROM ud d WHERE kind = 'name'""")
def official_brands(spark, sf_dir):
    return named_hosts(spark, sf_dir).select("page_id", "domain").withColumn(
        "brand", official_brand(F.col("domain")))


@register("lookalike_brands", f"""{_URLS} SELECT page_id, ud.domain, ul.brand FROM ud
  LEFT JOIN ul USING (domain) WHERE kind = 'name'""")
def lookalike_brands(spark, sf_dir):
    return named_hosts(spark, sf_dir).select("page_id", "domain").withColumn(
        "brand", lookalike_brand(F.col("domain")))


@register("brands_in_texts", f"""WITH {inputs.SMS_SQL}, t AS (SELECT msg_id, {o.padded('text')} AS w FROM sms),
  hit AS (SELECT DISTINCT msg_id, brand, brand_rank FROM t JOIN {o.BRAND_PHRASES} p ON contains(t.w, p.phrase))
  SELECT msg_id, coalesce(string_agg(brand, ',' ORDER BY brand_rank), '') AS brands
  FROM t LEFT JOIN hit USING (msg_id) GROUP BY msg_id""")
def brands_in_texts(spark, sf_dir):
    return inputs.sms(spark, sf_dir).select(
        "msg_id", F.array_join(brands_in_text(F.col("text")), ",").alias("brands"))


def _flag(name, values, column="domain"):
    return f"list_contains({o.sql_list(values)}, {column}) AS {name}"


@register("list_memberships", f"""{_URLS} SELECT page_id, domain, {_flag('shortener', fixed.SHORTENERS)},
  {_flag('free_hosting', fixed.FREE_HOSTING)}, {_flag('mailing_provider', fixed.MAILING_PROVIDERS)},
  {_flag('freemail', fixed.FREEMAIL_DOMAINS)},
  {_flag('risky_tld', fixed.RISKY_TLDS, "string_split(host, '.')[-1]")} FROM ud WHERE kind = 'name'""")
def list_memberships(spark, sf_dir):
    rows = named_hosts(spark, sf_dir)
    d = F.col("domain")
    return rows.select(
        "page_id", "domain", one_of(d, fixed.SHORTENERS).alias("shortener"),
        one_of(d, fixed.FREE_HOSTING).alias("free_hosting"),
        one_of(d, fixed.MAILING_PROVIDERS).alias("mailing_provider"),
        one_of(d, fixed.FREEMAIL_DOMAINS).alias("freemail"),
        one_of(F.substring_index("host", ".", -1), fixed.RISKY_TLDS).alias("risky_tld"))


@register("cloud_content_hosts", f"{_URLS} SELECT page_id, host, cloud FROM ux WHERE kind = 'name'")
def cloud_content_hosts(spark, sf_dir):
    rows = named_hosts(spark, sf_dir)
    return rows.select("page_id", "host", is_cloud_content(F.col("host"), F.col("path")).alias("cloud"))


_DETAIL = (f"{o.code_words('uf.code')} || ': ' || CASE WHEN uf.host <> '' THEN uf.host "
           "ELSE left(uf.url, 80) END")


def _url_rows(spark, sf_dir):
    rows = inputs.urls(spark, sf_dir)
    return rows.withColumn("findings", link_findings(F.array(url_report("url"))))


@register("url_findings", f"""{_URLS} SELECT page_id, uf.code, weight, {_DETAIL} AS detail FROM uf
  JOIN {o.weights(fixed.LINK_WEIGHTS)} USING (code)""")
def url_findings(spark, sf_dir):
    return exploded(_url_rows(spark, sf_dir), ["page_id"], F.col("findings"))


_SCORE = f"""{_URLS}, g AS (SELECT page_id, sum(weight) AS total,
    array_to_string(list(uf.code ORDER BY -weight, ord), ',') AS codes
  FROM uf JOIN {o.weights(fixed.LINK_WEIGHTS)} USING (code) GROUP BY page_id),
  s AS (SELECT page_id, url, coalesce(total, 0) AS total, coalesce(codes, '') AS codes,
    {o.sigmoid('least(coalesce(total, 0), 1.0) * 4.0')} AS sc FROM urls LEFT JOIN g USING (page_id))"""


@register("url_scores", f"""{_SCORE} SELECT page_id, url, round(least(1.0, total), 3)::DOUBLE AS link_risk,
  round(sc, 6) AS score, {o.label_of('round(sc, 9)')} AS label, {o.action_of('round(sc, 9)')} AS action, codes FROM s""")
def url_scores(spark, sf_dir):
    """The first slice end to end: URL, findings, capped layer, score, action, ordered reasons."""
    rows = _url_rows(spark, sf_dir).withColumn(
        "reasons", fusion.layer_reasons("link", F.col("findings")))
    fused = fusion.fuse(rows.withColumn("text_weight", F.lit(0.0)))
    label, action = fusion.decide(F.round("score", 9))
    from ..functions.findings import risk
    return fused.select(
        "page_id", "url", risk(F.col("findings")).alias("link_risk"), F.round("score", 6).alias("score"),
        label.alias("label"), action.alias("action"),
        F.array_join(F.transform("reasons", lambda r: r.code), ",").alias("codes"))


@register("first_wins_findings", f"""{_URLS}, f AS (
  SELECT d.domain AS site, uf.code, weight, {_DETAIL} AS detail, page_id FROM uf JOIN ud d USING (page_id)
  JOIN {o.weights(fixed.LINK_WEIGHTS)} USING (code))
  SELECT site, code, any_value(weight) AS weight, arg_min(detail, page_id) AS detail FROM f GROUP BY ALL""")
def first_wins_findings(spark, sf_dir):
    """First detail per (site, code): sites are few, so the keys are hot on purpose."""
    return first_wins_rows(_site_findings(spark, sf_dir), "site").select("site", "code", "weight", "detail")


def _site_findings(spark, sf_dir):
    rows = inputs.urls(spark, sf_dir).withColumn("r", url_report("url"))
    rows = rows.withColumn("findings", link_findings(F.array("r")))
    keyed = rows.select("page_id", F.col("r.domain").alias("site"), "findings")
    return exploded(keyed, ["site", F.lit("link").alias("layer"), F.col("page_id").alias("pos")],
                    F.col("findings"))


@register("layer_risks", f"""{_URLS}, f AS (
  SELECT DISTINCT d.domain AS site, uf.code, weight FROM uf JOIN ud d USING (page_id)
  JOIN {o.weights(fixed.LINK_WEIGHTS)} USING (code))
  SELECT site, 'link' AS layer, round(least(1.0, sum(weight)), 3)::DOUBLE AS risk FROM f GROUP BY site""")
def layer_risks(spark, sf_dir):
    return layer_risk(first_wins_rows(_site_findings(spark, sf_dir), "site"), "site")


_LINK_TEXTS = ["https://www.paypal.com/security", "Sign in to PayPal", "www.example.com", "click here",
               "Part 3.4 open it.", "accounts.google.com", "Your SBI passbook"]


@register("link_text_findings", f"""{_URLS}, l AS (
  SELECT ud.*, {inputs.pick_sql(_LINK_TEXTS, 'page_id')} AS text FROM ud),
  m AS (SELECT *, lower(regexp_extract(text, '(?i)(?:https?://)?((?:[a-z0-9-]{{1,63}}\\.){{1,10}}[a-z]{{2,24}})(?:[^a-z0-9-]|$)', 1)) AS sh,
    {o.padded('text')} AS w FROM l WHERE domain <> '' AND scheme IN ('http', 'https') AND NOT malformed),
  n AS (SELECT *, CASE WHEN sh = '' THEN '' ELSE {o.registered('sh')} END AS shown FROM m),
  b AS (SELECT page_id, arg_min(p.brand, p.brand_rank) AS brand FROM n JOIN {o.BRAND_PHRASES} p ON contains(n.w, p.phrase)
    WHERE NOT EXISTS (SELECT 1 FROM {o.BRAND_DOMAINS} x WHERE x.brand = p.brand AND x.domain = n.domain) GROUP BY page_id)
  SELECT page_id, 'link_text_mismatch' AS code, 'Link text shows ' || shown || ' but actually goes to ' || domain AS detail
  FROM n WHERE shown <> '' AND shown <> domain
  UNION ALL SELECT page_id, 'link_text_brand_mismatch', 'Link text mentions ' || brand || ' but goes to ' || domain
  FROM n JOIN b USING (page_id) WHERE NOT (shown <> '' AND shown <> domain)""")
def link_text_findings(spark, sf_dir):
    rows = inputs.urls(spark, sf_dir).withColumn("r", url_report("url"))
    detail = F.when(F.col("r.domain") != "", links.link_text_detail(
        inputs.pick(_LINK_TEXTS, F.col("page_id")), F.col("r.domain"), F.lit("")))
    return exploded(rows, ["page_id"], F.array_compact(F.array(detail)))


_FILES = ["ledger.pdf.exe", "minutes.pdf.html", "poster.svg", "budget.docm", "led‮fdp.exe", "files.zip",
          "photo.jpg", "report.pdf", "", "a.tar.gz", "x.PDF.", "setup.MSI"]


def _ext_sql(values):
    return o.sql_list(values)


@register("attachment_findings", f"""WITH a AS (
  SELECT doc_id, {inputs.pick_sql(_FILES, 'doc_id')} AS filename,
    CASE WHEN doc_id % 2 = 0 THEN 'text/html' ELSE 'application/octet-stream' END AS content_type FROM documents),
  n AS (SELECT *, rtrim(trim(lower(filename)), '.') AS n0 FROM a),
  c AS (SELECT *, replace(n0, chr(8238), '') AS nm FROM n),
  e AS (SELECT *, CASE WHEN contains(nm, '.') THEN string_split(nm, '.')[-1] ELSE '' END AS ext,
    CASE WHEN len(string_split(nm, '.')) >= 3 THEN string_split(nm, '.')[-2] ELSE '' END AS inner_ext FROM c)
  SELECT doc_id, filename, 'att_rtlo_filename' AS code FROM e WHERE contains(n0, chr(8238))
  UNION ALL SELECT doc_id, filename, CASE WHEN list_contains({_ext_sql(fixed.EXECUTABLE_EXTENSIONS)}, ext) THEN 'att_executable'
    WHEN list_contains({_ext_sql(fixed.HTML_EXTENSIONS)}, ext) OR (ext = '' AND content_type = 'text/html') THEN 'att_html'
    WHEN list_contains({_ext_sql(fixed.MACRO_EXTENSIONS)}, ext) THEN 'att_macro' ELSE 'att_archive' END
  FROM e WHERE list_contains({_ext_sql(fixed.EXECUTABLE_EXTENSIONS + fixed.HTML_EXTENSIONS + fixed.MACRO_EXTENSIONS + fixed.ARCHIVE_EXTENSIONS)}, ext)
    OR (ext = '' AND content_type = 'text/html')
  UNION ALL SELECT doc_id, filename, 'att_double_extension' FROM e
  WHERE list_contains({_ext_sql(fixed.DOCUMENT_EXTENSIONS)}, inner_ext) AND NOT list_contains({_ext_sql(fixed.DOCUMENT_EXTENSIONS)}, ext)""")
def attachment_findings(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 2 == 0, "text/html").otherwise("application/octet-stream")
    rows = inputs.table(spark, sf_dir, "documents").select(
        "doc_id", inputs.pick(_FILES, F.col("doc_id")).alias("filename"), kind.alias("content_type"))
    return rows.select("doc_id", "filename", F.explode(
        links.attachment_codes(F.col("filename"), F.col("content_type"))).alias("code"))


_EXTRACT = (f"WITH {inputs.SMS_SQL}, x AS (SELECT msg_id, unnest(list_transform(regexp_extract_all(text, "
            "'(?i)\\b(?:https?://|www\\.)[^\\s<>\"''()\\[\\]{}]+', 0), lambda u: rtrim(u, '.,;:!?'))) AS url, "
            "generate_subscripts(regexp_extract_all(text, '(?i)\\b(?:https?://|www\\.)[^\\s<>\"''()\\[\\]{}]+', 0), 1) AS p FROM sms)")


@register("extracted_urls", f"{_EXTRACT} SELECT msg_id, (p - 1)::INT AS pos, url FROM x")
def extracted_urls(spark, sf_dir):
    return extract_url_rows(inputs.sms(spark, sf_dir), "msg_id", "text")


@register("bare_domains", f"""WITH {inputs.SMS_SQL}, w AS (SELECT msg_id, unnest(string_split_regex(text, '\\s+')) AS token,
    generate_subscripts(string_split_regex(text, '\\s+'), 1) AS p FROM sms),
  d AS (SELECT msg_id, p, lower(regexp_extract(token, '^((?:[A-Za-z0-9-]+\\.)+[A-Za-z]{{2,24}})', 1)) AS host,
    regexp_extract(token, '^(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{{2,24}}(/.*)$', 1) AS path FROM w
    WHERE regexp_matches(token, '^(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{{2,24}}(/.*)?[,.]?$') AND NOT starts_with(lower(token), 'www.')),
  k AS (SELECT * FROM d WHERE list_contains({o.sql_list([s for s in o.default_suffixes() if '.' not in s])}, string_split(host, '.')[-1])
    AND (length(string_split(host, '.')[-2]) >= 2 OR path <> ''))
  SELECT msg_id, string_agg(host || rtrim(path, '.,;:!?)'), ' ' ORDER BY p) AS domains FROM k GROUP BY msg_id""")
def bare_domains(spark, sf_dir):
    rows = inputs.sms(spark, sf_dir).select(
        "msg_id", F.array_join(extract_bare_domains(F.col("text")), " ").alias("domains"))
    return rows.where("domains <> ''")


@register("text_link_findings", f"""{_EXTRACT}, full_urls AS (
  SELECT msg_id * 1000 + p AS k, url FROM x), {o.url_ctes('full_urls', 'k')}
  SELECT (k // 1000)::BIGINT AS msg_id, uf.code, arg_min({_DETAIL}, k) AS detail FROM uf GROUP BY ALL""")
def text_link_findings(spark, sf_dir):
    """URLs of the texts only (bare domains have their own query and tests)."""
    from ..functions.urls import extract_urls, url_reports
    rows = inputs.sms(spark, sf_dir).withColumn("f", link_findings(url_reports(extract_urls(F.col("text")))))
    return exploded(rows, ["msg_id"], F.col("f")).select("msg_id", "code", "detail")


#: URLs first, then bare domains in their order; the first link with a code gives its detail.
_REPORTED = f"""{_EXTRACT}, y AS (SELECT msg_id, url FROM x WHERE url <> ''),
  b AS (SELECT conv_id * 1000 + turn AS msg_id, unnest(bare) AS url, unnest(range(len(bare))) AS place
    FROM (SELECT conv_id, turn, CASE (conv_id + turn * 5) % {len(inputs.SMS_ENDINGS)} WHEN 2 THEN ['sbi-card-forms.in/start']
      WHEN 8 THEN ['t.me/tide_tables', 'a.co/d/m4x'] ELSE [] END AS bare FROM conversations)),
  xlinks AS (SELECT msg_id * 1000 + 2 * row_number() OVER (PARTITION BY msg_id) AS k, url FROM y
    UNION ALL SELECT msg_id * 1000 + 501 + 2 * place, 'http://' || url FROM b),
  {o.url_ctes('xlinks', 'k')},
  found AS (SELECT k // 1000 AS msg_id, code, arg_min({_DETAIL}, k) AS detail FROM uf
    WHERE NOT (code = 'url_http_only' AND k % 1000 >= 501 AND k % 2 = 1) GROUP BY k // 1000, code),
  n AS (SELECT k // 1000 AS msg_id, count(*)::INT AS links FROM xlinks GROUP BY k // 1000)
  SELECT f.msg_id::BIGINT AS msg_id, links, code, weight, detail FROM found f JOIN n USING (msg_id)
  JOIN {o.weights(fixed.LINK_WEIGHTS)} USING (code)"""


@register("text_link_reports", _REPORTED)
def text_link_report_rows(spark, sf_dir):
    """URLs and bare domains together, with their findings."""
    rows = inputs.sms(spark, sf_dir).withColumn("r", text_link_reports("text"))
    return exploded(rows, ["msg_id", F.size("r").alias("links")], link_findings(F.col("r")))


@register("page_texts", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html,
    '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
  b AS (SELECT page_id, regexp_replace(h, '(?is)<head\b[^>]*>.*?</head\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<template\b[^>]*>.*?</template\s*>', '', 'g') AS h FROM a),
  c AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<(p|div|br|tr|li|h[1-6]|table)\b[^>]*>', chr(10), 'g'), '<[a-zA-Z/!?][^>]*>', '', 'g') AS h FROM b),
  d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS h FROM c),
  e AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(h, '[\n\r]'), lambda l: trim(l, ' ' || chr(9) || chr(160))), lambda l: l <> ''), chr(10)) AS t FROM d)
  SELECT page_id, md5(t) AS text_md5, length(t)::INT AS chars FROM e""")
def page_texts(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("chars"))


@register("page_links", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html,
    '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
  m AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<a\s[^>]*>.*?</a\s*>', 0)) AS tag,
    generate_subscripts(regexp_extract_all(h, '(?is)<a\s[^>]*>.*?</a\s*>', 0), 1) AS p FROM a)
  SELECT page_id, (p - 1)::INT AS pos, regexp_extract(tag, '(?i)href\s*=\s*"([^"]*)"', 1) AS href,
    trim(regexp_replace(replace(regexp_replace(regexp_extract(tag, '(?is)^<a[^>]*>(.*)</a', 1), '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\s{2,}', ' ', 'g')) AS text,
    'html' AS source FROM m WHERE p <= 300""")
def page_links(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "pages")
    return exploded(rows, ["page_id"], html_links(F.col("html")), "pos")


@register("merged_links", f"""WITH {inputs.SMS_SQL}, x AS (SELECT msg_id, unnest(list_transform(regexp_extract_all(text,
    '(?i)\\b(?:https?://|www\\.)[^\\s<>"''()\\[\\]{{}}]+', 0), lambda u: rtrim(u, '.,;:!?'))) AS url FROM sms),
  b AS (SELECT DISTINCT msg_id, url FROM x WHERE url <> 'https://bit.ly/4qLmVx2' AND NOT contains('see www.example.org/help here', url))
  SELECT msg_id, 'https://bit.ly/4qLmVx2' AS href, 'html' AS source FROM sms
  UNION ALL SELECT msg_id, 'https://example.org/', 'html' FROM sms UNION ALL SELECT msg_id, url, 'text' FROM b""")
def merged_link_rows(spark, sf_dir):
    """Two HTML links per message; body URLs join them unless known or shown as anchor text."""
    known = F.array(*[F.struct(F.lit(h).alias("href"), F.lit(t).alias("text"), F.lit("html").alias("source"))
                      for h, t in (("https://bit.ly/4qLmVx2", "offer"),
                                   ("https://example.org/", "see www.example.org/help here"))])
    rows = exploded(inputs.sms(spark, sf_dir), ["msg_id"], merged_links(known, F.col("text")))
    return rows.select("msg_id", "href", "source")


