"""Building blocks of the comparison SQL (run by a second engine on the same tables)."""

from __future__ import annotations

from ..functions import fixed
from ..functions.domains import DEFAULT, default_suffixes


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def values(rows, columns: str) -> str:
    """Derived table of plain rows."""
    def cell(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return f"{v}::DOUBLE"
        return quote(v) if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({columns}))"


TWO_LABEL_SUFFIXES = sql_list([s for s in default_suffixes() if "." in s])
BRANDS = values([(b, i, len(b) >= fixed.MIN_FUZZY_LENGTH and b not in fixed.NO_FUZZY)
                 for i, b in enumerate(DEFAULT.brands)], "brand, brand_rank, fuzzy")
BRAND_DOMAINS = values([(b, i, d) for i, (b, ds) in enumerate(DEFAULT.brands.items()) for d in ds],
                       "brand, brand_rank, domain")
BRAND_PHRASES = values([(b, i, f" {p} ") for i, b in enumerate(DEFAULT.brands)
                        for p in DEFAULT.phrases_of(b)], "brand, brand_rank, phrase")


def registered(host: str) -> str:
    labels = f"string_split({host}, '.')"
    return (f"CASE WHEN regexp_matches({host}, '^[0-9.]+$|:') OR {host} = '' THEN {host} "
            f"WHEN len({labels}) > 2 AND list_contains({TWO_LABEL_SUFFIXES}, "
            f"array_to_string({labels}[-2:], '.')) THEN array_to_string({labels}[-3:], '.') "
            f"ELSE array_to_string({labels}[-2:], '.') END")


def domain_of(address: str) -> str:
    host = f"rtrim(lower(trim(string_split({address}, '@')[-1])), '.')"
    return f"CASE WHEN contains({address}, '@') THEN {registered(host)} ELSE '' END"


def skeleton(label: str) -> str:
    known = f"CASE WHEN {label} = 'xn--pypal-4ve' THEN 'pаypal' ELSE {label} END"
    return (f"replace(replace(translate(lower({known}), {quote(fixed.CONFUSABLE_FROM)}, "
            f"{quote(fixed.CONFUSABLE_TO)}), 'rn', 'm'), 'vv', 'w')")


def lookalike_cte(domains: str, name: str = "lookalikes") -> str:
    """CTE ``name(domain, brand)`` for the distinct ``domain`` values of ``domains``."""
    return f"""{name} AS (
  SELECT d.domain, arg_min(b.brand, b.brand_rank) AS brand
  FROM (SELECT DISTINCT domain, {skeleton("string_split(domain, '.')[1]")} AS shape FROM {domains}
        WHERE domain <> '' AND NOT regexp_matches(domain, '^[0-9.]+$|:|^0x')
          AND domain NOT IN (SELECT domain FROM {BRAND_DOMAINS})) d
  JOIN {BRANDS} b ON d.shape = b.brand
    OR list_contains(string_split_regex(d.shape, '[^a-z0-9]+'), b.brand)
    OR (b.fuzzy AND (contains(d.shape, b.brand) OR levenshtein(d.shape, b.brand) <= 1))
  GROUP BY d.domain)"""


def padded(text: str) -> str:
    return f"concat(' ', trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')), ' ')"


def code_words(code: str) -> str:
    plain = f"replace(replace({code}, 'url_', ''), '_', ' ')"
    return f"concat(upper(substr({plain}, 1, 1)), substr({plain}, 2))"


def weights(table: dict[str, float]) -> str:
    return values(list(table.items()), "code, weight")


def normalised(text: str, kind: str = "email") -> str:
    number = "' numtoken '" if kind == "email" else "' '"
    out = f"substr({text}, 1, {fixed.MODEL_INPUT_CHARS})"
    out = f"regexp_replace({out}, '(?i)(?:https?://|www\\.)[^\\s<>\"'']+', ' ', 'g')"
    out = (f"regexp_replace({out}, '[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_-]+"
           f"(?:\\.[\\p{{L}}\\p{{N}}_-]+)+', ' ', 'g')")
    out = f"regexp_replace({out}, '\\d+', {number}, 'g')"
    out = f"regexp_replace({out}, '\\s+', ' ', 'g')"
    return f"substr(lower(trim({out})), 1, {fixed.MODEL_TEXT_CHARS})"


def words(text: str) -> str:
    return (f"list_filter(string_split_regex({text}, '[^\\p{{L}}\\p{{N}}_]+'), "
            f"lambda w: regexp_matches(w, '^[a-z]{{2,}}$'))")


def terms_cte(source: str, key: str, text: str, stop_words, name: str = "tf") -> str:
    """CTEs ending in ``name(key, term, tf)``: words and bigrams without stop words."""
    return f"""{name}_w AS (
  SELECT {key}, list_filter({words(f"strip_accents(lower({text}))")},
    lambda w: NOT list_contains({sql_list(stop_words)}, w)) AS w FROM {source}),
{name}_t AS (
  SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {name}_w),
{name} AS (SELECT {key}, term, count(*) AS tf FROM {name}_t GROUP BY ALL)"""


def vocabulary_cte(tf: str, documents: str, name: str = "vocab") -> str:
    """CTE ``name(term, df, total, n, idf)``."""
    return f"""{name} AS (
  SELECT term, df, total, n, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (
    SELECT term, count(*) AS df, sum(tf)::BIGINT AS total,
           (SELECT count(*) FROM {documents}) AS n FROM {tf} GROUP BY term)
  WHERE df >= {fixed.MIN_DOCUMENT_FREQUENCY} AND df <= {fixed.MAX_DOCUMENT_SHARE} * n
  ORDER BY total DESC, term LIMIT {fixed.MAX_VOCABULARY})"""


def logit(p: str) -> str:
    c = f"least(greatest({p}, 1e-9), 1.0 - 1e-9)"
    return f"ln({c} / (1.0 - {c}))"


def sigmoid(x: str) -> str:
    return f"1.0 / (1.0 + exp(-({x})))"


def label_of(score: str) -> str:
    return (f"CASE WHEN {score} >= {fixed.QUARANTINE_THRESHOLD} THEN 'phishing' "
            f"WHEN {score} >= {fixed.REVIEW_THRESHOLD} THEN 'suspicious' ELSE 'legitimate' END")


def action_of(score: str) -> str:
    return (f"CASE WHEN {score} >= {fixed.QUARANTINE_THRESHOLD} THEN 'quarantine' "
            f"WHEN {score} >= {fixed.REVIEW_THRESHOLD} THEN 'review' ELSE 'deliver' END")


def url_ctes(source: str, key: str) -> str:
    """CTEs ``up`` (parts), ``ud`` (with domain), ``uf(key, ord, code, host, url)`` of URL rules."""
    def numeric(h):
        return (f"regexp_matches(lower({h}), '^(0x[0-9a-f]+|[0-9]+)(\\.(0x[0-9a-f]+|[0-9]+)){{0,3}}$')")
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    rules = []

    def rule(code, condition):
        rules.append((code, condition))

    named = "kind = 'name'"
    rule("url_obfuscated_host", "regexp_matches(url, '[\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}\\x{feff}]')")
    rule("url_at_symbol", "contains(netloc, '@')")
    rule("url_obfuscated_host", "regexp_matches(netloc, '[\\\\%]')")
    rule("url_obfuscated_ip", "kind = 'obfuscated_ip'")
    rule("url_ip_host", "kind = 'ip'")
    rule("url_punycode", f"{named} AND (regexp_matches(host, '(^|\\.)xn--') OR NOT regexp_matches(host, '^[\\x00-\\x7f]*$'))")
    rule("url_lookalike_domain", f"{named} AND lookalike IS NOT NULL")
    rule("url_brand_outside_domain", f"{named} AND lookalike IS NULL AND foreign_brand")
    rule("url_shortener", f"{named} AND list_contains({sql_list(fixed.SHORTENERS)}, domain)")
    rule("url_free_hosting", f"{named} AND list_contains({sql_list(fixed.FREE_HOSTING)}, domain)")
    rule("url_cloud_user_content", "cloud")
    rule("url_risky_tld", f"{named} AND list_contains({sql_list(fixed.RISKY_TLDS)}, string_split(host, '.')[-1])")
    rule("url_many_subdomains", f"{named} AND len(string_split(host, '.')) - len(string_split(domain, '.')) >= 4")
    rule("url_http_only", "scheme = 'http' AND NOT added")
    rule("url_nonstandard_port", "port <> '' AND port NOT IN ('80', '443')")
    rule("url_credential_words",
         f"len(list_intersect(string_split_regex(lower(path || ' ' || query), '[^a-z0-9-]+'), "
         f"{sql_list(fixed.CREDENTIAL_WORDS)})) > 0 AND (cloud OR NOT owned)")
    rule("url_long", "length(url) > 100")
    branches = " UNION ALL ".join(
        f"SELECT {key}, {i} AS ord, '{code}' AS code, host, url FROM uj WHERE usable AND ({cond})"
        for i, (code, cond) in enumerate(rules))
    cloud = " OR ".join(f"host = {quote(c)} OR ends_with(host, {quote('.' + c)})"
                        for c in fixed.CLOUD_USER_CONTENT)
    return f"""u0 AS (
  SELECT {key}, url, starts_with(lower(trim(url)), 'www.') AS added,
    CASE WHEN starts_with(lower(trim(url)), 'www.') THEN 'http://' || trim(url) ELSE trim(url) END AS f
  FROM {source}),
u1 AS (
  SELECT {key}, url, added, lower(regexp_extract(f, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
    regexp_extract(f, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS netloc,
    string_split(regexp_replace(f, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?', ''), '#')[1] AS tail FROM u0),
u2 AS (
  SELECT *, string_split(netloc, '@')[-1] AS loc, string_split(tail, '?')[1] AS path,
    regexp_extract(tail, '^[^?]*\\?(.*)$', 1) AS query,
    contains(netloc, '[') <> contains(netloc, ']') AS malformed FROM u1),
up AS (
  SELECT {key}, url, added, scheme, netloc, path, query, malformed, contains(netloc, '@') AS has_userinfo,
    CASE WHEN malformed THEN '' WHEN contains(loc, '[') THEN lower(regexp_extract(loc, '\\[([^\\]]*)\\]', 1))
         ELSE rtrim(lower(string_split(loc, ':')[1]), '.') END AS host,
    CASE WHEN contains(loc, '[') THEN regexp_extract(loc, '\\]:(.*)$', 1)
         ELSE regexp_extract(loc, '^[^:]*:(.*)$', 1) END AS port FROM u2),
uk AS (
  SELECT *, CASE WHEN host = '' THEN 'none'
      WHEN {numeric('host')} AND (NOT regexp_matches(host, '^({octet}\\.){{3}}{octet}$')
        OR regexp_matches(lower(host), '(^|\\.)(0x|0[0-9a-f])')) THEN 'obfuscated_ip'
      WHEN regexp_matches(host, '^({octet}\\.){{3}}{octet}$') OR contains(host, ':') THEN 'ip'
      ELSE 'name' END AS kind FROM up),
ud AS (SELECT *, CASE WHEN kind = 'name' THEN {registered('host')} ELSE host END AS domain FROM uk),
{lookalike_cte('ud', 'ul')},
ux AS (
  SELECT ud.*, ul.brand AS lookalike,
    kind = 'name' AND ({cloud} OR regexp_matches(host, {quote(fixed.BUCKET_HOST)})
      OR (host = 'docs.google.com' AND starts_with(path, '/forms'))) AS cloud,
    ud.domain IN (SELECT domain FROM {BRAND_DOMAINS}) AS owned,
    scheme IN ('http', 'https') AND NOT malformed AND host <> '' AS usable,
    {padded("CASE WHEN ends_with(host, ud.domain) THEN left(host, length(host) - length(ud.domain)) ELSE host END || ' ' || path")} AS spoken
  FROM ud LEFT JOIN ul USING (domain)),
ub AS (
  SELECT DISTINCT x.{key} FROM ux x JOIN {BRAND_PHRASES} p ON contains(x.spoken, p.phrase)
  WHERE NOT EXISTS (SELECT 1 FROM {BRAND_DOMAINS} o WHERE o.brand = p.brand AND o.domain = x.domain)),
uj AS (SELECT ux.*, ub.{key} IS NOT NULL AS foreign_brand FROM ux LEFT JOIN ub USING ({key})),
uf AS (
  SELECT {key}, min(ord) AS ord, code, any_value(host) AS host, any_value(url) AS url FROM (
    {branches}
    UNION ALL SELECT {key}, 0, 'url_malformed', '', url FROM uj WHERE malformed OR (scheme IN ('http', 'https') AND host = '')
    UNION ALL SELECT {key}, 0, 'url_dangerous_scheme', '', url FROM uj
      WHERE NOT malformed AND scheme IN ('javascript', 'data', 'vbscript', 'file'))
  GROUP BY {key}, code)"""


def _claims(value: str, method: str) -> str:
    plain = f"regexp_replace(regexp_replace({value}, '\\([^()]*\\)', ' ', 'g'), '\\([^()]*\\)', ' ', 'g')"
    found = f"regexp_extract_all(lower({plain}), '(?:^|[^a-z0-9_.-]){method}\\s*=\\s*([a-z]+)', 1)"
    return (f"CASE WHEN list_contains({found}, 'pass') THEN 'pass' "
            f"WHEN list_contains({found}, 'fail') THEN 'fail' ELSE {found}[1] END")


def header_ctes(source: str, trusted: str = "mx.google.com") -> str:
    """CTEs ``ha`` (authentication, domains) and ``hf(msg_id, ord, code, detail)``.

    ``source`` has one reply address and two authentication headers (top and lower).
    """
    claims = ", ".join(f"{_claims('auth_top', m)} AS t_{m}, {_claims('auth_lower', m)} AS l_{m}"
                       for m in ("spf", "dkim", "dmarc"))
    free = f"list_contains({sql_list(fixed.FREEMAIL_DOMAINS)}, {{}})"
    shown = ", ".join(
        f"CASE WHEN e_{m} = 'pass' AND NOT trusted THEN 'unverified' ELSE coalesce(e_{m}, 'none') END AS {m}"
        for m in ("spf", "dkim", "dmarc"))
    forged = " OR ".join(f"(coalesce(l_{m}, '') = 'pass' AND coalesce(e_{m}, '') <> 'pass')"
                         for m in ("spf", "dkim", "dmarc"))
    roles = " OR ".join(f"contains(display_words, {quote(f' {p} ')})" for p in fixed.ROLE_PHRASES)
    present = "from_domain <> ''"
    rules = [
        ("auth_unverified", "auth_source = 'missing'", "'No Authentication-Results header (origin unverifiable)'"),
        ("auth_unverified", "auth_source = 'untrusted'", f"'Top Authentication-Results not from {trusted}'"),
        ("forged_auth_header", "forged", f"'A lower header falsely claims {trusted} passed this message'"),
        ("dmarc_fail", "dmarc = 'fail'", "'DMARC failed: the From domain did not authorise this sender'"),
        ("spf_fail", "spf IN ('fail', 'permerror')", "'SPF failed: sending server not allowed for this domain'"),
        ("spf_softfail", "spf = 'softfail'", "'SPF soft-failed: sending server probably not authorised'"),
        ("dkim_fail", "dkim IN ('fail', 'permerror')", "'DKIM signature invalid: message may have been altered'"),
        ("missing_from", "from_domain = ''", "'No valid From address'"),
        ("punycode_sender_domain", f"{present} AND regexp_matches(from_host, '(^|\\.)xn--')",
         "'Sender domain uses punycode: ' || from_host"),
        ("lookalike_sender_domain", "lookalike IS NOT NULL",
         "'Sender domain ' || from_domain || ' imitates ' || lookalike || ' but is not an official domain'"),
        ("display_name_brand_spoof", f"{present} AND spoofed IS NOT NULL",
         "'Display name claims ''' || spoofed || ''' but the address is @' || from_domain"),
        ("display_name_other_email", f"{present} AND other <> '' AND {domain_of('other')} <> from_domain",
         "'Display name shows a different address (' || other || ') than the real sender'"),
        ("freemail_impersonation", f"{present} AND {free.format('from_domain')} AND ({roles})",
         "'Display name claims an official role but is sent from free mail (@' || from_domain || ')'"),
        ("reply_to_mismatch", f"{present} AND reply_domain <> '' AND reply_domain <> from_domain",
         "'Replies go to @' || reply_domain || ', not the sender''s domain @' || from_domain"),
        ("reply_to_freemail", f"{present} AND reply_domain <> '' AND reply_domain <> from_domain AND "
         f"{free.format('reply_domain')} AND NOT {free.format('from_domain')}",
         "'Replies are redirected to free mail @' || reply_domain"),
        ("return_path_mismatch", f"{present} AND return_domain <> '' AND return_domain <> from_domain AND NOT official",
         "'Bounce address @' || return_domain || ' differs from sender @' || from_domain"),
        ("bulk_recipients", f"recipient_count >= {fixed.BULK_RECIPIENTS}",
         "'Sent to ' || recipient_count || ' visible recipients'"),
        ("undisclosed_recipients", "recipient_count = 0", "'No visible recipients (hidden BCC mass mailing)'"),
        ("missing_message_id", "message_id = ''", "'Message-ID header missing'"),
    ]
    union = " UNION ALL ".join(
        f"SELECT msg_id, {i} AS ord, '{code}' AS code, {detail} AS detail FROM ha WHERE {cond}"
        for i, (code, cond, detail) in enumerate(rules))
    server = "lower(string_split(trim(string_split({}, ';')[1]), ' ')[1])"
    return f"""h1 AS (
  SELECT *, {claims}, {server.format('auth_top')} AS top_server, {server.format('auth_lower')} AS low_server,
    CASE WHEN received_spf <> '' THEN lower(string_split(received_spf, ' ')[1]) END AS spf_word,
    {domain_of('from_address')} AS from_domain, {domain_of('reply_to')} AS reply_domain,
    {domain_of('return_path')} AS return_domain, string_split(from_address, '@')[-1] AS from_host,
    {padded('from_display')} AS display_words,
    regexp_extract(from_display, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+(?:\\.[a-zA-Z0-9_-]+)+', 0) AS other FROM {source}),
h2 AS (
  SELECT *, auth_top <> '' AND top_server = '{trusted}' AS trusted, t_dkim AS e_dkim, t_dmarc AS e_dmarc,
    CASE WHEN auth_top <> '' THEN coalesce(t_spf, spf_word) END AS e_spf FROM h1),
{lookalike_cte('(SELECT from_domain AS domain FROM h1)', 'hl')},
hs AS (
  SELECT msg_id, arg_min(p.brand, p.brand_rank) AS spoofed FROM h1 JOIN {BRAND_PHRASES} p
    ON contains(h1.display_words, p.phrase)
  WHERE {free.format('h1.from_domain')} OR NOT EXISTS (SELECT 1 FROM {BRAND_DOMAINS} x
    WHERE x.brand = p.brand AND x.domain = h1.from_domain) GROUP BY msg_id),
ha AS (
  SELECT h2.*, {shown}, hl.brand AS lookalike, hs.spoofed,
    CASE WHEN auth_top = '' THEN 'missing' WHEN trusted THEN 'trusted' ELSE 'untrusted' END AS auth_source,
    auth_lower <> '' AND low_server = '{trusted}' AND ({forged}) AS forged,
    (SELECT arg_min(x.brand, x.brand_rank) FROM {BRAND_DOMAINS} x WHERE x.domain = h2.from_domain) AS official_brand,
    h2.from_domain IN (SELECT domain FROM {BRAND_DOMAINS}) AS official
  FROM h2 LEFT JOIN hl ON hl.domain = h2.from_domain LEFT JOIN hs USING (msg_id)),
hf AS ({union})"""


def trust_ctes(links: str = "ud") -> str:
    """CTE ``tr(msg_id, code, weight)``: credits of verified official senders.

    Needs ``ha``, ``hf``, ``lf(msg_id, code)`` and link domains in ``links(msg_id, domain)``.
    """
    bad = ", ".join(quote(c) for c in fixed.DISQUALIFYING_CODES)
    providers = sql_list(fixed.MAILING_PROVIDERS)
    return f"""tv AS (
  SELECT msg_id, official_brand AS brand FROM ha WHERE auth_source = 'trusted' AND dmarc = 'pass' AND official
    AND NOT list_contains({sql_list(fixed.FREEMAIL_DOMAINS)}, from_domain)
    AND msg_id NOT IN (SELECT msg_id FROM hf WHERE code IN ({bad}))),
tr AS (
  SELECT msg_id, 'verified_sender' AS code, -{fixed.VERIFIED_SENDER_CREDIT}::DOUBLE AS weight FROM tv
  UNION ALL SELECT msg_id, 'aligned_links', -{fixed.ALIGNED_LINKS_CREDIT}::DOUBLE FROM tv
  WHERE msg_id NOT IN (SELECT msg_id FROM lf) AND NOT EXISTS (
    SELECT 1 FROM {links} k WHERE k.msg_id = tv.msg_id AND k.domain <> '' AND NOT list_contains({providers}, k.domain)
      AND NOT EXISTS (SELECT 1 FROM {BRAND_DOMAINS} x WHERE x.brand = tv.brand AND x.domain = k.domain)))"""


def fusion_ctes(probability: str, base: str) -> str:
    """CTEs ``rs`` (all reasons) and ``fu(msg_id, …, score)`` from ``hf``, ``lf`` and ``tr``."""
    return f"""hw AS (SELECT msg_id, 'header' AS source, 1000 + ord AS ord, code, weight FROM hf
  JOIN {weights(fixed.HEADER_WEIGHTS)} USING (code)),
lw AS (SELECT msg_id, 'link' AS source, 2000 + ord AS ord, code, weight FROM lf
  JOIN {weights(fixed.LINK_WEIGHTS)} USING (code)),
lall AS (SELECT * FROM hw UNION ALL SELECT * FROM lw),
lsum AS (SELECT msg_id, source, {fixed.RULE_SCALE}::DOUBLE / greatest(
    list_reduce(list(weight ORDER BY ord), lambda a, b: a + b), 1.0::DOUBLE) AS k FROM lall GROUP BY ALL),
layer AS (SELECT msg_id, source, ord, code, weight * k AS weight FROM lall JOIN lsum USING (msg_id, source)),
tx AS (SELECT msg_id, {probability} AS p FROM {base}),
rs AS (
  SELECT msg_id, 'text' AS source, 0 AS ord, 'text_model' AS code,
    greatest(least({logit('p')}, {fixed.TEXT_CLIP}), -{fixed.TEXT_CLIP}) AS weight FROM tx
  UNION ALL SELECT * FROM layer
  UNION ALL SELECT msg_id, 'trust', CASE code WHEN 'verified_sender' THEN 3000 ELSE 3001 END, code, weight FROM tr),
fu AS (SELECT msg_id, sum(weight) AS total, {sigmoid('sum(weight)')} AS score,
    array_to_string(list(code ORDER BY -abs(weight), ord), ',') AS codes,
    -coalesce(sum(weight) FILTER (source = 'trust'), 0) AS credit,
    min(weight) FILTER (source = 'text') AS text_weight FROM rs GROUP BY msg_id)"""
