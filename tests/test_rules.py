"""Rule expressions on hand-written rows."""

import math

import pytest
from inkwarden.functions import domains, sms, text, urls
from inkwarden.operators import fusion, headers, links
from inkwarden.plans import scoring
from pyspark.sql import functions as F


def evaluate(spark, values, expression, schema="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


URL_CODES = {
    "https://example.com/about": [],
    "https://198.51.100.4/pay": ["url_ip_host"],
    "https://0x7f000001/x": ["url_obfuscated_ip"],
    "https://paypal.com@host.test/": ["url_at_symbol"],
    "https://g00gle.com/": ["url_lookalike_domain"],
    "https://tinyurl.com/abc": ["url_shortener"],
    "https://xn--bcher-kva.example/": ["url_punycode"],
    "https://example.com:8081/": ["url_nonstandard_port"],
    "http://example.org/": ["url_http_only"],
    "www.example.org": [],
    "ftp://example.org/": [],
    "data:text/html,hello": ["url_dangerous_scheme"],
    "https://[::1/": ["url_malformed"],
}


def test_url_codes(spark):
    found = evaluate(spark, list(URL_CODES), lambda v: urls.url_report(v).codes)
    assert dict(zip(URL_CODES, found, strict=True)) == URL_CODES


def test_long_url_counts_characters(spark):
    short, long = "https://example.com/" + "a" * 80, "https://example.com/" + "a" * 81
    assert evaluate(spark, [short, long], lambda v: urls.url_report(v).codes) == [[], ["url_long"]]


def test_registered_domains(spark):
    hosts = {"mail.example.co.uk": "example.co.uk", "a.b.example.com": "example.com",
             "branch.bank.in": "branch.bank.in", "192.0.2.1": "192.0.2.1", "x.y.unknownzone": "y.unknownzone"}
    found = evaluate(spark, list(hosts), domains.registered_domain)
    assert dict(zip(hosts, found, strict=True)) == hosts


def test_lookalikes(spark):
    cases = {"paypa1.com": "paypal", "paypal.com": None, "rnicrosoft.com": "microsoft",
             "example.com": None, "secure-netflix.com": "netflix"}
    found = evaluate(spark, list(cases), domains.lookalike_brand)
    assert dict(zip(cases, found, strict=True)) == cases


def test_sender_kinds(spark):
    cases = {"": "none", "a@b.example": "email", "+1 202 555 0143": "phone", "40404": "short_code",
             "AD-BANK": "alphanumeric"}
    found = evaluate(spark, list(cases), sms.sender_kind)
    assert dict(zip(cases, found, strict=True)) == cases


def test_urls_in_text_lose_closing_punctuation(spark):
    found = evaluate(spark, ["Go to https://a.example/x, or www.b.example!", "nothing"], urls.extract_urls)
    assert found == [["https://a.example/x", "www.b.example"], []]


def test_bare_domains_need_a_known_suffix(spark):
    found = evaluate(spark, ["see shop.example.com/x. and file.notasuffix now", "me@example.com"],
                     urls.extract_bare_domains)
    assert found == [["shop.example.com/x"], []]


def test_attachment_codes(spark):
    names = {"report.pdf": [], "setup.exe": ["att_executable"], "invoice.pdf.html": ["att_html", "att_double_extension"],
             "sheet.xlsm": ["att_macro"], "files.zip": ["att_archive"]}
    found = evaluate(spark, list(names), lambda v: links.attachment_codes(v, F.lit("application/octet-stream")))
    assert dict(zip(names, found, strict=True)) == names


def test_white_space_runs_become_one_blank(spark):
    values = ["a  b", "a\tb", "a   b", " a b\n", "a b", "\n\n a\r\n\r\nb \t"]
    assert evaluate(spark, values, lambda v: text.normalise(v, "email")) == ["a b"] * 6


def test_normalisers_differ_in_numbers(spark):
    value = ["Pay 42 to X@example.com at http://a.example/b now, card XX1234"]
    found = {kind: evaluate(spark, value, lambda v, k=kind: text.normalise(v, k))[0] for kind in text.NORMALISERS}
    assert found["email"] == "pay numtoken to at now, card xx numtoken"
    assert found["sms"] == "pay to at now, card xx"
    assert found["sms_masked"] == "pay to at now, card"


def test_blend_and_thresholds(spark):
    p = evaluate(spark, [0.9], lambda v: fusion.blend(v, F.lit(0.5)), "double")[0]
    odds = (math.log(0.9 / 0.1) + 0.0) / 2
    got = 1 / (1 + math.exp(-odds))
    assert p == pytest.approx(got)
    labels = evaluate(spark, [0.8, 0.79, 0.5, 0.49], lambda v: fusion.decide(v)[1], "double")
    assert labels == ["quarantine", "review", "review", "deliver"]


def _mail(*lines, body="Hello there"):
    return "\r\n".join([*lines, "", body]).encode()


@pytest.fixture(scope="module")
def verdicts(spark):
    clean = ["From: Example News <news@example.com>", "To: reader@example.org", "Subject: Weekly",
             "Message-ID: <1@example.com>"]
    rows = {
        "clean": _mail("Authentication-Results: mx.google.com; spf=pass; dkim=pass; dmarc=pass", *clean),
        "empty": b"   \r\n ",
        "forged": _mail("Authentication-Results: relay.test; dmarc=fail",
                        "Authentication-Results: mx.google.com; dmarc=pass", *clean),
        "lure": _mail("From: PayPal <help@mail-check.test>", "To: a@example.org", "Subject: Verify",
                      "Reply-To: x@gmail.com", "Message-ID: <2@x>",
                      body="Verify at http://paypa1.com/login or http://192.0.2.9/signin"),
        "parts": _mail(*clean, 'Content-Type: multipart/mixed; boundary="b"',
                       body="--b\r\nContent-Type: text/plain\r\n\r\nHi\r\n--b\r\nContent-Type: application/octet-stream\r\n"
                            "Content-Disposition: attachment; filename=\"run.exe\"\r\n\r\nMZ\r\n--b--\r\n"),
    }
    frame = spark.createDataFrame([(k, bytearray(v)) for k, v in rows.items()], "msg_id string, content binary")
    return {r.msg_id: r for r in scoring.score_emails(frame, 0.5).collect()}


def codes(row):
    return {r.code for r in row.reasons}


def test_unreadable_mail_is_reviewed(verdicts):
    row = verdicts["empty"]
    assert (row.score, row.label, row.action, row.analysed) == (None, "unknown", "review", False)


def test_clean_mail_keeps_the_wording_score(verdicts):
    assert verdicts["clean"].score == pytest.approx(0.5, abs=0.02)


def test_layers_are_capped(verdicts):
    row = verdicts["lure"]
    assert row.action == "quarantine"
    assert {"display_name_brand_spoof", "url_lookalike_domain", "url_ip_host"} <= codes(row)
    for layer in ("header", "link"):
        assert sum(r.weight for r in row.reasons if r.source == layer) <= 4 + 1e-9


def test_forged_header_and_attachment(verdicts):
    assert {"dmarc_fail"} <= codes(verdicts["forged"])
    assert "att_executable" in codes(verdicts["parts"])


def test_reasons_are_ordered_by_weight(verdicts):
    for row in verdicts.values():
        weights = [abs(r.weight) for r in row.reasons]
        assert weights == sorted(weights, reverse=True)


def test_comments_cannot_inject_results(spark):
    found = evaluate(spark, ["mx.test; spf=fail (dmarc=pass (really)) smtp.mailfrom=a"], headers.parse_auth_results)
    assert "pass" not in str(found)


def test_texts_beyond_ascii(spark):
    """White space, letters and digits have their Unicode meaning."""
    found = evaluate(spark, ["see https://shop.test\u00a0now, www.abc.test\u3000end", "caf\u00e9example.com", "so example.com."],
                     lambda v: F.struct(urls.extract_urls(v).alias("u"), urls.extract_bare_domains(v).alias("b"),
                                        text.normalise(v, "email").alias("n")))
    assert [r.u for r in found] == [["https://shop.test", "www.abc.test"], [], []]
    assert [r.b for r in found] == [[], [], ["example.com"]]
    assert found[0].n == "see now, end"
    digits = "\u0967\u0968\u0969\u096a"
    kinds = evaluate(spark, [digits, "1234", "+" + digits * 2], sms.sender_kind)
    assert kinds == ["short_code", "short_code", "phone"]
    channels = evaluate(spark, ["call " + digits * 3, "text YES to " + digits, "ref " + digits * 3, "call the officer on +1 23"],
                        lambda v: sms.contact_channels(v, F.lit(0)))
    assert channels == [["phone_number"], ["reply"], [], []]


def test_second_levels_of_all_countries(spark):
    hosts = {"a.garanti.com.tr": "garanti.com.tr", "x.co.il": "x.co.il", "b.x.com.ar": "x.com.ar", "x.com.pk": "x.com.pk",
             "www.x.co.id": "x.co.id", "a.b.de": "b.de", "a.b.co.uk": "b.co.uk", "a.b.solutions": "b.solutions"}
    assert evaluate(spark, list(hosts), domains.registered_domain) == list(hosts.values())


@pytest.mark.parametrize("anchors,written,cut", [(350, 0, True), (280, 50, True), (280, 20, False)])
def test_links_beyond_the_limit_are_flagged(spark, anchors, written, cut):
    from inkwarden.operators.ingest import parse_messages

    body = "".join(f'<a href="https://h{i}.test/">x</a>' for i in range(anchors)) + " " + " ".join(f"https://b{i}.test/" for i in range(written))
    mail = f"From: a@b.test\nContent-Type: text/html\n\n{body}".encode()
    row = parse_messages(spark.createDataFrame([(1, mail)], "msg_id int, content binary")).select("links", "truncated").first()
    assert (len(row.links), row.truncated) == (min(300, anchors + written), cut)
