"""One table of mixed submissions against the three plans on their own."""

from pyspark.sql import functions as F

from inkwarden.plans import scoring

MAIL = "From: Bank <desk@paypal-desk.test>\r\nSubject: Verify now\r\nMessage-ID: <1@x.test>\r\n\r\nSign in at http://198.51.100.23/login today\r\n"
TEXT = "Please verify your account at http://198.51.100.23/login today"
SCHEMA = "msg_id bigint, kind string, text string, sender string, content binary, label int"
ROWS = [
    (1, "sms", TEXT, "54321", None, 0), (2, "email", TEXT, None, None, 0), (3, None, TEXT, "x", None, 0),
    (4, "email", MAIL, None, None, 0), (5, "sms", None, None, MAIL.encode(), 0), (6, "fax", None, None, MAIL.encode(), 0),
    (7, "sms", MAIL, None, None, 0), (8, "sms", TEXT, None, b"", 0), (2, "email", TEXT, None, None, 0),
    (20, "email", None, None, None, 0), (21, "sms", "   \n", "1", None, 0), (22, "fax", TEXT, None, None, 0),
    (23, "sms", "a" * 5001, None, None, 0), (24, "email", "a" * 200_001, None, None, 0), (None, "email", TEXT, None, None, 0)]


def _verdicts(rows):
    return sorted((r["msg_id"] is not None, r["msg_id"] or 0, r["kind"], r["score"], r["action"], str(r["reasons"]), r["summary"]) for r in rows)


def test_each_route_is_its_own_plan(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = scoring.score_routed(rows, 0.7, 0.4).collect()
    ways = sorted((r["msg_id"], r["route"]) for r in got if r["msg_id"] is not None and r["refusal"] is None)
    assert ways == [(1, "sms"), (2, "text"), (2, "text"), (3, "text"), (4, "raw_email"), (5, "raw_email"), (6, "raw_email"), (7, "sms"), (8, "sms")]
    refused = {r["msg_id"]: r["refusal"] for r in got if r["route"] == "refused"}
    assert refused == {20: "empty", 21: "empty", 22: "unknown_kind", 23: "sms_too_long", 24: "too_long"}
    assert all(r["score"] is None and r["action"] is None for r in got if r["route"] == "refused")
    mail = spark.createDataFrame([(i, MAIL.encode()) for i in (4, 5, 6)], "msg_id bigint, content binary")
    sms = spark.createDataFrame([(1, TEXT, "54321"), (7, MAIL, ""), (8, TEXT, "")], "msg_id bigint, text string, sender string")
    text = spark.createDataFrame([(2, TEXT), (2, TEXT), (3, TEXT), (None, TEXT)], "msg_id bigint, text string")
    for route, alone in (("raw_email", scoring.score_emails(mail, 0.7)), ("sms", scoring.score_sms(sms, 0.4, 0.7)),
                         ("text", scoring.score_texts(text, 0.7, kind="email"))):
        assert _verdicts(r for r in got if r["route"] == route) == _verdicts(alone.collect()), route


def test_no_rows_and_no_shuffle(spark):
    rows = spark.createDataFrame([], SCHEMA)
    routed = scoring.score_routed(rows, F.lit(0.5), F.lit(0.5))
    assert routed.count() == 0
    assert "Exchange" not in routed._jdf.queryExecution().executedPlan().toString()
