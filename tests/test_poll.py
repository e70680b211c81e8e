"""The poll job on small mailboxes: cursors, abort and replay, released messages, the audit log over several polls."""

import pytest
from inkwarden.session import work_folder
from inkwarden.streaming import poll
from pyspark.sql import functions as F

LISTING = "mailbox bigint, uidvalidity bigint, uid bigint, message_id string, content_sha256 string, content string"


def listing(spark, uids, validity=1, mailbox=1):
    rows = [(mailbox, validity, u, f"<{u}@x>", f"h{u}", None if u == 4 else "bad" if u % 2 else "good") for u in uids]
    return spark.createDataFrame(rows, LISTING)


def score(batch):
    bad = F.col("content") == "bad"
    return batch.select("msg_id", F.when(bad, 0.95).otherwise(0.1).alias("score"),
                        F.when(bad, "quarantine").otherwise("deliver").alias("action"))


@pytest.fixture
def ledger(spark):
    return poll.Ledger(spark, work_folder(spark))


def taken(ledger, batch=None):
    rows = ledger.table("outcomes")
    if batch is not None:
        rows = rows.where(F.col("batch") == batch)
    return {r.uid: r.action_taken or r.event for r in rows.collect()}


def cursor(ledger, mailbox=1):
    row = ledger.snapshot("cursors", poll.CURSORS).where(F.col("mailbox") == mailbox).first()
    return row.uidvalidity, row.last_uid


def test_a_new_mailbox_starts_after_its_newest_message(spark, ledger):
    poll.poll_once(ledger, listing(spark, range(1, 6)), score, "2024-01-01 00:00:00")
    assert taken(ledger) == {} and cursor(ledger) == (1, 5)
    poll.poll_once(ledger, listing(spark, range(1, 9)), score, "2024-01-01 00:01:00")
    assert taken(ledger) == {6: "delivered", 7: "quarantined", 8: "delivered"} and cursor(ledger) == (1, 8)


def test_backfill_limit_and_vanished_messages(spark, ledger):
    for minute, expected in enumerate([{3: "quarantined", 4: "vanished"}, {5: "quarantined", 6: "delivered"}, {}]):
        batch = poll.poll_once(ledger, listing(spark, range(1, 7)), score, f"2024-01-01 00:0{minute}:00", backfill=4, limit=2)
        assert taken(ledger, batch) == expected
    assert [r.ok for r in poll.verify_polls(ledger).collect()] == [True]


def test_a_renumbered_folder_is_not_scanned_again(spark, ledger):
    poll.poll_once(ledger, listing(spark, range(1, 6)), score, "2024-01-01 00:00:00", backfill=2)
    poll.poll_once(ledger, listing(spark, range(1, 40), validity=2), score, "2024-01-01 00:01:00")
    assert taken(ledger, 1) == {} and cursor(ledger) == (2, 39)
    resets = ledger.table("audit").where("event = 'cursor_reset'").orderBy("batch").collect()
    assert [(r.start_after_uid, r.previous_uidvalidity, r.backfill) for r in resets] == [(3, None, 2), (39, 1, 0)]


def test_an_aborted_poll_leaves_nothing(spark, ledger):
    messages = listing(spark, range(1, 6))
    poll.stage_poll(ledger, messages, score, "2024-01-01 00:00:00", backfill=None, quarantine_mode=False)
    assert ledger.last() == -1 and ledger.table("outcomes").count() == 0 and poll.verify_polls(ledger).count() == 0

    def broken(batch):
        return score(batch).withColumn("score", F.raise_error(F.lit("model is gone")).cast("double"))

    with pytest.raises(Exception, match="model is gone"):
        poll.poll_once(ledger, messages, broken, "2024-01-01 00:01:00", backfill=None)
    assert poll.poll_once(ledger, messages, score, "2024-01-01 00:02:00", backfill=None) == 0
    assert taken(ledger) == {1: "quarantined", 2: "delivered", 3: "quarantined", 4: "vanished", 5: "quarantined"}
    assert {r.incident_id[:16] for r in ledger.table("incidents").collect()} == {"20240101T000200Z"}
    assert ledger.table("records").count() == 3
    with pytest.raises(ValueError, match="not the next one"):
        ledger.publish(0, "2024-01-01 00:02:00")


def test_released_and_unmovable_messages(spark, ledger):
    released = lambda: spark.createDataFrame([("h1",), ("h1",)], "content_sha256 string")
    poll.poll_once(ledger, listing(spark, [1, 3, 5]), score, "2024-01-01 00:00:00", backfill=None, released=released,
                   moved=lambda: F.col("uid") != 3)
    assert taken(ledger) == {1: "skipped_released", 3: "quarantine_failed", 5: "quarantined"}
    assert {r.source_uid for r in ledger.table("records").collect()} == {5}
    counts = poll.poll_counts(ledger).first()
    assert (counts.scanned, counts.quarantined, counts.flagged_for_review, counts.skipped) == (2, 1, 1, 1)


def test_the_log_goes_on_over_polls_and_shows_what_is_missing(spark, ledger):
    both = lambda top: listing(spark, range(1, top)).unionByName(listing(spark, range(1, top // 2), mailbox=2))
    for i, top in enumerate((12, 30, 31)):
        poll.poll_once(ledger, both(top), score, f"2024-01-01 00:0{i}:00", backfill=None, limit=None, rows_per_file=5)
    assert {r.mailbox: (r.ok, r.files) for r in poll.verify_polls(ledger).collect()} == {1: (True, 8), 2: (True, 4)}
    seals = ledger.table("seals").where("mailbox = 1").orderBy("seal_no").collect()
    assert [r.seal_no for r in seals] == list(range(1, 9))
    assert all(b.prev == a.hash for a, b in zip(seals, seals[1:], strict=False))
    audit, heads = ledger.table("audit").drop("batch"), ledger.snapshot("cursors", poll.CURSORS)
    heads = heads.select("mailbox", "seals", "head")
    gone = audit.where(~((F.col("mailbox") == 1) & (F.col("uid") == 20)))
    found = poll.ops.verify_audit_log(gone, ledger.table("seals").drop("batch"), heads, ["mailbox"], poll.AUDIT_FIELDS)
    assert {r.mailbox: r.ok for r in found.collect()} == {1: False, 2: True}


def test_an_empty_listing_is_a_poll_without_rows(spark, ledger):
    poll.poll_once(ledger, listing(spark, []), score, "2024-01-01 00:00:00")
    poll.poll_once(ledger, listing(spark, [1, 2, 3]), score, "2024-01-01 00:01:00", backfill=None)
    assert len(taken(ledger)) == 3 and [r.ok for r in poll.verify_polls(ledger).collect()] == [True]


def test_restores_are_compare_and_set(spark, ledger):
    poll.poll_once(ledger, listing(spark, [1, 3, 5]), score, "2024-01-01 00:00:00", backfill=None)
    ids = {r.source_uid: r.incident_id for r in ledger.table("records").collect()}

    def ask(*rows):
        schema = "request_id string, incident_id string, base_version int, event string, by string, at string"
        return spark.createDataFrame([(n, ids.get(u, "x"), v, e, "me", f"2024-01-01 01:00:{s:02d}") for n, u, v, e, s in rows], schema)

    poll.restore(ledger, ask(("late", 1, 1, "started", 5), ("early", 1, 1, "started", 4), ("tie2", 3, 1, "started", 4),
                             ("tie1", 3, 1, "started", 4), ("done", 3, 2, "restored", 6), ("over", 3, 3, "started", 7),
                             ("gap", 5, 2, "restored", 1), ("none", 9, 1, "started", 1)), "2024-01-01 01:01:00")
    first = {r.request_id: r.outcome for r in ledger.table("restores").collect()}
    assert first == {"late": "conflict", "early": "applied", "tie1": "applied", "tie2": "conflict", "done": "applied",
                     "over": "conflict", "gap": "conflict", "none": "unknown"}
    # A failure clears the mark; a batch that dies before it is published changes nothing.
    poll.stage_restores(ledger, ask(("dead", 1, 2, "restored", 8)), "2024-01-01 01:02:00")
    poll.restore(ledger, ask(("fail", 1, 2, "failed", 9)), "2024-01-01 01:03:00")
    now = {r.source_uid: (r.version, r.status, r.restored_by) for r in poll.current_records(ledger).collect()}
    assert now == {1: (3, "held", None), 3: (3, "restored", "me"), 5: (1, "held", None)}
    # The poll goes on from its cursor, and what was released is not quarantined again in a renumbered folder.
    poll.poll_once(ledger, listing(spark, [1, 3, 5], validity=2), score, "2024-01-01 02:00:00", backfill=None)
    assert taken(ledger, 3) == {1: "quarantined", 3: "skipped_released", 5: "quarantined"}
    events = [(r.event, r.by) for r in ledger.table("audit").where("by is not null").orderBy("batch").collect()]
    assert events == [("restored", "me"), ("restore_failed", "me")]
    assert [r.ok for r in poll.verify_polls(ledger).collect()] == [True]
