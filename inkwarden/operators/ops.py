"""Quarantine, audit and mailbox operations as table jobs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions import fixed
from ..operators.fusion import strength

# ---------------------------------------------------------------- actions and counts


def action_taken(action: Column, quarantine_mode: bool | Column, moved: Column | None = None) -> Column:
    """What a batch did with a scanned message."""
    mode = quarantine_mode if isinstance(quarantine_mode, Column) else F.lit(quarantine_mode)
    failed = ~moved if moved is not None else F.lit(False)
    return (F.when((action == "quarantine") & mode & failed, "quarantine_failed")
            .when((action == "quarantine") & mode, "quarantined")
            .when(action == "quarantine", "would_quarantine")
            .when(action == "review", "flagged_for_review").otherwise("delivered"))


def batch_counts(actions: DataFrame, by: list[str] | None = None) -> DataFrame:
    taken = F.col("action_taken")
    return actions.groupBy(*(by or [])).agg(
        F.count_if(taken != "skipped").alias("scanned"),
        F.count_if(taken == "quarantined").alias("quarantined"),
        F.count_if(taken == "would_quarantine").alias("would_quarantine"),
        F.count_if(taken.isin("flagged_for_review", "quarantine_failed")).alias("flagged_for_review"),
        F.count_if(taken == "skipped").alias("skipped"))


def audit_tail(audit: DataFrame, limit: int = fixed.AUDIT_TAIL, order: str = "seq") -> DataFrame:
    """The last rows of the log (a top-k, not a sort of the log)."""
    return audit.orderBy(F.desc(order)).limit(limit)


def latest_versions(versions: DataFrame, key: str = "incident_id", version: str = "version") -> DataFrame:
    """Current record per key; the maximum is combined before the shuffle."""
    columns = [c for c in versions.columns if c != key]
    newest = F.max_by(F.struct(*columns), F.col(version))
    return versions.groupBy(key).agg(newest.alias("_r")).select(key, "_r.*")


def record_status() -> Column:
    return (F.when(F.col("restored_at").isNotNull(), "restored")
            .when(F.col("restore_started_at").isNotNull(), "restoring").otherwise("held"))


def kpis(audit: DataFrame, records: DataFrame, limit: int = fixed.AUDIT_TAIL) -> DataFrame:
    """One row: scanned (of the last audit rows), quarantined, restored, held.

    Held means *not restored*, a message being restored still counts.
    """
    scanned = audit_tail(audit, limit).agg(F.count_if(F.col("event") == "scanned")).scalar()
    counts = records.agg(F.count("*").alias("quarantined"),
                         F.count_if(F.col("restored_at").isNotNull()).alias("restored"),
                         F.count_if(F.col("restored_at").isNull()).alias("held"))
    return counts.select(scanned.alias("scanned"), "quarantined", "restored", "held")


def quarantine_rows(records: DataFrame, reports: DataFrame) -> DataFrame:
    """Records with the reasons of their report; without one the kind is email and there are none."""
    joined = records.join(reports.select("incident_id", F.col("kind").alias("_kind"), "reasons"),
                          "incident_id", "left")
    none = F.array().cast(joined.schema["reasons"].dataType)
    return joined.withColumns({"kind": F.coalesce("_kind", F.lit("email")), "status": record_status(),
                               "reasons": F.coalesce("reasons", none)}).drop("_kind")


def quarantine_listing(records: DataFrame, reports: DataFrame,
                       limit: int = fixed.MAX_LISTED) -> DataFrame:
    """Newest records first, at most ``limit``; the limit is taken before the join."""
    newest = records.orderBy(F.desc("incident_id")).limit(limit)
    return quarantine_rows(newest, reports).orderBy(F.desc("incident_id"))


# ---------------------------------------------------------------- dashboard columns


def percent(score: Column) -> Column:
    """A probability as a percentage that never claims certainty."""
    return (F.when(score.isNull(), "n/a").when(score >= 0.999, ">99.9%").when(score <= 0.001, "<0.1%")
            .otherwise(F.concat(F.format_number(score * 100, 1), F.lit("%"))))


def humanise_code(code: Column) -> Column:
    """``dmarc_fail`` to ``DMARC fail``."""
    # Acronyms, and the one abbreviation that is spelled out.
    acronyms = ["dmarc", "spf", "dkim", "url", "sms", "html", "ip", "tld", "otp", "id"]
    words = F.filter(F.split(code, "_"), lambda w: w != "")

    def shown(word: Column, i: Column) -> Column:
        full = F.when(word == "att", "attachment").otherwise(word)
        first = F.concat(F.upper(F.left(full, F.lit(1))), F.substr(full, F.lit(2)))
        return (F.when(full.isin(acronyms), F.upper(full)).when(i == 0, first).otherwise(full))

    return F.array_join(F.transform(words, shown), " ")


def signed_weight(weight: Column) -> Column:
    sign = F.when(weight > 0, "+").when(weight < 0, "−").otherwise("±")
    return F.concat(sign, F.format_number(F.abs(weight), 1))


def direction(weight: Column) -> Column:
    return F.when(weight > 0, "phishing").when(weight < 0, "safe").otherwise("neutral")


def relative_age(ts: Column, now: Column) -> Column:
    """Coarse age: just now, then seconds, minutes, hours, days, weeks, months, years ago."""
    # Unit, how many make the next unit.
    steps = [("second", 60.0), ("minute", 60.0), ("hour", 24.0), ("day", 7.0), ("week", 4.35),
             ("month", 12.0)]
    seconds = F.round(now.cast("timestamp").cast("double") - ts.cast("timestamp").cast("double"))
    value, out = seconds, F.when(seconds.isNull(), "Unknown time").when(seconds < 45, "just now")
    for unit, size in steps:
        number = F.round(value).cast("bigint")
        text = F.concat(number.cast("string"), F.lit(f" {unit}"), F.when(number == 1, "").otherwise("s"),
                        F.lit(" ago"))
        out = out.when(value < size, text)
        value = value / size
    number = F.round(value).cast("bigint")
    return out.otherwise(F.concat(number.cast("string"), F.lit(" year"),
                                  F.when(number == 1, "").otherwise("s"), F.lit(" ago")))


def dashboard(rows: DataFrame, status: str = "all", now: Column | None = None,
              shown: int = 3) -> DataFrame:
    """Display columns of quarantine rows: percentage, age, top signals and how many more."""
    chosen = {"all": F.lit(True), "restored": F.col("status") == "restored",
              "held": F.col("status") != "restored"}[status]
    chips = F.transform(F.slice("reasons", 1, shown), lambda r: F.concat_ws(
        " ", humanise_code(r.code), signed_weight(r.weight), direction(r.weight), strength(r.weight)))
    hidden = F.greatest(F.size("reasons") - shown, F.lit(0))
    moment = now if now is not None else F.current_timestamp()
    return rows.where(chosen).select(
        "incident_id", "kind", "status", percent(F.col("score")).alias("percent"),
        F.concat(F.date_format("quarantined_at", "yyyy-MM-dd HH:mm"), F.lit(" UTC")).alias("time"),
        relative_age(F.col("quarantined_at"), moment).alias("age"),
        F.array_join(chips, "; ").alias("signals"),
        F.when(hidden > 0, F.concat(F.lit("+"), hidden.cast("string"), F.lit(" more")))
        .otherwise("").alias("more"))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("status") != "restored").alias("held"),
                    F.count_if(F.col("status") == "restored").alias("restored"),
                    F.count("*").alias("all"))


# ---------------------------------------------------------------- release and restore


def released_hashes(records: DataFrame) -> DataFrame:
    """Content hashes a person released, or is releasing right now."""
    marked = F.col("restored_at").isNotNull() | F.col("restore_started_at").isNotNull()
    known = F.coalesce(F.col("content_sha256"), F.lit("")) != ""
    return records.where(marked & known).select("content_sha256").distinct()


def without_released(messages: DataFrame, released: DataFrame) -> DataFrame:
    return messages.join(released, "content_sha256", "left_anti")


def restore_transitions(events: DataFrame) -> DataFrame:
    """Each restore event with its outcome: ``applied``, or ``conflict`` after a restore.

    ``events``: ``incident_id, version, event`` (started, failed, restored).  The first
    restore per incident is a combined minimum, so a busy incident needs no window.
    """
    first = events.where(F.col("event") == "restored").groupBy("incident_id").agg(
        F.min("version").alias("restored_version"))
    joined = events.join(first, "incident_id", "left")
    late = F.col("version") > F.col("restored_version")
    return joined.withColumn("outcome", F.when(late, "conflict").otherwise("applied")).drop(
        "restored_version")


def restore_states(events: DataFrame) -> DataFrame:
    """State per incident after all applied events: restored, restoring or held."""
    applied = restore_transitions(events).where(F.col("outcome") == "applied")
    last = applied.groupBy("incident_id").agg(F.max_by("event", "version").alias("last"))
    return last.select("incident_id", F.when(F.col("last") == "restored", "restored")
                       .when(F.col("last") == "started", "restoring").otherwise("held").alias("state"))


def reconcile(records: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored message of each record: by (validity, uid) first, then by message id.

    A match counts only with an equal content hash, so that hash is part of both joins: a
    message id shared by many messages cannot multiply rows.
    """
    by_uid = records.join(stored.select(
        F.col("uidvalidity").alias("quarantine_uidvalidity"), F.col("uid").alias("quarantine_uid"),
        "content_sha256", F.col("uid").alias("found_uid")),
        ["quarantine_uidvalidity", "quarantine_uid", "content_sha256"]).select(
        "incident_id", F.lit(1).alias("priority"), "found_uid")
    firsts = stored.groupBy("message_id", "content_sha256").agg(F.min("uid").alias("found_uid"))
    by_id = records.where(F.col("message_id") != "").join(
        firsts, ["message_id", "content_sha256"]).select(
        "incident_id", F.lit(2).alias("priority"), "found_uid")
    return by_uid.unionByName(by_id).groupBy("incident_id").agg(
        F.min_by("found_uid", "priority").alias("found_uid"), F.min("priority").alias("priority"))


# ---------------------------------------------------------------- audit chain


def _ascii_json(json: Column) -> Column:
    """Non-ASCII characters as ``\\uXXXX``, as in the canonical entry."""
    def escaped(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        return F.when(F.regexp_like(c, F.lit(r"[^\u0000-\u007f]")),
                      F.regexp_replace(units, "(.{4})", r"\\\\u$1")).otherwise(c)
    plain = F.regexp_like(json, F.lit(r"^[\u0000-\u007f]*$"))
    return F.when(plain, json).otherwise(
        F.array_join(F.transform(F.split(json, ""), escaped), ""))


def canonical_halves(fields: list[str]) -> tuple[Column, Column]:
    """The canonical entry (sorted keys, compact JSON) around the value of ``prev``."""
    def part(names: list[str]) -> Column:
        text = F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false"})
        return _ascii_json(text.substr(F.lit(2), F.length(text) - 2))

    before = sorted(f for f in fields if f < "prev")
    after = sorted(f for f in fields if f > "prev")
    head = F.concat(F.lit("{"), part(before), F.lit(',"prev":"')) if before else F.lit('{"prev":"')
    tail = F.concat(F.lit('",'), part(after), F.lit("}")) if after else F.lit('"}')
    return head, tail


def link_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash chain over rows that arrive sorted by (chain, seq); keeps one hash and one count in memory."""
    chain, last, line = None, fixed.GENESIS, 0
    for frame in batches:
        prevs, hashes, lines = [], [], []
        for key, head, tail, start, before in zip(frame["_chain"], frame["_head"], frame["_tail"], frame["_start"],
                                                  frame["_before"], strict=True):
            if key != chain:
                chain, last, line = key, start, before
            prevs.append(last)
            last = hashlib.sha256(f"{head}{last}{tail}".encode()).hexdigest()
            line += 1
            hashes.append(last)
            lines.append(line)
        yield frame.assign(prev=prevs, hash=hashes, line_no=lines)


def _linked(entries: DataFrame, keys: list[str], order: str, fields: list[str],
            heads: DataFrame | None = None) -> DataFrame:
    """Adds ``prev, hash, line_no``: a hash chain per value of ``keys``.  Rows stream through each task in order
    with one hash of state.  ``heads`` (``keys, head, lines``) are the ends of chains that go on."""
    head, tail = canonical_halves(fields)
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    start, before, given = F.lit(fixed.GENESIS), F.lit(0), entries.columns
    if heads is not None:
        known = heads.select(*keys, F.col("head").alias("_known"), F.col("lines").alias("_lines"))
        entries = entries.join(known, keys, "left")
        start, before = F.coalesce("_known", start), F.coalesce("_lines", before)
    # What is made of a row's columns is made after the rows are placed, so it is in no shuffle.
    placed = entries.repartition(*keys).withColumns({"_chain": name, "_head": head, "_tail": tail, "_start": start, "_before": before.cast("int")})
    placed = placed.select(*given, "_chain", "_head", "_tail", "_start", "_before").sortWithinPartitions("_chain", order)
    added = [T.StructField("prev", T.StringType()), T.StructField("hash", T.StringType()),
             T.StructField("line_no", T.IntegerType())]
    schema = T.StructType([*placed.schema.fields, *added])
    return placed.mapInPandas(link_batches, schema).drop("_chain", "_head", "_tail", "_start", "_before")


def build_audit_chain(entries: DataFrame, chain: list[str], order: str,
                      fields: list[str], rows_per_file: int = 4096) -> DataFrame:
    """Adds ``file_no, line_no, prev, hash``: one hash chain per log file.

    A chain is sequential, so a log is rotated: file ``n`` of a mailbox holds its entries
    among the sequence numbers ``n * rows_per_file ...``; no file can exceed that size, even
    if one mailbox writes everything.  ``seal_audit_files`` binds the files of a mailbox, so the
    size of a file changes nothing that verification finds.
    """
    numbered = entries.withColumn("file_no", F.floor(F.col(order) / rows_per_file).cast("bigint"))
    return link_files(numbered, chain, order, fields)


def link_files(entries: DataFrame, chain: list[str], order: str, fields: list[str]) -> DataFrame:
    """Adds ``line_no, prev, hash`` to entries that have their ``file_no`` already."""
    return _linked(entries, [*chain, "file_no"], order, fields)


SEALED = ["file_no", "last", "rows"]


def _file_ends(lines: DataFrame, chain: list[str]) -> DataFrame:
    return lines.groupBy(*chain, "file_no").agg(F.count("*").alias("rows"), F.max_by("hash", "line_no").alias("last"))


def seal_audit_files(lines: DataFrame, chain: list[str], heads: DataFrame | None = None) -> DataFrame:
    """A second chain per mailbox over its files: ``file_no, rows, last`` (hash), ``prev, hash, seal_no``.

    Its input is one row a file.  The last seal of each mailbox (``audit_heads``) is to be kept apart from the logs.
    With the ``heads`` of earlier seals, new files continue their chain.
    """
    ends = None if heads is None else heads.withColumnRenamed("seals", "lines")
    return _linked(_file_ends(lines, chain), chain, "file_no", SEALED, ends).withColumnRenamed("line_no", "seal_no")


def audit_heads(seals: DataFrame, chain: list[str]) -> DataFrame:
    """Per mailbox the number of the last seal and its hash."""
    return seals.groupBy(*chain).agg(F.max("seal_no").cast("bigint").alias("seals"),
                                     F.max_by("hash", "seal_no").alias("head"))


def verify_audit_log(lines: DataFrame, seals: DataFrame, heads: DataFrame, chain: list[str],
                     fields: list[str]) -> DataFrame:
    """Per mailbox: ``ok, files`` (sealed) and ``problem``, the first file or seal that is wrong.

    Found are edited, missing and reordered lines, removed, shortened and added files, edited seals, and seals
    removed anywhere, at the end too.
    """
    keys = [*chain, "file_no"]
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    # A file is short, so its lines are placed once and everything about them is found there.
    found = _judged(_bare_lines(lines, keys, fields).where(named).repartition(*keys), keys).select(
        *keys, "_rows", "_last", _first_problem().alias("_inside"))
    per_file = (seals.select(*keys, "rows", _short("last").alias("last")).join(found, keys, "full").withColumn(
        "_problem", F.when(F.col("_rows").isNull(), "is missing").when(F.col("rows").isNull(), "is not sealed")
        .when(F.col("_inside") != "", F.col("_inside"))
        .when((F.col("rows") != F.col("_rows")) | (F.col("last") != F.col("_last")), "does not end as sealed")))
    worst = F.min(F.when(F.col("_problem").isNotNull(), F.struct("file_no", "_problem")))
    files = per_file.groupBy(*chain).agg(worst.alias("_worst"), F.count("rows").alias("files"))
    order = verify_audit_chain(seals.withColumnRenamed("seal_no", "line_no"), chain, SEALED)
    ends = audit_heads(seals, chain).withColumnsRenamed({"seals": "_seals", "head": "_head"})
    out = (files.join(order.select(*chain, F.col("problem").alias("_order")), chain, "full")
           .join(heads, chain, "full").join(ends, chain, "left"))
    problem = (F.when(F.coalesce("_order", F.lit("")) != "", F.concat(F.lit("seal "), F.col("_order")))
               .when(~(F.col("seals").eqNullSafe(F.col("_seals")) & F.col("head").eqNullSafe(F.col("_head"))),
                     "the seals do not end as noted")
               .when(F.col("_worst").isNotNull(),
                     F.concat(F.lit("file "), F.col("_worst.file_no").cast("string"), F.lit(" "), F.col("_worst._problem")))
               .otherwise(""))
    return out.select(*chain, (problem == "").alias("ok"), F.coalesce("files", F.lit(0)).alias("files"), problem.alias("problem"))


def verify_audit_chain(lines: DataFrame, chain: list[str], fields: list[str],
                       line: str = "line_no") -> DataFrame:
    """Per chain: ``ok, checked, problem`` with the first bad line.

    Every line is checked on its own (hash over its content) and against the line before it.
    Lines meet the one before in blocks of ``BLOCK_LINES`` line numbers, which spreads one long chain over all tasks.
    """
    return _judged(_bare_lines(lines, chain, fields, line), chain).select(
        *chain, F.col("_first").isNull().alias("ok"),
        F.when(F.col("_first").isNull(), F.col("_lines")).otherwise(F.col("_first.n") - 1)
        .cast("bigint").alias("checked"), _first_problem().alias("problem"))


#: Lines of a chain that meet in one place; the last of them is sent to the next block too.
BLOCK_LINES = 1 << 16


def _short(digest: str) -> Column:
    """A digest in hex as its 32 bytes; any other text as bytes that no digest has."""
    c = F.col(digest)
    return F.when(F.regexp_like(c, F.lit("^[0-9a-f]{64}$")), F.unhex(c)).otherwise(F.concat(F.lit("=" * 33), c).cast("binary"))


def _bare_lines(lines: DataFrame, chain: list[str], fields: list[str], line: str = "line_no") -> DataFrame:
    """``chain, n, prev, hash`` (bytes) and ``_edited``, all that the verification of a chain needs to shuffle."""
    head, tail = canonical_halves(fields)
    edited = F.sha2(F.concat(head, F.col("prev"), tail), 256) != F.col("hash")
    return lines.select(*chain, F.col(line).alias("n"), _short("prev").alias("prev"), _short("hash").alias("hash"),
                        F.coalesce(edited, F.lit(False)).alias("_edited"))


def _judged(bare: DataFrame, chain: list[str]) -> DataFrame:
    """Per chain ``_first`` bad line (n, p), ``_lines`` checked (once for each line before it), ``_rows`` and the ``_last`` hash."""
    block = F.floor(F.col("n") / BLOCK_LINES)
    here, ahead = F.struct(block.alias("_block"), F.lit(True).alias("_own")), F.struct((block + 1).alias("_block"), F.lit(False).alias("_own"))
    edge = F.pmod(F.col("n"), F.lit(BLOCK_LINES)) == BLOCK_LINES - 1
    placed = bare.select("*", F.inline(F.when(edge, F.array(here, ahead)).otherwise(F.array(here))))
    before = W.partitionBy(*chain, "_block").orderBy("n").rangeBetween(-1, -1)
    joined = placed.withColumns({"_before": F.count(F.lit(1)).over(before), "_hashes": F.count("hash").over(before),
                                 "_low": F.min("hash").over(before), "_high": F.max("hash").over(before)}).where("_own")
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*chain, "n"]])
    met = F.when(known, F.col("_before")).otherwise(0)
    follows = (met > 0) & (F.col("_hashes") == met) & (F.col("_low") == F.col("prev")) & (F.col("_high") == F.col("prev"))
    follows = F.when(F.col("n") == 1, F.col("prev") == F.unhex(F.lit(fixed.GENESIS))).otherwise(follows)
    problem = (F.when(F.col("hash").isNull() | F.col("prev").isNull(), "is not a valid audit entry")
               .when(~F.coalesce(follows, F.lit(False)), "chain broken (line missing or reordered)")
               .when(F.col("_edited"), "contents were modified"))
    judged = joined.withColumns({"_problem": problem, "_met": F.greatest(met, F.lit(1))})
    first = F.min(F.when(F.col("_problem").isNotNull(), F.struct("n", F.col("_problem").alias("p"))))
    return judged.groupBy(*chain).agg(first.alias("_first"), F.sum("_met").alias("_lines"), F.count("*").alias("_rows"), F.max_by("hash", "n").alias("_last"))


def _first_problem() -> Column:
    return F.when(F.col("_first").isNull(), "").otherwise(F.concat(
        F.lit("line "), F.col("_first.n").cast("string"),
        F.when(F.startswith("_first.p", F.lit("chain")), ": ")
        .when(F.startswith("_first.p", F.lit("contents")), ": ").otherwise(" "),
        F.col("_first.p")))


# ---------------------------------------------------------------- rates and cursors


#: Parts of a burst's span.  They divide a million microseconds, so a span always has whole parts.
BURST_PARTS = 64


def bursts(hits: DataFrame, key: list[str], ts: str, limit: int,
           seconds: int = fixed.BURST_SECONDS) -> DataFrame:
    """Adds ``in_window`` (hits of the key in the last seconds, inclusive) and ``burst``.

    Hits of one moment are counted before the shuffle.  A moment adds its count and takes it back one span later;
    the running total of both is the window's count.  It runs inside parts of the span, each of which starts with the
    sum of the parts before it.  A part has at most ``seconds * 15,625`` moments, and that sum is taken over at most
    two spans of parts, so no window grows with the data, whatever a key's share.  Moments meet their hits again in a join
    whose hit side adaptive execution may split, so many hits of one moment spread over tasks.
    A hit without a time is in no window and has 0; a null key is a key of its own.
    """
    span = seconds * 1_000_000
    part = span // BURST_PARTS
    floor = lambda c, width: F.col(c) - F.pmod(F.col(c), F.lit(width))
    keys = [f"key_{i}" for i in range(len(key))]
    rows = hits.select(F.struct("*").alias("hit"), *[F.col(k).alias(name) for k, name in zip(key, keys, strict=True)],
                       F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    moments = rows.where("at is not null").groupBy(*keys, "at").agg(F.count("*").alias("n"))
    marks = moments.select(*keys, F.inline(F.array(
        F.struct("at", F.lit(1).alias("kind"), F.col("n").alias("change")),
        F.struct((F.col("at") + span).alias("at"), F.lit(2).alias("kind"), (-F.col("n")).alias("change")))))
    totals = moments.withColumn("at", floor("at", part)).groupBy(*keys, "at").agg(F.sum("n").alias("n"))
    home = floor("at", span)
    copies = totals.select("*", F.inline(F.array(F.struct(home.alias("span"), F.lit(True).alias("own")),
                                                 F.struct((home + span).alias("span"), F.lit(False).alias("own")))))
    parts_before = W.partitionBy(*keys, "span").orderBy("at").rangeBetween(-span, -part)
    starts = copies.withColumn("change", F.sum("n").over(parts_before)).where("own and change is not null").select(
        *keys, "at", F.lit(0).alias("kind"), "change")
    running = W.partitionBy(*keys, "part").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = (marks.unionByName(starts).withColumn("part", floor("at", part))
               .withColumn("in_window", F.sum("change").over(running)).where("kind = 1")
               .select(*[F.col(k).alias(f"its_{k}") for k in keys], F.col("at").alias("its_at"), "in_window"))
    same = F.col("at") == F.col("its_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"its_{k}"))
    found = rows.join(counted, same, "left").select("hit.*", F.coalesce("in_window", F.lit(0).cast("bigint")).alias("in_window"))
    return found.withColumn("burst", F.col("in_window") > limit)


def backfill_selection(messages: DataFrame, backfill: int, mailbox: str = "mailbox",
                       uid: str = "uid") -> DataFrame:
    """The last N (at most 500) messages per mailbox; ranks are cut before the shuffle."""
    wanted = max(0, min(backfill, fixed.MAX_BACKFILL))
    rank = F.row_number().over(W.partitionBy(mailbox).orderBy(F.desc(uid)))
    return messages.withColumn("_rank", rank).where(F.col("_rank") <= wanted).drop("_rank")


def starting_cursors(messages: DataFrame, saved: DataFrame, backfill: int = 0,
                     mailbox: str = "mailbox", uid: str = "uid") -> DataFrame:
    """``(mailbox, uidvalidity, last_uid, reset)``: the saved cursor if the folder is unchanged,
    else after the newest message, or before the last N with a backfill."""
    wanted = max(0, min(backfill, fixed.MAX_BACKFILL))
    newest = messages.groupBy(mailbox, "uidvalidity").agg(F.max(uid).alias("_newest"))
    if wanted:
        rank = F.row_number().over(W.partitionBy(mailbox).orderBy(F.desc(uid)))
        after = (messages.withColumn("_rank", rank).where(F.col("_rank") <= wanted + 1)
                 .groupBy(mailbox).agg(F.max(F.when(F.col("_rank") == wanted + 1, F.col(uid))).alias("_start")))
        newest = newest.join(after, mailbox, "left").withColumn(
            "_newest", F.coalesce("_start", F.lit(0))).drop("_start")
    same = saved.select(mailbox, F.col("uidvalidity").alias("_v"), F.col("last_uid").alias("_saved"))
    joined = newest.join(same, mailbox, "left")
    kept = F.coalesce(F.col("_v") == F.col("uidvalidity"), F.lit(False)) & F.col("_saved").isNotNull()
    return joined.select(mailbox, "uidvalidity",
                         F.when(kept, F.col("_saved")).otherwise(F.col("_newest")).alias("last_uid"),
                         (~kept).alias("reset"))


def incremental_batch(messages: DataFrame, cursors: DataFrame, mailbox: str = "mailbox",
                      uid: str = "uid", limit: int = fixed.MAX_PER_BATCH) -> DataFrame:
    """The next messages after each cursor, oldest first, at most ``limit`` per mailbox."""
    fresh = messages.join(cursors.select(mailbox, "last_uid"), mailbox).where(
        F.col(uid) > F.col("last_uid")).drop("last_uid")
    rank = F.row_number().over(W.partitionBy(mailbox).orderBy(uid))
    return fresh.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def advanced_cursors(batch: DataFrame, mailbox: str = "mailbox", uid: str = "uid") -> DataFrame:
    return batch.groupBy(mailbox).agg(F.max(uid).alias("last_uid"))
