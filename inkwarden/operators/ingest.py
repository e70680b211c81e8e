"""Message tables: parsing, explosion to child tables, assembly, routing, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, mail, text
from ..functions.core import clean_line, exploded, let, literals, reused
from ..functions.urls import extract_urls
from .ordering import cumulative


def parse_messages(messages: DataFrame, max_bytes: int = fixed.MAX_MESSAGE_BYTES) -> DataFrame:
    """``msg_id, content`` to one wide row per message; no shuffle.

    Messages that fail the guard keep their row with ``status`` other than ``ok`` and
    empty fields; scoring sends them to review.
    """
    staged = messages
    for name, column in _structure(max_bytes):
        staged = staged.withColumn(name, column)
    parsed = staged.select(*[c for c in messages.columns if c != "content"], "status", *_fields())
    body, links = _body_and_links()
    # One link more than wanted shows that some are left out.
    return (parsed.withColumn("body", body).withColumn("links", links)
            .withColumn("truncated", F.col("truncated") | (F.size("links") > fixed.MAX_LINKS))
            .withColumn("links", F.slice("links", 1, fixed.MAX_LINKS))
            .withColumn("recipient_count", F.size("to") + F.size("cc"))
            .drop("html_links"))


@reused
def _structure(max_bytes: int) -> list[tuple[str, Column]]:
    usable = F.when(F.col("status") == "ok", F.col("content")).otherwise(F.lit(b""))
    return [("status", mail.guard(F.col("content"), max_bytes)),
            ("raw", mail.as_characters(usable)),
            ("block", mail.header_block(F.col("raw"))),
            ("headers", mail.parse_headers(F.col("block"))),
            ("tree", mail.part_tree(F.col("block"), mail.body_block(F.col("raw")))),
            ("bodies", mail.bodies(F.col("tree"))),
            ("sender", mail.single_address(mail.first_header(F.col("headers"), "from")))]


@reused
def _fields() -> list[Column]:
    h = F.col("headers")
    limit = fixed.MAX_HEADER_CHARS
    return [
        clean_line(mail.first_header(h, "subject"), limit).alias("subject"),
        F.col("sender.display").alias("from_display"), F.col("sender.address").alias("from_address"),
        mail.address_list(mail.header_values(h, "reply-to")).alias("reply_to"),
        mail.single_address(mail.first_header(h, "return-path")).address.alias("return_path"),
        mail.address_list(mail.header_values(h, "to")).alias("to"),
        mail.address_list(mail.header_values(h, "cc")).alias("cc"),
        clean_line(mail.first_header(h, "message-id"), limit).alias("message_id"),
        clean_line(mail.first_header(h, "date"), limit).alias("date"),
        mail.clean_values(h, "authentication-results").alias("authentication_results"),
        mail.clean_values(h, "received-spf").alias("received_spf"),
        mail.clean_values(h, "received").alias("received"),
        F.col("bodies.text_body").alias("text_body"), F.col("bodies.html_text").alias("html_text"),
        F.col("bodies.links").alias("html_links"),
        mail.attachments(F.col("tree")).alias("attachments"),
        mail.part_defects(F.col("tree")).alias("defects"),
        (F.col("bodies.truncated") | F.arrays_overlap(
            mail.part_defects(F.col("tree")), literals(fixed.PARTIAL_DEFECTS))).alias("truncated")]


@reused
def _body_and_links() -> tuple[Column, Column]:
    body = F.array_join(F.filter(F.array("text_body", "html_text"), lambda p: p != ""), "\n")
    return body, mail.merged_links(F.col("html_links"), F.col("body"), fixed.MAX_LINKS + 1)


def explode_headers(messages: DataFrame) -> DataFrame:
    """``(msg_id, pos, name, value)``, at most 50 instances per name and message; none of a message beyond the guard."""
    headers = mail.parse_headers(mail.header_block(mail.as_characters(F.col("content"))))

    def capped(hs: Column) -> Column:
        # One list per distinct name keeps its first instances; a name's headers are compared once.
        names = F.array_distinct(F.transform(hs, lambda h: h["name"]))
        kept = F.transform(names, lambda n: F.slice(F.filter(hs, lambda g: g["name"] == n), 1, fixed.MAX_HEADER_INSTANCES))
        return F.array_sort(F.flatten(kept), lambda a, b: a.pos - b.pos)

    return exploded(messages.where(mail.guard(F.col("content")) == "ok"), ["msg_id"], let(headers, capped))


def explode_parts(messages: DataFrame) -> DataFrame:
    """``(msg_id, part, content_type, filename, disposition, text)`` of the leaf parts."""
    raw = messages.withColumn("raw", mail.as_characters(F.col("content")))
    tree = mail.leaves(mail.part_tree(mail.header_block(F.col("raw")), mail.body_block(F.col("raw"))))
    rows = F.transform(tree, lambda n: F.struct(
        n.kind.alias("content_type"), n.filename.alias("filename"),
        n.disposition.alias("disposition"),
        F.when(~mail.is_attachment(n), mail.decoded_text(n)).alias("text")))
    return exploded(raw, ["msg_id"], rows, "part")


def explode_links(parsed: DataFrame) -> DataFrame:
    return exploded(parsed, ["msg_id"], F.col("links"), "pos")


def explode_attachments(parsed: DataFrame) -> DataFrame:
    return exploded(parsed, ["msg_id"], F.col("attachments"), "pos")


def apply_text_budget(parts: DataFrame, budget: int = fixed.MAX_TEXT_CHARS,
                      key: str = "msg_id", order: str = "part") -> DataFrame:
    """Cut the texts of a message's parts so that together they fit the budget.

    Lengths are summed per 1,000 parts first and then within them, so even a message of
    very many parts is spread; only lengths take part in the running sum.
    """
    sized = parts.select(key, order, F.length("text").cast("bigint").alias("_n")).withColumn(
        "_bucket", F.floor(F.col(order) / 1000))
    run = cumulative(sized, "_bucket", order, ["_n"], [key])
    used = run.select(key, order, (F.col("cum__n") - F.col("_n")).alias("_used"))
    left = F.greatest(F.lit(budget) - F.col("_used"), F.lit(0))
    parts = parts.join(used, [key, order])
    cut = parts.withColumn("left", left).withColumn(
        "kept", F.expr("substring(text, 1, cast(left as int))"))
    return (cut.withColumn("truncated", F.length("kept") < F.length("text"))
            .drop("left", "text", "_used").withColumnRenamed("kept", "text"))


def extract_url_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    found = F.transform(extract_urls(F.col(column)), lambda u: F.struct(u.alias("url")))
    return exploded(df, [key], found, "pos")


def with_identity(messages: DataFrame) -> DataFrame:
    return (messages.withColumn("content_sha256", mail.content_sha256(F.col("content")))
            .withColumn("message_id", mail.message_id(F.col("content"))))


def sanitise_strings(df: DataFrame, limit: int = fixed.MAX_DETAIL,
                     limits: dict[str, int] | None = None) -> DataFrame:
    """Make every string of a table display-safe, inside arrays and structs as well."""
    from pyspark.sql import types as T

    def safe(value: Column, kind: T.DataType, size: int) -> Column:
        if isinstance(kind, T.StringType):
            return text.sanitise(value, size)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: safe(x, kind.elementType, size))
        if isinstance(kind, T.StructType):
            inner = F.struct(*[safe(value[f.name], f.dataType, size).alias(f.name) for f in kind])
            return F.when(value.isNotNull(), inner)
        return value

    sizes = limits or {}
    return df.select(*[safe(F.col(f.name), f.dataType, sizes.get(f.name, limit)).alias(f.name)
                       for f in df.schema])


def fill_placeholders(value: Column, row_id: Column, sender: bool = False) -> Column:
    """Deterministic phone numbers of the right shape for published evaluation rows."""
    number = row_id.cast("bigint")
    mobile = F.concat(F.lit("9"), F.lpad(((number * 7919) % 1_000_000_000).cast("string"), 9, "0"))
    if sender:
        mobile = F.concat(F.lit("+91 "), F.left(mobile, F.lit(5)), F.lit(" "), F.right(mobile, F.lit(5)))
    free = F.concat(F.lit("1800 425 "), F.lpad((number % 10_000).cast("string"), 4, "0"))
    return F.replace(F.replace(value, F.lit("{MOBILE}"), mobile), F.lit("{TOLLFREE}"), free)


def assemble_messages(rows: DataFrame) -> DataFrame:
    """Evaluation columns to raw mail as a provider would deliver it (its header on top)."""
    domain = F.substring_index("from_address", "@", -1)
    result = F.when(F.col("dmarc") == "pass", "pass").otherwise("fail")
    lines = [
        F.concat(F.lit("Authentication-Results: mx.google.com; dkim="), result,
                 F.lit(" header.i=@"), domain, F.lit("; spf="), result, F.lit(" smtp.mailfrom="),
                 F.col("from_address"), F.lit("; dmarc="), result, F.lit(" header.from="), domain),
        F.concat(F.lit('From: "'), F.col("from_display"), F.lit('" <'), F.col("from_address"), F.lit(">")),
        F.lit("To: user@example.org"),
        F.concat(F.lit("Subject: "), F.col("subject")),
        F.concat(F.lit("Message-ID: <"), F.col("id").cast("string"), F.lit("@"), domain, F.lit(">")),
        F.lit("Date: Thu, 08 Oct 2026 10:00:00 +0530"),
        F.when(F.col("reply_to") != "", F.concat(F.lit("Reply-To: "), F.col("reply_to"))),
        F.lit("MIME-Version: 1.0"), F.lit("Content-Type: text/plain; charset=utf-8"),
        F.lit(""), F.col("body"),
    ]
    raw = F.concat_ws("\r\n", *lines)
    return rows.withColumn("content", F.encode(raw, "UTF-8"))


def route_kind(kind: Column, text_column: Column) -> Column:
    """``sms``, ``raw_email`` (two or more leading header lines) or ``text``.

    Two lines decide it: an open repetition would recurse over every header line of the text.
    """
    headed = F.regexp_like(text_column, F.lit(r"^(?:[A-Za-z][A-Za-z0-9-]{0,40}:[^\n]*+\n){2}"))
    return F.when(kind == "sms", "sms").when(headed, "raw_email").otherwise("text")


def refusal(kind: Column, text: Column) -> Column:
    """Why a submitted text is not scored: ``unknown_kind``, ``too_long``, ``empty``, ``sms_too_long``, else null."""
    return (F.when(~kind.isin("email", "sms"), "unknown_kind")
            .when(F.length(text) > fixed.MAX_PASTE_CHARS, "too_long")
            .when(~F.regexp_like(text, F.lit(rf"[^{fixed.WHITE}]")), "empty")
            .when((kind == "sms") & (F.length(text) > fixed.MAX_SMS_CHARS), "sms_too_long"))
