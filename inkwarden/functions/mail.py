"""Raw mail to columns: headers, addresses, the part tree, bodies, links, attachments.

The content is read as one character per byte, cut by pattern, and every piece is decoded
on its own, so no byte sequence can fail.  One message is one row throughout: parts,
links and attachments are bounded arrays, and parsing needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .core import clean_line, let, one_of, strip, url_unquote
from .html import html_links, html_text
from .urls import extract_urls

_KNOWN_CHARSETS = ["", "utf-8", "utf8", "us-ascii", "ascii"]
_LATIN_CHARSETS = ["iso-8859-1", "latin-1", "latin1", "iso8859-1"]


def guard(content: Column, max_bytes: int = fixed.MAX_MESSAGE_BYTES) -> Column:
    """``ok``, ``limit_exceeded`` or ``unparseable`` from sizes and counts only."""
    text = F.decode(content, "ISO-8859-1")

    def judged(t: Column) -> Column:
        ends = F.array(F.instr(t, "\r\n\r\n"), F.instr(t, "\n\n"))
        header_end = F.coalesce(F.array_min(F.filter(ends, lambda p: p > 0)) - 1, F.length(t))
        boundaries = (F.length(t) - F.length(F.replace(t, F.lit("\n--"), F.lit("")))) / 3
        return (F.when(F.btrim(t, F.lit(" \t\n\r\u000b\u000c")) == "", "unparseable")
                .when(header_end > fixed.MAX_HEADER_SECTION, "limit_exceeded")
                .when(boundaries > fixed.MAX_BOUNDARY_LINES, "limit_exceeded").otherwise("ok"))

    return F.when(content.isNull() | (F.length(content) > max_bytes), "limit_exceeded").otherwise(let(text, judged))


def as_characters(content: Column) -> Column:
    """One character per byte, line ends unified."""
    text = F.replace(F.decode(content, "ISO-8859-1"), F.lit("\r\n"), F.lit("\n"))
    return F.replace(text, F.lit("\r"), F.lit("\n"))


def to_utf8(characters: Column) -> Column:
    """Bytes held as characters, read as UTF-8; invalid bytes become U+FFFD."""
    plain = F.regexp_like(characters, F.lit(r"^[\u0000-\u007f]*$"))
    decoded = F.make_valid_utf8(F.encode(characters, "ISO-8859-1").cast("string"))
    return F.when(plain, characters).otherwise(decoded)


def header_block(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("\n")), "").otherwise(F.substring_index(text, "\n\n", 1))


def body_block(text: Column) -> Column:
    start = F.instr(text, "\n\n")
    return (F.when(F.startswith(text, F.lit("\n")), F.substring(text, 2, 2 ** 30))
            .when(start > 0, text.substr(start + 2, F.length(text))).otherwise(""))


def unfold(block: Column) -> Column:
    return F.regexp_replace(block, r"\n(?=[ \t])", "")


def parse_headers(block: Column) -> Column:
    """``array<struct<pos, name, value>>`` top-most first, values cut before any other work."""
    lines = F.filter(F.split(unfold(block), "\n"),
                     lambda line: F.regexp_like(line, F.lit(r"^[^:\s]+[ \t]*:")))
    return F.transform(lines, lambda line, i: F.struct(
        i.alias("pos"), F.lower(F.trim(F.substring_index(line, ":", 1))).alias("name"),
        to_utf8(F.left(F.regexp_replace(line, r"^[^:]*:[ \t]*", ""), F.lit(fixed.MAX_RAW_HEADER)))
        .alias("value")))


def header_values(headers: Column, name: str) -> Column:
    named = F.filter(headers, lambda h: h["name"] == name)
    return F.transform(F.slice(named, 1, fixed.MAX_HEADER_INSTANCES), lambda h: h.value)


def first_header(headers: Column, name: str) -> Column:
    return F.coalesce(F.get(header_values(headers, name), F.lit(0)), F.lit(""))


def clean_values(headers: Column, name: str) -> Column:
    return F.transform(header_values(headers, name),
                       lambda v: clean_line(v, fixed.MAX_HEADER_CHARS))


def _without_quotes(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"\"[^\"]*\"", ""), r"\([^()]*\)", "")


def _bare_address(chunk: Column) -> Column:
    inside = F.regexp_extract(chunk, r"<\s*([^<>\s]*)\s*>", 1)
    return F.when(F.contains(chunk, F.lit("<")), inside).otherwise(
        F.regexp_extract(chunk, r"^\s*(\S*)", 1))


def _plausible(address: Column) -> Column:
    """An address with one ``@`` and no empty label, as strict address parsing wants."""
    return F.when(F.regexp_like(address, F.lit(r"^[^@<>]+(?:@[^@<>]+)?$"))
                  & ~F.regexp_like(address, F.lit(r"@.*\.\.")), address).otherwise("")


def address_list(values: Column) -> Column:
    """Lower-case addresses of all values, in order."""
    chunks = F.flatten(F.transform(values, lambda v: F.split(_without_quotes(v), ",")))
    found = F.transform(chunks, lambda c: F.lower(
        clean_line(_plausible(_bare_address(c)), fixed.MAX_HEADER_CHARS)))
    return F.slice(F.filter(found, lambda a: a != ""), 1, fixed.MAX_ADDRESSES)


def single_address(value: Column) -> Column:
    """``struct<display, address>`` of a header that holds one address."""

    def parts(v: Column) -> Column:
        bare = _without_quotes(v)
        several = F.contains(bare, F.lit(","))
        before = strip(F.regexp_extract(v, r"(?s)^(.*?)<[^<>]*>[^<>]*$", 1))
        unquoted = F.regexp_replace(F.btrim(before, F.lit("\"")), r"\\(.)", "$1")
        comment = F.regexp_extract(v, r"\(([^()]*)\)", 1)
        display = F.when(F.contains(v, F.lit("<")), unquoted).otherwise(comment)
        address = F.when(several, "").otherwise(_plausible(_bare_address(bare)))
        return F.struct(
            F.when(address != "", clean_line(display, fixed.MAX_HEADER_CHARS)).otherwise("")
            .alias("display"),
            F.lower(clean_line(address, fixed.MAX_HEADER_CHARS)).alias("address"))

    return let(value, parts)


def _parameter(header: Column, name: str) -> Column:
    # Fixed format: name="value" or name=value; the extended form is percent-encoded.
    quoted = F.regexp_extract(header, rf"(?i)(?:^|[;\s]){name}\s*=\s*\"([^\"]*)\"", 1)
    plain = F.regexp_extract(header, rf"(?i)(?:^|[;\s]){name}\s*=\s*([^\";\s]+)", 1)
    extended = F.regexp_extract(header, rf"(?i)(?:^|[;\s]){name}\*\s*=\s*[^']*'[^']*'([^;\s]+)", 1)
    return (F.when(quoted != "", quoted).when(plain != "", plain)
            .otherwise(url_unquote(extended)))


def _node(block: Column, body: Column, depth: Column) -> Column:
    def fields(b: Column) -> Column:
        line = lambda name: F.regexp_extract(
            b, rf"(?im)^{name}[ \t]*:[ \t]*(.*)$", 1)
        content_type = line("content-type")
        disposition = line("content-disposition")
        kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
        kind = F.when(F.regexp_like(kind, F.lit(r"^[^/\s]+/[^/\s]+$")), kind).otherwise("text/plain")
        filename = _parameter(disposition, "filename")
        filename = F.when(filename != "", filename).otherwise(_parameter(content_type, "name"))
        return F.struct(
            kind.alias("kind"), _parameter(content_type, "boundary").alias("boundary"),
            F.lower(_parameter(content_type, "charset")).alias("charset"),
            F.lower(F.trim(F.substring_index(disposition, ";", 1))).alias("disposition"),
            clean_line(to_utf8(filename), fixed.MAX_FILENAME).alias("filename"),
            F.lower(F.trim(line("content-transfer-encoding"))).alias("encoding"),
            body.alias("body"), depth.alias("depth"), F.lit(False).alias("container"))

    return let(unfold(block), fields)


def _is_multipart(n: Column) -> Column:
    return F.startswith(n.kind, F.lit("multipart/")) & (n.boundary != "")


def _children(n: Column) -> Column:
    marker = F.concat(F.lit("\\n--\\Q"), n.boundary, F.lit("\\E"))
    pieces = F.split(F.concat(F.lit("\n"), n.body), marker)
    closing = F.array_position(
        F.transform(pieces, lambda p: F.startswith(p, F.lit("--")).cast("string")), "true")
    kept = F.when(closing > 0, F.slice(pieces, F.lit(2), (closing - 2).cast("int"))).otherwise(
        F.slice(pieces, F.lit(2), F.size(pieces)))
    texts = F.transform(kept, lambda p: F.regexp_replace(p, r"^[ \t]*\n?", ""))
    own = F.when(_is_multipart(n), texts).otherwise(F.array(n.body))
    return F.transform(own, lambda t: _node(header_block(t), body_block(t), n.depth + 1))


def part_tree(block: Column, body: Column) -> Column:
    """All parts in document order, containers included (marked)."""

    def open_once(nodes: Column, _step: Column) -> Column:
        def opened(n: Column) -> Column:
            expand = ~n.container & (_is_multipart(n) | (n.kind == "message/rfc822"))
            closed = F.struct(n.kind.alias("kind"), n.boundary.alias("boundary"),
                              n.charset.alias("charset"), n.disposition.alias("disposition"),
                              n.filename.alias("filename"), n.encoding.alias("encoding"),
                              F.lit("").alias("body"), n.depth.alias("depth"),
                              F.lit(True).alias("container"))
            return F.when(expand, F.concat(F.array(closed), _children(n))).otherwise(F.array(n))
        return F.flatten(F.transform(nodes, opened))

    root = F.array(_node(block, body, F.lit(0)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(fixed.MAX_DEPTH)), root, open_once)


def _base64_bytes(body: Column) -> Column:
    letters = F.regexp_replace(body, r"[^A-Za-z0-9+/]", "")

    def padded(s: Column) -> Column:
        whole = F.left(s, F.length(s) - F.when(F.length(s) % 4 == 1, 1).otherwise(0))
        return F.try_to_binary(F.concat(whole, F.substring(F.lit("=="), 1, (4 - F.length(whole) % 4) % 4)),
                               F.lit("base64"))

    return let(letters, padded)


def decoded_bytes_length(n: Column) -> Column:
    return F.when(n.encoding == "base64", F.coalesce(F.length(_base64_bytes(n.body)), F.lit(0))
                  ).otherwise(F.length(n.body)).cast("bigint")


def decoded_text(n: Column) -> Column:
    """Text of a leaf part: transfer encoding undone, then the charset."""
    from_base64 = F.decode(_base64_bytes(n.body), "ISO-8859-1")
    soft = F.regexp_replace(n.body, r"=[ \t]*\n", "")
    quoted = F.regexp_replace(F.replace(F.replace(soft, F.lit("%"), F.lit("%25")), F.lit("+"),
                                        F.lit("%2B")), r"=([0-9A-Fa-f]{2})", "%$1")

    def in_charset(raw: Column) -> Column:
        return F.when(one_of(n.charset, _LATIN_CHARSETS), raw).otherwise(to_utf8(raw))

    return (F.when(n.encoding == "base64", let(F.coalesce(from_base64, F.lit("")), in_charset))
            .when(n.encoding == "quoted-printable",
                  let(to_utf8(quoted), lambda q: F.coalesce(F.try_url_decode(q), n.body)))
            .otherwise(let(n.body, in_charset)))


def is_attachment(n: Column) -> Column:
    return ((n.disposition == "attachment") | (n.filename != "")
            | ~F.startswith(n.kind, F.lit("text/")))


def part_defects(tree: Column) -> Column:
    """Defects that mean part of a message was not analysed, plus unknown charsets."""
    seen = F.slice(tree, 1, fixed.MAX_PARTS)
    deep = F.exists(seen, lambda n: ~n.container & (n.depth >= fixed.MAX_DEPTH) & _is_multipart(n))
    odd = F.exists(seen, lambda n: ~n.container & F.startswith(n.kind, F.lit("text/"))
                   & ~one_of(n.charset, _KNOWN_CHARSETS + _LATIN_CHARSETS))
    from .core import codes_array
    return codes_array(("nesting_too_deep", deep),
                       ("too_many_parts", F.size(tree) > fixed.MAX_PARTS),
                       ("unknown_charset", odd))


def leaves(tree: Column) -> Column:
    return F.filter(F.slice(tree, 1, fixed.MAX_PARTS), lambda n: ~n.container & ~(
        (n.depth >= fixed.MAX_DEPTH) & _is_multipart(n)))


def attachments(tree: Column) -> Column:
    return F.transform(F.filter(leaves(tree), is_attachment), lambda n: F.struct(
        n.filename.alias("filename"), n.kind.alias("content_type"),
        decoded_bytes_length(n).alias("size")))


def bodies(tree: Column) -> Column:
    """Texts, HTML texts and HTML links under one character budget for the message."""
    texts = F.filter(leaves(tree), lambda n: ~is_attachment(n))

    def shown(n: Column) -> Column:
        is_html = n.kind == "text/html"
        return let(decoded_text(n), lambda t: F.struct(
            is_html.alias("is_html"),
            F.when(is_html, html_text(t)).otherwise(t).alias("text"),
            F.when(is_html, html_links(t, fixed.MAX_LINKS + 1)).alias("links"),
            (is_html & (F.length(t) > fixed.MAX_HTML_SOURCE)).alias("cut")))

    no_strings = F.array().cast("array<string>")
    start = F.struct(F.lit(fixed.MAX_TEXT_CHARS).alias("left"), no_strings.alias("plain"),
                     no_strings.alias("html"),
                     F.array().cast("array<struct<href:string,text:string,source:string>>").alias("links"),
                     F.lit(False).alias("truncated"))

    def add(s: Column, p: Column) -> Column:
        def spent(piece: Column) -> Column:
            return F.struct(
                (s.left - F.length(piece)).alias("left"),
                F.when(p.is_html, s.plain).otherwise(F.concat(s.plain, F.array(piece))).alias("plain"),
                F.when(p.is_html, F.concat(s.html, F.array(piece))).otherwise(s.html).alias("html"),
                F.when(p.is_html, F.concat(s.links, p.links)).otherwise(s.links).alias("links"),
                (s.truncated | p.cut | (F.length(piece) < F.length(p.text))).alias("truncated"))

        full = F.struct(s.left.alias("left"), s.plain.alias("plain"), s.html.alias("html"),
                        s.links.alias("links"), F.lit(True).alias("truncated"))
        return F.when(s.left > 0, let(F.left(p.text, s.left), spent)).otherwise(full)

    return F.aggregate(F.transform(texts, shown), start, add, lambda s: F.struct(
        strip(F.array_join(s.plain, "\n")).alias("text_body"),
        strip(F.array_join(s.html, "\n")).alias("html_text"),
        s.links.alias("links"), s.truncated.alias("truncated")))


def merged_links(html_link_rows: Column, body: Column, limit: int = fixed.MAX_LINKS) -> Column:
    """HTML links, then body URLs that are neither a known target nor an anchor's text; at most ``limit``."""

    def merge(known: Column) -> Column:
        shown = F.transform(F.filter(known, lambda k: (k.source == "html") & (k.text != "")),
                            lambda k: k.text)
        targets = F.transform(known, lambda k: k.href)
        fresh = F.filter(F.array_distinct(extract_urls(body, limit)),
                         lambda u: ~F.array_contains(targets, u)
                         & ~F.exists(shown, lambda t: F.contains(t, u)))
        added = F.transform(fresh, lambda u: F.struct(
            clean_line(u, fixed.MAX_URL_CHARS).alias("href"), F.lit("").alias("text"),
            F.lit("text").alias("source")))
        return F.slice(F.concat(known, added), 1, limit)

    return let(html_link_rows, merge)


def message_id(content: Column) -> Column:
    """Message-ID from the header section only, ``''`` if missing or malformed."""
    head = F.decode(F.substring(content, 1, fixed.MAX_HEADER_SECTION), "ISO-8859-1")
    section = F.substring_index(F.substring_index(head, "\r\n\r\n", 1), "\n\n", 1)
    return F.regexp_extract(section, r"(?im)^message-id:[ \t]*(<[^<>\s]{1,250}>)", 1)


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)
