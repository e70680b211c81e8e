"""Text expressions: model normalisation, tokens, language check, display safety."""

from __future__ import annotations

import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .core import SPACE, clean_line, json_literal, let, one_of

# Characters and runs that normalisation removes or masks.
INVISIBLE = r"[\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff]"
NUMBER = r"(?U)\d+"
MASKED_NUMBER = r"(?U)(?<![A-Za-z])(?=[Xx*-]*\d)[\dXx*][\dXx*-]*(?![A-Za-z])"
# Runs of white space other than one plain blank, which would only be replaced by itself; in ASCII texts, and in others.
# The first class is tried on every character, so it is one of few ranges.
_ASCII = r"[\t-\r\x1c-\x20]"
_WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ASCII_SPACES = f"{_ASCII}(?:{_ASCII}+|(?<! ))"
SPACES = rf"[\t-\r\x1c-\x1f\x85-\x{{ffff}}](?<={_WHITE}){_WHITE}*+| {_WHITE}++"
PLACEHOLDER = r"&lt;[#A-Z]{0,12}&gt;?"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _normalised(text: Column, steps: list[tuple[str, str]]) -> Column:
    # Few texts hold an address or a link, and looking for them is a slow search.
    def unlinked(cut: Column) -> Column:
        linked = F.contains(cut, F.lit("://")) | F.contains(F.lower(cut), F.lit("www."))
        return F.when(linked, F.regexp_replace(cut, fixed.MODEL_URL, " ")).otherwise(cut)

    def unaddressed(cut: Column) -> Column:
        return F.when(F.contains(cut, F.lit("@")), F.regexp_replace(cut, fixed.ADDRESS, " ")).otherwise(cut)

    def collapsed(out: Column) -> Column:
        return F.when(is_ascii(out), F.regexp_replace(out, ASCII_SPACES, " ")).otherwise(F.regexp_replace(out, SPACES, " "))

    out = let(let(F.left(text, F.lit(fixed.MODEL_INPUT_CHARS)), unlinked), unaddressed)
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    return F.left(F.lower(F.trim(let(out, collapsed))), F.lit(fixed.MODEL_TEXT_CHARS))


# A model names its normaliser; it can only be one of these.
NORMALISERS = {
    "email": lambda text: _normalised(text, [(NUMBER, " numtoken ")]),
    "sms": lambda text: _normalised(text, [(NUMBER, " ")]),
    "sms_masked": lambda text: _normalised(text, [(MASKED_NUMBER, " "), (NUMBER, " ")]),
}


def normalise(text: Column, kind: str) -> Column:
    if kind not in NORMALISERS:
        raise ValueError(f"unknown normaliser {kind!r}")
    return NORMALISERS[kind](text)


def unescape(text: Column) -> Column:
    """Character references to characters: named ones and numbers."""
    names = json_literal({f"&{n};": chr(c) for n, c in name2codepoint.items()} | {"&apos;": "'"},
                         "map<string,string>")

    def character(reference: Column) -> Column:
        digits = F.regexp_extract(reference, r"&#[xX]?([0-9a-fA-F]+);", 1)
        is_hex = F.regexp_like(reference, F.lit(r"^&#[xX]"))
        number = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")

        def drawn(n: Column) -> Column:
            valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
            return F.coalesce(F.decode(F.unhex(F.lpad(F.hex(F.when(valid, n)), 8, "0")), "UTF-32"),
                              F.lit("\ufffd"))

        return F.when(F.startswith(reference, F.lit("&#")), let(number, drawn)
                      ).otherwise(F.coalesce(F.try_element_at(names, reference), reference))

    def replaced(t: Column) -> Column:
        # "&amp;" goes last so that "&amp;lt;" ends as "&lt;".
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(
            r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,8});"), F.lit(0)))
        others = F.filter(found, lambda r: r != "&amp;")
        done = F.aggregate(others, t, lambda acc, r: F.replace(acc, r, character(r)))
        return F.when(F.contains(t, F.lit("&")),
                      F.replace(done, F.lit("&amp;"), F.lit("&"))).otherwise(t)

    return let(text, replaced)


def clean_fingerprints(text: Column) -> Column:
    """Remove anonymisation placeholders of a text-message corpus, then unescape."""
    return unescape(F.regexp_replace(text, PLACEHOLDER, " "))


def clean_honeypot(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)phishing@pot", " ")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda t: t != "")


def is_english(text: Column) -> Column:
    def judged(tokens: Column) -> Column:
        hits = F.size(F.filter(tokens, lambda t: one_of(t, fixed.ENGLISH_WORDS)))
        share = hits / F.greatest(F.size(tokens), F.lit(1))
        return (hits >= fixed.ENGLISH_MIN_HITS) & (share >= fixed.ENGLISH_MIN_SHARE)

    return let(words_of(text), judged)


def _accent_table() -> tuple[str, str]:
    """Accented letters whose decomposition is one ASCII letter plus marks."""
    source, target = [], []
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for point in block:
            plain = "".join(c for c in unicodedata.normalize("NFKD", chr(point))
                            if not unicodedata.combining(c))
            if len(plain) == 1 and plain.isascii():
                source.append(chr(point))
                target.append(plain)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(text: Column) -> Column:
    folded = F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{Mn}+", "")
    return F.when(~is_ascii(text), folded).otherwise(text)


def words(text: Column) -> Column:
    """Whole words of two or more Latin letters."""
    return F.regexp_extract_all(text, F.lit(r"[a-z](?<![\p{L}\p{N}_][a-z])[a-z]++(?![\p{L}\p{N}_])"), F.lit(0))


def term_words(text: Column) -> Column:
    """The words of a normalised text that terms are made of, stop words included."""
    return words(strip_accents(F.lower(text)))


def terms(text: Column, stop_words: list[str]) -> Column:
    """Words and bigrams of a normalised text; stop words go before the bigrams."""
    kept = F.filter(term_words(text), lambda t: ~t.isin(stop_words))

    def with_bigrams(w: Column) -> Column:
        pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
                           lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(w, F.slice(pairs, 1, F.greatest(F.size(w) - 1, F.lit(0))))

    return let(kept, with_bigrams)


def readable_tokens(normalised: Column) -> Column:
    return F.size(words(normalised))


def sanitise(value: Column, limit: int = fixed.MAX_DETAIL) -> Column:
    """Display-safe text: no invisible or control characters, bounded length."""
    return clean_line(F.regexp_replace(value, INVISIBLE, ""), limit)


def model_input(subject: Column, text_body: Column, html_text: Column) -> Column:
    body = F.array_join(F.filter(F.array(text_body, html_text), lambda p: p != ""), "\n")
    return F.concat(subject, F.lit("\n"), body)


def dedup_key(normalised: Column) -> Column:
    return F.left(normalised, F.lit(fixed.DEDUP_KEY_CHARS))


