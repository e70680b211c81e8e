"""Domain and brand expressions.

All dimension data (brands, phrases, public suffixes) is small and bounded, so it
enters the plan as literals: looking a host up costs no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .core import in_text_list, json_literal, let, one_of, reused, strip

_IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9a-fA-F]{1,4}"
_IPV6 = (rf"(?:(?:{_HEX}:){{7}}{_HEX}"
         rf"|(?=[0-9a-fA-F:]*$)(?=[^:]*(?::[^:]*){{2,8}}$)(?!.*::.*::)(?!.*:::)"
         rf"(?!:*(?:[0-9a-fA-F]+:+){{7}}[0-9a-fA-F])"
         rf"(?:{_HEX}(?::{_HEX})*)?::(?:{_HEX}(?::{_HEX})*)?)")


def country_suffixes() -> list[str]:
    return [*fixed.COUNTRY_CODES, "uk"]


def default_suffixes() -> list[str]:
    """Generic and country domains, and the second levels of each country that has them."""
    countries = country_suffixes()
    second = [f"{s}.{c}" for c in countries if c not in fixed.FLAT_COUNTRIES for s in fixed.USUAL_SECOND_LEVELS]
    second += [f"{s}.{c}" for c, labels in fixed.SECOND_LEVELS.items() for s in labels]
    return list(dict.fromkeys(fixed.GENERIC_SUFFIXES + countries + second))


@dataclass(frozen=True)
class Dims:
    """Bounded reference data: brands in rank order, claim phrases and public suffixes."""

    brands: dict[str, list[str]] = field(default_factory=lambda: dict(fixed.BRAND_DOMAINS))
    phrases: dict[str, list[str]] = field(default_factory=lambda: dict(fixed.BRAND_PHRASES))
    suffixes: tuple[str, ...] = field(default_factory=lambda: tuple(default_suffixes()))
    wildcards: tuple[str, ...] = ()
    exceptions: tuple[str, ...] = ()

    def with_brands(self, extra: dict[str, list[str]]) -> Dims:
        brands = {b: list(d) for b, d in self.brands.items()}
        for brand, domains in extra.items():
            known = brands.setdefault(brand, [])
            known += [d for d in domains if d not in known]
        return Dims(brands, self.phrases, self.suffixes, self.wildcards, self.exceptions)

    def phrases_of(self, brand: str) -> list[str]:
        return self.phrases.get(brand, [brand])

    @cached_property
    def owner_of(self) -> dict[str, str]:
        owners: dict[str, str] = {}
        for brand, domains in self.brands.items():
            for domain in domains:
                owners.setdefault(domain, brand)
        return owners

    def brand_rows(self) -> Column:
        """Literal array of (brand, fuzzy, phrases, domains) in rank order."""
        rows = [{"brand": brand,
                 "fuzzy": len(brand) >= fixed.MIN_FUZZY_LENGTH and brand not in fixed.NO_FUZZY,
                 "phrases": [f" {p} " for p in self.phrases_of(brand)], "domains": domains}
                for brand, domains in self.brands.items()]
        return json_literal(rows, "array<struct<brand:string,fuzzy:boolean,"
                                  "phrases:array<string>,domains:array<string>>>")

    def owner_map(self) -> Column:
        return json_literal(self.owner_of, "map<string,string>")


DEFAULT = Dims()


def normalise_host(host: Column) -> Column:
    bare = F.btrim(F.lower(strip(host)), F.lit("\"'<>[]"))

    def without_port(h: Column) -> Column:
        one_colon = F.regexp_like(h, F.lit(r"^[^:]*:[^:]*$"))
        return F.rtrim(F.when(one_colon, F.substring_index(h, ":", 1)).otherwise(h), F.lit("."))

    return let(bare, without_port)


def is_ip(host: Column) -> Column:
    """``host`` must be normalised."""
    return F.regexp_like(host, F.lit(rf"^(?:{_IPV4}|{_IPV6})$"))


def is_ipv6(host: Column) -> Column:
    return F.regexp_like(host, F.lit(rf"^{_IPV6}$"))


def is_obfuscated_ip(host: Column) -> Column:
    """Numeric hosts that browsers treat as addresses but that do not look like one."""
    numeric = F.regexp_like(host, F.lit(r"(?i)^(?:0x[0-9a-f]+|[0-9]+)(?:\.(?:0x[0-9a-f]+|[0-9]+)){0,3}$"))
    odd_label = F.regexp_like(host, F.lit(r"(?i)(?:^|\.)(?:0x|0[0-9a-fx])"))
    return numeric & (~is_ip(host) | odd_label)


def suffix_labels(labels: Column, dims: Dims) -> Column:
    """Number of labels of the longest public suffix of a host, 0 if it is unknown."""

    def tail(n: int) -> Column:
        return F.array_join(F.slice(labels, -n, n), ".")

    levels: dict[int, list[str]] = {}
    for suffix in dims.suffixes + dims.wildcards:
        levels.setdefault(suffix.count(".") + 1, []).append(suffix)
    below: dict[int, list[str]] = {}
    for parent in dims.wildcards:
        below.setdefault(parent.count(".") + 2, []).append(parent)
    count = F.lit(0)
    for n in sorted(levels.keys() | below.keys()):
        hit = in_text_list(tail(n), levels[n]) if n in levels else F.lit(False)
        if n in below:
            wild = in_text_list(tail(n - 1), below[n])
            hit = hit | (wild & ~in_text_list(tail(n), dims.exceptions) if dims.exceptions else wild)
        count = F.when((F.size(labels) >= n) & hit, F.lit(n)).otherwise(count)
    return count


def registered_name(host: Column, dims: Dims = DEFAULT) -> Column:
    """Registered domain of a normalised host name that is known not to be an address."""

    def from_labels(labels: Column) -> Column:
        def cut(n: Column) -> Column:
            name = F.get(labels, F.size(labels) - n - 1)
            filled = F.filter(labels, lambda s: s != "")
            last_two = F.array_join(
                F.slice(filled, F.greatest(F.size(filled) - 1, F.lit(1)), F.lit(2)), ".")
            owned = F.array_join(F.slice(labels, F.size(labels) - n, n + 1), ".")
            return F.when((n > 0) & (n < F.size(labels)) & (name != ""), owned).otherwise(last_two)

        return let(suffix_labels(labels, dims), cut)

    return let(F.split(host, r"\."), from_labels)


def registered_domain(host: Column, dims: Dims = DEFAULT) -> Column:
    """``host`` must be normalised; addresses are returned unchanged."""
    return let(host, lambda h: F.when((h == "") | is_ip(h), h).otherwise(registered_name(h, dims)))


@reused
def domain_of(address: Column, dims: Dims = DEFAULT) -> Column:
    """Registered domain of an address, ``''`` without an ``@``."""
    host = normalise_host(F.substring_index(address, "@", -1))
    return F.when(F.contains(address, F.lit("@")), registered_domain(host, dims)).otherwise("")


def _character(code_point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code_point), 8, "0")), "UTF-32")


def _punycode_step(state: Column, digit: Column) -> Column:
    """One base-36 digit of the Punycode decoder (RFC 3492) as a fold over characters."""
    big = lambda v: F.lit(v).cast("bigint")

    def keep(ok: Column) -> Column:
        return F.struct(state.n.alias("n"), state.i.alias("i"), state.old.alias("old"),
                        state.bias.alias("bias"), state.w.alias("w"), state.k.alias("k"),
                        state.out.alias("out"), ok.alias("ok"))

    def with_values(v: Column) -> Column:
        more = F.struct(state.n.alias("n"), v.i.alias("i"), state.old.alias("old"),
                        state.bias.alias("bias"), (state.w * (36 - v.t)).alias("w"),
                        (state.k + 36).alias("k"), state.out.alias("out"),
                        (state.ok & (v.i < 1_000_000_000) & (state.w < 100_000_000)).alias("ok"))

        def finish(d: Column) -> Column:
            size = (F.size(state.out) + 1).cast("bigint")
            first = F.expr("0L")
            steps = F.lit(0)
            rest = d
            for bound in (455, 455 * 35, 455 * 35 ** 2, 455 * 35 ** 3, 455 * 35 ** 4):
                steps = steps + F.when(d > bound, 1).otherwise(0)
            for power in range(5, 0, -1):
                limit = 455 * 35 ** (power - 1)
                rest = F.when((d > limit) & (rest == d), (d / (35 ** power)).cast("bigint")).otherwise(rest)
            bias = steps.cast("bigint") * 36 + (rest * 36 / (rest + 38)).cast("bigint")
            at = v.i % size
            point = state.n + F.floor(v.i / size)
            out = F.concat(F.slice(state.out, F.lit(1), at.cast("int")), F.array(point),
                           F.slice(state.out, (at + 1).cast("int"), size.cast("int")))
            return F.struct(point.alias("n"), (at + 1).alias("i"), (at + 1).alias("old"),
                            bias.alias("bias"), (first + 1).alias("w"), (first + 36).alias("k"),
                            out.alias("out"), (state.ok & (point <= 0x10FFFF)).alias("ok"))

        size = (F.size(state.out) + 1).cast("bigint")
        delta = v.i - state.old
        halved = F.floor(delta / F.when(state.old == 0, big(700)).otherwise(big(2))).cast("bigint")
        damped = let(halved, lambda h: h + F.floor(h / size).cast("bigint"))
        return F.when(v.digit < v.t, let(damped, finish)).otherwise(more)

    threshold = F.greatest(F.least(state.k - state.bias, big(26)), big(1))
    values = F.struct(digit.alias("digit"), threshold.alias("t"),
                      (state.i + digit * state.w).alias("i"))
    usable = state.ok & (state.w < 1_000_000_000) & (state.i < 1_000_000_000)
    return F.when(usable, let(values, with_values)).otherwise(keep(F.lit(False)))


def decode_punycode(label: Column) -> Column:
    """Readable form of an ``xn--`` label; anything undecodable is returned as it is."""

    def decoded(body: Column) -> Column:
        tail = F.regexp_extract(body, r"([a-z0-9]+)$", 1)
        basic = F.regexp_extract(body, r"^(.*)-[a-z0-9]+$", 1)
        points = F.transform(F.filter(F.split(basic, ""), lambda c: c != ""),
                             lambda c: F.ascii(c).cast("bigint"))
        digits = F.transform(F.filter(F.split(tail, ""), lambda c: c != ""),
                             lambda c: F.when(c >= "a", F.ascii(c) - 97)
                             .otherwise(F.ascii(c) - 22).cast("bigint"))
        start = F.struct(F.lit(128).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("i"),
                         F.lit(0).cast("bigint").alias("old"), F.lit(72).cast("bigint").alias("bias"),
                         F.lit(1).cast("bigint").alias("w"), F.lit(36).cast("bigint").alias("k"),
                         points.alias("out"), F.lit(True).alias("ok"))
        final = F.aggregate(digits, start, _punycode_step)
        return let(final, lambda s: F.when(
            s.ok & (s.k == 36) & (F.size(s.out) <= 63),
            F.array_join(F.transform(s.out, _character), "")))

    looks = F.startswith(label, F.lit("xn--")) & F.regexp_like(label, F.lit(r"^xn--[a-z0-9-]*[a-z0-9]$")) & (F.length(label) <= 63)
    return F.when(looks, F.coalesce(let(F.substring(label, 5, 63), decoded), label)).otherwise(label)


def skeleton(text: Column) -> Column:
    """Look-alike characters mapped to Latin letters."""
    latin = F.translate(F.lower(text), fixed.CONFUSABLE_FROM, fixed.CONFUSABLE_TO)
    return F.replace(F.replace(latin, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))


def official_brand(domain: Column, dims: Dims = DEFAULT) -> Column:
    """Brand owning a registered domain, NULL if none."""
    return F.try_element_at(dims.owner_map(), domain)


def _imitation_hint(dims: Dims) -> str:
    """Pattern that every imitation satisfies, so most names skip the brand comparison.

    A brand is a token, is contained, or is one edit away; one edit leaves the first or
    the second half of the brand in place.
    """
    fuzzy = [b for b in dims.brands
             if len(b) >= fixed.MIN_FUZZY_LENGTH and b not in fixed.NO_FUZZY]
    whole = "|".join(dims.brands)
    heads = "|".join(dict.fromkeys(b[: len(b) // 2] for b in fuzzy))
    tails = "|".join(dict.fromkeys(b[len(b) // 2:] for b in fuzzy))
    inside = "|".join(fuzzy)
    return (rf"(?:^|[^a-z0-9])(?:{whole})(?:[^a-z0-9]|$)|{inside}|^(?:{heads})|(?:{tails})$")


def lookalike_brand(domain: Column, dims: Dims = DEFAULT) -> Column:
    """First brand (by rank) that a registered domain imitates, NULL if none."""

    def first_match(shape: Column) -> Column:
        def matching(tokens: Column) -> Column:
            def imitates(b: Column) -> Column:
                near = ((F.abs(F.length(b.brand) - F.length(shape)) <= 1)
                        & (F.levenshtein(b.brand, shape, 1) >= 0))
                fuzzy = b.fuzzy & (F.contains(shape, b.brand) | near)
                return (shape == b.brand) | F.array_contains(tokens, b.brand) | fuzzy
            return F.get(F.filter(dims.brand_rows(), imitates), F.lit(0)).brand
        return F.when(F.regexp_like(shape, F.lit(_imitation_hint(dims))),
                      let(F.split(shape, r"[^a-z0-9]+"), matching))

    def known(d: Column) -> Column:
        label = F.substring_index(d, ".", 1)
        excluded = (d == "") | is_ip(d) | one_of(d, dims.owner_of)
        return F.when(~excluded, let(skeleton(decode_punycode(label)), first_match))

    return let(domain, known)


def padded_words(text: Column) -> Column:
    """Lower-case words separated and surrounded by single blanks."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def claimed_brands(text: Column, dims: Dims = DEFAULT) -> Column:
    """Brand rows named in a text as whole words, in rank order."""
    def rows(padded: Column) -> Column:
        return F.filter(dims.brand_rows(),
                        lambda b: F.exists(b.phrases, lambda p: F.contains(padded, p)))
    return let(padded_words(text), rows)


def brands_in_text(text: Column, dims: Dims = DEFAULT) -> Column:
    return F.transform(claimed_brands(text, dims), lambda b: b.brand)
