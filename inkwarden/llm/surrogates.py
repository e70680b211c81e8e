"""Personal data replaced by keyed surrogates of the same kind, with Spark SQL functions only.

Found are e-mail addresses, secrets (long hexadecimal strings), IPv4 addresses, telephone, social security and card
numbers, and names behind a title, with the bare repeats of such a name (whole, or its family name) in the same text.
Given and family names are entities of their own, so long and short forms of a name agree.  A value is brought to a normal form, so spellings of one entity get one
surrogate everywhere; the surrogate is drawn from SHA-256 of a key, the kind, the normal form and an attempt number,
then dressed in the spelling found: separators, case, country code, private address ranges, a valid check digit, the
title's gender and the script stay.  All distinct entities are checked: if two would share a surrogate, or one would
get a value that occurs as an entity itself, all but one go on to the next attempt.  Later attempts draw from wider
spaces: longer names, local parts and numbers, whole private ranges, then an unused public one.  What is left after
``ROUNDS`` attempts is numbered, so every count of entities ends.  Only those exceptions are joined back to the texts;
every other surrogate is computed where it stands.

Null and empty texts stay as they are; texts, local parts and hosts of any length take time in proportion to it (a text
full of different titled names takes more: each of them is looked for again).  Repeated rows, null ids and extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, scratch_table

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Titles by the gender they show; the same lists find names.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Signor", "Господин", "Κύριος"],
          "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Signora", "Госпожа", "Κυρία"]}
#: Labels of a host that do not begin with two letters, so the address can't end in them.  Repeated groups are possessive:
#: Java repeats those in a loop, others by recursion, which a text of some thousand labels would carry beyond the stack.
PLAIN_LABELS = r"(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+"
#: In this order: at one place the first that fits is taken.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
             rf"(?:{PLAIN_LABELS}\.(?=[A-Za-z]{{2}})[A-Za-z0-9-]++(?={PLAIN_LABELS}\.[A-Za-z]{{2}}))*+{PLAIN_LABELS}\.[A-Za-z]{{2,}}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
             r"|(?<![\d-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "name": r"(?<!\p{L})(?:" + "|".join(TITLES["m"] + TITLES["f"]) + r")\.?\p{IsWhite_Space}+\p{Lu}\p{Ll}+"
            r"(?:\p{IsWhite_Space}\p{Lu}\p{Ll}+)?",
}
ANY = "|".join(PATTERNS.values())
#: A titled name.
NAME = PATTERNS["name"]
#: What every value has somewhere: a quick look passes over most texts.
HINT = r"[0-9@]|[a-f]{32}|[A-F]{32}|(?<!\p{L})(?:" + "|".join(TITLES["m"] + TITLES["f"]) + ")"
#: Given names by script and gender, and syllables of family names by script.
GIVEN = {
    "latin": {"m": "Adam Bruno Carl Daniel Emil Felix Gabriel Hugo Ivan Jonas Karim Leo Martin Noel Oscar Paul".split(),
              "f": "Anna Berta Clara Diana Elena Flora Gina Helen Iris Julia Karla Laura Maria Nora Olivia Paula".split()},
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(),
                 "f": "Анна Вера Галина Дарья Елена Ирина Ксения Лидия".split()},
    "greek": {"m": "Αλέξης Γιώργος Δημήτρης Κώστας Λουκάς Μάριος Νίκος Πέτρος".split(),
              "f": "Άννα Γεωργία Δέσποινα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split()},
}
SYLLABLES = {"latin": "bar den fol gor hal kem lin mar nes por ral sen tor vel wen zim".split(),
             "cyrillic": "бар вен гор дол зим кав лен мар нов пет рог сев тар фер хол шан".split(),
             "greek": "βαρ γορ δελ ζιμ καλ λεν μαρ νικ παρ ραλ σεν ταρ φωτ χαλ ψαρ ρεν".split()}


#: Attempts drawn from the stream; later ones stand for numbers.  Numbers of digits grow from attempt LONGER on by one in STEP.
ROUNDS, LONGER, STEP = 50, 21, 3
#: Attempts from which an address has its whole private range, another private range, and the unused public range.
RANGE, OTHER, UNUSED = 5, 10, 20


def any_of(words: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), (at % len(words)).cast("int"))


def kind_of(value: Column) -> Column:
    """The first pattern that the whole value fits."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(rf"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def bare_name(value: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(value, r"^\p{L}+\.?\p{IsWhite_Space}+", "")


def gender_of(value: Column) -> Column:
    return F.when(value.rlike("^(?:" + "|".join(TITLES["f"]) + r")(?!\p{L})"), F.lit("f")).otherwise(F.lit("m"))


def normal_form(kind: Column, value: Column) -> Column:
    """One text for all spellings of an entity."""
    digits = F.regexp_replace(value, r"\D", "")
    return (F.when(kind.isin("email", "secret"), F.lower(value))
            .when(kind == "phone", F.when(F.length(digits) > 10, F.right(digits, F.lit(10))).otherwise(digits))
            .when(kind.isin("card", "ssn"), digits)
            .when(kind == "name", F.concat(gender_of(value), F.lit(":"), F.lower(F.regexp_replace(bare_name(value), r"\p{IsWhite_Space}+", " "))))
            .otherwise(value))


def stream(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """128 hexadecimal digits that depend on key, kind, normal form and attempt."""
    part = lambda n: F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(n)), kind, attempt.cast("string"), normal).cast("binary"), 256)
    return F.concat(part(1), part(2))


def byte_at(bits: Column, i: Column) -> Column:
    """Byte number ``i`` (from 0, again from the start after 64) of a stream."""
    return F.conv(F.substr(bits, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replaced_characters(text: Column, bits: Column, hexadecimal: Column) -> Column:
    """Digits become digits and letters letters (in a secret any of 0-9a-f); all else stays."""
    def one(c: Column, i: Column) -> Column:
        n = byte_at(bits, i)
        return (F.when(hexadecimal, F.lower(F.hex(n % 16)))
                .when(c.rlike("[0-9]"), (n % 10).cast("string"))
                .when(c.rlike("[a-z]"), F.char(n % 26 + 97)).otherwise(c))

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.split(text, ""), one), "")).otherwise("")


def address(normal: Column, bits: Column, attempt: Column) -> Column:
    """An IPv4 address; private, loopback and link-local ranges keep the parts that make them such.

    Later attempts take all of 172.16-31, then 10 for the private and link-local ranges, then 240-255 for all.
    """
    keep = (F.when(normal.rlike(r"^(?:10|127)\."), 1).when(normal.rlike(r"^(?:192\.168|169\.254|172\.(?:1[6-9]|2\d|3[01]))\."), 2)
            .otherwise(0))
    free = F.when(attempt >= UNUSED, 0).when((attempt >= OTHER) & (keep == 2), 1).otherwise(keep)
    wide = (attempt >= RANGE) & (free == 2) & normal.startswith("172.")
    fresh = lambda i: (F.when((i == 0) & (attempt >= UNUSED), byte_at(bits, i) % 16 + 240)
                       .when(i == 0, byte_at(bits, i) % 99 + 11).otherwise(byte_at(bits, i) % 254 + 1))
    octet = lambda c, i: (F.when((i == 0) & (free == 1) & (keep == 2), F.lit("10")).when((i == 1) & wide, (byte_at(bits, i) % 16 + 16).cast("string"))
                          .when(i < free, c).otherwise(fresh(i).cast("string")))
    return F.array_join(F.transform(F.split(normal, r"\."), octet), ".")


def name(kind: Column, normal: Column, bits: Column, attempt: Column) -> Column:
    """A given name of the same gender, or a family name, of the same script; every attempt adds a syllable."""
    gender, out = F.substr(normal, F.lit(1), F.lit(1)), F.lit(None).cast("string")
    drawn = F.least(attempt, F.lit(ROUNDS))
    for script, test in (("latin", r"."), ("greek", r"\p{IsGreek}"), ("cyrillic", r"\p{IsCyrillic}")):
        given = F.when(gender == "f", any_of(GIVEN[script]["f"], byte_at(bits, F.lit(0)))).otherwise(any_of(GIVEN[script]["m"], byte_at(bits, F.lit(0))))
        added = F.array_join(F.transform(F.sequence(F.lit(1), drawn + 3), lambda i: any_of(SYLLABLES[script], byte_at(bits, i))), "")  # noqa: B023
        made = F.when(kind == "family", F.initcap(added)).otherwise(F.concat(given, F.substr(added, F.lit(1), drawn * 3)))
        out = F.when(normal.rlike(test), made).otherwise(out)
    return out


def numbered(kind: Column, normal: Column, number: Column) -> Column:
    """A surrogate for each number, different ones for different numbers of a kind."""
    digits = F.lpad(number.cast("string"), F.greatest(F.length(normal), F.lit(20)), "0")
    check = F.when(F.call_function("luhn_check", normal), F.lit(0)).otherwise(1)
    valid = F.get(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(digits, d.cast("string")))), F.lit(0))
    part = lambda n: (F.floor(number / (1 << n)) % 256).cast("string")
    four = F.concat_ws(".", (F.floor(number / (1 << 24)) % 16 + 240).cast("string"), part(16), part(8), part(0))
    out = F.lit(None).cast("string")
    for script, test in (("latin", r"."), ("greek", r"\p{IsGreek}"), ("cyrillic", r"\p{IsCyrillic}")):
        spelled = F.transform(F.split(F.lpad(F.hex(number), 16, "0"), ""), lambda c: any_of(SYLLABLES[script], F.conv(c, 16, 10)))  # noqa: B023
        out = F.when(normal.rlike(test), F.initcap(F.array_join(spelled, ""))).otherwise(out)
    return (F.when(kind == "email", F.concat(F.lit("n"), number.cast("string"), F.lit("@numbered.example")))
            .when(kind == "ip", F.when(number < 1 << 28, four).otherwise(F.concat_ws(".", four, F.floor(number / (1 << 28)).cast("string"))))
            .when(kind == "secret", F.lpad(F.lower(F.hex(number)), F.length(normal), "0"))
            .when(kind == "card", F.concat(digits, ((valid + check) % 10).cast("string")))
            .when(kind.isin("given", "family"), out).otherwise(digits))


def surrogate(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a normal form."""
    return bound(stream(kind, normal, attempt, key), lambda bits: drawn_from(bits, kind, normal, attempt))


def drawn_from(bits: Column, kind: Column, normal: Column, attempt: Column) -> Column:
    """The surrogate that a stream gives."""
    drawn = F.least(attempt, F.lit(ROUNDS))
    more = F.when(kind == "email", drawn).when(kind.isin("phone", "ssn", "card") & (drawn >= LONGER), F.floor((drawn - LONGER) / STEP) + 1).otherwise(0).cast("int")
    plain = replaced_characters(F.concat(normal, F.repeat(F.lit("0"), more)), bits, kind == "secret")
    before_top = F.left(normal, F.length(normal) - F.length(F.substring_index(normal, ".", -1)))
    before_top = F.replace(before_top, F.lit("@"), F.concat(F.repeat(F.lit("a"), more), F.lit("@")))
    body = F.substr(plain, F.lit(1), F.length(plain) - 1)
    checked = F.concat(body, F.get(F.filter(F.sequence(F.lit(0), F.lit(9)).cast("array<string>"),
                                            lambda d: F.call_function("luhn_check", F.concat(body, d))), F.lit(0)))
    return (F.when(attempt >= ROUNDS, numbered(kind, normal, attempt - ROUNDS))
            .when(kind == "email", F.concat(replaced_characters(before_top, bits, F.lit(False)), F.lit("example")))
            .when(kind == "ip", address(normal, bits, attempt))
            .when(kind == "card", F.when(F.call_function("luhn_check", normal), checked).otherwise(plain))
            .when(kind.isin("given", "family"), name(kind, normal, bits, attempt))
            .otherwise(plain))


def dressed(kind: Column, value: Column, made: Column) -> Column:
    """A surrogate in the spelling of the value that it replaces; digits it has more follow at the end."""
    signs = F.length(F.regexp_replace(value, "[^0-9A-Za-z]", ""))
    shift = F.when(kind == "phone", F.greatest(signs - 10, F.lit(0))).otherwise(0)

    def one(i: Column) -> Column:
        c = F.substr(value, i, F.lit(1))
        at = F.length(F.regexp_replace(F.substr(value, F.lit(1), i), "[^0-9A-Za-z]", "")) - shift
        new = F.substr(made, at, F.lit(1))
        return F.when(~c.rlike("[0-9A-Za-z]") | (at < 1), c).otherwise(new)

    spelled = F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")
    spelled = F.concat(spelled, F.substr(made, signs - shift + 1))
    loud = (value == F.upper(value)) & (value != F.lower(value))
    title = F.regexp_extract(value, r"^\p{L}+\.?\p{IsWhite_Space}+", 0)
    return (F.when(kind.isin("phone", "card", "ssn"), spelled)
            .when(kind == "name", F.concat(F.when(value.rlike(f"^(?:{NAME})$"), title).otherwise(""), made))
            .when(loud, F.upper(made)).otherwise(made))


def entities(found: Column) -> Column:
    """array<struct<value, kind, normal>> of an array of values; a bare repeat has the normal form of the titled name."""
    titled = lambda found: F.filter(found, lambda v: v.rlike(f"^(?:{NAME})$"))

    def one(value: Column) -> Column:
        def bare() -> Column:
            low = F.lower(F.regexp_replace(value, r"\p{IsWhite_Space}+", " "))
            forms = F.transform(titled(found), lambda v: normal_form(F.lit("name"), v))
            whole = F.get(F.filter(forms, lambda n: F.substr(n, F.lit(3)) == low), F.lit(0))
            return F.coalesce(whole, F.concat(F.lit("m:"), low))

        return F.get(F.transform(F.array(kind_of(value)), lambda kind: F.struct(
            value.alias("value"), F.coalesce(kind, F.lit("name")).alias("kind"),
            F.when(kind.isNull(), bare()).otherwise(normal_form(kind, value)).alias("normal"))), F.lit(0))

    return F.transform(found, one)


def parts(e: Column) -> Column:
    """array<struct<kind, normal>>: what gets surrogates of its own; of a name its given name with the gender, and its family name."""
    own = F.substr(e["normal"], F.lit(3))
    family = F.struct(F.lit("family").alias("kind"), F.substring_index(own, " ", -1).alias("normal"))
    given = F.struct(F.lit("given").alias("kind"), F.concat(F.left(e["normal"], F.lit(2)), F.substring_index(own, " ", 1)).alias("normal"))
    return (F.when(e["kind"] != "name", F.array(F.struct(e["kind"].alias("kind"), e["normal"].alias("normal"))))
            .when(F.instr(own, " ") > 0, F.array(given, family)).otherwise(F.array(family)))


def repeats(found: Column) -> Column:
    """A pattern of all values and of the bare repeats of the titled names among the found; null if there are none."""
    names = F.array_distinct(F.transform(F.filter(found, lambda v: v.rlike(f"^(?:{NAME})$")), bare_name))
    whole = F.transform(names, lambda n: F.regexp_replace(n, r"\p{IsWhite_Space}", r"\\p{IsWhite_Space}+"))
    family = F.transform(names, lambda n: F.regexp_extract(n, r"\p{L}+$", 0))
    words = F.array_sort(F.array_distinct(F.concat(whole, family)), lambda a, b: F.length(b) - F.length(a))
    return F.when(F.size(names) > 0, F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join(words, "|"), F.lit(r")(?!\p{L})")))


def common_form(kind: Column, normal: Column) -> Column:
    """The form in which surrogates and real values are compared: lower case, a given name without the gender."""
    return F.lower(F.when(kind == "given", F.regexp_replace(normal, "^[mf]:", "")).otherwise(normal))


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """The rows (kind, normal) with ``place`` 0, 1, 2, ...: ranges of a hash are counted, and ranked one by one."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), "kind", "normal").cast("binary"), 256)
    rows = rows.withColumn("_h", digest).withColumn("_b", F.left("_h", F.lit(4)))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    own = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "kind", "normal"))
    return (rows.join(sizes.select("_b", before.alias("_before")), "_b").withColumn("place", (F.col("_before") + own - 1).cast("int"))
            .drop("_h", "_b", "_before"))


def exceptions(known: DataFrame, key: str) -> DataFrame:
    """(kind, normal, attempt) of the entities (kind, normal) whose first attempt is not free.

    Of the entities that would share a surrogate the one with the smallest hash keeps it.  Later attempts also
    yield to every surrogate given before.  From attempt ``ROUNDS`` on, each round gives numbers not used yet; a taken
    value can refuse one number only, so the rounds end.
    """
    known = scratch_table(known.withColumn("attempt", F.lit(0))
                          .withColumn("made", surrogate(F.col("kind"), F.col("normal"), F.col("attempt"), key)), "entities")
    settled = waiting = known
    done, used = 0, ROUNDS
    while True:
        # One row for each surrogate in question: who takes it, and whether it is a real value or was given before.
        claims = waiting.select("kind", F.lower("made").alias("made"), F.struct(F.xxhash64("normal").alias("rank"), "normal").alias("who"), F.lit(0).alias("taken"))
        nobody = F.lit(None).cast(claims.schema["who"].dataType)
        real = known.select("kind", common_form(F.col("kind"), F.col("normal")).alias("made"), nobody.alias("who"), F.lit(1).alias("taken"))
        given = settled.join(waiting.select("kind", "normal"), ["kind", "normal"], "left_anti")
        given = given.select("kind", F.lower("made").alias("made"), nobody.alias("who"), F.lit(1).alias("taken"))
        asked = claims.unionAll(real.unionAll(given) if settled is not known else real)
        owners = (asked.groupBy("kind", "made").agg(F.count("who").alias("n"), F.min("who").alias("who"), F.max("taken").alias("taken"))
                  .where("n > 0 AND (n > 1 OR taken = 1)"))
        lost = (waiting.withColumn("made", F.lower("made")).join(owners, ["kind", "made"]).where((F.col("taken") == 1) | (F.col("normal") != F.col("who.normal")))
                .select("kind", "normal", (F.col("attempt") + 1).alias("attempt")))
        done += 1
        if done >= ROUNDS:
            lost = ranked(scratch_table(lost, "left"), key).select("kind", "normal", (F.col("place") + used).alias("attempt"))
        lost = scratch_table(lost.withColumn("made", surrogate(F.col("kind"), F.col("normal"), F.col("attempt"), key)), "lost")
        if lost.isEmpty():
            return settled.where("attempt > 0").select("kind", "normal", "attempt")
        if done >= ROUNDS:
            used += lost.count()
        kept = settled.join(lost.select("kind", "normal"), ["kind", "normal"], "left_anti")
        settled, waiting = kept.select(*lost.columns).unionAll(lost), lost


def replace(docs: DataFrame, key: str = "public example key") -> DataFrame:
    """The rows of ``docs`` with ``text`` rewritten, and ``n_replaced`` and ``kinds`` (the distinct kinds found).

    A null text stays null with 0 replaced; all other columns stay.  Columns of the two names are replaced.
    """
    nothing = F.array().cast("array<string>")
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(nothing)
    docs = docs.drop("n_replaced", "kinds")
    # Bare repeats are spellings of titled names, so the titled ones hold all entities.
    each = docs.select(F.explode(F.array_distinct(found)).alias("value"))
    each = each.select(F.explode(entities(F.array("value"))).alias("e")).select(F.explode(parts(F.col("e"))).alias("e")).select("e.kind", "e.normal")
    changed = exceptions(each.distinct(), key)
    place = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    plain = docs.withColumn("_found", found).withColumn("_any", repeats(F.col("_found")))
    plain = plain.withColumn("_found", F.when(F.col("_any").isNotNull(), F.regexp_extract_all("text", F.col("_any"), F.lit(0))).otherwise(F.col("_found")))
    plain = plain.withColumn("_found", entities(F.col("_found")))
    if changed.isEmpty():
        plain = plain.withColumn("_moved", F.lit(None).cast("map<string,int>"))
    else:
        # Texts that hold an exception, by two hashes of the text.
        held = (docs.select(*[h.alias(f"_h{i}") for i, h in enumerate(place)], F.explode(entities(F.array_distinct(found))).alias("e"))
                .select("_h0", "_h1", F.explode(parts(F.col("e"))).alias("e"))
                .select("_h0", "_h1", "e.kind", "e.normal").distinct().join(changed, ["kind", "normal"])
                .groupBy("_h0", "_h1").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "normal"), "attempt"))).alias("_moved")))
        plain = (plain.withColumn("_h0", place[0]).withColumn("_h1", place[1]).join(held, ["_h0", "_h1"], "left").drop("_h0", "_h1"))

    def fresh(e: Column) -> Column:
        def one(p: Column) -> Column:
            attempt = F.coalesce(F.try_element_at("_moved", F.concat_ws("|", p["kind"], p["normal"])), F.lit(0))
            return surrogate(p["kind"], p["normal"], attempt, key)

        return dressed(e["kind"], e["value"], F.array_join(F.transform(parts(e), one), " "))

    def woven(between: Column) -> Column:
        return F.concat(F.get(between, F.lit(0)), F.array_join(F.transform(
            F.col("_found"), lambda e, i: F.concat(fresh(e), F.get(between, i + 1))), ""))

    # The text between the values is split off once, not for each of them.
    text = F.get(F.transform(F.array(F.when(F.col("_any").isNull(), F.split("text", ANY, -1)).otherwise(F.split("text", F.col("_any"), -1))), woven), F.lit(0))
    return (plain.withColumn("n_replaced", F.size("_found"))
            .withColumn("kinds", F.array_distinct(F.transform("_found", lambda e: e["kind"])))
            .withColumn("text", F.when(F.col("n_replaced") > 0, text).otherwise(F.col("text")))
            .select(*docs.columns, "n_replaced", "kinds"))


def op8_surrogates(spark, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced."""
    return replace(documents(spark, sf_dir)).select("doc_id", "text", "n_replaced", "kinds")
