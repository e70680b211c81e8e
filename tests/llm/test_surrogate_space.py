"""Kinds of values with few surrogates: every count of entities ends with distinct ones."""

import re

import pytest
from pyspark.sql import functions as F

from inkwarden.llm import surrogates


def settled(spark, entities):
    known = spark.createDataFrame(entities, "kind string, normal string")
    moved = surrogates.exceptions(known, "k").withColumnRenamed("attempt", "a")
    rows = known.join(moved, ["kind", "normal"], "left").withColumn("a", F.coalesce("a", F.lit(0)))
    made = {(r[0], r[1]): r[2] for r in rows.select("kind", "normal", surrogates.surrogate(F.col("kind"), F.col("normal"), F.col("a"), "k")).collect()}
    assert len(made) == len(entities) and None not in made.values()
    assert len({(k, v) for (k, _), v in made.items()}) == len(entities)
    assert not {(k, v) for (k, _), v in made.items()} & set(entities)
    return made


def test_addresses_without_letters_before_the_top_level(spark):
    made = settled(spark, [("email", f"_@-.{top}") for top in ("com", "org", "net", "de")]
                   + [("email", f"{c}@{d}.{top}") for c in "abcdefgh" for d in "abcdefghijkl" for top in ("com", "org", "net", "de", "fr", "nl", "it", "es")])
    assert all(re.fullmatch(r"[a-z_]+@[a-z-]+\.example", v) for v in made.values())


def test_more_than_half_of_a_space(spark, monkeypatch):
    """Ninety of a hundred two-digit numbers, and more addresses than half of a range made small."""
    for name, at in {"RANGE": 2, "OTHER": 3, "LONGER": 4}.items():
        monkeypatch.setattr(surrogates, name, at)
    monkeypatch.setattr(surrogates, "byte_at", lambda bits, i, f=surrogates.byte_at: f(bits, i) % 10)
    made = settled(spark, [("ssn", f"{i:02d}") for i in range(90)] + [("ip", f"192.168.{i}.{j}") for i in range(1, 11) for j in range(1, 10)])
    assert any(v.startswith("10.") for v in made.values())


@pytest.mark.parametrize("rounds", [0, 2])
def test_what_is_left_is_numbered(spark, monkeypatch, rounds):
    monkeypatch.setattr(surrogates, "ROUNDS", rounds + 1)
    monkeypatch.setattr(surrogates, "byte_at", lambda bits, i: F.lit(3) + 0 * i)
    taken = [("email", f"n{i}@numbered.example") for i in range(5)] + [("ip", f"240.0.0.{i}") for i in range(9)]
    settled(spark, taken + [(k, v) for i in range(20) for k, v in (
        ("ip", f"8.8.4.{i}"), ("email", f"x{i}@y.org"), ("ssn", f"{i:09d}"), ("card", f"{i:016d}"), ("secret", f"{i:032x}"))])


def test_longer_numbers_keep_their_spelling(spark):
    rows = spark.createDataFrame([("phone", "+1 (212) 555-0199", "98765432101"), ("phone", "212-555-0199", "98765432101"), ("ssn", "123-45-6789", "9876543210")],
                                 "kind string, value string, made string")
    got = [r[0] for r in rows.select(surrogates.dressed(F.col("kind"), F.col("value"), F.col("made"))).collect()]
    assert got == ["+1 (987) 654-32101", "987-654-32101", "987-65-43210"]
