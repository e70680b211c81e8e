"""Texts that no pattern may recurse over or go through again and again."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from inkwarden.llm import surrogates

#: The address as first stated: labels, the last of at least two letters.
PLAIN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def test_addresses_are_those_of_the_plain_pattern(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "B", "7", ".", "-", "@", "co", "com", ".x", " "]) for _ in range(rng.randrange(2, 30))) for _ in range(4000)]
    texts += ["x@a.b.c.d", "x@a.com.1.2", "x@a.com-", "x@a..com", "x@a.co1.7", "x@1.2.3", "x@a.com.org.x.y", "x@a-.com"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = frame.select("text", F.regexp_extract_all("text", F.lit(surrogates.PATTERNS["email"]), F.lit(0)).alias("found")).collect()
    assert sum(bool(r["found"]) for r in got) > 300
    for r in got:
        assert r["found"] == PLAIN.findall(r["text"]), r["text"]


@pytest.fixture(scope="module")
def replaced(spark):
    """Texts of every shape by name, and what became of them."""
    texts = {"labels": "to a@" + "b." * 100_000 + "com now", "no top": "to a@" + "1." * 100_000 + "2 now",
             "local": "to " + "ab1" * 350_000 + "@site.org now", "digits": "7" * 1_000_000, "spaces": "Mr" + " " * 1_000_000 + "x",
             "signs": "@." * 300_000, "dots": "a@b" + ".co" * 100_000, "letters": "x" * 1_000_000 + " Mr Adam Smith",
             "many": "Mr Adam Smith and x@y.org, " * 2000}
    frame = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    began = time.time()
    out = {r["doc_id"]: r for r in surrogates.replace(frame).collect()}
    return texts, out, time.time() - began


def test_long_texts_end_in_time(replaced):
    texts, out, seconds = replaced
    assert out.keys() == texts.keys() and seconds < 240
    assert {k: r["n_replaced"] for k, r in out.items()} == {
        "labels": 1, "no top": 0, "local": 1, "digits": 0, "spaces": 0, "signs": 0, "dots": 1, "letters": 1, "many": 4000}


def test_long_values_keep_their_shape(replaced):
    texts, out, _ = replaced
    made = out["local"]["text"]
    assert re.fullmatch(r"to ([a-z][a-z][0-9]){350000}@[a-z]{4}\.example now", made) and made != texts["local"]
    assert re.fullmatch(r"to [a-z]@([a-z]\.){100000}example now", out["labels"]["text"])
    assert len(set(out["many"]["text"].split(", "))) == 2
