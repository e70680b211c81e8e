"""Long, short and bare forms of a name agree, and no surrogate is a name of the corpus."""

import re

from pyspark.sql import functions as F

from inkwarden.llm import surrogates


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r["doc_id"]: r for r in surrogates.replace(docs).collect()}


def test_forms_of_a_name_agree(spark):
    rows = replaced(spark, ["Mr. John Smith came. Mr. Smith left, John  Smith stayed; Smith's hat, Smithson's coat.",
                            "Herr Smith here", "John Smith without a title", "Ms. Ann Smith and Mr. John Jones",
                            "Господин Иван Петров, затем Иван Петров и Петров"])
    one = re.fullmatch(r"Mr\. (\w+) (\w+) came\. Mr\. (\w+) left, (\w+) (\w+) stayed; (\w+)'s hat, Smithson's coat\.", rows[0]["text"])
    given, family = one[1], one[2]
    assert one[3] == one[5] == one[6] == family and one[4] == given and family.lower() != "smith" and given.lower() != "john"
    assert rows[0]["n_replaced"] == 4 and rows[0]["kinds"] == ["name"]
    assert rows[1]["text"] == f"Herr {family} here" and rows[2]["text"] == "John Smith without a title"
    other = re.fullmatch(r"Ms\. (\w+) (\w+) and Mr\. (\w+) (\w+)", rows[3]["text"])
    assert other[2] == family and other[3] == given and other[4] != family
    assert "Петров" not in rows[4]["text"] and len(set(re.findall(r"\w+", rows[4]["text"])[2::3])) <= 2


def test_no_surrogate_is_a_real_name(spark):
    """The first surrogates of some names are made real; then they are given to nobody."""
    own = [("family", f"smith{c}") for c in "abcdefgh"] + [("given", "m:john"), ("given", "f:ann")]
    made = lambda rows: [r[0] for r in spark.createDataFrame(rows, "kind string, normal string, a int").select(
        surrogates.surrogate(F.col("kind"), F.col("normal"), F.col("a"), "k")).collect()]
    first = made([(k, n, 0) for k, n in own])
    real = own + [(k, ("f:" if k == "given" else "") + m.lower()) for (k, _), m in zip(own, first, strict=True)]
    known = spark.createDataFrame(real, "kind string, normal string").distinct()
    moved = {(r["kind"], r["normal"]): r["attempt"] for r in surrogates.exceptions(known, "k").collect()}
    assert all(moved.get(e, 0) > 0 for e in own)
    last = made([(*e, moved.get(e, 0)) for e in real])
    assert not {m.lower() for m in last} & {n.split(":")[-1] for _, n in real}
