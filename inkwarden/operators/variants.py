"""Models that differ in their training rows, texts, weights or stop words, fitted side by side and compared on the same tests.

The variants that share a text and a stop list share a view of the corpus: its terms are counted once by the set of variants a row
trains, and a variant's vocabulary is the sum over the sets it is in.  Texts are packed in chunks (``packed.py``); one pass
counts the terms of all views, one writes their features, every round of the optimiser is one job for all variants and one pass scores them all.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import term_words
from ..session import written
from . import evaluate, fusion, holdout, packed

#: Variants and test sets are bits of a number, and of sets of variants there are at most as many as such numbers.
MOST_VARIANTS = 16


class Variant(NamedTuple):
    """A model: the column of its text, its training rows, its stop words, and the weight of a row (none: 1)."""

    name: str
    text: str
    rows: Column
    stop_words: tuple[str, ...] = tuple(fixed.CORPUS_STOP_WORDS)
    weight: Column | None = None


def _bits(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)], F.lit(0))


def _in(bits: str, place: int) -> Column:
    return F.getbit(F.col(bits), F.lit(place)) == 1


def _trains(own: list[int]):
    """Of some sets of variants, those that train each of ``own``."""
    return lambda sets: np.array([[int(x) >> k & 1 for x in sets] for k in own], bool).reshape(len(own), -1)


def _weigh(variants: int, by_class: dict[int, dict[int, float]]):
    """Weights of rows (label, trains, own) in the fits."""
    def weights(kept: pa.StructArray) -> np.ndarray:
        label, trains = (kept.field(c).to_numpy(zero_copy_only=False) for c in ("label", "trains"))
        own = kept.field("own").flatten().to_numpy(zero_copy_only=False).reshape(-1, variants)
        out = np.zeros((variants, len(kept)))
        for k, each in by_class.items():
            out[k] = np.where(trains >> k & 1, own[:, k] * np.where(label == 1, each[1], each[0]), 0.0)
        return out

    return weights


def variant_rates(corpus: DataFrame, variants: list[Variant], tests: dict[str, Column],
                  blends: dict[str, tuple[str, str]] | None = None, rounds: int = 20) -> DataFrame:
    """``variant, test_set, n_train, n_terms`` and the rates of :func:`evaluate.two_threshold_rates`.

    ``corpus`` has ``label`` (rows with other values than 0 and 1 are left out) and the columns the variants and tests
    name.  A blend is the mean of two variants' log-odds; its rows and terms are those of the first.  A
    variant without rows of both classes is left out, and so are its blends.  Null texts have no terms, null conditions
    do not hold, null weights are 1.
    """
    if not 0 < len(variants) <= MOST_VARIANTS or not 0 < len(tests) <= MOST_VARIANTS:
        raise ValueError(f"one to {MOST_VARIANTS} variants and test sets are compared at once")
    spark, names = corpus.sparkSession, [v.name for v in variants]
    views = list(dict.fromkeys((v.text, v.stop_words) for v in variants))
    texts = list(dict.fromkeys(text for text, _ in views))
    weights = [F.lit(1.0) if v.weight is None else F.coalesce(v.weight.cast("double"), F.lit(1.0)) for v in variants]
    trains = _bits([v.rows for v in variants])
    rows = corpus.select(F.col("label").cast("int").alias("label"), *[term_words(F.col(t)).alias(f"words_{i}") for i, t in enumerate(texts)],
                         trains.alias("trains"), _bits(list(tests.values())).alias("tests"),
                         F.array(*weights).alias("own")).where("label IN (0, 1) AND (trains > 0 OR tests > 0)")
    # The views read the same words, so texts, roles and splits are worked out once.
    rows = rows.select("*", (F.col("trains") > 0).alias("trained"), F.col("trains").cast("string").alias("group"))
    chunks = packed.pack(rows, [f"words_{i}" for i in range(len(texts))])
    rows = chunks.select(F.inline("kept"))
    sums = [F.sum(F.get("own", F.lit(k))).alias(f"w_{k}") for k in range(len(variants))]
    counts = rows.where("trains > 0").groupBy("trains", "label").agg(F.count("*").alias("n"), *sums).toPandas()

    # Balanced class weights: a variant's rows over twice those of the class.
    by_class, sizes, totals = {}, np.zeros(len(variants), np.int64), np.zeros(len(variants))
    for k in range(len(variants)):
        own = counts[(counts["trains"].to_numpy(np.int64) >> k & 1) == 1].groupby("label")[["n", f"w_{k}"]].sum()
        sizes[k] = own["n"].sum()
        if len(own) == 2:
            by_class[k] = {label: sizes[k] / (2 * n) for label, n in own["n"].items()}
            totals[k] = sum(by_class[k][label] * w for label, w in own[f"w_{k}"].items())

    places = [(texts.index(text), stop) for text, stop in views]
    fits_of = [[k for k, v in enumerate(variants) if (v.text, v.stop_words) == view] for view in views]
    found = packed.vocabularies(packed.statistics(chunks, places), {i: _trains(own) for i, own in enumerate(fits_of)},
                                {i: sizes[own] for i, own in enumerate(fits_of)})
    words, idf, known = [], [np.zeros(0)] * len(variants), np.zeros(len(variants), np.int64)
    for i, own in enumerate(fits_of):
        terms, df = found[i]
        words.append(terms)
        for k, rows_with in zip(own, df, strict=True):
            idf[k], known[k] = np.where(rows_with > 0, np.log((1 + sizes[k]) / (1 + rows_with)) + 1, 0.0), (rows_with > 0).sum()
    table = packed.features(chunks, places, words, idf, fits_of, _weigh(len(variants), by_class), ["label", "tests"])
    fits = holdout.fit_many(table, fits_of, idf, totals, rounds)

    fitted = [names[k] for k in sorted(by_class)]
    scored = table.mapInArrow(holdout.scores_of(spark.sparkContext.broadcast(fits), ["label", "tests"]),
                              "label int, tests int, scores array<double>").where("tests > 0")
    score = {name: F.get("scores", F.lit(names.index(name))) for name in fitted}
    facts = {name: (int(sizes[names.index(name)]), int(known[names.index(name)])) for name in fitted}
    for name, (first, second) in (blends or {}).items():
        if first in fitted and second in fitted:
            score[name], facts[name] = fusion.blend(score[first], score[second]), facts[first]
    if not score:
        raise ValueError("no variant has rows of both classes")
    each = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(facts[n][0]).cast("bigint").alias("n_train"),
                              F.lit(facts[n][1]).cast("bigint").alias("n_terms"), c.alias("score")) for n, c in score.items()])
    sets = F.array_compact(F.array(*[F.when(_in("tests", i), F.lit(name)) for i, name in enumerate(tests)]))
    measured = scored.select("label", F.explode(sets).alias("test_set"), each.alias("each")).select("label", "test_set", F.inline("each"))
    # A row a variant and test set, read several times by those who compare them.
    return written(evaluate.two_threshold_rates(measured, ["variant", "test_set", "n_train", "n_terms"]))


def guarded(rates: DataFrame, validation: str, guards: dict[str, tuple[str, float | None, float | None]], simplicity: list[str]) -> DataFrame:
    """The rates on the ``validation`` set, one row a variant, with each guard's value, ``eligible`` and ``chosen``.

    A guard is a test set and the greatest false-alarm rate and least recall at 0.5 that its name asks for; a rate that
    does not exist fails it.  The choice is that of :func:`evaluate.choose_variant`.
    """
    values, holds = [], F.lit(True)
    for name, (test_set, most, least) in guards.items():
        here = F.col("test_set") == test_set
        values += [F.max(F.when(here, F.col("fpr_05"))).alias(f"{name}_fpr"), F.max(F.when(here, F.col("recall_05"))).alias(f"{name}_recall")]
        if most is not None:
            holds = holds & F.coalesce(F.col(f"{name}_fpr") <= most, F.lit(False))
        if least is not None:
            holds = holds & F.coalesce(F.col(f"{name}_recall") >= least, F.lit(False))
    out = rates.where(F.col("test_set") == validation).drop("test_set").join(rates.groupBy("variant").agg(*values), "variant")
    out = out.withColumn("eligible", holds)
    best = evaluate.choose_variant(out, simplicity, F.col("eligible")).select("variant", F.lit(True).alias("_best"))
    return out.join(F.broadcast(best), "variant", "left").withColumn("chosen", F.coalesce("_best", F.lit(False))).drop("_best")
