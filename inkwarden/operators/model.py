"""Text model as tables: terms, vocabulary, TF-IDF, training, scoring, explanations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.core import let, sigmoid
from ..functions.text import normalise, readable_tokens, term_words
from . import cells


def with_term_counts(docs: DataFrame, text: str, stop_words: list[str], name: str) -> DataFrame:
    """Adds ``name``: ``array<struct<term, tf>>``, counted inside the row, so nothing is shuffled."""
    return docs.withColumn(name, cells.counted(term_words(F.col(text)), stop_words))


def term_counts(docs: DataFrame, key: str, text: str, stop_words: list[str]) -> DataFrame:
    """``(key, term, tf)``, one document a row."""
    placed = with_term_counts(docs.select(key, text), text, stop_words, "_t")
    # Outer: the inner form makes Spark filter on the array first, computing it twice.
    return placed.select(key, F.inline_outer("_t")).where("term is not null")


def term_statistics(docs: DataFrame, text: str, stop_words: list[str]) -> DataFrame:
    """``(term, df, total)``: documents with the term, and all its occurrences."""
    return cells.statistics(docs, term_words(F.col(text)), stop_words)


def vocabulary(statistics: DataFrame, documents: DataFrame,
               min_df: int = fixed.MIN_DOCUMENT_FREQUENCY,
               max_share: float = fixed.MAX_DOCUMENT_SHARE,
               size: int = fixed.MAX_VOCABULARY) -> DataFrame:
    """``(term, df, total, n)``: frequent enough, not too common, the most used ones."""
    n = documents.agg(F.count("*")).scalar()
    kept = statistics.withColumn("n", n).where(
        (F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n")))
    return kept.orderBy(F.desc("total"), "term").limit(size)


def with_idf(vocab: DataFrame) -> DataFrame:
    return vocab.withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)


@dataclass(frozen=True)
class Lookup:
    """A bounded vocabulary with its numbers on the executors, sent once as a broadcast; plans hold none of it."""

    size: int
    sent: Broadcast

    @classmethod
    def of(cls, table: DataFrame, columns: list[str]) -> Lookup:
        """From ``term``, ``idf`` and, for contributions, ``coef``; more rows than a vocabulary may hold is an error."""
        rows = table.select("term", *columns).limit(fixed.MAX_VOCABULARY + 1).toPandas()
        if not 0 < len(rows) <= fixed.MAX_VOCABULARY:
            raise ValueError(f"a model needs 1 to {fixed.MAX_VOCABULARY} terms")
        found = cells.Weighted(rows["term"].tolist(), *([float(v) for v in rows[c]] for c in columns))
        return cls(len(rows), table.sparkSession.sparkContext.broadcast(found))

    def with_weights(self, docs: DataFrame, text: Column, stop_words: list[str], name: str) -> DataFrame:
        """Adds ``name``: ``struct<indices, weights>``, the TF-IDF of a text's terms with sublinear
        counts and unit length.  A projection: nothing is shuffled."""
        return docs.withColumn(name, cells.weights(self.sent, term_words(text), stop_words))


@dataclass(frozen=True)
class TextModel:
    """``terms``: (term, idf, coef), at most 50,000 rows because vocabularies are cut there."""

    terms: DataFrame
    intercept: float
    normaliser: str = "email"
    stop_words: tuple[str, ...] = tuple(fixed.CORPUS_STOP_WORDS)

    @cached_property
    def lookup(self) -> Lookup:
        return Lookup.of(self.terms, ["idf", "coef"])


def tfidf(docs: DataFrame, vocab: DataFrame, key: str, text: str,
          stop_words: list[str]) -> DataFrame:
    """``(key, term, weight)`` with sublinear counts and unit length per document."""
    lookup = Lookup.of(vocab, ["idf"])
    placed = docs.select(key, cells.named_weights(lookup.sent, term_words(F.col(text)), stop_words, "weight").alias("_w"))
    return placed.select(key, F.inline_outer("_w")).where("term is not null").select(key, "term", "weight")


def training_weights(frame: DataFrame, label: str = "label", row_weight: str = "row_weight") -> DataFrame:
    """Balanced class weight times row weight; two class rows are broadcast."""
    counts = frame.groupBy(label).agg(F.count("*").alias("class_rows"))
    total = frame.agg(F.count("*")).scalar()
    classes = counts.withColumn("class_weight", total / (2 * F.col("class_rows")))
    return (frame.join(F.broadcast(classes.select(label, "class_weight")), label)
            .withColumn("weight", F.col("class_weight") * F.col(row_weight)))


def _as_vector(weights: Column, size: int) -> Column:
    """Sparse ML vector, built by the JVM reader of the vector type."""
    from pyspark.ml.linalg import VectorUDT

    layout = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                      weights.indices.alias("indices"), weights.weights.alias("values"))
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(layout.alias("v"))), schema).getField("v")


def train(frame: DataFrame, curated: DataFrame | None = None, kind: str = "email",
          stop_words: list[str] | None = None, max_iterations: int = 100,
          min_df: int = fixed.MIN_DOCUMENT_FREQUENCY) -> TextModel:
    """Fit the logistic text model on ``(id, text, label)`` rows of normalised text.

    The optimiser aggregates gradients over partitions; only the coefficients (at most the
    vocabulary size) reach the driver.
    """
    from pyspark.ml.classification import LogisticRegression

    spark = frame.sparkSession
    stop = stop_words if stop_words is not None else (
        fixed.SMS_STOP_WORDS if kind == "sms" else fixed.CORPUS_STOP_WORDS)
    rows = frame.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), "text",
                        F.col("label").cast("double").alias("label"), F.lit(1.0).alias("row_weight"))
    if curated is not None:
        rows = rows.unionByName(curated.select(
            F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), "text",
            F.col("label").cast("double").alias("label"),
            F.lit(fixed.CURATED_WEIGHT[kind]).alias("row_weight")))
    statistics = term_statistics(rows, "text", stop)
    lookup = Lookup.of(with_idf(vocabulary(statistics, rows, min_df=min_df)), ["idf"])
    weighted = training_weights(rows)
    total = weighted.agg(F.sum("weight")).first()[0]
    placed = lookup.with_weights(weighted, F.col("text"), stop, "_w")
    data = placed.select("label", "weight", _as_vector(F.col("_w"), lookup.size).alias("features"))
    fitted = LogisticRegression(
        weightCol="weight", elasticNetParam=0.0, standardization=False, maxIter=max_iterations,
        regParam=1.0 / (fixed.INVERSE_REGULARISATION * total)).fit(data)
    table = spark.createDataFrame(
        [(t, i, float(c)) for t, i, c in zip(
            lookup.sent.value.terms, lookup.sent.value.idf.tolist(), fitted.coefficients.toArray(), strict=True)],
        "term string, idf double, coef double")
    return TextModel(table, float(fitted.intercept), "email" if kind == "email" else "sms", tuple(stop))


def with_contributions(docs: DataFrame, model: TextModel, text: str, name: str) -> DataFrame:
    """Adds ``name``: ``array<struct<contribution, term>>``, what each known term of the row's
    text adds to the log-odds.  A projection of the row: scoring never shuffles."""
    found = term_words(normalise(F.col(text), model.normaliser))
    return docs.withColumn(name, cells.named_weights(model.lookup.sent, found, list(model.stop_words), "contribution", scaled=True))


def contributions(docs: DataFrame, model: TextModel, key: str, text: str) -> DataFrame:
    """``(key, term, contribution)`` rows."""
    placed = with_contributions(docs.select(key, text), model, text, "_parts")
    return placed.select(key, F.inline_outer("_parts")).where("term is not null").select(
        key, "term", "contribution")


def best_terms(parts: Column, k: int, digits: int | None = None) -> Column:
    """The ``k`` terms that pushed most towards phishing; equal ones (after rounding to
    ``digits``, if given) in the order of the term."""
    value = lambda p: F.round(p.contribution, digits) if digits else p.contribution
    positive = F.filter(parts, lambda p: value(p) > 0)
    ordered = F.array_sort(F.transform(positive, lambda p: F.struct(
        (-value(p)).alias("k"), p.term.alias("term"))))
    return F.transform(F.slice(ordered, 1, k), lambda p: F.struct(
        (-p.k).alias("contribution"), p.term.alias("term")))


def top_terms(docs: DataFrame, model: TextModel, key: str, text: str, k: int = fixed.TOP_TERMS,
              digits: int | None = None) -> DataFrame:
    """``(key, term, contribution, rank)`` of the best terms per document."""
    placed = with_contributions(docs.select(key, text), model, text, "_parts")
    best = placed.select(key, F.posexplode_outer(best_terms(F.col("_parts"), k, digits)).alias(
        "_pos", "_t")).where("_t is not null")
    return best.select(key, F.col("_t.term").alias("term"), F.col("_t.contribution").alias("contribution"),
                       (F.col("_pos") + 1).alias("rank"))


def with_prediction(docs: DataFrame, model: TextModel, text: str, name: str,
                    k: int = fixed.TOP_TERMS) -> DataFrame:
    """Adds ``<name>_p`` (probability) and ``<name>_top`` (best terms) to every row."""
    placed = with_contributions(docs, model, text, "_parts")
    total = F.aggregate("_parts", F.lit(0.0), lambda acc, p: acc + p.contribution)
    return (placed.withColumn(f"{name}_p", sigmoid(total + F.lit(model.intercept)))
            .withColumn(f"{name}_top", best_terms(F.col("_parts"), k)).drop("_parts"))


def predict(docs: DataFrame, model: TextModel, key: str, text: str,
            k: int = fixed.TOP_TERMS) -> DataFrame:
    """``(key, probability, top array<struct<contribution, term>>)`` for every document."""
    return with_prediction(docs.select(key, text), model, text, "m", k).select(
        key, F.col("m_p").alias("probability"), F.col("m_top").alias("top"))


def token_counts(docs: DataFrame, key: str, text: str, kind: str = "email") -> DataFrame:
    return docs.select(key, readable_tokens(normalise(F.col(text), kind)).alias("tokens"))


def blended_top(first: Column, second: Column, k: int = fixed.TOP_TERMS) -> Column:
    """Explanation of two averaged models: weights count half each and add up per term."""
    def merged(both: Column) -> Column:
        names = F.array_distinct(F.transform(both, lambda t: t.term))
        return F.transform(names, lambda n: F.struct(
            (-F.aggregate(F.filter(both, lambda t: t.term == n), F.lit(0.0),
                          lambda acc, t: acc + t.contribution / 2)).alias("k"), n.alias("term")))

    # Bound once: the search for each name would sort both lists again.
    return F.slice(F.array_sort(let(F.concat(first, second), merged)), 1, k)


def fingerprint(model_terms: DataFrame) -> DataFrame:
    """One row that changes when any term, idf or coefficient of a model changes.

    Row digests are folded into 256 groups by commutative sums, so the order of the rows
    does not matter and nothing is collected.
    """
    row = F.sha2(F.concat_ws("|", "term", F.format_string("%.12e", "idf"),
                             F.format_string("%.12e", "coef")), 256)
    limbs = [F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)]
    sums = model_terms.agg(F.count("*").alias("rows"),
                           *[F.sum(limb).alias(f"s{i}") for i, limb in enumerate(limbs)])
    return sums.select("rows", F.sha2(F.concat_ws("|", *[f"s{i}" for i in range(8)]), 256)
                       .alias("fingerprint"))


def verify_fingerprint(model_terms: DataFrame, expected: str) -> DataFrame:
    """The terms, or an error before any is used when the fingerprint differs."""
    found = fingerprint(model_terms).first()["fingerprint"]
    if found != expected:
        raise ValueError("the model table does not match its registered fingerprint")
    return model_terms
