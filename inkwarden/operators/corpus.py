"""Corpus building: union, first-wins duplicates, splits, counts, quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.core import literals
from ..functions.text import dedup_key
from .ordering import exact_quantile


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Union by name with a ``source`` column; missing columns become NULL."""
    named = [df.withColumn("source", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def drop_near_duplicates(corpus: DataFrame, rank: str, row: str, text: str = "text",
                         min_chars: int = fixed.MIN_EMAIL_CHARS) -> DataFrame:
    """Keep the first copy per leading 2,000 characters, ordered by (rank, row).

    The minimum is combined before the shuffle, so a text copied over a third of the table
    arrives as one row per task; nothing is collected per group.  Short texts go last: they
    only ever share a key with themselves, and a filter up front would be pushed below the
    projection that normalises, which would then run twice.
    """
    columns = [c for c in corpus.columns]
    first = F.min_by(F.struct(*columns), F.struct(rank, row))
    return (corpus.groupBy(F.sha2(dedup_key(F.col(text)), 256).alias("_key"))
            .agg(first.alias("_row")).select("_row.*").where(F.length(text) >= min_chars))


def drop_excluded(deduplicated: DataFrame, label: str = "label") -> DataFrame:
    """Rows without a label took part in the duplicate removal; now they go."""
    return deduplicated.where(F.col(label).isNotNull())


def source_rank(source: Column, priority: list[str]) -> Column:
    """Position of a source in the priority list."""
    return F.array_position(literals(priority), source).cast("int")


#: Labels whose boundaries are broadcast, a row each.
MOST_LABELS = 10_000


def stratified_split(corpus: DataFrame, key: str, label: str = "label",
                     test_share: float = fixed.TEST_SHARE, seed: str = "42") -> DataFrame:
    """Adds ``split``: exactly ``floor(share * rows)`` test rows per label, chosen by hash.

    Selecting the smallest hashes per label needs a rank per label.  Hashes are counted in 65,536 ranges; only the
    keys in the range that holds the boundary are ranked.  That gives the last test key of each label, and every
    row is decided by comparing with it: one row per label, at most ``MOST_LABELS``, is broadcast, and no text is
    shuffled.  More labels are refused.
    """
    from pyspark.sql import Window as W

    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))
    hashed = corpus.select(label, F.col(key).alias("_k"), digest.alias("_h")).withColumn("_b", F.left("_h", F.lit(4)))
    ranges = hashed.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    run = W.partitionBy(label).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(label)
    bounds = ranges.select(
        label, "_b", (F.sum("_n").over(run) - F.col("_n")).alias("_before"),
        F.floor(F.sum("_n").over(whole) * F.lit(test_share)).alias("_wanted"))
    edge = bounds.where((F.col("_before") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_before") + F.col("_n")))
    near = hashed.join(edge.select(label, "_b", (F.col("_wanted") - F.col("_before")).alias("_rest")), [label, "_b"])
    local = F.row_number().over(W.partitionBy(label).orderBy("_h", "_k"))
    last = (near.withColumn("_i", local).where("_i <= _rest").groupBy(F.col(label).alias("_label"))
            .agg(F.max(F.struct("_h", "_k")).alias("_last")))
    rows = last.limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels: a stratified split is for classes, not for keys")
    last = corpus.sparkSession.createDataFrame(rows, last.schema)
    own = F.struct(digest.alias("_h"), F.col(key).alias("_k"))
    placed = corpus.join(F.broadcast(last), F.col(label) == F.col("_label"), "left")
    return (placed.withColumn("split", F.when(F.coalesce(own <= F.col("_last"), F.lit(False)), "test").otherwise("train"))
            .drop("_label", "_last"))


def time_split(corpus: DataFrame, order: str, share: float = fixed.TRAIN_QUANTILE) -> DataFrame:
    """Adds ``split``: rows up to the quantile of ``order`` train, newer ones test."""
    cut = exact_quantile(corpus, order, share).scalar()
    return corpus.withColumn("cutoff", cut).withColumn(
        "split", F.when(F.col(order) <= F.col("cutoff"), "train").otherwise("test"))


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """Rows by source and label with subtotals; totals carry ``level`` > 0."""
    return (corpus.rollup("source", "label").agg(
        F.count("*").alias("rows"), F.grouping_id().alias("level")))


def expand_templates(templates: DataFrame, slots: dict[str, list[str]], variants: int = 8,
                     seed: str = "2026") -> DataFrame:
    """``(template_id, label, category, template)`` to distinct filled texts with variants.

    A slot value depends only on the seed, the template, the variant and the slot name.
    """
    rows = templates.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    text = F.col("template")
    for name, values in slots.items():
        digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("template_id").cast("string"),
                                   F.col("variant").cast("string"), F.lit(name)))
        number = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint")
        pick = F.get(literals(values), (number % len(values)).cast("int"))
        text = F.replace(text, F.lit("{" + name + "}"), pick)
    filled = rows.withColumn("text", text)
    return filled.groupBy("text").agg(
        F.min_by(F.struct("template_id", "label", "category", "variant"),
                 F.struct("template_id", "variant")).alias("r")).select("r.*", "text")


def quality_violations(evals: DataFrame, splits: list[str], max_imbalance: int = 2) -> DataFrame:
    """``(check, item, n)`` rows that break a rule of an evaluation set; empty when clean."""
    def rows(df: DataFrame, check: str, item: Column, n: Column) -> DataFrame:
        return df.select(F.lit(check).alias("check"), item.cast("string").alias("item"),
                         n.cast("bigint").alias("n"))

    ids = evals.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    texts = evals.groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n")).where("n > 1")
    odd = evals.where(~F.col("split").isin(splits) | ~F.col("label").isin(0, 1))
    balance = evals.groupBy("split").agg(
        F.abs(F.sum(F.when(F.col("label") == 1, 1).otherwise(-1))).alias("n")).where(
        F.col("n") > max_imbalance)
    one_sided = evals.groupBy("category", "label").agg(
        F.countDistinct("split").alias("n")).where(F.col("n") < len(splits))
    phones = evals.where(F.regexp_like("text", F.lit(r"(?:^|[^0-9])[6-9][0-9]{9}(?:[^0-9]|$)")))
    links = evals.where(F.regexp_like("text", F.lit(r"(?i)https?://|www\.|@[a-z0-9-]+\.[a-z]")))
    one = F.lit(1)
    parts = [
        rows(ids, "duplicate_id", F.col("id"), F.col("n")),
        rows(texts, "duplicate_text", F.col("text_md5"), F.col("n")),
        rows(odd, "bad_domain", F.col("id"), one),
        rows(balance, "label_balance", F.col("split"), F.col("n")),
        rows(one_sided, "category_one_sided", F.concat_ws("|", "category", F.col("label").cast("string")),
             F.col("n")),
        rows(phones, "phone_number", F.col("id"), one),
        rows(links, "link_or_address", F.col("id"), one),
    ]
    return reduce(DataFrame.unionByName, parts)


def frozen_overlap(training: DataFrame, frozen: DataFrame, text: str = "text") -> DataFrame:
    """Training rows whose text key occurs among the frozen evaluation texts."""
    keys = frozen.select(F.sha2(dedup_key(F.col(text)), 256).alias("_key")).distinct()
    return (training.withColumn("_key", F.sha2(dedup_key(F.col(text)), 256))
            .join(keys, "_key", "left_semi").drop("_key"))


def attach_raw_text(selection: DataFrame, raw: DataFrame, key: str, raw_text: str,
                    row: str) -> DataFrame:
    """Raw text by normalised key; the first occurrence wins, the key itself is the fallback."""
    firsts = raw.groupBy(F.sha2(F.col(key), 256).alias("_key")).agg(
        F.min_by(F.col(raw_text), F.col(row)).alias("_raw"))
    joined = selection.withColumn("_key", F.sha2(dedup_key(F.col("text")), 256)).join(
        firsts, "_key", "left")
    return joined.withColumn("raw_text", F.coalesce("_raw", "text")).drop("_key", "_raw")
