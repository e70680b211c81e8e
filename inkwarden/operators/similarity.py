"""Leakage audit: training texts that reuse the wording of frozen evaluation texts.

Two exact tests: a shared run of five words, and a Jaccard similarity of the word sets of
0.4 or more.  Neither compares all pairs: runs meet by hash, and sets meet only through the
rare words that any similar pair must share (prefix filter) within matching sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

RUN = 5
LIMIT = 0.4


def _runs(df: DataFrame, key: str, text: str) -> DataFrame:
    tokens = df.select(key, words(F.lower(F.col(text))).alias("w"))
    starts = F.when(F.size("w") >= RUN, F.sequence(F.lit(1), F.size("w") - (RUN - 1)))
    run = F.transform(starts, lambda i: F.array_join(F.slice("w", i, RUN), " "))
    # Outer: the inner form makes Spark filter on the array first, computing it twice.
    return tokens.select(key, F.explode_outer(F.array_distinct(run)).alias("run")).where("run is not null")


def shared_runs(training: DataFrame, frozen: DataFrame, key: str, text: str = "text",
                frozen_text: str = "text") -> DataFrame:
    """``(key, shared_runs)``: number of distinct five-word runs found in any frozen text.

    Runs are hashed to 16 bytes before the shuffle; the frozen side is made distinct, so the
    join is a lookup and a frequent run cannot multiply rows.
    """
    mine = _runs(training, key, text).select(key, F.unhex(F.md5("run")).alias("run"))
    theirs = _runs(frozen.withColumn("_f", F.lit(0)), "_f", frozen_text).select(
        F.unhex(F.md5("run")).alias("run")).distinct()
    return (mine.join(theirs, "run", "left_semi").groupBy(key)
            .agg(F.count("*").alias("shared_runs")))


def similar_pairs(training: DataFrame, frozen: DataFrame, key: str, frozen_key: str,
                  text: str = "text", frozen_text: str = "text", limit: float = LIMIT) -> DataFrame:
    """``(key, frozen_key, common, jaccard)`` for all pairs with Jaccard >= ``limit``.

    Equal word sets are compared once and expanded afterwards, so a text copied many times
    costs one comparison.  With words ordered from rare to frequent, two sets as similar as
    the limit share a word among the first ``n - ceil(limit * n) + 1`` words of both.
    """
    def sets(df: DataFrame, k: str, t: str) -> DataFrame:
        unique = df.select(k, F.array_sort(F.array_distinct(words(F.lower(F.col(t))))).alias("w"))
        return unique.withColumn("set_id", F.sha2(F.array_join("w", " "), 256))

    mine, theirs = sets(training, key, text), sets(frozen, frozen_key, frozen_text)
    mine_sets = mine.groupBy("set_id").agg(F.first("w").alias("w"))
    frozen_sets = theirs.groupBy("set_id").agg(F.first("w").alias("w"))
    longest = frozen_sets.agg(F.max(F.size("w"))).scalar()
    mine_sets = mine_sets.where(F.size("w") * F.lit(limit) <= longest)

    frequency = (mine_sets.select(F.explode("w").alias("word")).groupBy("word")
                 .agg(F.count("*").alias("f")))

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        cells = df.select("set_id", F.size("w").alias("n"), F.explode("w").alias("word"))
        known = cells.join(frequency, "word", "left").select(
            "set_id", "n", F.struct(F.coalesce("f", F.lit(0)).alias("f"), "word").alias("c"))
        ordered = known.groupBy("set_id", "n").agg(F.array_sort(F.collect_list("c")).alias("cells"))
        keep = F.col("n") - F.ceil(F.col("n") * F.lit(limit)) + 1
        return ordered.select(F.col("set_id").alias(name), F.col("n").alias(f"{name}_n"), F.explode(
            F.transform(F.slice("cells", F.lit(1), keep.cast("int")), lambda c: c.word)).alias("word"))

    left, right = prefixes(mine_sets, "_a"), prefixes(frozen_sets, "_b")
    sized = ((F.col("_a_n") >= F.col("_b_n") * F.lit(limit)) & (F.col("_b_n") >= F.col("_a_n") * F.lit(limit)))
    candidates = left.join(right, "word").where(sized).select("_a", "_b").distinct()
    with_a = candidates.join(mine_sets.select(F.col("set_id").alias("_a"), F.col("w").alias("_aw")), "_a")
    both = with_a.join(frozen_sets.select(F.col("set_id").alias("_b"), F.col("w").alias("_bw")), "_b")
    common = F.size(F.array_intersect("_aw", "_bw"))
    pairs = both.select("_a", "_b", common.alias("common"),
                        (common / (F.size("_aw") + F.size("_bw") - common)).alias("jaccard")).where(
        F.col("jaccard") >= limit)
    out = (pairs.join(mine.select(key, F.col("set_id").alias("_a")), "_a")
           .join(theirs.select(frozen_key, F.col("set_id").alias("_b")), "_b"))
    return out.select(key, frozen_key, F.col("common").cast("bigint").alias("common"), "jaccard")
