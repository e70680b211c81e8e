"""Ranks and cumulative sums over a whole table without a single-partition window.

Values are aggregated per distinct value first, then summed per bucket; only the bucket
totals (a bounded number) meet in one place, and inside a bucket the order is local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_LOGIT_BUCKETS_PER_UNIT = 256


def score_bucket(score: Column) -> Column:
    """Order-preserving bucket of a probability; at most 20,481 values.

    Log-odds spread the scores that pile up near 0 and 1.
    """
    inside = F.least(F.greatest(score, F.lit(1e-17)), F.lit(1.0 - 2.0 ** -53))
    odds = F.log(inside / (1 - inside))
    return F.floor(F.least(F.greatest(odds, F.lit(-40.0)), F.lit(40.0)) * _LOGIT_BUCKETS_PER_UNIT)


def cumulative(distinct: DataFrame, bucket: str, order: str, sums: list[str],
               keys: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Running totals ``cum_<c>`` (inclusive) of ``sums`` in the order of ``order``.

    ``distinct`` has one row per value; ``bucket`` must be monotone in ``order`` and bounded.
    """
    keys = keys or []
    direction = F.desc if descending else F.asc
    totals = distinct.groupBy(*keys, bucket).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = W.partitionBy(*keys).orderBy(direction(bucket)).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, bucket, *[
        F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums])
    local = W.partitionBy(*keys, bucket).orderBy(direction(order)).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    joined = distinct.join(offsets, [*keys, bucket])
    return joined.select(*distinct.columns, *[
        (F.col(f"_o_{c}") + F.sum(c).over(local)).alias(f"cum_{c}") for c in sums])


def exact_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row ``quantile``: linear interpolation between the two nearest order statistics.

    ``column`` is a bigint.  Four passes narrow the value down by 16 bits each, so every
    pass aggregates to at most 65,536 counts, whatever the distribution.
    """
    values = df.where(F.col(column).isNotNull()).select(
        F.col(column).cast("bigint").alias("v")).groupBy("v").agg(F.count("*").alias("c"))
    # Flipping the sign bit makes the unsigned digit order equal to the numeric order.
    digits = [F.shiftrightunsigned(F.col("v").bitwiseXOR(F.lit(-2 ** 63)), shift)
              .bitwiseAND(F.lit(0xFFFF)) for shift in (48, 32, 16, 0)]
    values = values.select("v", "c", *[d.alias(f"d{i}") for i, d in enumerate(digits)])
    at = values.agg((F.sum("c") - 1) * F.lit(float(q))).scalar()
    known: list[str] = []
    state = None
    for i in range(4):
        digit = f"d{i}"
        if state is None:
            ends = F.array_distinct(F.array(F.floor("at"), F.ceil("at")))
            counts = (values.groupBy(digit).agg(F.sum("c").alias("n")).withColumn("at", at)
                      .withColumn("k", F.explode(ends)).withColumn("left", F.col("k")))
        else:
            # ``state`` has at most two rows: the two order statistics looked for.
            counts = values.join(F.broadcast(state), known).groupBy(
                "k", "left", "at", *known, digit).agg(F.sum("c").alias("n"))
        run = W.partitionBy("k").orderBy(digit).rowsBetween(W.unboundedPreceding, W.currentRow)
        state = (counts.withColumn("upto", F.sum("n").over(run))
                 .where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left")))
                 .select("k", "at", (F.col("left") - F.col("upto") + F.col("n")).alias("left"),
                         *known, digit))
        known.append(digit)
    value = F.lit(0).cast("bigint")
    for i, shift in enumerate((48, 32, 16, 0)):
        value = value.bitwiseOR(F.shiftleft(F.col(f"d{i}"), shift))
    found = state.select("at", "k", value.bitwiseXOR(F.lit(-2 ** 63)).cast("double").alias("x"))
    return found.agg((F.min("x") + (F.max("x") - F.min("x")) * F.max(F.col("at") - F.floor("at")))
                     .alias("quantile"))
