"""Evaluation aggregates: threshold metrics, curves, rates, variant choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .ordering import cumulative, score_bucket


def _ratio(top: Column, bottom: Column, digits: int = 4) -> Column:
    return F.round(F.when(bottom > 0, top / bottom).otherwise(0.0), digits)


def threshold_metrics(scored: DataFrame, by: list[str] | None = None, threshold: float = 0.5,
                      label: str = "label", score: str = "score") -> DataFrame:
    """tp, fp, tn, fn and the four rates; empty denominators give 0."""
    flagged, positive = F.col(score) >= threshold, F.col(label) == 1
    counts = scored.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(flagged & positive).alias("tp"),
        F.count_if(flagged & ~positive).alias("fp"), F.count_if(~flagged & ~positive).alias("tn"),
        F.count_if(~flagged & positive).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        *(by or []), "n", "tp", "fp", "tn", "fn", _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(fp, fp + tn).alias("false_positive_rate"))


def _per_score(scored: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    distinct = scored.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return distinct.withColumn("bucket", score_bucket(F.col("score")))


def roc_auc(scored: DataFrame, by: list[str] | None = None, label: str = "label",
            score: str = "score") -> DataFrame:
    """Area under the ROC curve with ties (average ranks), per group."""
    keys = by or []
    run = cumulative(_per_score(scored, keys, label, score), "bucket", "score", ["neg"], keys)
    # Every positive beats the negatives below its score and half of those at its score.
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2))
    out = run.groupBy(*keys).agg(won.alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("m"))
    return out.select(*keys, F.when((F.col("p") > 0) & (F.col("m") > 0), F.round(
        F.col("won") / (F.col("p") * F.col("m")), 4)).alias("roc_auc"))


def average_precision(scored: DataFrame, by: list[str] | None = None, label: str = "label",
                      score: str = "score") -> DataFrame:
    """Area under the precision-recall curve as the sum of recall steps times precision."""
    keys = by or []
    run = cumulative(_per_score(scored, keys, label, score), "bucket", "score", ["pos", "neg"],
                     keys, descending=True)
    step = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    out = run.groupBy(*keys).agg(F.sum(step).alias("s"), F.sum("pos").alias("p"))
    return out.select(*keys, F.when(F.col("p") > 0, F.round(F.col("s") / F.col("p"), 4)).alias("pr_auc"))


def scorer_summary(verdicts: DataFrame, by: list[str], threshold: float = fixed.QUARANTINE_THRESHOLD,
                   totals: bool = False) -> DataFrame:
    """Flagged and quarantined rates of the scorer and of its wording alone.

    ``verdicts``: ``action, analysed, text_probability`` and the grouping columns.  With
    ``totals`` the overall row comes from the same pass (grouping sets).
    """
    keys = [F.col(c) for c in by]
    grouped = verdicts.groupingSets([keys, []], *keys) if totals else verdicts.groupBy(*by)
    wording = F.col("analysed") & (F.col("text_probability") >= 0.5)
    certain = F.col("analysed") & (F.col("text_probability") >= threshold)
    sums = grouped.agg(
        F.count("*").alias("n"), F.count_if(~F.col("analysed")).alias("unanalysed_review"),
        F.count_if(F.col("action").isin("review", "quarantine")).alias("a"),
        F.count_if(F.col("action") == "quarantine").alias("b"),
        F.count_if(wording).alias("c"), F.count_if(certain).alias("d"))
    return sums.select(
        *by, "n", "unanalysed_review", _ratio(F.col("a"), F.col("n")).alias("flagged_rate"),
        _ratio(F.col("b"), F.col("n")).alias("quarantined_rate"),
        _ratio(F.col("c"), F.col("n")).alias("text_only_flagged_rate"),
        _ratio(F.col("d"), F.col("n")).alias("text_only_quarantined_rate"))


def two_threshold_rates(scored: DataFrame, by: list[str] | None = None,
                        threshold: float = fixed.QUARANTINE_THRESHOLD) -> DataFrame:
    """Counts and rates at 0.5 and at the quarantine threshold; a NULL score counts as 1."""
    keys = by or []
    score = F.coalesce(F.col("score"), F.lit(1.0))
    legit, phish = F.col("label") == 0, F.col("label") == 1
    at, high = score >= 0.5, score >= threshold
    sums = scored.groupBy(*keys).agg(
        F.count_if(legit).alias("n_legit"), F.count_if(phish).alias("n_phish"),
        F.count_if(legit & at).alias("fp_05"), F.count_if(legit & high).alias("fp_q"),
        F.count_if(phish & at).alias("tp_05"), F.count_if(phish & high).alias("tp_q"))
    c = F.col
    return sums.select(
        *keys, "n_legit", "n_phish", "fp_05", "fp_q",
        F.when(c("n_legit") > 0, F.round(c("fp_05") / c("n_legit"), 4)).alias("fpr_05"),
        F.when(c("n_legit") > 0, F.round(c("fp_q") / c("n_legit"), 4)).alias("fpr_q"),
        F.when(c("n_phish") > 0, F.round(c("tp_05") / c("n_phish"), 4)).alias("recall_05"),
        F.when(c("n_phish") > 0, F.round(c("tp_q") / c("n_phish"), 4)).alias("recall_q"),
        F.when((c("n_legit") > 0) & (c("n_phish") > 0), _ratio(
            2 * c("tp_05"), c("tp_05") + c("fp_05") + c("n_phish"))).alias("f1_05"))


def errors_by_category(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    wrong = (F.col("score") >= threshold).cast("int") != F.col("label")
    return scored.where(wrong).groupBy("category").agg(F.count("*").alias("errors"))


def choose_variant(results: DataFrame, simplicity: list[str], guards: Column) -> DataFrame:
    """The best eligible variant: F1, then false positives (quarantine, 0.5), then simplicity."""
    order = F.lit(None).cast("int")
    for place, name in enumerate(simplicity):
        order = F.when(F.col("variant") == name, F.lit(place)).otherwise(order)
    ranked = results.where(guards).withColumn("simplicity", order)
    return ranked.orderBy(F.desc("f1_05"), "fp_q", "fp_05", "simplicity").limit(1)


def rule_variants(reasons: DataFrame, hidden: dict[str, list[str]], key: str = "msg_id") -> DataFrame:
    """Scores per rule variant: the same reasons with some codes switched off.

    ``reasons``: ``key, code, weight`` rows.  One pass computes all variants side by side.
    """
    sums = reasons.groupBy(key).agg(*[
        F.sum(F.when(F.col("code").isin(codes) if codes else F.lit(False), 0.0)
              .otherwise(F.col("weight"))).alias(name) for name, codes in hidden.items()])
    stacked = F.explode(F.map_from_arrays(
        F.array(*[F.lit(n) for n in hidden]), F.array(*[F.col(n) for n in hidden])))
    return sums.select(key, stacked.alias("variant", "logit")).withColumn(
        "score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit"))))
