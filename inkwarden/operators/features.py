"""Long findings table: explode, first-wins per message, layer risk, feature matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.core import exploded
from ..functions.findings import codes_of

LAYER_WEIGHTS = {"header": fixed.HEADER_WEIGHTS, "link": fixed.LINK_WEIGHTS, "sms": fixed.SMS_WEIGHTS}


def explode_findings(df: DataFrame, layer: str, column: str, key: str = "msg_id") -> DataFrame:
    """``(key, layer, pos, code, weight, detail)``."""
    rows = exploded(df, [key, F.lit(layer).alias("layer")], F.col(column), "pos")
    return rows.select(key, "layer", "pos", "code", "weight", "detail")


def first_wins_rows(findings: DataFrame, key: str = "msg_id") -> DataFrame:
    """The first detail per (message, layer, code).  Combined on the map side before the shuffle."""
    first = F.min_by(F.struct("weight", "detail"), "pos")
    return (findings.groupBy(key, "layer", "code").agg(first.alias("f"), F.min("pos").alias("pos"))
            .select(key, "layer", "code", "pos", "f.weight", "f.detail"))


def layer_risk(findings: DataFrame, key: str = "msg_id") -> DataFrame:
    """Capped sum of the weights per message and layer."""
    return findings.groupBy(key, "layer").agg(
        F.round(F.least(F.lit(1.0), F.sum("weight")), 3).alias("risk"))


def feature_matrix(df: DataFrame, key: str = "msg_id") -> DataFrame:
    """0/1 per code with stable column names, plus risks and counts.

    Works on message rows with ``header_findings``, ``link_findings`` and ``url_reports``:
    the pivot is a projection, no shuffle.
    """
    def flags(column: str, prefix: str, codes: dict[str, float]) -> list[Column]:
        found = codes_of(F.col(column))
        return [F.array_contains(found, c).cast("double").alias(prefix + c) for c in codes]

    header = flags("header_findings", "hdr_", fixed.HEADER_WEIGHTS)
    link = flags("link_findings", "lnk_", fixed.LINK_WEIGHTS)
    domains = F.array_distinct(F.filter(
        F.transform("url_reports", lambda r: r.domain), lambda d: d != ""))
    return df.select(
        key, *header, (F.col("auth_source") == "trusted").cast("double").alias("hdr_auth_trusted"),
        F.col("header_risk").alias("hdr_risk"), *link,
        F.size("url_reports").cast("double").alias("lnk_url_count"),
        F.size(domains).cast("double").alias("lnk_domain_count"), F.col("link_risk").alias("lnk_risk"))


def pivot_findings(findings: DataFrame, layer: str, prefix: str, key: str = "msg_id") -> DataFrame:
    """The same 0/1 columns from the long findings table (codes are a fixed list)."""
    codes = list(LAYER_WEIGHTS[layer])
    mine = findings.where(F.col("layer") == layer)
    return mine.groupBy(key).agg(*[
        F.max((F.col("code") == c).cast("double")).alias(f"{prefix}{c}") for c in codes])
