"""Findings as arrays of ``struct<code, weight, detail>`` inside a message row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let, weight_map

FINDINGS_TYPE = "array<struct<code:string,weight:double,detail:string>>"


def first_wins(details: Column, weights: dict[str, float]) -> Column:
    """Keep the first detail per code and attach the code's weight."""
    table = weight_map(weights)

    def build(items: Column) -> Column:
        codes = F.array_distinct(F.transform(items, lambda d: d.code))
        return F.transform(codes, lambda c: F.struct(
            c.alias("code"), F.try_element_at(table, c).alias("weight"),
            F.get(F.filter(items, lambda d: d.code == c), F.lit(0)).detail.alias("detail")))

    return let(details, build)


def detail_if(code: str, condition: Column, detail: Column) -> Column:
    """A ``struct<code, detail>`` when the condition holds, NULL otherwise."""
    return F.when(condition, F.struct(F.lit(code).alias("code"), detail.alias("detail")))


def codes_of(findings: Column) -> Column:
    return F.transform(findings, lambda f: f.code)


def total_weight(findings: Column) -> Column:
    return F.aggregate(findings, F.lit(0.0), lambda acc, f: acc + f.weight)


def risk(findings: Column) -> Column:
    """Sum of the weights, capped at 1, three decimals."""
    return F.round(F.least(F.lit(1.0), total_weight(findings)), 3)


def no_findings() -> Column:
    return F.array().cast(FINDINGS_TYPE)
