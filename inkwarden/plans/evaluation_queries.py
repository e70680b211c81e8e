"""Registered queries: evaluation aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import evaluate as e
from . import inputs
from . import oracle as o
from .text_queries import labelled_documents

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return add


def _scored(spark, sf_dir):
    return inputs.scored(spark, sf_dir)


_ONE = f"WITH {inputs.SCORED_SQL}, s AS (SELECT *, coalesce(score, 1.0) AS sc FROM scored)"


def _ratio(a, b):
    return f"round(CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END, 4)"


@register("threshold_metrics", f"""{_ONE}, c AS (SELECT category, count(*) AS n, count(*) FILTER (sc >= 0.5 AND label = 1) AS tp,
    count(*) FILTER (sc >= 0.5 AND label <> 1) AS fp, count(*) FILTER (sc < 0.5 AND label <> 1) AS tn,
    count(*) FILTER (sc < 0.5 AND label = 1) AS fn FROM s GROUP BY category)
  SELECT category, n, tp, fp, tn, fn, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall,
    {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {_ratio('fp', 'fp + tn')} AS false_positive_rate FROM c""")
def threshold_metrics(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("score", F.coalesce("score", F.lit(1.0)))
    return e.threshold_metrics(rows, ["category"])


@register("roc_auc", f"""{_ONE}, r AS (SELECT category, label, rank() OVER (PARTITION BY category ORDER BY sc)
    + (count(*) OVER (PARTITION BY category, sc) - 1) / 2.0 AS rk FROM s),
  a AS (SELECT category, sum(rk) FILTER (label = 1) AS rs, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS m FROM r GROUP BY category)
  SELECT category, CASE WHEN p > 0 AND m > 0 THEN round((rs - p * (p + 1) / 2.0)::DOUBLE / (p * m), 4) END AS roc_auc FROM a""")
def roc_auc(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("score", F.coalesce("score", F.lit(1.0)))
    return e.roc_auc(rows, ["category"])


@register("average_precision", f"""{_ONE}, d AS (SELECT category, sc, count(*) FILTER (label = 1) AS pos, count(*) AS n FROM s GROUP BY ALL),
  c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM d WINDOW w AS (PARTITION BY category ORDER BY sc DESC))
  SELECT category, CASE WHEN sum(pos) > 0 THEN round(sum(pos * cp / cn) / sum(pos), 4) END AS pr_auc FROM c GROUP BY category""")
def average_precision(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("score", F.coalesce("score", F.lit(1.0)))
    return e.average_precision(rows, ["category"])


_SUMMARY = f"""count(*) AS n, count(*) FILTER (NOT analysed) AS unanalysed_review,
    {_ratio("count(*) FILTER (action IN ('review', 'quarantine'))", 'count(*)')} AS flagged_rate,
    {_ratio("count(*) FILTER (action = 'quarantine')", 'count(*)')} AS quarantined_rate,
    {_ratio("count(*) FILTER (analysed AND text_probability >= 0.5)", 'count(*)')} AS text_only_flagged_rate,
    {_ratio("count(*) FILTER (analysed AND text_probability >= 0.8)", 'count(*)')} AS text_only_quarantined_rate"""


@register("scorer_summary", f"WITH {inputs.SCORED_SQL} SELECT label, category, {_SUMMARY} FROM scored GROUP BY label, category")
def scorer_summary(spark, sf_dir):
    return e.scorer_summary(_scored(spark, sf_dir), ["label", "category"])


@register("source_totals", f"WITH {inputs.SCORED_SQL} SELECT source, {_SUMMARY} FROM scored GROUP BY GROUPING SETS ((source), ())")
def source_totals(spark, sf_dir):
    """Per source and overall in one pass."""
    return e.scorer_summary(_scored(spark, sf_dir), ["source"], totals=True)


_RATES = f"""nl AS n_legit, np AS n_phish, f5 AS fp_05, fq AS fp_q,
    CASE WHEN nl > 0 THEN round(f5::DOUBLE / nl, 4) END AS fpr_05, CASE WHEN nl > 0 THEN round(fq::DOUBLE / nl, 4) END AS fpr_q,
    CASE WHEN np > 0 THEN round(t5::DOUBLE / np, 4) END AS recall_05, CASE WHEN np > 0 THEN round(tq::DOUBLE / np, 4) END AS recall_q,
    CASE WHEN nl > 0 AND np > 0 THEN {_ratio('2 * t5', 't5 + f5 + np')} END AS f1_05"""
_RATE_COUNTS = """count(*) FILTER (label = 0) AS nl, count(*) FILTER (label = 1) AS np, count(*) FILTER (label = 0 AND sc >= 0.5) AS f5,
    count(*) FILTER (label = 0 AND sc >= 0.8) AS fq, count(*) FILTER (label = 1 AND sc >= 0.5) AS t5, count(*) FILTER (label = 1 AND sc >= 0.8) AS tq"""


@register("two_threshold_rates", f"{_ONE}, c AS (SELECT category, {_RATE_COUNTS} FROM s GROUP BY category) SELECT category, {_RATES} FROM c")
def two_threshold_rates(spark, sf_dir):
    return e.two_threshold_rates(_scored(spark, sf_dir), ["category"])


@register("errors_by_category", f"{_ONE} SELECT category, count(*) AS errors FROM s WHERE (sc >= 0.5)::INT <> label GROUP BY category")
def errors_by_category(spark, sf_dir):
    return e.errors_by_category(_scored(spark, sf_dir).withColumn("score", F.coalesce("score", F.lit(1.0))))


_VARIANTS = {"V0": (37, 101), "V1": (41, 97), "V3": (43, 89), "V2": (59, 83)}
_VARIANT_SQL = " UNION ALL ".join(
    f"SELECT '{v}' AS variant, label, ((doc_id * {a}) % {b}) / {b}.0::DOUBLE AS sc FROM scored" for v, (a, b) in _VARIANTS.items())


@register("chosen_variant", f"""WITH {inputs.SCORED_SQL}, s AS ({_VARIANT_SQL}), c AS (SELECT variant, {_RATE_COUNTS} FROM s GROUP BY variant),
  r AS (SELECT variant, {_RATES} FROM c)
  SELECT variant, f1_05, fp_q, fp_05 FROM r WHERE fpr_05 <= 0.9 AND recall_05 >= 0.1
  ORDER BY f1_05 DESC, fp_q, fp_05, list_position(['V0', 'V1', 'V3', 'V2'], variant) LIMIT 1""")
def chosen_variant(spark, sf_dir):
    base = _scored(spark, sf_dir)
    frames = [base.select(F.lit(v).alias("variant"), "label", ((F.col("doc_id") * a) % b / F.lit(float(b))).alias("score"))
              for v, (a, b) in _VARIANTS.items()]
    rates = e.two_threshold_rates(reduce(DataFrame.unionByName, frames), ["variant"])
    best = e.choose_variant(rates, list(_VARIANTS), (F.col("fpr_05") <= 0.9) & (F.col("recall_05") >= 0.1))
    return best.select("variant", "f1_05", "fp_q", "fp_05")


_HIDDEN = {"S0": ["sender", "credit"], "S1": ["credit"], "S2": []}
_REASONS = """reasons_t AS (SELECT doc_id, unnest(['text', 'sender', 'link', 'credit']) AS code,
    unnest([(doc_id % 9 - 4) * 0.7::DOUBLE, (doc_id % 3) * 0.9::DOUBLE, (doc_id % 5) * 0.4::DOUBLE, -(doc_id % 2)::DOUBLE]) AS weight FROM labels)"""


@register("rule_variants", f"""WITH {_REASONS} SELECT doc_id, variant, round(1 / (1 + exp(-sum(CASE WHEN list_contains(hidden, code) THEN 0 ELSE weight END))), 6) AS score
  FROM reasons_t, (VALUES ('S0', ['sender', 'credit']), ('S1', ['credit']), ('S2', []::VARCHAR[])) v(variant, hidden) GROUP BY doc_id, variant""")
def rule_variants(spark, sf_dir):
    k = F.col("doc_id")
    cell = lambda code, w: F.struct(F.lit(code).alias("code"), w.cast("double").alias("weight"))
    reasons = inputs.table(spark, sf_dir, "labels").select("doc_id", F.inline(F.array(
        cell("text", (k % 9 - 4) * 0.7), cell("sender", (k % 3) * 0.9), cell("link", (k % 5) * 0.4), cell("credit", -(k % 2)))))
    return e.rule_variants(reasons, _HIDDEN, "doc_id").select("doc_id", "variant", F.round("score", 6).alias("score"))


def _holdout_rates(spark, sf_dir):
    from ..operators.corpus import stratified_split
    from ..operators.holdout import holdout_rates

    return holdout_rates(stratified_split(labelled_documents(spark, sf_dir), "id"))


#: What a hold-out is trained on and measured on, counted anew for each source.
_HELD_OUT_SQL = f"""WITH docs AS (SELECT doc_id, {o.normalised('text')} AS text, quality AS label, source FROM documents JOIN labels USING (doc_id)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':42'), doc_id) AS k,
    count(*) OVER (PARTITION BY label) AS n FROM docs),
  parts AS (SELECT doc_id, text, label, source, k > floor(n * {fixed.TEST_SHARE}) AS trained FROM ranked),
  train AS (SELECT * FROM parts WHERE trained), {o.terms_cte('train', 'doc_id', 'text', fixed.CORPUS_STOP_WORDS)},
  held AS (SELECT DISTINCT source AS held_out FROM parts WHERE label = 0 AND source IS NOT NULL),
  sizes AS (SELECT held_out, count(*) AS n_train FROM held, train WHERE source IS DISTINCT FROM held_out GROUP BY held_out),
  df AS (SELECT held_out, term, count(*) AS df FROM held, tf JOIN train USING (doc_id)
    WHERE source IS DISTINCT FROM held_out GROUP BY held_out, term),
  kept AS (SELECT held_out, count(*) AS n FROM df JOIN sizes USING (held_out)
    WHERE df >= {fixed.MIN_DOCUMENT_FREQUENCY} AND df <= {fixed.MAX_DOCUMENT_SHARE} * n_train GROUP BY held_out)
  SELECT held_out, n_train, least(n, {fixed.MAX_VOCABULARY})::BIGINT AS n_terms,
    (SELECT count(*) FROM parts p WHERE p.source = held_out AND p.label = 0) AS n_unseen_legit, true AS in_range
  FROM sizes JOIN kept USING (held_out)"""


@register("leave_one_source_out", _HELD_OUT_SQL)
def leave_one_source_out(spark, sf_dir):
    """Training without each source of the table: what it is trained and measured on, and whether the rates hold together."""
    rate = lambda c: F.col(c).between(0, 1)
    return _holdout_rates(spark, sf_dir).select(
        "held_out", "n_train", "n_terms", "n_unseen_legit",
        (rate("fpr_05") & rate("recall_05") & (F.col("fpr_q") <= F.col("fpr_05"))).alias("in_range"))


@register("source_holdout_rates")
def source_holdout_rates(spark, sf_dir):
    """Training without each source of the table in turn: its rates."""
    return _holdout_rates(spark, sf_dir)


# Every row has a role by its source: the positive rows of some are a trap's, split by time; others are templates.
_ROLE_SQL = "CASE WHEN source IS NULL THEN 'rest' WHEN left(md5(source), 1) < '3' AND quality = 1 THEN 'trap' WHEN left(md5(source), 1) BETWEEN '3' AND '4' THEN 'template' ELSE 'rest' END"
_MORE_STOP = {"E1": fixed.PRONOUN_STOP_WORDS, "E2": [*fixed.PRONOUN_STOP_WORDS, *fixed.ACCOUNT_STOP_WORDS]}
_VARIANT_ROWS = {"A": "role = 'rest' AND split = 'train' AND old", "B": "role = 'rest' AND split = 'train'",
                 **{v: "role IN ('rest', 'trap') AND split = 'train'" for v in ("C", "E1", "E2")},
                 "V0": "role = 'rest' AND split = 'train'", "V1": "(role = 'rest' AND split = 'train') OR role = 'template'"}
_TEST_ROWS = {"validation": "role = 'rest' AND split = 'test' AND NOT late", "test": "role = 'rest' AND split = 'test' AND late",
              "future": "role = 'trap' AND split = 'test'"}
_BLENDS = {"V2": ("V1", "C"), "V3": ("V0", "C")}


def _variant_corpus(spark, sf_dir):
    """All labelled documents with their roles and splits, and the three texts that models read."""
    from ..functions.text import normalise
    from ..operators.corpus import stratified_split, time_split

    first, s = F.left(F.md5("source"), F.lit(1)), F.col("source")
    role = (F.when(s.isNull(), "rest").when((first < "3") & (F.col("quality") == 1), "trap")
            .when(first.between("3", "4"), "template").otherwise("rest"))
    rows = inputs.table(spark, sf_dir, "documents").join(inputs.table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("text").alias("raw"), F.col("quality").alias("label"), role.alias("role"),
        F.coalesce(first < "b", F.lit(False)).alias("old"))
    parts = [stratified_split(rows.where("role = 'rest'"), "id"), time_split(rows.where("role = 'trap'"), "id").drop("cutoff"),
             rows.where("role = 'template'").withColumn("split", F.lit("none"))]
    late = F.substring(F.md5(F.col("id").cast("string")), 1, 1) >= "8"
    texts = {kind: normalise(F.col("raw"), kind) for kind in ("email", "sms", "sms_masked")}
    return reduce(DataFrame.unionByName, parts).withColumns({"late": late, **texts}).drop("raw")


def _trained_variants(spark, sf_dir):
    from ..operators.variants import Variant, variant_rates

    kinds = {"V0": "sms", "V1": "sms_masked"}
    weight = F.when(F.col("role") == "template", fixed.TEMPLATE_WEIGHT).otherwise(1.0)
    stop = lambda name: fixed.SMS_STOP_WORDS if name in kinds else [*fixed.CORPUS_STOP_WORDS, *_MORE_STOP.get(name, [])]
    fits = [Variant(name, kinds.get(name, "email"), F.expr(rows), tuple(stop(name)),
                    weight if name == "V1" else None) for name, rows in _VARIANT_ROWS.items()]
    return variant_rates(_variant_corpus(spark, sf_dir), fits, {name: F.expr(rows) for name, rows in _TEST_ROWS.items()}, _BLENDS)


@register("training_variants")
def training_variants(spark, sf_dir):
    """Nine models on the same tests: training rows A to C, stop words E1 and E2, texts and templates V0 and V1, blends V2 and
    V3; with their guards, which are eligible, and the one chosen."""
    from ..operators.variants import guarded

    # Documents are no messages, so the guards are looser than a mailbox would need.
    return guarded(_trained_variants(spark, sf_dir), "validation", {"test": ("test", 0.6, None), "future": ("future", None, 0.3)},
                   ["A", "B", "C", "E1", "E2", "V0", "V3", "V1", "V2"])


def _variant_terms_sql(name: str) -> str:
    return f"""SELECT '{name}' AS variant, (SELECT count(*) FROM parts WHERE {_VARIANT_ROWS[name]}) AS n_train, (SELECT count(*) FROM (
      WITH rows_of AS (SELECT doc_id, text FROM parts WHERE {_VARIANT_ROWS[name]}), {o.terms_cte('rows_of', 'doc_id', 'text', [*fixed.CORPUS_STOP_WORDS, *_MORE_STOP.get(name, [])])}
      SELECT term FROM tf GROUP BY term HAVING count(*) >= {fixed.MIN_DOCUMENT_FREQUENCY}
        AND count(*) <= {fixed.MAX_DOCUMENT_SHARE} * (SELECT count(*) FROM rows_of) LIMIT {fixed.MAX_VOCABULARY})) AS n_terms"""


@register("variant_facts", f"""WITH docs AS (SELECT doc_id, {o.normalised('text')} AS text, quality AS label, {_ROLE_SQL} AS role,
    coalesce(left(md5(source), 1) < 'b', false) AS old, left(md5(doc_id::VARCHAR), 1) >= '8' AS late FROM documents JOIN labels USING (doc_id)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY role, label ORDER BY md5(doc_id || ':42'), doc_id) AS k,
    count(*) OVER (PARTITION BY role, label) AS n, (SELECT quantile_cont(doc_id, {fixed.TRAIN_QUANTILE}) FROM docs WHERE role = 'trap') AS cut FROM docs),
  parts AS (SELECT *, CASE role WHEN 'rest' THEN CASE WHEN k <= floor(n * {fixed.TEST_SHARE}) THEN 'test' ELSE 'train' END
    WHEN 'trap' THEN CASE WHEN doc_id <= cut THEN 'train' ELSE 'test' END ELSE 'none' END AS split FROM ranked),
  facts AS ({" UNION ALL ".join(map(_variant_terms_sql, ("A", "B", "C", "E1", "E2")))}),
  tested AS ({" UNION ALL ".join(f"SELECT '{t}' AS test_set, count(*) FILTER (label = 0) AS n_legit, count(*) FILTER (label = 1) AS n_phish FROM parts WHERE {r}" for t, r in _TEST_ROWS.items())})
  SELECT variant, test_set, n_train, n_terms, n_legit, n_phish, true AS in_order FROM facts, tested WHERE n_legit + n_phish > 0""")
def variant_facts(spark, sf_dir):
    """What the variants over mail texts are trained and tested on, and whether their rates hold together."""
    order = (F.coalesce(F.col("fpr_q") <= F.col("fpr_05"), F.lit(True)) & F.coalesce(F.col("recall_q") <= F.col("recall_05"), F.lit(True)))
    return _trained_variants(spark, sf_dir).where(~F.col("variant").startswith("V")).select(
        "variant", "test_set", "n_train", "n_terms", "n_legit", "n_phish", order.alias("in_order"))
