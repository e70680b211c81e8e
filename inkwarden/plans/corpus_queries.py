"""Registered queries: corpus building, splits, data checks, leakage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.text import dedup_key
from ..operators import corpus as c
from ..operators.ordering import exact_quantile
from ..operators.similarity import shared_runs, similar_pairs
from . import inputs
from . import oracle as o

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return add


_NORM = f"""norm AS (SELECT doc_id, source, lang, {o.normalised('text')} AS text,
    CASE WHEN starts_with(source, 'src1') THEN 1 ELSE 2 END AS src_rank FROM documents)"""


def _norm(spark, sf_dir) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", text.normalise(F.col("text"), "email").alias("text"),
        F.when(F.startswith("source", F.lit("src1")), 1).otherwise(2).alias("src_rank"))


@register("corpus_union", """SELECT 'documents' AS source, doc_id AS id, md5(text) AS text_md5, lang FROM documents
  UNION ALL SELECT 'conversations', conv_id, md5(text), NULL FROM conversations
  UNION ALL SELECT 'benchmark', item_id, md5(text), NULL FROM benchmark""")
def corpus_union(spark, sf_dir):
    hashed = F.md5("text").alias("text_md5")
    return c.union_sources({
        "documents": inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), hashed, "lang"),
        "conversations": inputs.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), hashed),
        "benchmark": inputs.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), hashed)})


_DEDUP = f"""WITH {_NORM}, d AS (SELECT *, row_number() OVER (PARTITION BY substr(text, 1, {fixed.DEDUP_KEY_CHARS})
    ORDER BY src_rank, doc_id) AS r FROM norm WHERE length(text) >= {fixed.MIN_EMAIL_CHARS})"""


@register("deduplicated_corpus", f"{_DEDUP} SELECT doc_id, source, src_rank, md5(text) AS text_md5 FROM d WHERE r = 1")
def deduplicated_corpus(spark, sf_dir):
    kept = c.drop_near_duplicates(_norm(spark, sf_dir), "src_rank", "doc_id")
    return kept.select("doc_id", "source", "src_rank", F.md5("text").alias("text_md5"))


@register("excluded_duplicates", f"""{_DEDUP} SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 2 END)::BIGINT AS label
  FROM d WHERE r = 1 AND doc_id % 3 <> 0""")
def excluded_duplicates(spark, sf_dir):
    """Unlabelled rows take part in the duplicate removal, then leave."""
    label = F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("doc_id") % 2)
    rows = _norm(spark, sf_dir).withColumn("label", label)
    return c.drop_excluded(c.drop_near_duplicates(rows, "src_rank", "doc_id")).select("doc_id", "label")


@register("stratified_split", """WITH h AS (SELECT doc_id, quality AS label, md5(doc_id || ':42') AS h FROM labels),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, doc_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM h)
  SELECT doc_id, label, CASE WHEN k <= floor(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return c.stratified_split(rows, "doc_id").select("doc_id", "label", "split")


@register("time_split", """WITH q AS (SELECT quantile_cont(doc_id, 0.7) AS cut FROM labels)
  SELECT doc_id, cut::DOUBLE AS cutoff, CASE WHEN doc_id <= cut THEN 'train' ELSE 'test' END AS split FROM labels, q""")
def time_split(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "labels").select("doc_id")
    return c.time_split(rows, "doc_id").select("doc_id", "cutoff", "split")


@register("order_statistics", """SELECT 'p70' AS name, quantile_cont((o_totalprice * 100)::BIGINT, 0.7)::DOUBLE AS quantile FROM orders
  UNION ALL SELECT 'p10', quantile_cont((o_totalprice * 100)::BIGINT - 30000000, 0.1)::DOUBLE FROM orders
  UNION ALL SELECT 'p50', quantile_cont(o_custkey, 0.5)::DOUBLE FROM orders""")
def order_statistics(spark, sf_dir):
    """The exact quantile on skewed, negative and repeated values."""
    orders = inputs.table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    parts = [("p70", cents, 0.7), ("p10", cents - 30_000_000, 0.1), ("p50", F.col("o_custkey"), 0.5)]
    frames = [exact_quantile(orders.select(v.alias("v")), "v", q).select(F.lit(n).alias("name"), "quantile")
              for n, v, q in parts]
    return reduce(DataFrame.unionByName, frames)


@register("corpus_counts", """SELECT source, label, count(*) AS rows, grouping(source, label)::BIGINT AS level
  FROM (SELECT source, quality AS label FROM labels JOIN documents USING (doc_id)) GROUP BY ROLLUP (source, label)""")
def corpus_counts(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "labels").join(
        inputs.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return c.corpus_counts(rows.select("source", F.col("quality").alias("label")))


# Sample slots of the expanded templates.
_SLOTS = {"b": ["SBI", "HDFC Bank", "ICICI Bank"], "city": ["Pune", "Chennai", "Jaipur", "Kochi"],
          "p": ["Anil", "Divya"]}


def _slot_sql():
    text_sql = "template"
    for name, values in _SLOTS.items():
        number = f"('0x' || left(md5('2026:' || template_id || ':' || variant || ':{name}'), 8))::BIGINT"
        text_sql = f"replace({text_sql}, '{{{name}}}', {o.sql_list(values)}[({number} % {len(values)} + 1)::INT])"
    return text_sql


@register("expanded_templates", f"""WITH t AS (SELECT item_id AS template_id, (item_id % 2)::INT AS label, 'cat' || (item_id % 5) AS category,
    '{{b}} notice for {{p}} in {{city}}: ' || text AS template FROM benchmark),
  v AS (SELECT *, unnest(range(0, 8)) AS variant FROM t), f AS (SELECT *, {_slot_sql()} AS text FROM v),
  r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY template_id, variant) AS k FROM f)
  SELECT template_id, label, category, variant::INT AS variant, md5(text) AS text_md5 FROM r WHERE k = 1""")
def expanded_templates(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("template_id"), (F.col("item_id") % 2).cast("int").alias("label"),
        F.concat(F.lit("cat"), (F.col("item_id") % 5).cast("string")).alias("category"),
        F.concat(F.lit("{b} notice for {p} in {city}: "), "text").alias("template"))
    return c.expand_templates(rows, _SLOTS).select(
        "template_id", "label", "category", "variant", F.md5("text").alias("text_md5"))


_EVALSET = """es AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'validation' ELSE 'test' END AS split, quality AS label,
    lang || doc_id % 40 AS category, CASE WHEN doc_id % 50 = 0 THEN text || ' call 9731260485 now' WHEN doc_id % 51 = 0 THEN text || ' www.x.test' ELSE text END AS text
  FROM labels JOIN documents USING (doc_id))"""


@register("eval_set_violations", f"""WITH {_EVALSET}
  SELECT 'duplicate_id' AS check, id::VARCHAR AS item, count(*) AS n FROM es GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'duplicate_text', md5(text), count(*) FROM es GROUP BY text HAVING count(*) > 1
  UNION ALL SELECT 'label_balance', split, abs(sum(CASE WHEN label = 1 THEN 1 ELSE -1 END))::BIGINT FROM es GROUP BY split HAVING abs(sum(CASE WHEN label = 1 THEN 1 ELSE -1 END)) > 2
  UNION ALL SELECT 'category_one_sided', category || '|' || label, count(DISTINCT split) FROM es GROUP BY category, label HAVING count(DISTINCT split) < 2
  UNION ALL SELECT 'phone_number', id::VARCHAR, 1 FROM es WHERE regexp_matches(text, '(^|[^0-9])[6-9][0-9]{{9}}([^0-9]|$)')
  UNION ALL SELECT 'link_or_address', id::VARCHAR, 1 FROM es WHERE regexp_matches(lower(text), 'https?://|www\\.|@[a-z0-9-]+\\.[a-z]')""")
def eval_set_violations(spark, sf_dir):
    k = F.col("doc_id")
    rows = inputs.table(spark, sf_dir, "labels").join(inputs.table(spark, sf_dir, "documents"), "doc_id").select(
        k.alias("id"), F.when(k % 3 == 0, "validation").otherwise("test").alias("split"),
        F.col("quality").alias("label"), F.concat("lang", (k % 40).cast("string")).alias("category"),
        F.when(k % 50 == 0, F.concat("text", F.lit(" call 9731260485 now")))
        .when(k % 51 == 0, F.concat("text", F.lit(" www.x.test"))).otherwise(F.col("text")).alias("text"))
    return c.quality_violations(rows, ["validation", "test"])


@register("frozen_overlap", f"""WITH {_NORM}, fz AS (SELECT DISTINCT substr(text, 1, 2000) AS k FROM norm WHERE doc_id % 10 = 0)
  SELECT doc_id FROM norm WHERE doc_id % 10 <> 0 AND substr(text, 1, 2000) IN (SELECT k FROM fz)""")
def frozen_overlap(spark, sf_dir):
    """Training documents whose text also occurs among the frozen ones (every tenth here)."""
    rows = _norm(spark, sf_dir)
    return c.frozen_overlap(rows.where("doc_id % 10 <> 0"), rows.where("doc_id % 10 = 0")).select("doc_id")


@register("raw_texts", f"""WITH {_NORM}, raw AS (SELECT n.doc_id, substr(n.text, 1, 2000) AS k, d.text AS raw FROM norm n JOIN documents d USING (doc_id) WHERE n.doc_id % 7 <> 0),
  f AS (SELECT k, arg_min(raw, doc_id) AS raw FROM raw GROUP BY k)
  SELECT n.doc_id, md5(coalesce(f.raw, n.text)) AS raw_md5 FROM norm n LEFT JOIN f ON f.k = substr(n.text, 1, 2000)""")
def raw_texts(spark, sf_dir):
    raw = inputs.table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select(
        "doc_id", F.col("text").alias("raw"),
        dedup_key(text.normalise(F.col("text"), "email")).alias("key"))
    joined = c.attach_raw_text(_norm(spark, sf_dir), raw, "key", "raw", "doc_id")
    return joined.select("doc_id", F.md5("raw_text").alias("raw_md5"))


@register("english_future_subset", f"""WITH {_NORM}, q AS (SELECT quantile_cont(doc_id, 0.7) AS cut FROM norm)
  SELECT doc_id FROM norm, q WHERE doc_id > cut AND lang = 'en'""")
def english_future_subset(spark, sf_dir):
    """Semi join of the future part with the ids of the English rows."""
    rows = _norm(spark, sf_dir)
    future = c.time_split(rows.select("doc_id"), "doc_id").where("split = 'test'")
    return future.join(rows.where("lang = 'en'").select("doc_id"), "doc_id", "left_semi").select("doc_id")


_WORDS = o.words("lower(text)")


@register("leaked_runs", f"""WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
  tr AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM t WHERE len(w) >= 5),
  br AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM b WHERE len(w) >= 5)
  SELECT doc_id, count(*) AS shared_runs FROM tr WHERE run IN (SELECT run FROM br) GROUP BY doc_id""")
def leaked_runs(spark, sf_dir):
    return shared_runs(inputs.table(spark, sf_dir, "documents"), inputs.table(spark, sf_dir, "benchmark"), "doc_id")


@register("similar_texts", f"""WITH t AS (SELECT doc_id, list_distinct({_WORDS}) AS w FROM documents), b AS (SELECT item_id, list_distinct({_WORDS}) AS w FROM benchmark),
  p AS (SELECT doc_id, item_id, len(list_intersect(t.w, b.w)) AS common, len(t.w) AS n, len(b.w) AS m FROM t, b WHERE len(t.w) > 0 AND len(b.w) > 0)
  SELECT doc_id, item_id, common::BIGINT AS common, round(common / (n + m - common), 6) AS jaccard FROM p WHERE common / (n + m - common) >= 0.25""")
def similar_texts(spark, sf_dir):
    """Pairs of documents and frozen texts with similar word sets (looser than the audit limit)."""
    pairs = similar_pairs(inputs.table(spark, sf_dir, "documents"), inputs.table(spark, sf_dir, "benchmark"),
                          "doc_id", "item_id", limit=0.25)
    return pairs.select("doc_id", "item_id", "common", F.round("jaccard", 6).alias("jaccard"))
