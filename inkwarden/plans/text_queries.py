"""Registered queries: text preparation and the text model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import model as m
from ..operators.fusion import blend
from ..operators.ingest import fill_placeholders, sanitise_strings
from ..session import written
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


def _documents(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents")


@register("normalised_texts", f"""SELECT doc_id, md5(e) AS email_md5, length(e)::INT AS email_chars,
    md5(s) AS sms_md5, length(s)::INT AS sms_chars
  FROM (SELECT doc_id, {o.normalised('text')} AS e, {o.normalised('text', 'sms')} AS s FROM documents)""")
def normalised_texts(spark, sf_dir):
    rows = _documents(spark, sf_dir).select(
        "doc_id", text.normalise(F.col("text"), "email").alias("e"),
        text.normalise(F.col("text"), "sms").alias("s"))
    return rows.select("doc_id", F.md5("e").alias("email_md5"), F.length("e").alias("email_chars"),
                       F.md5("s").alias("sms_md5"), F.length("s").alias("sms_chars"))


@register("masked_number_texts")
def masked_number_texts(spark, sf_dir):
    """Look-around pattern the second engine cannot run; golden rows are in the tests."""
    rows = inputs.sms(spark, sf_dir).withColumn("text", F.concat(
        F.lit("Card XX5523 and **9046 used. Ring 1860-XXX-XXXX "), "text"))
    return rows.select("msg_id", text.normalise(F.col("text"), "sms_masked").alias("text"))


@register("cleaned_fingerprints", """SELECT doc_id, replace(replace(replace(replace(replace(regexp_replace(
    'Back &lt;#&gt; hours since &lt;DATE&gt ' || text || ' caf&eacute; &#8364; &pound;5 &amp;lt;',
    '&lt;[#A-Z]{0,12}&gt;?', ' ', 'g'), '&eacute;', 'é'), '&#8364;', '€'), '&pound;', '£'), '&lt;', '<'), '&amp;', '&') AS text
  FROM documents""")
def cleaned_fingerprints(spark, sf_dir):
    noisy = F.concat(F.lit("Back &lt;#&gt; hours since &lt;DATE&gt "), "text",
                     F.lit(" caf&eacute; &#8364; &pound;5 &amp;lt;"))
    return _documents(spark, sf_dir).select("doc_id", text.clean_fingerprints(noisy).alias("text"))


_ENGLISH = (f"len(list_filter(w, lambda t: list_contains({o.sql_list(fixed.ENGLISH_WORDS)}, t)))")


@register("english_documents", f"""WITH n AS (SELECT doc_id, lang, list_filter(string_split_regex({o.normalised('text')}, '\\s+'),
    lambda t: t <> '') AS w FROM documents)
  SELECT doc_id, lang, {_ENGLISH} >= {fixed.ENGLISH_MIN_HITS}
    AND {_ENGLISH} / greatest(len(w), 1) >= {fixed.ENGLISH_MIN_SHARE} AS english FROM n""")
def english_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "doc_id", "lang", text.is_english(text.normalise(F.col("text"), "email")).alias("english"))


@register("model_inputs", """SELECT conv_id, turn, md5(concat('Turn ' || role, chr(10), CASE WHEN turn % 3 = 0 THEN text
    WHEN turn % 3 = 1 THEN text || chr(10) || 'html of ' || role ELSE 'html of ' || role END)) AS input_md5 FROM conversations""")
def model_inputs(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "conversations")
    plain = F.when(F.col("turn") % 3 != 2, F.col("text")).otherwise("")
    html = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("html of "), "role")).otherwise("")
    return rows.select("conv_id", "turn", F.md5(text.model_input(
        F.concat(F.lit("Turn "), "role"), plain, html)).alias("input_md5"))


@register("sanitised_texts", """SELECT doc_id, substr(trim(regexp_replace(regexp_replace(replace(replace(
    'Total' || chr(8238) || 'fdp' || chr(8203) || chr(7) || text, chr(8238), ''), chr(8203), ''),
    '[\\x00-\\x1f\\x7f]+', ' ', 'g'), '\\s{2,}', ' ', 'g')), 1, 300) AS text,
  substr(trim(source), 1, 300) AS source FROM documents""")
def sanitised_texts(spark, sf_dir):
    noisy = F.concat(F.lit("Total‮fdp​\u0007"), "text")
    return sanitise_strings(_documents(spark, sf_dir).select("doc_id", noisy.alias("text"), "source"))


@register("filled_placeholders", """SELECT doc_id,
    'Call 1800 425 ' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || ' or SMS 9' || lpad(((doc_id * 7919) % 1000000000)::VARCHAR, 9, '0')
      || ' ' || source AS text,
    '+91 ' || left('9' || lpad(((doc_id * 7919) % 1000000000)::VARCHAR, 9, '0'), 5) || ' '
      || right(lpad(((doc_id * 7919) % 1000000000)::VARCHAR, 9, '0'), 5) AS sender FROM documents""")
def filled_placeholders(spark, sf_dir):
    template = F.concat(F.lit("Call {TOLLFREE} or SMS {MOBILE} "), "source")
    return _documents(spark, sf_dir).select(
        "doc_id", fill_placeholders(template, F.col("doc_id")).alias("text"),
        fill_placeholders(F.lit("{MOBILE}"), F.col("doc_id"), sender=True).alias("sender"))


_NORM = f"WITH norm AS (SELECT doc_id, {o.normalised('text')} AS text FROM documents)"
_TF = f"{_NORM}, {o.terms_cte('norm', 'doc_id', 'text', fixed.CORPUS_STOP_WORDS)}"
_VOCAB = f"{_TF}, {o.vocabulary_cte('tf', 'documents')}"


def _normalised(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.normalise(F.col("text"), "email").alias("text"))


@register("term_counts", f"""{_TF} SELECT doc_id, count(*) AS distinct_terms, sum(tf)::BIGINT AS terms,
    sum(tf * length(term))::BIGINT AS checksum, max(term) AS last_term FROM tf GROUP BY doc_id""")
def term_counts(spark, sf_dir):
    """Summed inside each row first: a greatest term over single terms would sort all of them by document."""
    rows = m.with_term_counts(_normalised(spark, sf_dir), "text", fixed.CORPUS_STOP_WORDS, "t").where(F.size("t") > 0)
    added = lambda value: F.aggregate("t", F.lit(0).cast("bigint"), lambda acc, t: acc + value(t))
    sums = rows.select(
        "doc_id", F.size("t").alias("n"), added(lambda t: t.tf).alias("terms"),
        added(lambda t: t.tf * F.length(t.term)).alias("checksum"), F.array_max(F.col("t.term")).alias("last"))
    return sums.groupBy("doc_id").agg(
        F.sum("n").alias("distinct_terms"), F.sum("terms").alias("terms"), F.sum("checksum").alias("checksum"),
        F.max("last").alias("last_term"))


def _vocabulary(spark, sf_dir):
    return m.with_idf(m.vocabulary(
        m.term_statistics(_normalised(spark, sf_dir), "text", fixed.CORPUS_STOP_WORDS), _documents(spark, sf_dir)))


@register("vocabulary", f"{_VOCAB} SELECT term, df, total, round(idf, 6) AS idf FROM vocab")
def vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir).select("term", "df", "total", F.round("idf", 6).alias("idf"))


@register("tfidf_weights", f"""{_VOCAB}, w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term))
  SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_weights(spark, sf_dir):
    weights = m.tfidf(_normalised(spark, sf_dir), _vocabulary(spark, sf_dir), "doc_id", "text",
                      fixed.CORPUS_STOP_WORDS)
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@register("training_weights", """WITH f AS (SELECT doc_id, quality AS label, CASE WHEN doc_id % 10 = 0 THEN 20.0::DOUBLE ELSE 1.0::DOUBLE END AS row_weight FROM labels),
  c AS (SELECT label, (SELECT count(*) FROM f) / (2.0::DOUBLE * count(*)) AS cw FROM f GROUP BY label)
  SELECT doc_id, label, round(cw * row_weight, 6) AS weight FROM f JOIN c USING (label)""")
def training_weights(spark, sf_dir):
    weight = F.when(F.col("doc_id") % 10 == 0, fixed.CURATED_WEIGHT["email"]).otherwise(1.0)
    frame = inputs.table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("label"), weight.alias("row_weight"))
    return m.training_weights(frame).select("doc_id", "label", F.round("weight", 6).alias("weight"))


# A model with fixed coefficients over the document vocabulary, so both engines score alike.
_COEF_SQL = "((length(term) * 7 + ascii(term)) % 11 - 5) / 10.0::DOUBLE"
_MODEL = f"{_VOCAB}, model AS (SELECT term, idf, {_COEF_SQL} AS coef FROM vocab)"


def table_model(spark, sf_dir, sign: float = 1.0) -> m.TextModel:
    coef = ((F.length("term") * 7 + F.ascii("term")) % 11 - 5) / F.lit(10.0) * sign
    terms = _vocabulary(spark, sf_dir).select("term", "idf", coef.alias("coef"))
    return m.TextModel(terms, -0.25 * sign, "email")


_SCORE_CTES = f"""{_MODEL}, {inputs.SMS_SQL}, snorm AS (SELECT msg_id, {o.normalised('text')} AS text FROM sms),
  {o.terms_cte('snorm', 'msg_id', 'text', fixed.CORPUS_STOP_WORDS, 'stf')},
  cw AS (SELECT msg_id, term, (1 + ln(tf)) * idf AS w, coef FROM stf JOIN model USING (term)),
  contrib AS (SELECT msg_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY msg_id)) * coef AS c FROM cw),
  prob AS (SELECT msg_id, {o.sigmoid('coalesce(sum(c), 0) + -0.25')} AS p FROM sms LEFT JOIN contrib USING (msg_id) GROUP BY msg_id)"""


@register("model_probabilities", f"{_SCORE_CTES} SELECT msg_id, round(p, 6) AS probability FROM prob")
def model_probabilities(spark, sf_dir):
    scored = m.predict(inputs.sms(spark, sf_dir), table_model(spark, sf_dir), "msg_id", "text")
    return scored.select("msg_id", F.round("probability", 6).alias("probability"))


@register("model_contributions", f"{_SCORE_CTES} SELECT msg_id, term, round(c, 6) AS contribution FROM contrib")
def model_contributions(spark, sf_dir):
    parts = m.contributions(inputs.sms(spark, sf_dir), table_model(spark, sf_dir), "msg_id", "text")
    return parts.select("msg_id", "term", F.round("contribution", 6).alias("contribution"))


@register("readable_tokens", f"""SELECT doc_id, len({o.words(o.normalised('text'))})::INT AS tokens FROM documents""")
def readable_tokens(spark, sf_dir):
    return m.token_counts(_documents(spark, sf_dir), "doc_id", "text")


@register("top_terms", f"""{_SCORE_CTES}, r AS (SELECT msg_id, term, round(c, 9) AS c FROM contrib),
  k AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY c DESC, term) AS rank FROM r WHERE c > 0)
  SELECT msg_id, term, round(c, 6) AS contribution, rank::INT AS rank FROM k WHERE rank <= 5""")
def top_terms(spark, sf_dir):
    best = m.top_terms(inputs.sms(spark, sf_dir), table_model(spark, sf_dir), "msg_id", "text", digits=9)
    return best.select("msg_id", "term", F.round("contribution", 6).alias("contribution"), "rank")


@register("blended_probabilities", f"""WITH {inputs.SMS_SQL} SELECT msg_id,
  round({o.sigmoid(f"({o.logit('p_sms')} + {o.logit('p_email')}) / 2")}, 6) AS probability FROM sms""")
def blended_probabilities(spark, sf_dir):
    return inputs.sms(spark, sf_dir).select("msg_id", F.round(blend(
        F.col("p_sms"), F.col("p_email")), 6).alias("probability"))


@register("blended_top_terms", f"""{_SCORE_CTES}, r AS (SELECT msg_id, term, round(c, 9) AS c FROM contrib),
  a AS (SELECT msg_id, term, c, row_number() OVER (PARTITION BY msg_id ORDER BY c DESC, term) AS k FROM r WHERE c > 0),
  b AS (SELECT msg_id, term, round(c * CASE WHEN length(term) % 2 = 0 THEN 2 ELSE 0.5 END, 9)::DOUBLE AS c FROM r WHERE c > 0),
  b2 AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY c DESC, term) AS k FROM b),
  u AS (SELECT msg_id, term, round(sum(c / 2), 9) AS c FROM (SELECT * FROM a WHERE k <= 15 UNION ALL SELECT * FROM b2 WHERE k <= 15) GROUP BY ALL),
  f AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY c DESC, term) AS k FROM u)
  SELECT msg_id, string_agg(term, '|' ORDER BY k) AS top FROM f WHERE k <= 5 GROUP BY msg_id""")
def blended_top_terms(spark, sf_dir):
    """Top terms of two models (15 each), halved, added per term, best five."""
    rows = m.with_contributions(inputs.sms(spark, sf_dir), table_model(spark, sf_dir), "text", "parts")
    second = F.transform("parts", lambda p: F.struct((F.round(p.contribution, 9) * F.when(
        F.length(p.term) % 2 == 0, 2.0).otherwise(0.5)).alias("contribution"), p.term.alias("term")))
    wide = 3 * fixed.TOP_TERMS
    merged = m.blended_top(m.best_terms(F.col("parts"), wide, 9), m.best_terms(second, wide, 9), 2 * wide)
    summed = F.transform(merged, lambda t: F.struct((-t.k).alias("contribution"), t.term.alias("term")))
    named = rows.select("msg_id", m.best_terms(summed, fixed.TOP_TERMS, 9).alias("best"))
    return named.where(F.size("best") > 0).select(
        "msg_id", F.array_join(F.transform("best", lambda t: t.term), "|").alias("top"))


@register("model_fingerprint")
def model_fingerprint(spark, sf_dir):
    return m.fingerprint(table_model(spark, sf_dir).terms)


def labelled_documents(spark, sf_dir):
    """Labelled documents as a training corpus: ``id, text, label, source``."""
    return _documents(spark, sf_dir).join(inputs.table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), text.normalise(F.col("text"), "email").alias("text"),
        F.col("quality").alias("label"), "source")


@register("trained_model_metrics")
def trained_model_metrics(spark, sf_dir):
    """Stratified split, training, and the metrics on the held-out rows."""
    from ..operators.corpus import stratified_split
    from ..operators.evaluate import average_precision, roc_auc, threshold_metrics

    parts = written(stratified_split(labelled_documents(spark, sf_dir), "id"))
    model = m.train(parts.where("split = 'train'"), kind="email")
    test = parts.where("split = 'test'")
    scored = written(test.select("id", "label").join(
        m.predict(test, model, "id", "text").select("id", F.col("probability").alias("score")), "id"))
    out = threshold_metrics(scored)
    return out.select("*", roc_auc(scored).scalar().alias("roc_auc"),
                      average_precision(scored).scalar().alias("pr_auc"))


