"""Ranking, packing, coverage, evidence and JSON queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import numeric as nm
from marginalia.functions import text as tx
from marginalia.operators import audit, folds, graph, retrieval
from marginalia.plans.registry import query
from marginalia.plans.text import NOISE, NORMAL
from marginalia.tables import load, load_texts, spans

STATES = rf"""
WITH clean AS (SELECT doc_id, lang, source, {NORMAL} AS t FROM documents),
verdicts AS (SELECT *, {NOISE} AS reason FROM clean),
firsts AS (SELECT *, min(doc_id) FILTER (reason IS NULL) OVER (PARTITION BY source, t) AS canonical FROM verdicts),
states AS (SELECT doc_id, source, reason, CASE WHEN reason IS NOT NULL THEN 'noise' WHEN doc_id <> canonical THEN 'duplicate' ELSE 'included' END AS state FROM firsts)
"""


@query(STATES + "SELECT source, state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM states GROUP BY 1, 2")
def coverage_by_state(spark, d):
    """How many documents of each source are included, duplicates or noise, and their share of the source."""
    n = audit.span_states(load_texts(spark, d), "doc_id", F.col("text"), "source").groupBy("source", "state").agg(F.count("*").alias("n"))
    total = n.groupBy("source").agg(F.sum("n").alias("total"))
    return n.join(total, "source").select("source", "state", "n", nm.ratio(F.col("n"), F.col("total")).alias("share"))


METRICS = STATES + """,
ledger AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'processed' WHEN toxic = 1 THEN 'failed' ELSE 'not_used' END AS outcome FROM labels),
m AS (SELECT source, count(*) AS total, count(*) FILTER (state = 'included') AS canonical, count(*) FILTER (state = 'duplicate') AS duplicates, count(*) FILTER (state = 'noise') AS noise,
  count(*) FILTER (state = 'included' AND outcome = 'processed') AS processed, count(*) FILTER (state = 'included' AND outcome = 'failed') AS failed, count(*) FILTER (state = 'included' AND outcome IS NULL) AS silent,
  count(*) AS accounted FROM states LEFT JOIN ledger USING (doc_id) GROUP BY 1),
r AS (SELECT *, round(accounted / total, 6) AS accounting, CASE WHEN canonical = 0 THEN 0.0 ELSE round(processed / canonical, 6) END AS semantic FROM m)
"""


def _metrics(spark, d):
    outcome = F.when(F.col("quality") == 1, "processed").when(F.col("toxic") == 1, "failed").otherwise("not_used")
    ledger = load(spark, d, "labels").select("doc_id", outcome.alias("outcome"))
    return audit.coverage_metrics(audit.span_states(load_texts(spark, d), "doc_id", F.col("text"), "source"), ledger, "doc_id", "source")


@query(METRICS + "SELECT * FROM r")
def coverage_metrics(spark, d):
    return _metrics(spark, d)


@query(METRICS + """SELECT source, silent, semantic, CASE WHEN silent > 0 OR accounting < 1 OR failed > 0 THEN 'failed' WHEN canonical = 0 OR semantic < 1 - 1e-9 THEN 'degraded' ELSE 'passed' END AS gate,
  CASE WHEN silent > 0 OR accounting < 1 OR failed > 0 THEN concat_ws(',', CASE WHEN silent > 0 THEN 'silent_drop' END, CASE WHEN accounting < 1 THEN 'accounting' END, CASE WHEN failed > 0 THEN 'failed_spans' END)
  ELSE concat_ws(',', CASE WHEN canonical = 0 THEN 'no_canonical' END, CASE WHEN semantic < 1 - 1e-9 THEN 'semantic' END) END AS reasons FROM r""")
def coverage_gate(spark, d):
    return audit.coverage_gate(_metrics(spark, d)).select("source", "silent", "semantic", "gate", "reasons")


@query("""
WITH s AS (SELECT conv_id, count(*) AS total, count(*) FILTER (length(text) > 150) AS referenced FROM conversations WHERE role <> 'system' GROUP BY 1),
r AS (SELECT *, CASE WHEN total <= 0 THEN NULL ELSE round(referenced / total, 6) END AS rate FROM s)
SELECT min(rate) AS least, round(avg(rate), 6) AS mean, count(*) FILTER (rate < 0.3) AS low FROM r""")
def ref_coverage_stats(spark, d):
    s = load(spark, d, "conversations").filter("role <> 'system'").groupBy("conv_id").agg(F.count("*").alias("total"), F.count_if(F.length("text") > 150).alias("referenced"))
    rate = s.withColumn("rate", F.when(F.col("total") > 0, F.round(F.col("referenced") / F.col("total"), 6)))
    return rate.agg(F.min("rate").alias("least"), F.round(F.avg("rate"), 6).alias("mean"), F.count_if(F.col("rate") < 0.3).alias("low"))


CLAIMS = """
WITH claims AS (SELECT doc_id AS claim_id, CASE doc_id % 4 WHEN 0 THEN 'ai_explanation' WHEN 1 THEN 'definition' ELSE 'fact' END AS claim_type, lang AS domain_id FROM documents),
refs AS (SELECT doc_id AS claim_id, unnest([CASE WHEN doc_id % 5 = 0 THEN 'x' || doc_id ELSE 'T' || lpad(doc_id::VARCHAR, 6, '0') END, 'T' || lpad((doc_id + 1)::VARCHAR, 6, '0'), 'T9' || lpad((doc_id % 100000)::VARCHAR, 5, '0')]) AS ref FROM documents),
spans AS (SELECT lang AS domain_id, 'T' || lpad(doc_id::VARCHAR, 6, '0') AS ref FROM documents),
bound AS (SELECT DISTINCT c.claim_id, c.claim_type, r.ref, CASE WHEN NOT regexp_matches(r.ref, '^[TPDIS][0-9]{4,6}([.][0-9]{1,2})?$') THEN 'invalid' WHEN EXISTS (SELECT 1 FROM spans s WHERE s.domain_id = c.domain_id AND s.ref = r.ref) THEN 'bound'
  WHEN EXISTS (SELECT 1 FROM spans s WHERE s.ref = r.ref) THEN 'cross_domain' ELSE 'missing' END AS binding FROM claims c JOIN refs r USING (claim_id))
"""


def _claim_tables(spark, d):
    i = F.col("doc_id")
    docs = load(spark, d, "documents").select("doc_id", "lang")
    claims = docs.select(i.alias("claim_id"), F.when(i % 4 == 0, "ai_explanation").when(i % 4 == 1, "definition").otherwise("fact").alias("claim_type"), F.col("lang").alias("domain_id"))
    refs = docs.select(i.alias("claim_id"), F.explode(F.array(F.when(i % 5 == 0, F.concat(F.lit("x"), i.cast("string"))).otherwise(tx.sequence_id(F.lit("T"), i)), tx.sequence_id(F.lit("T"), i + 1), F.concat(F.lit("T9"), F.lpad((i % 100000).cast("string"), 5, "0")))).alias("ref"))
    known = docs.select(F.col("lang").alias("domain_id"), tx.sequence_id(F.lit("T"), i).alias("ref"))
    return claims, refs, known


def _claims(spark, d):
    claims, refs, known = _claim_tables(spark, d)
    return claims, audit.bind_claims(claims, refs, known, known)


@query(CLAIMS + "SELECT * FROM bound")
def claim_binding(spark, d):
    return _claims(spark, d)[1]


@query(CLAIMS + """, status AS (SELECT c.claim_id, c.claim_type, CASE WHEN c.claim_type = 'ai_explanation' THEN 'not_required' WHEN count(*) FILTER (b.binding = 'bound') > 0 THEN 'passed' ELSE 'failed' END AS status FROM claims c LEFT JOIN bound b USING (claim_id) GROUP BY 1, 2)
SELECT claim_type, status, count(*) AS n FROM status GROUP BY 1, 2""")
def evidence_report(spark, d):
    claims, bound = _claims(spark, d)
    return audit.claim_status(claims, bound).groupBy("claim_type", "status").agg(F.count("*").alias("n"))


@query(r"""
WITH q AS (SELECT d.doc_id, d.text, CASE d.doc_id % 3 WHEN 0 THEN b.text WHEN 1 THEN replace(substr(d.text, 5, 30), ' ', '  ') ELSE replace(substr(d.text, 5, 30), 'o', '0') END AS quote FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40),
p AS (SELECT doc_id, lower(regexp_replace(text, '\s+', '', 'g')) AS h, lower(regexp_replace(quote, '\s+', '', 'g')) AS n FROM q)
SELECT doc_id, contains(h, n) OR contains(replace(h, '0', 'o'), replace(n, '0', 'o')) OR contains(replace(h, '1', 'l'), replace(n, '1', 'l')) OR contains(replace(h, '5', 's'), replace(n, '5', 's')) OR contains(replace(h, '8', 'b'), replace(n, '8', 'b'))
  OR contains(replace(h, '2', 'z'), replace(n, '2', 'z')) OR contains(replace(h, '6', 'g'), replace(n, '6', 'g')) OR contains(replace(h, '9', 'q'), replace(n, '9', 'q')) AS verified FROM p""")
def quote_verify(spark, d):
    """Whether the quote that each document is said to hold is there, allowing for one common misreading."""
    docs, items = load_texts(spark, d), load(spark, d, "benchmark").withColumnRenamed("text", "passage")
    by, part = F.col("doc_id") % 3, F.substring("text", 5, 30)
    quote = F.when(by == 0, F.col("passage")).when(by == 1, F.replace(part, F.lit(" "), F.lit("  "))).otherwise(F.replace(part, F.lit("o"), F.lit("0")))
    return docs.join(items, items.item_id == docs.doc_id % 40).select("doc_id", tx.fuzzy_contains(F.col("text"), quote).alias("verified"))


BM25 = """
WITH tok AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS t FROM documents),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+')[1:5], lambda x: lower(x))) AS term FROM benchmark) GROUP BY 1, 2),
post AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
scored AS (SELECT a.item_id, p.doc_id, sum(a.times * ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.len / greatest(s.avgdl, 1)))) AS score
  FROM post p JOIN asked a USING (term) JOIN df USING (term) CROSS JOIN size s GROUP BY 1, 2)
"""


def _bm25(spark, d, of="true"):
    terms = F.slice(tx.char_tokens(F.col("text")), 1, 5)
    return retrieval.bm25(load_texts(spark, d), load(spark, d, "benchmark").filter(of).select("item_id", terms.alias("terms")), "doc_id", F.col("text"), "item_id", "terms")


@query(BM25 + "SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM scored QUALIFY rank <= 10")
def bm25_topk(spark, d):
    return retrieval.best(_bm25(spark, d), "item_id", "doc_id", 10).select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query("""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q::DOUBLE[], q::DOUBLE[])) + 1e-9) AS score FROM embeddings, q WHERE vec_id <> 0)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, vec_id LIMIT 20""")
def cosine_topk(spark, d):
    e = load(spark, d, "embeddings")
    scored = retrieval.cosine_scores(e.filter("vec_id <> 0"), e.filter("vec_id = 0"), "vec_id", "embedding")
    return scored.orderBy(F.round("score", 9).desc(), "vec_id").limit(20).select("vec_id", F.round("score", 6).alias("score"))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(v.e, q.e) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(q.e, q.e)) + 1e-9) AS score FROM v JOIN v q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id)::INT AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY rank <= 20""")
def cosine_topk_each(spark, d):
    """The 20 nearest vectors of every query vector."""
    e = load(spark, d, "embeddings")
    return retrieval.cosine_best(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 20).withColumn("score", F.round("score", 6))


@query(BM25 + """, f AS (SELECT doc_id, score, max(score) OVER () AS most FROM scored WHERE item_id = 1),
m AS (SELECT f.doc_id, d.n_chars, 0.60 * f.score / f.most + 0.30 * CASE d.lang WHEN 'en' THEN 1.0 WHEN 'fr' THEN 0.6 ELSE 0.2 END + 0.10 * least(0.5, 0.1 * len(list_filter(['the', 'of', 'and'], lambda t: contains(d.text, t)))) AS score FROM f JOIN documents d USING (doc_id)),
c AS (SELECT * FROM m ORDER BY round(score, 9) DESC, doc_id LIMIT 40)
SELECT doc_id, round(score, 6) AS score FROM c ORDER BY n_chars DESC, round(score, 9) DESC, doc_id LIMIT 10""")
def hybrid_rank(spark, d):
    """Fused scores of one query: 40 candidates, of which the ten longest stay."""
    one = _bm25(spark, d, "item_id = 1").select("doc_id", F.col("score").alias("bm25"))
    most = one.agg(F.max("bm25").alias("most"))
    docs = one.join(load(spark, d, "documents"), "doc_id").crossJoin(F.broadcast(most))  # one row
    level = F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "fr", 0.6).otherwise(0.2)
    score = retrieval.fused(F.col("bm25"), F.col("most"), None, level, tx.phrase_bonus(F.array(*map(F.lit, ("the", "of", "and"))), F.col("text")))
    return retrieval.two_stage(docs.select("doc_id", "n_chars", score.alias("score")), "doc_id", F.col("n_chars"), 10).select("doc_id", F.round("score", 6).alias("score"))



WHOLE_BM25 = BM25.replace("[1:5]", "")
BM25_COLUMNS = "SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM scored QUALIFY rank <= 10"


def _whole_bm25(docs, items):
    return retrieval.bm25(docs, items.select("item_id", tx.char_tokens(F.col("text")).alias("terms")), "doc_id", F.col("text"), "item_id", "terms")


@query(WHOLE_BM25 + BM25_COLUMNS)
def bm25_topk_whole(spark, d):
    """As bm25_topk, with all tokens of each passage."""
    scored = _whole_bm25(load_texts(spark, d), load(spark, d, "benchmark"))
    return retrieval.best(scored, "item_id", "doc_id", 10).select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query(WHOLE_BM25 + """, q AS (SELECT b.item_id, list_distinct(list_transform(regexp_extract_all(b.text, '[A-Za-z0-9]{2,}'), lambda x: lower(x))) AS t, e.embedding::DOUBLE[] AS v FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id WHERE b.item_id % 20 = 0),
f AS (SELECT q.item_id, d.doc_id, d.n_chars, coalesce(s.score, 0) / coalesce(max(s.score) OVER (PARTITION BY q.item_id), 1) AS part, CASE d.lang WHEN 'en' THEN 1.0 WHEN 'fr' THEN 0.6 ELSE 0.2 END AS level, least(1.0, 0.2 * len(list_filter(q.t, lambda t: contains(d.text, t)))) AS phrase, q.v IS NULL AS keyword,
  coalesce(greatest(list_inner_product(q.v, e.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) + 1e-9), 0), 0) AS near
  FROM q CROSS JOIN documents d LEFT JOIN scored s ON s.item_id = q.item_id AND s.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
m AS (SELECT item_id, doc_id, n_chars, CASE WHEN keyword THEN 0.60 * part + 0.30 * level + 0.10 * phrase ELSE 0.45 * part + 0.40 * near + 0.10 * level + 0.05 * phrase END AS score FROM f),
c AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) <= 40)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, round(score, 9) DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM c QUALIFY rank <= 10""")
def hybrid_rank_each(spark, d):
    """Fused scores of every query passage against every document: the words are the passage's, and passages and
    documents have the vectors of their ids. 40 candidates of each query, of which the ten longest stay."""
    docs, e = load_texts(spark, d), load(spark, d, "embeddings")
    items = load(spark, d, "benchmark").filter("item_id % 20 = 0")
    asked = items.select("item_id", tx.term_set(F.col("text")).alias("words")).join(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("asked")), "item_id", "left")
    scored = _whole_bm25(docs, items).withColumnRenamed("score", "bm25")
    most = scored.groupBy("item_id").agg(F.max("bm25").alias("most"))
    level = F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "fr", 0.6).otherwise(0.2)
    near = F.coalesce(nm.cosine(F.col("embedding"), F.col("asked")), F.lit(0.0))
    held = docs.join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    met = held.crossJoin(asked).select("item_id", "doc_id", "n_chars", level.alias("level"), (tx.phrase_bonus(F.col("words"), F.col("text")) / 0.5).alias("phrase"), F.when(F.col("asked").isNotNull(), near).alias("near"))
    both = met.join(scored, ["item_id", "doc_id"], "left").join(most, "item_id", "left")
    part, top = F.coalesce("bm25", F.lit(0.0)), F.coalesce("most", F.lit(0.0))
    fused = lambda n: retrieval.fused(part, top, n, F.col("level"), F.col("phrase"))
    score = F.when(F.col("near").isNull(), fused(None)).otherwise(fused(F.col("near")))
    return retrieval.two_stage(both.select("item_id", "doc_id", "n_chars", score.alias("score")), "doc_id", F.col("n_chars"), 10, "item_id").select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))

@query("""
WITH RECURSIVE s AS (SELECT conv_id AS domain_id, turn + 1 AS ordinal, ceil(length(text) / 4.0)::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT domain_id, ordinal, tokens, n, CASE WHEN tokens > 400 THEN 0 ELSE 1 END AS seg, CASE WHEN tokens > 400 THEN 400 ELSE 400 - tokens END AS space FROM s WHERE n = 1
UNION ALL SELECT s.domain_id, s.ordinal, s.tokens, s.n, CASE WHEN s.tokens > 400 THEN f.seg WHEN f.seg = 0 OR s.tokens > f.space THEN f.seg + 1 ELSE f.seg END,
  CASE WHEN s.tokens > 400 THEN f.space WHEN f.seg = 0 OR s.tokens > f.space THEN 400 - s.tokens ELSE f.space - s.tokens END FROM f JOIN s ON s.domain_id = f.domain_id AND s.n = f.n + 1)
SELECT domain_id, ordinal, tokens, CASE WHEN tokens <= 400 THEN seg END::BIGINT AS segment FROM f""")
def budget_segments(spark, d):
    return folds.budget_segments(spans(spark, d), 400)


@query("""
WITH RECURSIVE s AS (SELECT conv_id AS domain_id, turn + 1 AS ordinal, ceil(length(text) / 4.0)::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT domain_id, ordinal, n, 1 AS batch, 1 AS size, tokens AS used FROM s WHERE n = 1
UNION ALL SELECT s.domain_id, s.ordinal, s.n, CASE WHEN f.size >= 3 OR f.used + s.tokens > 300 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.size >= 3 OR f.used + s.tokens > 300 THEN 1 ELSE f.size + 1 END, CASE WHEN f.size >= 3 OR f.used + s.tokens > 300 THEN s.tokens ELSE f.used + s.tokens END FROM f JOIN s ON s.domain_id = f.domain_id AND s.n = f.n + 1)
SELECT domain_id, ordinal, batch::BIGINT AS batch FROM f""")
def ku_batches(spark, d):
    return folds.unit_batches(spans(spark, d), 300, 3)


@query("""
WITH RECURSIVE s AS (SELECT conv_id AS domain_id, turn + 1 AS ordinal, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT domain_id, ordinal, n, CASE WHEN chars > 1500 THEN 'char_budget_exceeded' WHEN chars > 400 THEN 'truncated' ELSE 'sent' END AS status, CASE WHEN chars > 1500 THEN 0 ELSE 1 END AS taken, CASE WHEN chars > 1500 THEN 0 ELSE chars END AS used FROM s WHERE n = 1
UNION ALL SELECT s.domain_id, s.ordinal, s.n, CASE WHEN f.taken >= 4 THEN 'max_spans_exceeded' WHEN f.used + s.chars > 1500 THEN 'char_budget_exceeded' WHEN s.chars > 400 THEN 'truncated' ELSE 'sent' END,
  CASE WHEN f.taken >= 4 OR f.used + s.chars > 1500 THEN f.taken ELSE f.taken + 1 END, CASE WHEN f.taken >= 4 OR f.used + s.chars > 1500 THEN f.used ELSE f.used + s.chars END FROM f JOIN s ON s.domain_id = f.domain_id AND s.n = f.n + 1)
SELECT domain_id, ordinal, status FROM f""")
def excerpt_packing(spark, d):
    return folds.excerpts(spans(spark, d).withColumn("chars", F.length("text").cast("long")), 4, 1500, 400)


@query("""
WITH RECURSIVE s AS (SELECT conv_id AS domain_id, turn + 1 AS ordinal, ceil(length(text) / 4.0)::BIGINT AS tokens, turn % 5 = 4 AS preferred, role = 'user' AS boundary, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT domain_id, ordinal, n, 1 AS seg, tokens AS used FROM s WHERE n = 1
UNION ALL SELECT s.domain_id, s.ordinal, s.n, CASE WHEN f.used + s.tokens > 600 OR s.preferred OR (s.boundary AND f.used >= 150) THEN f.seg + 1 ELSE f.seg END, CASE WHEN f.used + s.tokens > 600 OR s.preferred OR (s.boundary AND f.used >= 150) THEN s.tokens ELSE f.used + s.tokens END FROM f JOIN s ON s.domain_id = f.domain_id AND s.n = f.n + 1)
SELECT domain_id, ordinal, seg::BIGINT AS segment FROM f""")
def plan_segments(spark, d):
    s = spans(spark, d).select("domain_id", "ordinal", "tokens", ((F.col("ordinal") - 1) % 5 == 4).alias("preferred"), (F.col("role") == "user").alias("boundary"))
    return folds.planned_segments(s, 600)


@query("""
WITH u AS (SELECT conv_id, turn + 1 AS a, turn + 1 + turn % 2 AS b, max(turn + 1) OVER (PARTITION BY conv_id) AS top FROM conversations),
v AS (SELECT *, lag(b) OVER (PARTITION BY conv_id ORDER BY a) AS before FROM u),
r AS (SELECT conv_id, count(*) FILTER (a > b OR a < 1) AS bad_range, count(*) FILTER (coalesce(before + 1, 1) <> a) AS not_contiguous, max(b) > max(top) AS past_end, count(*) FILTER (b - a + 1 < 3) AS short_units FROM v GROUP BY 1)
SELECT *, CASE WHEN bad_range > 0 OR not_contiguous > 0 OR past_end THEN 'rejected' WHEN short_units > 0 THEN 'low_quality' ELSE 'succeeded' END AS status FROM r""")
def boundary_rules(spark, d):
    """Units of each conversation: ranges in order, without gaps, to the end; short units lower the quality."""
    a = F.col("turn") + 1
    u = load(spark, d, "conversations").select("conv_id", a.alias("a"), (a + F.col("turn") % 2).alias("b"))
    v = u.withColumn("before", F.lag("b").over(W.partitionBy("conv_id").orderBy("a")))
    r = v.groupBy("conv_id").agg(F.count_if((F.col("a") > F.col("b")) | (F.col("a") < 1)).alias("bad_range"), F.count_if(F.coalesce(F.col("before") + 1, F.lit(1)) != F.col("a")).alias("not_contiguous"), (F.max("b") > F.max("a")).alias("past_end"), F.count_if(F.col("b") - F.col("a") + 1 < 3).alias("short_units"))
    return r.withColumn("status", F.when((F.col("bad_range") > 0) | (F.col("not_contiguous") > 0) | F.col("past_end"), "rejected").when(F.col("short_units") > 0, "low_quality").otherwise("succeeded"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k_number FROM events")
def json_head_extract(spark, d):
    k = F.get_json_object("props", "$.k")
    return load(spark, d, "events").select("event_id", k.alias("k"), k.try_cast("int").alias("k_number"))


@query("""
WITH j AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[1,2,' || event_id % 9 || ']' WHEN 1 THEN 'broken [' WHEN 2 THEN NULL ELSE '[]' END AS raw FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 3 ELSE 0 END AS n, CASE WHEN event_id % 4 = 0 THEN 3 + event_id % 9 ELSE 0 END AS total FROM j""")
def safe_json_list(spark, d):
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, F.concat(F.lit("[1,2,"), (i % 9).cast("string"), F.lit("]"))).when(i % 4 == 1, "broken [").when(i % 4 == 3, "[]")
    items = F.coalesce(F.from_json(raw, "array<bigint>"), F.expr("cast(array() as array<bigint>)"))
    return load(spark, d, "events").select("event_id", F.size(items).alias("n"), F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("""
SELECT event_id, round(greatest(0.0, least(1.0, value / 60)), 6) AS confidence, CASE WHEN value / 100 >= 0.85 THEN 'high' WHEN value / 100 >= 0.6 THEN 'medium' ELSE 'low' END AS importance,
  greatest(floor((event_id % 40000) * 0.9)::BIGINT - 6144, 0) AS budget FROM events""")
def importance_budget(spark, d):
    return load(spark, d, "events").select("event_id", F.round(nm.clamp01(F.col("value") / 60), 6).alias("confidence"), nm.importance(F.col("value") / 100).alias("importance"), nm.usable_budget(F.col("event_id") % 40000).alias("budget"))


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 2 AS needs FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2),
d(node, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT node FROM e) UNION SELECT e.node, d.depth + 1 FROM d JOIN e ON e.needs = d.node)
SELECT node, max(depth)::INT AS layer FROM d GROUP BY 1""")
def dag_layers(spark, d):
    part = load(spark, d, "part").select(F.col("p_partkey").alias("node"))
    half = part.filter("node > 1").select("node", F.floor(F.col("node") / 2).alias("needs"))
    third = part.filter("node > 2").select("node", F.floor(F.col("node") / 3).alias("needs"))
    return graph.layers(part, half.union(third).distinct())
