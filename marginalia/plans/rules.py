"""Boundaries, gates, item states and the bookkeeping queries around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import numeric as nm
from marginalia.functions import text as tx
from marginalia.operators import evidence
from marginalia.operators import relational as rel
from marginalia.operators import rules
from marginalia.plans.audits import CLAIMS, _claim_tables
from marginalia.plans.registry import query
from marginalia.tables import load, spans


@query("""
WITH s AS (SELECT conv_id AS domain_id, turn + 1 AS ordinal, ceil(length(text) / 4.0)::BIGINT AS tokens, max(turn + 1) OVER (PARTITION BY conv_id) AS top FROM conversations),
u AS (SELECT domain_id, ordinal AS a, CASE WHEN domain_id % 3 = 0 THEN ordinal + 1 WHEN domain_id % 5 = 1 AND ordinal = 3 THEN ordinal - 1 ELSE least(ordinal + 1, top) END AS b FROM s WHERE ordinal % 2 = 1 AND domain_id % 13 <> 4),
k AS (SELECT domain_id, ordinal AS pos FROM s WHERE ordinal % 4 = 0 AND domain_id % 4 <> 0 UNION ALL SELECT domain_id, 1 FROM s WHERE ordinal = 1 AND domain_id % 6 = 5 UNION ALL SELECT domain_id, 2 FROM s WHERE ordinal = 4 AND domain_id % 2 = 0 UNION ALL SELECT domain_id, 2 FROM s WHERE ordinal = 4 AND domain_id % 9 = 4),
d AS (SELECT domain_id, max(ordinal) AS top, sum(tokens) AS total FROM s GROUP BY 1),
v AS (SELECT DISTINCT k.domain_id, pos FROM k JOIN d USING (domain_id) WHERE pos >= 1 AND pos < top),
g AS (SELECT domain_id, start, lead(start, 1, top + 1) OVER (PARTITION BY domain_id ORDER BY start) - 1 AS stop FROM (SELECT domain_id, pos + 1 AS start FROM v UNION ALL SELECT domain_id, 1 FROM d) JOIN d USING (domain_id)),
w AS (SELECT g.domain_id, g.start, (SELECT sum(tokens) FROM s WHERE s.domain_id = g.domain_id AND s.ordinal BETWEEN g.start AND g.stop) AS weight, (SELECT count(*) FROM u WHERE u.domain_id = g.domain_id AND u.a >= g.start AND u.b <= g.stop) AS held,
  (SELECT count(*) FROM u WHERE u.domain_id = g.domain_id AND u.a <= g.stop AND u.b >= g.start AND (u.a < g.start OR u.b > g.stop)) AS crossing FROM g),
n AS (SELECT domain_id, count(*) AS segments, count(*) FILTER (weight > 400 AND held >= 2) AS heavy, sum(crossing) AS h6 FROM w GROUP BY 1),
l AS (SELECT *, lag(b) OVER (PARTITION BY domain_id ORDER BY a) AS before FROM u),
c AS (SELECT l.domain_id, count(*) FILTER (a < 1 OR b < 1 OR a > b) AS h1, count(*) FILTER (a <> before + 1) AS h2, min(a) AS first, arg_max(b, a) AS last, count(*) FILTER (b - a + 1 < 2) AS small,
  count(*) FILTER ((SELECT sum(tokens) FROM s WHERE s.domain_id = l.domain_id AND s.ordinal BETWEEN a AND b) > 400) AS oversized FROM l GROUP BY 1),
b AS (SELECT k.domain_id, count(*) - count(DISTINCT pos) AS twice, count(*) FILTER (NOT EXISTS (SELECT 1 FROM u WHERE u.domain_id = k.domain_id AND u.b = pos)) AS inside, count(*) FILTER (pos >= top) AS late FROM k JOIN d USING (domain_id) GROUP BY 1),
r AS (SELECT domain_id, CASE WHEN first IS NULL THEN NULL ELSE segments END AS segments,
  CASE WHEN first IS NULL THEN 'H0' ELSE concat_ws(',', CASE WHEN h1 > 0 THEN 'H1' END, CASE WHEN h2 > 0 THEN 'H2' END, CASE WHEN first <> 1 OR last <> top THEN 'H3' END, CASE WHEN twice > 0 OR inside > 0 THEN 'H4' END, CASE WHEN late > 0 THEN 'H5' END, CASE WHEN h6 > 0 THEN 'H6' END) END AS hard,
  CASE WHEN first IS NULL THEN '' ELSE concat_ws(',', CASE WHEN small > 0 THEN 'L1' END, CASE WHEN segments > greatest(floor(top * 0.4), 1) THEN 'L2' END, CASE WHEN total > 400 AND segments = 1 THEN 'L3' END, CASE WHEN heavy > 0 THEN 'L4' END) END AS soft,
  CASE WHEN first IS NOT NULL THEN oversized END AS oversized FROM d LEFT JOIN c USING (domain_id) LEFT JOIN n USING (domain_id) LEFT JOIN b USING (domain_id))
SELECT *, CASE WHEN hard <> '' THEN 'rejected' WHEN soft <> '' THEN 'low_quality' ELSE 'succeeded' END AS status FROM r""")
def boundary_checks(spark, d):
    """All rules for units and breaks, over plans made from conversations, of which many break some rule."""
    s = spans(spark, d).select("domain_id", "ordinal", F.ceil(F.length("text") / 4).alias("tokens"))
    top = s.groupBy("domain_id").agg(F.max("ordinal").alias("top"))
    i, o = F.col("domain_id"), F.col("ordinal")
    b = F.when(i % 3 == 0, o + 1).when((i % 5 == 1) & (o == 3), o - 1).otherwise(F.least(o + 1, "top"))
    units = s.join(top, "domain_id").filter((o % 2 == 1) & (i % 13 != 4)).select("domain_id", o.alias("a"), b.alias("b"))
    two = F.lit(2).cast("long")
    at = F.array_compact(F.array(F.when((o % 4 == 0) & (i % 4 != 0), o), F.when((o == 1) & (i % 6 == 5), o), F.when((o == 4) & (i % 2 == 0), two), F.when((o == 4) & (i % 9 == 4), two)))
    return rules.boundary_report(s, units, s.select("domain_id", F.explode(at).alias("at")), 400, least=2, ratio=0.4)


@query("""
WITH i AS (SELECT d.doc_id, d.doc_id // 10 AS domain_id, d.doc_id % 2 = 0 AS required, CASE WHEN toxic = 1 THEN 'failed' WHEN quality IS NULL AND d.doc_id % 17 = 0 THEN 'unsupported' WHEN n_chars < 60 THEN 'noise' ELSE 'included' END AS state,
  CASE WHEN quality = 1 OR d.doc_id % 4 <> 0 THEN 'processed' WHEN quality = 0 OR d.doc_id % 3 = 0 THEN 'not_used' END AS outcome FROM documents d LEFT JOIN labels USING (doc_id)),
m AS (SELECT domain_id, count(*) FILTER (state = 'included' AND outcome IS NULL) AS silent, round(count(*) FILTER (doc_id % 101 <> 7) / count(*), 6) AS accounting, count(*) FILTER (required AND state = 'failed') AS required_failed, count(*) FILTER (required AND state = 'unsupported') AS required_unsupported,
  (count(*) FILTER (required) > 0 AND count(*) FILTER (required AND state = 'included') = 0)::INT::BIGINT AS required_bare, count(*) FILTER (state = 'included' AND doc_id % 97 = 5) AS unassigned, count(*) FILTER (state = 'included') AS canonical, count(*) FILTER (state = 'included' AND outcome = 'processed') AS processed,
  count(*) FILTER (required AND state = 'included' AND outcome IS DISTINCT FROM 'processed') AS required_unprocessed, count(*) FILTER (doc_id % 83 = 3) AS refs_invalid, count(*) FILTER (doc_id % 71 = 2) AS segments_failed, count(DISTINCT doc_id // 5) AS segments, count(DISTINCT CASE WHEN doc_id % 61 <> 1 THEN doc_id // 5 END) AS segments_merged, count(*) FILTER (doc_id % 53 = 4) AS structures_dropped FROM i GROUP BY 1),
r AS (SELECT *, CASE WHEN canonical = 0 THEN 0.0 ELSE round(processed / canonical, 6) END AS semantic FROM m),
g AS (SELECT *, concat_ws(',', CASE WHEN silent > 0 THEN 'silent_dropped' END, CASE WHEN accounting < 1 THEN 'domain_accounting_rate' END, CASE WHEN required_failed > 0 THEN 'required_items_failed' END, CASE WHEN required_unsupported > 0 THEN 'required_items_unsupported' END, CASE WHEN required_bare > 0 THEN 'required_items_without_canonical_span' END, CASE WHEN unassigned > 0 THEN 'unassigned_count' END) AS blocks,
  concat_ws(',', CASE WHEN canonical = 0 THEN 'canonical_non_noise_spans' END, CASE WHEN semantic < 1 - 1e-9 THEN 'semantic_processing_rate' END, CASE WHEN required_unprocessed > 0 THEN 'required_spans_unprocessed' END, CASE WHEN refs_invalid > 0 THEN 'source_refs_invalid' END, CASE WHEN segments_failed > 0 THEN 'segment_failed_count' END, CASE WHEN segments_merged < segments THEN 'merge' END, CASE WHEN structures_dropped > 0 THEN 'structures_dropped' END) AS lacks FROM r)
SELECT domain_id, accounting, semantic, CASE WHEN blocks <> '' THEN 'failed' WHEN lacks <> '' THEN 'degraded' ELSE 'passed' END AS gate, CASE WHEN blocks <> '' THEN blocks ELSE lacks END AS reasons FROM g""")
def coverage_gate_whole(spark, d):
    """The gate of each ten documents by all of its metrics."""
    i = F.col("doc_id")
    state = F.when(F.col("toxic") == 1, "failed").when(F.col("quality").isNull() & (i % 17 == 0), "unsupported").when(F.col("n_chars") < 60, "noise").otherwise("included")
    outcome = F.when((F.coalesce("quality", F.lit(0)) == 1) | (i % 4 != 0), "processed").when((F.col("quality") == 0) | (i % 3 == 0), "not_used")
    items = load(spark, d, "documents").select("doc_id", "n_chars").join(load(spark, d, "labels"), "doc_id", "left").select("doc_id", F.floor(i / 10).alias("domain_id"), (i % 2 == 0).alias("required"), state.alias("state"), outcome.alias("outcome"))
    live, needed = F.col("state") == "included", F.col("required")
    m = items.groupBy("domain_id").agg(
        F.count_if(live & F.col("outcome").isNull()).alias("silent"), nm.ratio(F.count_if(i % 101 != 7), F.count("*"), 1.0).alias("accounting"),
        F.count_if(needed & (F.col("state") == "failed")).alias("required_failed"), F.count_if(needed & (F.col("state") == "unsupported")).alias("required_unsupported"),
        ((F.count_if(needed) > 0) & (F.count_if(needed & live) == 0)).cast("long").alias("required_bare"), F.count_if(live & (i % 97 == 5)).alias("unassigned"), F.count_if(live).alias("canonical"),
        nm.ratio(F.count_if(live & (F.col("outcome") == "processed")), F.count_if(live)).alias("semantic"), F.count_if(needed & live & ~F.col("outcome").eqNullSafe("processed")).alias("required_unprocessed"),
        F.count_if(i % 83 == 3).alias("refs_invalid"), F.count_if(i % 71 == 2).alias("segments_failed"), F.count_distinct(F.floor(i / 5)).alias("segments"),
        F.count_distinct(F.when(i % 61 != 1, F.floor(i / 5))).alias("segments_merged"), F.count_if(i % 53 == 4).alias("structures_dropped"),
    )
    return rules.whole_gate(m).select("domain_id", "accounting", "semantic", "gate", "reasons")


EVIDENCE = CLAIMS + """,
made AS (SELECT claim_id, claim_id % 7 AS invocation FROM claims WHERE claim_id % 29 <> 11),
reads AS (SELECT DISTINCT (doc_id + unnest([0, 6])) % 7 AS invocation, 'T' || lpad(doc_id::VARCHAR, 6, '0') AS ref FROM documents WHERE doc_id % 4 <> 3),
flags AS (SELECT b.*, m.invocation IS NOT NULL AS known_producer, EXISTS (SELECT 1 FROM reads r WHERE r.invocation = m.invocation AND r.ref = b.ref) AS shown, EXISTS (SELECT 1 FROM reads r WHERE r.ref = b.ref) AS read FROM bound b LEFT JOIN made m USING (claim_id)),
sources AS (SELECT *, CASE binding WHEN 'invalid' THEN 'malformed_source_id' WHEN 'cross_domain' THEN 'cross_domain_source_id' WHEN 'missing' THEN 'source_not_in_domain' ELSE CASE WHEN NOT shown AND claim_type <> 'ai_explanation' THEN 'source_not_presented_to_this_claim_producer' END END AS failure FROM flags),
nested AS (SELECT c.claim_id, c.claim_type, c.domain_id, CASE WHEN c.claim_type = 'ai_explanation' THEN 'not_required' WHEN count(*) FILTER (s.binding = 'bound' AND s.failure IS NULL) > 0 AND c.claim_id % 29 <> 11 THEN 'passed' ELSE 'failed' END AS status,
  concat_ws(';', CASE WHEN c.claim_type <> 'ai_explanation' AND c.claim_id % 29 = 11 THEN 'producer_visibility_missing' END, string_agg(s.failure || ':' || s.ref, ';' ORDER BY s.ref)) AS reasons,
  string_agg(s.ref || '=' || s.binding || CASE WHEN s.shown THEN '+' ELSE '' END, ' ' ORDER BY s.ref) AS sources FROM claims c LEFT JOIN sources s USING (claim_id) GROUP BY 1, 2, 3)
"""


def _evidence(spark, d):
    claims, refs, spans = _claim_tables(spark, d)
    i = F.col("doc_id")
    producers = claims.select("claim_id", F.when(F.col("claim_id") % 29 != 11, F.col("claim_id") % 7).alias("invocation"))
    reads = load(spark, d, "documents").filter("doc_id % 4 <> 3").select(F.explode(F.array(i % 7, (i + 6) % 7)).alias("invocation"), tx.sequence_id(F.lit("T"), i).alias("ref"))
    sources = evidence.bound_sources(claims, refs, spans, producers, reads)
    return claims, sources, evidence.claims_with_sources(claims, sources, producers)


@query(EVIDENCE + "SELECT * FROM nested")
def evidence_claims(spark, d):
    """Claims with their sources, and why these don't count: bound elsewhere or nowhere, or not shown to the producer."""
    nested = _evidence(spark, d)[2]
    mark = lambda s: F.concat(s["ref"], F.lit("="), s["binding"], F.when(s["shown"], "+").otherwise(""))
    return nested.select("claim_id", "claim_type", "domain_id", "status", F.array_join("reasons", ";").alias("reasons"), F.array_join(F.transform("sources", mark), " ").alias("sources"))


@query(EVIDENCE + """, by_source AS (SELECT claim_id // 4 AS domain_id, count(*) FILTER (binding = 'invalid') AS invalid, count(*) FILTER (binding = 'cross_domain') AS cross_domain, count(*) FILTER (binding = 'missing') AS missing, count(*) FILTER (failure LIKE 'source_not_presented%') AS not_shown, count(*) FILTER (failure LIKE 'source_not_presented%' AND NOT read) AS unread FROM sources GROUP BY 1),
by_claim AS (SELECT claim_id // 4 AS domain_id, count(*) FILTER (reasons LIKE 'producer%') AS without_provenance, count(*) FILTER (status = 'failed') AS failed_claims, count(*) FILTER (claim_type = 'definition') AS critical, count(*) FILTER (claim_type = 'definition' AND status = 'passed') AS critical_bound FROM nested GROUP BY 1),
r AS (SELECT domain_id, CASE WHEN critical = 0 THEN 1.0 ELSE round(critical_bound / critical, 6) END AS critical_rate, concat_ws(',', CASE WHEN invalid > 0 THEN 'invalid_source_refs' END, CASE WHEN cross_domain > 0 THEN 'cross_domain_refs' END, CASE WHEN missing > 0 THEN 'unbound_source_refs' END, CASE WHEN not_shown > 0 THEN 'not_in_claim_producer_refs' END, CASE WHEN without_provenance > 0 THEN 'claims_without_provenance' END,
  CASE WHEN unread > 0 THEN 'unread_source_refs' END, CASE WHEN failed_claims > 0 THEN 'failed_claims' END, CASE WHEN critical_bound < critical THEN 'critical_claim_evidence_rate' END) AS reasons FROM by_claim LEFT JOIN by_source USING (domain_id))
SELECT *, CASE WHEN reasons <> '' THEN 'failed' ELSE 'passed' END AS gate FROM r""")
def evidence_gates(spark, d):
    """The evidence gate of each four claims, with the rate of critical ones that pass (1.0 without any)."""
    claims, sources, nested = _evidence(spark, d)
    of = claims.select("claim_id", F.floor(F.col("claim_id") / 4).alias("four"))
    report = evidence.evidence_report(of, nested, sources, "four").withColumnRenamed("four", "domain_id")
    return rules.evidence_gate(report).select("domain_id", nm.ratio(F.col("critical_bound"), F.col("critical"), 1.0).alias("critical_rate"), "reasons", "gate")


@query("""
WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'ppt' WHEN 2 THEN 'image' WHEN 3 THEN 'transcript' WHEN 4 THEN NULL ELSE 'text' END AS kind, CASE page_id % 7 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'needs_ocr' WHEN 2 THEN 'parsing' WHEN 3 THEN 'transcribing' WHEN 4 THEN NULL ELSE 'ready' END AS status, CASE WHEN page_id % 11 = 0 THEN '[docx 解析失败: ' || url WHEN page_id % 11 = 1 THEN url END AS error FROM pages),
s AS (SELECT page_id, CASE WHEN starts_with(error, '[') AND length(error) <= 300 OR status = 'FAILED' THEN 'parse_failed' WHEN status IN ('needs_ocr', 'transcribing') THEN 'unsupported_parse_state' WHEN kind IS NULL OR kind = 'image' THEN 'unsupported_file_type' END AS reason FROM p)
SELECT page_id, CASE WHEN reason IS NULL THEN 'included' WHEN reason = 'parse_failed' THEN 'failed' ELSE 'unsupported' END AS state, reason, CASE WHEN reason = 'parse_failed' THEN 'failed_parse' WHEN reason IS NOT NULL THEN 'unsupported_file_type' END AS span_reason FROM s""")
def item_states(spark, d):
    i = F.col("page_id")
    kind = F.when(i % 6 == 0, "pdf").when(i % 6 == 1, "ppt").when(i % 6 == 2, "image").when(i % 6 == 3, "transcript").when(i % 6 == 5, "text")
    status = F.when(i % 7 == 0, "FAILED").when(i % 7 == 1, "needs_ocr").when(i % 7 == 2, "parsing").when(i % 7 == 3, "transcribing").when(i % 7 > 4, "ready")
    error = F.when(i % 11 == 0, F.concat(F.lit("[docx 解析失败: "), "url")).when(i % 11 == 1, F.col("url"))
    of = load(spark, d, "pages").select("page_id", rules.item_state(kind, status, error).alias("of"))
    return of.select("page_id", "of.state", "of.reason", rules.span_reason(F.col("of.reason")).alias("span_reason"))


@query("""
WITH e AS (SELECT event_id, upper(substr(event_type, 1, 1)) AS prefix, event_id % 5 = 0 AS ended FROM events),
live AS (SELECT prefix, event_id, row_number() OVER (PARTITION BY prefix ORDER BY event_id) AS n FROM e WHERE NOT ended),
over_ AS (SELECT prefix, event_id, row_number() OVER (PARTITION BY prefix ORDER BY event_id) + (SELECT count(*) FROM live WHERE live.prefix = e.prefix) AS n FROM e WHERE ended)
SELECT event_id, prefix || lpad(n::VARCHAR, 6, '0') AS source_id FROM (SELECT * FROM live UNION ALL SELECT * FROM over_)""")
def terminal_source_ids(spark, d):
    """Numbers of live items, and after them those of items that ended without content."""
    e = load(spark, d, "events").select("event_id", F.upper(F.substring("event_type", 1, 1)).alias("prefix"))
    return rules.terminal_ids(e, "prefix", "event_id", F.col("event_id") % 5 == 0).select("event_id", "source_id")


@query("""
SELECT event_id, CASE WHEN event_id % 7 = 3 THEN NULL ELSE greatest((epoch_us(date_trunc('second', ts) + to_seconds(floor(value)::BIGINT - 10)) - epoch_us(date_trunc('second', ts))) // 1000, 0) END AS latency_ms FROM events""")
def node_latency(spark, d):
    """Times of start and end as text, to the second; some are none."""
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    end = F.timestamp_seconds(F.unix_seconds(at) + F.floor("value") - 10)
    text = lambda c, form: F.date_format(c, form)
    start_text = F.when(F.col("event_id") % 2 == 0, text(at, "yyyy-MM-dd HH:mm:ss")).otherwise(text(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    end_text = F.when(F.col("event_id") % 7 == 3, "soon").otherwise(text(end, "yyyy-MM-dd HH:mm:ss"))
    return load(spark, d, "events").select("event_id", rules.duration_ms(start_text, end_text).alias("latency_ms"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 500")
def page_of_rows(spark, d):
    """The second page of 500 rows."""
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(500).limit(500)


@query("SELECT p_partkey FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def narrowest_scope(spark, d):
    """Three scopes of which the narrowest isn't given: the next one filters."""
    part = load(spark, d, "part")
    kind = part.agg(F.min("p_type")).first()[0]
    return rel.narrowest_scope(part, p_partkey=None, p_type=kind, p_brand="any").select("p_partkey")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer)")
def single_row(spark, d):
    """One row by its key, which pushes down to the scan, without a sensitive column."""
    customers = load(spark, d, "customer")
    return rel.optional_filters(customers, c_custkey=customers.agg(F.max("c_custkey")).first()[0], c_mktsegment=None, c_nationkey=None).drop("c_acctbal", "c_mktsegment")


@query("""
WITH f AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'up_' ELSE 'x_' END || event_id AS name, ts, (SELECT max(ts) FROM events) AS now FROM events)
SELECT event_id, name FROM f WHERE starts_with(name, 'up_') AND ts < now - INTERVAL 24 HOUR AND ts < now - INTERVAL 5 MINUTE""")
def stale_uploads(spark, d):
    """Left uploads of over a day; those of the last five minutes are never touched."""
    e = load(spark, d, "events").select("event_id", F.concat(F.when(F.col("event_id") % 3 == 0, "up_").otherwise("x_"), F.col("event_id").cast("string")).alias("name"), "ts")
    now = e.agg(F.max("ts").alias("now"))
    old = F.col("ts") < F.least(F.col("now") - F.expr("INTERVAL 24 HOURS"), F.col("now") - F.expr("INTERVAL 5 MINUTES"))
    return e.filter(F.startswith("name", F.lit("up_"))).crossJoin(F.broadcast(now)).filter(old).select("event_id", "name")  # one row


@query("SELECT source, count(*) AS indexable, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9]')) AS indexed FROM documents GROUP BY 1")
def index_status(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("indexable"), F.count_if(F.col("text").rlike("[A-Za-z0-9]")).alias("indexed"))


@query("SELECT o.o_orderkey, k.kept_id AS custkey FROM orders o JOIN (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS kept_id FROM customer) k ON k.c_custkey = o.o_custkey")
def children_remapped(spark, d):
    """Of customers that count as one the least id stays, and orders follow it."""
    kept = rel.keep_least_id(load(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey").select(F.col("c_custkey").alias("o_custkey"), "kept_id")
    return load(spark, d, "orders").join(kept, "o_custkey").select("o_orderkey", F.col("kept_id").alias("custkey"))


@query("""
SELECT event_type || ':' || (user_id % 50) AS item_key, max(CASE WHEN value >= 40 THEN 3 WHEN value >= 10 THEN 2 ELSE 1 END) AS severity, round(max(least(value / 60, 1)), 6) AS confidence, array_to_string(list_sort(list_distinct(list(event_id % 40))), ',') AS refs, count(*) AS merged FROM events GROUP BY 1""")
def merged_items(spark, d):
    """Items of one key: the greatest severity and confidence, and the references of all."""
    key = F.concat("event_type", F.lit(":"), (F.col("user_id") % 50).cast("string"))
    severity = F.when(F.col("value") >= 40, 3).when(F.col("value") >= 10, 2).otherwise(1)
    return load(spark, d, "events").groupBy(key.alias("item_key")).agg(F.max(severity).alias("severity"), F.round(F.max(F.least(F.col("value") / 60, F.lit(1.0))), 6).alias("confidence"), F.array_join(F.sort_array(F.collect_set(F.col("event_id") % 40)), ",").alias("refs"), F.count("*").alias("merged"))


@query("""
WITH k AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'def:' WHEN 'click' THEN 'formula:' WHEN 'error' THEN 'derive:' WHEN 'signup' THEN 'example:' ELSE event_type || ':' END || json_extract_string(props, '$.k') AS structure_key FROM events WHERE event_id % 10 <> 0)
SELECT structure_key, count(*) AS blocks, min(event_id) AS first_block, (SELECT count(*) FROM k) = (SELECT sum(n) FROM (SELECT count(*) AS n FROM k GROUP BY structure_key)) AS conserved FROM k GROUP BY 1""")
def merged_structures(spark, d):
    """Blocks of one stable key become one, and whether all that came in are in some group."""
    kind = F.col("event_type")
    key = F.concat(F.when(kind == "view", "def:").when(kind == "click", "formula:").when(kind == "error", "derive:").when(kind == "signup", "example:").otherwise(F.concat(kind, F.lit(":"))), F.get_json_object("props", "$.k"))
    blocks = load(spark, d, "events").filter("event_id % 10 <> 0").select("event_id", key.alias("structure_key"))
    merged = blocks.groupBy("structure_key").agg(F.count("*").alias("blocks"), F.min("event_id").alias("first_block"))
    total = blocks.agg(F.count("*").alias("came")).crossJoin(merged.agg(F.sum("blocks").alias("went")))
    return merged.crossJoin(F.broadcast(total)).select("structure_key", "blocks", "first_block", (F.col("came") == F.col("went")).alias("conserved"))  # one row


@query("""
WITH p AS (SELECT p_partkey, p_size % 5 + 1 AS first, p_size % 5 + 1 + p_size % 8 AS last, p_partkey % 2 = 1 AS odd, p_size % 7 + 1 AS weekday FROM part),
w AS (SELECT p_partkey, weekday, odd, unnest(range(first, last + 1)) AS week FROM p)
SELECT DISTINCT p_partkey, (DATE '2024-02-26' + ((week - 1) * 7 + weekday - 1)::INT)::VARCHAR AS day FROM w WHERE NOT odd OR week % 2 = 1""")
def term_dates(spark, d):
    """Days of every week of a range, or of its odd weeks, from the first Monday of a term."""
    size = F.col("p_size")
    weeks = load(spark, d, "part").select("p_partkey", (size % 7 + 1).alias("weekday"), (F.col("p_partkey") % 2 == 1).alias("odd"), F.explode(F.sequence(size % 5 + 1, size % 5 + 1 + size % 8)).alias("week"))
    day = F.date_add(F.lit("2024-02-26").cast("date"), ((F.col("week") - 1) * 7 + F.col("weekday") - 1).cast("int"))
    return weeks.filter(~F.col("odd") | (F.col("week") % 2 == 1)).select("p_partkey", day.cast("string").alias("day")).distinct()


@query("SELECT event_id, k AS span, json_extract_string(props, '$.' || k)::BIGINT AS segment FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def assignment_map(spark, d):
    """A plan's JSON object as rows of span and segment."""
    return load(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string, bigint>")).alias("span", "segment"))


@query("""
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0 THEN 'workday_without_source' END, CASE WHEN o_custkey % 9 NOT IN (1, 2, 3, 4, 5, 6, 7) THEN 'weekday' END, CASE WHEN o_custkey % 20 > o_orderkey % 25 THEN 'weeks' END) AS problems
FROM orders""")
def calendar_problems(spark, d):
    """What a calendar row lacks: a workday its source date, a rule a weekday from 1 to 7 or weeks in order."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = load(spark, d, "orders").select("o_orderkey", (key % 4 == 0).alias("workday"), F.when(key % 3 == 0, F.col("o_orderdate")).alias("source_date"), (cust % 9).alias("weekday"), (cust % 20).alias("first"), (key % 25).alias("last"))
    return rows.select("o_orderkey", rules.named(("workday_without_source", F.col("workday") & F.col("source_date").isNull()), ("weekday", ~F.col("weekday").between(1, 7)), ("weeks", F.col("first") > F.col("last"))).alias("problems"))


@query("""
WITH r AS (SELECT s_nationkey AS role, min(s_suppkey) AS model FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
SELECT s.s_suppkey AS model, count(r.role) > 0 AS is_default, count(r.role) AS roles FROM supplier s LEFT JOIN r ON r.model = s.s_suppkey GROUP BY 1""")
def model_flags(spark, d):
    """Models with whether they come first in the route of some role."""
    models = load(spark, d, "supplier")
    first = models.filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("role")).agg(F.min("s_suppkey").alias("model"))
    held = first.groupBy("model").agg(F.count("*").alias("roles"))
    return models.select(F.col("s_suppkey").alias("model")).join(held, "model", "left").select("model", F.col("roles").isNotNull().alias("is_default"), F.coalesce("roles", F.lit(0)).alias("roles"))
