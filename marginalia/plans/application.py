"""Application queries: visibility, updates, guards, nested reports, references, dates and indexes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import numeric as nm
from marginalia.functions import text as tx
from marginalia.operators import relational as op
from marginalia.operators import retrieval
from marginalia.plans.registry import query
from marginalia.tables import events, load, load_texts


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS answer, o_orderstatus = 'F' AS revealed FROM orders")
def visible_answers(spark, d):
    """Answers show only once they are handed in."""
    done = F.col("o_orderstatus") == "F"
    return load(spark, d, "orders").select("o_orderkey", F.when(done, F.col("o_totalprice")).alias("answer"), done.alias("revealed"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'P' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 2 <> 0 THEN 'not_asked' WHEN o_orderstatus = 'O' THEN 'changed' ELSE 'conflict' END AS outcome FROM orders")
def compare_and_set(spark, d):
    """Updates that hold only where the row still has the status they expect."""
    asked, fits = F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus") == "O"
    return load(spark, d, "orders").select("o_orderkey", F.when(asked & fits, "P").otherwise(F.col("o_orderstatus")).alias("status"), F.when(~asked, "not_asked").when(fits, "changed").otherwise("conflict").alias("outcome"))


@query("SELECT s_suppkey, n_name, CASE n_regionkey WHEN 0 THEN s_acctbal > 0 WHEN 1 THEN s_acctbal > 1000 ELSE false END AS allowed FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def capability_matrix(spark, d):
    """Whether each supplier meets the least balance of its role; the table of roles has two rows."""
    roles = spark.createDataFrame([(0, 0.0), (1, 1000.0)], "n_regionkey int, least double")
    s = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(roles), "n_regionkey", "left")
    return s.select("s_suppkey", "n_name", F.coalesce(F.col("s_acctbal") > F.col("least"), F.lit(False)).alias("allowed"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' ORDER BY o_orderdate, o_orderkey LIMIT 5")
def upcoming_first(spark, d):
    return load(spark, d, "orders").filter(F.col("o_orderdate") >= F.lit("1995-06-01").cast("timestamp_ntz")).orderBy("o_orderdate", "o_orderkey").limit(5).select("o_orderkey", "o_orderdate")


@query("SELECT l_returnflag, count(*) AS n, l_returnflag IN ('A', 'N') AS valid FROM lineitem GROUP BY 1")
def enum_violations(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")).withColumn("valid", F.col("l_returnflag").isin("A", "N"))


@query("SELECT d.doc_id, l.quality, b.item_id FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id WHERE d.lang = 'de' OR l.toxic = 1 OR b.item_id IS NOT NULL")
def left_joins_or_filter(spark, d):
    joined = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left").join(load(spark, d, "benchmark").select("item_id"), F.col("doc_id") == F.col("item_id"), "left")
    return joined.filter((F.col("lang") == "de") | (F.col("toxic") == 1) | F.col("item_id").isNotNull()).select("doc_id", "quality", "item_id")


@query("""
WITH m AS (SELECT s_nationkey, s_name AS model, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier WHERE s_acctbal > 0)
SELECT n.n_name AS role, coalesce(m.model, 'default') AS model, coalesce(m.place, 1)::INT AS place FROM nation n LEFT JOIN m ON m.s_nationkey = n.n_nationkey AND m.place <= 5""")
def role_routes(spark, d):
    """Enabled models of each role in order, at most five, or the default."""
    enabled = load(spark, d, "supplier").filter("s_acctbal > 0")
    routed = op.top_per_key(enabled, ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], 5)
    return load(spark, d, "nation").join(routed, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_name").alias("role"), F.coalesce("s_name", F.lit("default")).alias("model"), F.coalesce("rank", F.lit(1)).alias("place"))


@query("SELECT n_name, s_suppkey FROM nation JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) p ON p.s_nationkey = n_nationkey WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def disable_guard(spark, d):
    """Primary suppliers that are in use, and so can't be disabled."""
    primary = load(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    used = load(spark, d, "lineitem").filter("l_quantity > 49")
    return primary.join(used, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey")


@query("SELECT conv_id, count(*) FILTER (length(text) < 100) AS short, count(*) FILTER (length(text) BETWEEN 100 AND 500) AS medium, count(*) FILTER (length(text) > 500) AS long, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS assistant_chars FROM conversations GROUP BY 1")
def segment_stats(spark, d):
    n = F.length("text")
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(n < 100).alias("short"), F.count_if(n.between(100, 500)).alias("medium"), F.count_if(n > 500).alias("long"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", n)), F.lit(0)).cast("long").alias("assistant_chars"))


@query("""
WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS offered, count(*) FILTER (event_type = 'purchase' AND value > 50) AS used FROM events GROUP BY 1)
SELECT user_id, CASE WHEN offered <= 0 THEN 1.0 ELSE round(used / offered, 6) END AS coverage, CASE WHEN offered <= 0 THEN 0.0 ELSE round(used / offered, 6) END AS utilization FROM g""")
def input_coverage(spark, d):
    bought = F.col("event_type") == "purchase"
    g = load(spark, d, "events").groupBy("user_id").agg(F.count_if(bought).alias("offered"), F.count_if(bought & (F.col("value") > 50)).alias("used"))
    return g.select("user_id", nm.ratio(F.col("used"), F.col("offered"), 1.0).alias("coverage"), nm.ratio(F.col("used"), F.col("offered")).alias("utilization"))


@query("""
WITH m AS (SELECT user_id, least(1.0, greatest(0.0, 0.5 + sum(CASE WHEN value > 20 THEN 0.15 ELSE -0.25 END) / count(*))) AS mastery, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, round(mastery, 6) AS mastery, n FROM m WHERE CASE WHEN mastery = 0 THEN 0.5 ELSE mastery END < 0.7 ORDER BY round(mastery, 6), n DESC, user_id""")
def review_priority(spark, d):
    """Units below 0.7, where none counts as 0.5, weakest first."""
    step = F.when(F.col("value") > 20, 0.15).otherwise(-0.25)
    m = load(spark, d, "events").groupBy("user_id").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) + F.sum(step) / F.count("*"))).alias("mastery"), F.count("*").alias("n"))
    weak = m.filter(F.when(F.col("mastery") == 0, 0.5).otherwise(F.col("mastery")) < 0.7)
    return weak.select("user_id", F.round("mastery", 6).alias("mastery"), "n").orderBy("mastery", F.col("n").desc(), "user_id")


@query("""
WITH q AS (SELECT list_distinct(string_split('the quick brown fox', '')) AS q), s AS (SELECT doc_id, list_distinct(string_split(lower(text), '')) AS t FROM documents)
SELECT doc_id, round(len(list_intersect(t, q)) / len(t), 6) AS overlap, round(1.0 / (row_number() OVER (PARTITION BY doc_id % 50 ORDER BY len(list_intersect(t, q)) DESC, doc_id) + 1), 6) AS rerank FROM s, q""")
def charset_overlap(spark, d):
    """How much of a text's characters a query has, and reciprocal ranks by that within a scope."""
    q = F.array_distinct(F.split(F.lit("the quick brown fox"), ""))
    s = load(spark, d, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), "")).alias("t")).withColumn("hits", F.size(F.array_intersect("t", q)))
    place = F.row_number().over(W.partitionBy(F.col("doc_id") % 50).orderBy(F.col("hits").desc(), "doc_id"))
    return s.select("doc_id", F.round(F.col("hits") / F.size("t"), 6).alias("overlap"), F.round(1 / (place + 1), 6).alias("rerank"))


@query("""
WITH u AS (SELECT p_partkey, p_size, list_distinct(list_transform(regexp_extract_all(p_type, '[A-Za-z0-9]{2,}'), lambda x: lower(x))) AS t FROM part),
s AS (SELECT p_partkey, p_size, count(*) OVER (PARTITION BY p_size) AS candidates, round(len(list_intersect(t, ['standard', 'small', 'brass'])) / len(list_distinct(list_concat(t, ['standard', 'small', 'brass']))), 6) AS score FROM u)
SELECT p_size, p_partkey, score FROM s WHERE score > 0 OR candidates = 1 QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY score DESC, p_partkey) <= 3""")
def term_match_rescue(spark, d):
    """The three best of each scope by term overlap; a single candidate stays even without any."""
    wanted = F.array(*map(F.lit, ("standard", "small", "brass")))
    s = load(spark, d, "part").select("p_size", "p_partkey", F.round(nm.jaccard(tx.term_set(F.col("p_type")), wanted), 6).alias("score"))
    counts = s.groupBy("p_size").agg(F.count("*").alias("candidates"))
    kept = s.join(counts, "p_size").filter((F.col("score") > 0) | (F.col("candidates") == 1))
    return op.top_per_key(kept, ["p_size"], [F.col("score").desc(), F.col("p_partkey")], 3).select("p_size", "p_partkey", "score")


@query("""
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN epoch_us(date_trunc('second', ts)) - CASE WHEN event_id % 4 = 2 THEN 28800000000 ELSE 0 END END AS us FROM events""")
def utc_parse(spark, d):
    """Naive and offset time strings to UTC; what isn't a time is null."""
    by, whole = F.col("event_id") % 4, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    raw = F.when(by == 0, whole).when(by == 1, F.concat(F.replace(whole, F.lit(" "), F.lit("T")), F.lit("Z"))).when(by == 2, F.concat(F.replace(whole, F.lit(" "), F.lit("T")), F.lit("+08:00"))).otherwise("not a time")
    return load(spark, d, "events").select("event_id", F.unix_micros(raw.try_cast("timestamp")).alias("us"))


@query("""
SELECT o_orderkey, (o_orderdate + INTERVAL 600 SECOND) AS lease_until, date_diff('day', o_orderdate::DATE, DATE '1998-12-31') AS days_left, greatest(1, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 * (o_orderkey % 30) END)::BIGINT AS review_in FROM orders""")
def lease_and_review_dates(spark, d):
    key = F.col("o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", F.expr("o_orderdate + INTERVAL 600 SECONDS").alias("lease_until"), F.datediff(F.lit("1998-12-31").cast("date"), F.col("o_orderdate")).cast("long").alias("days_left"), F.greatest(F.lit(1), F.when(key % 2 == 0, 1).otherwise(2 * (key % 30))).cast("long").alias("review_in"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE user_id END AS ref FROM events""")
def reference_coerce(spark, d):
    """A whole number, ``chunk 12`` or an object with an id to the number; null for all else."""
    by, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    raw = F.when(by == 0, user).when(by == 1, F.concat(F.lit("Chunk #"), user)).when(by == 2, F.concat(F.lit('{"id": '), user, F.lit("}"))).otherwise("none")
    digits = F.regexp_extract(F.coalesce(F.get_json_object(F.when(F.startswith(raw, F.lit("{")), raw), "$.id"), raw), r"(?i)^(?:chunk\s*#?)?\s*([0-9]+)$", 1)
    return load(spark, d, "events").select("event_id", F.when(digits != "", digits.cast("long")).alias("ref"))


@query("""
WITH r AS (SELECT doc_id, ['T' || lpad(doc_id::VARCHAR, 6, '0'), 'bad', 'P0001.02', 'T1', 'P0001.02'] AS refs FROM documents)
SELECT doc_id, array_to_string(list_filter(refs, lambda x, i: regexp_matches(x, '^[TPDIS][0-9]{4,6}([.][0-9]{1,2})?$') AND list_position(refs, x) = i), ',') AS kept, len(list_distinct(list_filter(refs, lambda x: NOT regexp_matches(x, '^[TPDIS][0-9]{4,6}([.][0-9]{1,2})?$')))) AS dropped FROM r""")
def invalid_ref_removal(spark, d):
    refs = F.array(tx.sequence_id(F.lit("T"), F.col("doc_id")), *map(F.lit, ("bad", "P0001.02", "T1", "P0001.02")))
    r = load(spark, d, "documents").select("doc_id", F.array_distinct(refs).alias("refs"))
    kept = F.filter("refs", tx.is_source_id)
    return r.select("doc_id", F.array_join(kept, ",").alias("kept"), (F.size("refs") - F.size(kept)).cast("long").alias("dropped"))


@query("SELECT event_id, ['ok', 'empty', 'not_json', 'schema'][event_id % 4 + 1] AS verdict FROM events")
def validated_json(spark, d):
    """Empty, no JSON, JSON of another shape, or good."""
    by = F.col("event_id") % 4
    raw = F.when(by == 0, '{"id": 1, "name": "x"}').when(by == 1, " ").when(by == 2, "{nope").otherwise('{"id": "x"}')
    parsed = F.from_json(raw, "id int, name string", {"mode": "PERMISSIVE"})
    shape = F.get_json_object(raw, "$.name").isNotNull() & parsed["id"].isNotNull()
    broken = F.expr("try_parse_json(raw) IS NULL")
    return load(spark, d, "events").withColumn("raw", raw).select("event_id", F.when(F.trim("raw") == "", "empty").when(broken, "not_json").when(shape, "ok").otherwise("schema").alias("verdict"))


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), l AS (SELECT doc_id, list_concat(w[1:3], w[2:5], w[1:2]) AS refs FROM w)
SELECT doc_id, array_to_string(list_filter(refs, lambda x, i: list_position(refs, x) = i)[1:4], ' ') AS refs, len(list_distinct(refs)) > 4 AS truncated FROM l""")
def nested_refs(spark, d):
    """References of several lists, distinct in order, with the list capped and the cap told."""
    w = load(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    refs = F.array_distinct(F.flatten(F.array(F.slice("w", 1, 3), F.slice("w", 2, 4), F.slice("w", 1, 2))))
    return w.select("doc_id", F.array_join(F.slice(refs, 1, 4), " ").alias("refs"), (F.size(refs) > 4).alias("truncated"))


@query("""
WITH s AS (SELECT conv_id, role, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS blocks, count(*) AS n FROM conversations GROUP BY 1, 2)
SELECT conv_id, string_agg(role || '(' || blocks || ')', ' ' ORDER BY role) AS document, bool_or(role = 'assistant' AND n > 0) AS has_answer, max(n) > 4 AS long_section FROM s GROUP BY 1""")
def composed_sections(spark, d):
    """Sections of each conversation by role, and what a review of the composition asks."""
    s = load(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_join(F.transform(F.sort_array(F.collect_list("turn")), lambda t: t.cast("string")), ",").alias("blocks"), F.count("*").alias("n"))
    section = F.concat("role", F.lit("("), "blocks", F.lit(")"))
    return s.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(section)), " ").alias("document"), F.bool_or(F.col("role") == "assistant").alias("has_answer"), (F.max("n") > 4).alias("long_section"))


@query("""
WITH old AS (SELECT source, sum(n_chars) AS h FROM documents WHERE doc_id % 10 <> 0 GROUP BY 1), new AS (SELECT source, sum(n_chars) AS h, count(*) AS n FROM documents GROUP BY 1)
SELECT new.source, CASE WHEN old.h IS NULL THEN 'build' WHEN old.h = new.h THEN 'reuse' ELSE 'rebuild' END AS action, new.n FROM new LEFT JOIN old USING (source)""")
def rebuild_on_hash(spark, d):
    """Parts whose input changed are rebuilt; the others are used again."""
    docs = load(spark, d, "documents")
    old, new = docs.filter("doc_id % 10 <> 0").groupBy("source").agg(F.sum("n_chars").alias("old")), docs.groupBy("source").agg(F.sum("n_chars").alias("new"), F.count("*").alias("n"))
    action = F.when(F.col("old").isNull(), "build").when(F.col("old") == F.col("new"), "reuse").otherwise("rebuild")
    return new.join(old, "source", "left").select("source", action.alias("action"), "n")


def _digests(docs, name):
    """A digest of each source's documents that no order changes: how many, and sums of two hashes of id and text."""
    key = F.concat_ws(":", "doc_id", F.sha2("text", 256))
    total = lambda seed: F.sum(F.xxhash64(key, F.lit(seed)).cast("decimal(20,0)"))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.struct(F.count("*"), total(1), total(2)).alias(name))


def _rebuild(old, new):
    before, now = _digests(old, "old").drop("n"), _digests(new, "new")
    action = F.when(F.col("old").isNull(), "build").when(F.col("old") == F.col("new"), "reuse").otherwise("rebuild")
    return now.join(before, "source", "left").select("source", action.alias("action"), "n")


@query("""
WITH edited AS (SELECT source, text, CASE WHEN source = (SELECT min(source) FROM documents) AND doc_id % 10 = 0 THEN reverse(text) ELSE text END AS old FROM documents)
SELECT source, CASE WHEN bool_or(old <> text) THEN 'rebuild' ELSE 'reuse' END AS action, count(*) AS n FROM edited GROUP BY 1""")
def rebuild_on_digest(spark, d):
    """As rebuild_on_hash, by the texts themselves; before, each tenth text of the first source was another of the same
    length."""
    docs = load(spark, d, "documents")
    first = docs.agg(F.min("source").alias("first"))
    text = F.when((F.col("source") == F.col("first")) & (F.col("doc_id") % 10 == 0), F.reverse("text")).otherwise(F.col("text"))
    return _rebuild(docs.crossJoin(F.broadcast(first)).withColumn("text", text).drop("first"), docs)  # one row


@query("""
WITH t AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf, min(doc_id) AS first_doc FROM t GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5""")
def postings_index(spark, d):
    """Terms of the inverted index with how many documents and places they have. Places are counted per document first,
    so that a frequent term is summed from parts."""
    per = load(spark, d, "documents").select("doc_id", F.explode(tx.char_tokens(F.col("text"))).alias("term")).filter(F.col("term").rlike("^[a-z0-9]+$")).groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"), F.min("doc_id").alias("first_doc")).filter("df >= 5")


@query("""
WITH t AS (SELECT doc_id, unnest(list_concat(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)), regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}]'))) AS term FROM documents)
SELECT term, doc_id, count(*) AS tf FROM t GROUP BY 1, 2""")
def postings_whole(spark, d):
    """Postings of every term, the rarest and ideographs too: in which documents it is, and how often."""
    return retrieval.postings(load_texts(spark, d), "doc_id", F.col("text"))


@query("""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN upper(lang) || ' ' || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 10 = 3),
t AS (SELECT doc_id, unnest(list_concat(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)), regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}]'))) AS term FROM c), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY 1, 2)
SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS places, sha256(string_agg(term || ':' || tf, ',' ORDER BY term)) AS digest FROM p GROUP BY 1""")
def postings_updated(spark, d):
    """An index from which some documents go, and to which others come anew or changed, by document: terms, places and a
    digest of all postings, as a rebuild would have them."""
    docs, i = load_texts(spark, d), F.col("doc_id")
    index = retrieval.postings(docs.filter(i % 10 != 5), "doc_id", F.col("text"))
    changed = docs.filter((i % 10 == 3) | ((i % 10 == 5) & (i % 7 != 0))).select("doc_id", F.when(i % 10 == 3, F.concat_ws(" ", F.upper("lang"), "text")).otherwise(F.col("text")).alias("text"))
    now = retrieval.updated_postings(index, docs.filter((i % 7 == 0) & (i % 10 != 3)).select("doc_id"), changed, "doc_id", F.col("text"))
    each = F.transform(F.sort_array(F.collect_list(F.struct("term", "tf"))), lambda x: F.concat_ws(":", x["term"], x["tf"].cast("string")))  # of one document
    return now.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("places"), F.sha2(F.array_join(each, ","), 256).alias("digest"))


@query("""
WITH r AS (SELECT sha256(text) AS key, min(doc_id) AS reply FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT d.doc_id, r.reply, r.key IS NULL AS missing FROM documents d LEFT JOIN r ON r.key = sha256(d.text)""")
def replay_lookup(spark, d):
    """Recorded answers by the hash of the request; a miss is told."""
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    recorded = docs.filter("doc_id % 2 = 0").groupBy("key").agg(F.min("doc_id").alias("reply"))
    return docs.join(recorded, "key", "left").select("doc_id", "reply", F.col("reply").isNull().alias("missing"))


@query("""
SELECT o.o_orderkey, coalesce(c.c_mktsegment, 'unknown') AS segment, o.o_totalprice > 300000 AS error FROM orders o LEFT JOIN customer c ON c.c_name = 'Customer#' || lpad(o.o_custkey::VARCHAR, 9, '0')""")
def join_on_text(spark, d):
    """Rows joined on a text that names the other side."""
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    return o.join(c, name == c.c_name, "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"), (F.col("o_totalprice") > 300000).alias("error"))


@query("""
WITH p AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal FROM documents), k AS (SELECT *, CASE WHEN ordinal > 1 THEN ordinal - 1 END AS parent_ordinal FROM p)
SELECT k.doc_id, q.doc_id AS parent_id FROM k LEFT JOIN p q ON q.source = k.source AND q.ordinal = k.parent_ordinal""")
def resolve_self_reference(spark, d):
    """Parents named by ordinal become ids in one pass."""
    p = load(spark, d, "documents").select("doc_id", "source", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("ordinal"))
    parent = p.select("source", (F.col("ordinal") + 1).alias("ordinal"), F.col("doc_id").alias("parent_id"))
    return p.join(parent, ["source", "ordinal"], "left").select("doc_id", "parent_id")


@query("""
WITH f AS (SELECT user_id, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2)
SELECT user_id, CASE WHEN bool_and(top > 50) AND count(*) = 5 THEN '' ELSE string_agg(CASE WHEN top <= 50 THEN event_type END, '; ' ORDER BY event_type) END AS degraded_by FROM f GROUP BY 1""")
def quality_verdict(spark, d):
    """All dimensions must hold; those that don't are named."""
    f = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("top"))
    g = f.groupBy("user_id").agg(F.sort_array(F.collect_set(F.when(F.col("top") <= 50, F.col("event_type")))).alias("bad"), F.count("*").alias("n"), F.bool_and(F.col("top") > 50).alias("all"))
    return g.select("user_id", F.when(F.col("all") & (F.col("n") == 5), "").when(F.size("bad") > 0, F.array_join("bad", "; ")).alias("degraded_by"))
