"""Scans, filters, joins, grouped counts, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import relational as op
from marginalia.plans.registry import query
from marginalia.tables import events, load


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def scan_filter_project(spark, d):
    return op.optional_filters(load(spark, d, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31' AND l_returnflag IN ('R', 'A')")
def filter_between_in(spark, d):
    ranged = op.in_range(load(spark, d, "lineitem").withColumn("at", F.col("l_shipdate").cast("timestamp_ntz")), "at", "1994-01-01", "1996-12-31")
    return ranged.filter(F.col("l_returnflag").isin("R", "A")).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def filter_in_subquery(spark, d):
    poor = load(spark, d, "customer").filter("c_acctbal < 0")
    orders = load(spark, d, "orders")
    return orders.join(poor, orders.o_custkey == poor.c_custkey, "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def filter_not_in_subquery(spark, d):
    return op.orphans(load(spark, d, "customer"), load(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_type LIKE 'STANDARD%' AND p_name NOT LIKE '%1'")
def like_prefix(spark, d):
    return load(spark, d, "part").filter(F.col("p_type").startswith("STANDARD") & ~F.col("p_name").like("%1")).select("p_partkey", "p_name")


@query("SELECT count(*) FILTER (props IS NOT NULL AND props <> '') AS filled, count(*) FILTER (props IS NULL OR props = '') AS blank FROM events")
def null_predicates(spark, d):
    filled = F.col("props").isNotNull() & (F.col("props") != "")
    return load(spark, d, "events").agg(F.count_if(filled).alias("filled"), F.count_if(~F.coalesce(filled, F.lit(False))).alias("blank"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END AS size_class,
  coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, TIMESTAMP '2000-01-01') AS closed_at, substr(coalesce(o_orderpriority, ''), 1, 4) AS preview
FROM orders""")
def case_coalesce_projection(spark, d):
    price = F.col("o_totalprice")
    return load(spark, d, "orders").select(
        "o_orderkey", F.when(price > 200000, "large").when(price > 50000, "medium").otherwise("small").alias("size_class"),
        F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")), F.lit("2000-01-01").cast("timestamp_ntz")).alias("closed_at"),
        F.substring(F.coalesce("o_orderpriority", F.lit("")), 1, 4).alias("preview"),
    )


@query("""
WITH steps AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, before, event_type FROM steps
WHERE (before, event_type) IN (SELECT r.r_name, n.n_name FROM region r JOIN nation n ON false) OR (before = 'view' AND event_type IN ('click', 'purchase')) OR (before = 'click' AND event_type = 'purchase')""")
def state_transition_filter(spark, d):
    """Steps of each user that the transition table allows; the table has three rows."""
    from pyspark.sql import Window as W

    allowed = spark.createDataFrame([("view", "click"), ("view", "purchase"), ("click", "purchase")], "before string, event_type string")
    steps = events(spark, d).withColumn("before", F.lag("event_type").over(W.partitionBy("user_id").orderBy("us", "event_id")))
    return steps.join(F.broadcast(allowed), ["before", "event_type"], "left_semi").select("event_id", "user_id", "before", "event_type")


@query("SELECT o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 'P' WHEN 'P' THEN 'F' END AS next_status, count(*) AS n FROM orders GROUP BY 1, 2")
def successor_states(spark, d):
    states = F.array(*map(F.lit, "OPF"))
    after = F.get(states, F.array_position(states, F.col("o_orderstatus")).cast("int"))
    return load(spark, d, "orders").withColumn("next_status", F.when(F.array_contains(states, F.col("o_orderstatus")), after)).groupBy("o_orderstatus", "next_status").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IS DISTINCT FROM 7")
def scope_violations(spark, d):
    return op.scope_violations(load(spark, d, "supplier"), s_nationkey=7).select("s_suppkey", "s_nationkey")


@query("SELECT doc_id, CASE WHEN length(text) > 500 OR contains(text, 'password') THEN 'high' ELSE 'low' END AS risk FROM documents")
def risk_classify(spark, d):
    text = F.col("text")
    return load(spark, d, "documents").select("doc_id", F.when((F.length(text) > 500) | F.contains(text, F.lit("password")), "high").otherwise("low").alias("risk"))


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity, coalesce(s.s_name, 'unknown') AS supplier_name
FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey""")
def left_join_display_name(spark, d):
    lines, names = load(spark, d, "lineitem"), load(spark, d, "supplier")
    return lines.join(names, lines.l_suppkey == names.s_suppkey, "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.coalesce("s_name", F.lit("unknown")).alias("supplier_name"))


@query("""
SELECT c.c_custkey, coalesce(c.c_name, '?') || ' / ' || coalesce(n.n_name, 'no nation') || ' / ' || coalesce(r.r_name, 'no region') AS label
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def chain_left_join(spark, d):
    c, n, r = (load(spark, d, t) for t in ("customer", "nation", "region"))
    out = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    return out.select("c_custkey", F.concat_ws(" / ", F.coalesce("c_name", F.lit("?")), F.coalesce("n_name", F.lit("no nation")), F.coalesce("r_name", F.lit("no region"))).alias("label"))


@query("""
SELECT c.c_mktsegment, o.o_orderpriority, count(*) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1, 2""")
def inner_three_way(spark, d):
    l, o, c = (load(spark, d, t) for t in ("lineitem", "orders", "customer"))
    joined = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return joined.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""
SELECT 'documents_without_label' AS relation, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'customers_without_order', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'lines_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def orphan_anti(spark, d):
    pairs = {"documents_without_label": ("documents", "labels", "doc_id", "doc_id"), "customers_without_order": ("customer", "orders", "c_custkey", "o_custkey"), "lines_without_order": ("lineitem", "orders", "l_orderkey", "o_orderkey")}
    counts = [op.orphans(load(spark, d, a), load(spark, d, b), ka, kb).agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, (a, b, ka, kb) in pairs.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("""
SELECT l_orderkey, l_partkey, l_extendedprice, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_quantity) AS rank FROM lineitem) WHERE rank <= 3""")
def lateral_topk(spark, d):
    return op.top_per_key(load(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")], 3).select("l_orderkey", "l_partkey", "l_extendedprice", "rank")


@query("""
WITH a AS (SELECT doc_id, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS v FROM documents WHERE lang = 'en'), b AS (SELECT doc_id, quality AS v FROM labels)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.v AS left_value, b.v AS right_value,
  CASE WHEN a.v IS NULL THEN 'right_only' WHEN b.v IS NULL THEN 'left_only' WHEN a.v = b.v THEN 'agree' ELSE 'conflict' END AS verdict
FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def full_outer_reconcile(spark, d):
    long_ = load(spark, d, "documents").filter("lang = 'en'").select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("v"))
    return op.reconcile(long_, load(spark, d, "labels"), "doc_id", "v", "quality")


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, coalesce(s.s_name, p.p_name, 'none') AS found
FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_partkey LEFT JOIN part p ON p.p_partkey = l.l_partkey""")
def fallback_lookup(spark, d):
    """By the first code that is known, else by the second."""
    l, s, p = load(spark, d, "lineitem"), load(spark, d, "supplier"), load(spark, d, "part")
    out = l.join(s, l.l_partkey == s.s_suppkey, "left").join(p, l.l_partkey == p.p_partkey, "left")
    return out.select("l_orderkey", "l_linenumber", "l_quantity", F.coalesce("s_name", "p_name", F.lit("none")).alias("found"))


@query("""
WITH r AS (SELECT n_nationkey AS rule, n_nationkey % 7 + 1 AS weekday, n_nationkey % 10 + 1 AS first_week, n_nationkey % 10 + 20 AS last_week, n_nationkey % 3 AS parity FROM nation),
o AS (SELECT o_orderkey, isodow(o_orderdate) AS weekday, date_diff('day', DATE '1992-01-06', o_orderdate::DATE) // 7 % 52 + 1 AS week FROM orders WHERE o_orderdate >= TIMESTAMP '1992-01-06')
SELECT o.o_orderkey, r.rule, o.week::INT AS week FROM o JOIN r ON r.weekday = o.weekday AND o.week BETWEEN r.first_week AND r.last_week AND (r.parity = 0 OR o.week % 2 = r.parity % 2)""")
def range_parity_join(spark, d):
    """Days by the rules of a timetable: weekday, weeks from and to, and odd, even or all weeks."""
    from marginalia.functions.numeric import week_number

    key = F.col("n_nationkey")
    rules = load(spark, d, "nation").select(key.alias("rule"), (key % 7 + 1).alias("weekday"), (key % 10 + 1).alias("first_week"), (key % 10 + 20).alias("last_week"), (key % 3).alias("parity"))
    days = load(spark, d, "orders").select("o_orderkey", (F.weekday("o_orderdate") + 1).alias("weekday"), ((week_number(F.col("o_orderdate").cast("date"), F.lit("1992-01-06").cast("date")) - 1) % 52 + 1).alias("week"))
    met = days.join(rules, "weekday").filter(F.col("week").between(F.col("first_week"), F.col("last_week")) & ((F.col("parity") == 0) | (F.col("week") % 2 == F.col("parity") % 2)))
    return met.select("o_orderkey", "rule", "week")


@query("""
WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, [event_id % 5, event_id % 7] AS periods FROM events),
off AS (SELECT user_id, day, periods FROM e WHERE event_id % 11 = 0)
SELECT event_id, user_id FROM e WHERE NOT EXISTS (SELECT 1 FROM off WHERE off.user_id = e.user_id AND off.day = e.day AND len(list_intersect(off.periods, e.periods)) > 0)""")
def array_overlap_anti(spark, d):
    """Occurrences without those that a partial day off touches."""
    e = events(spark, d).select("event_id", "user_id", F.to_date("ts").alias("day"), F.array(F.col("event_id") % 5, F.col("event_id") % 7).alias("periods"))
    off = e.filter("event_id % 11 = 0").select("user_id", "day", F.col("periods").alias("off"))
    on = (e.user_id == off.user_id) & (e.day == off.day) & F.arrays_overlap(e.periods, off.off)
    return e.join(off, on, "left_anti").select("event_id", "user_id")


@query("""
WITH r AS (SELECT part.p_partkey AS range_id, part.p_size * 20 AS first, part.p_size * 20 + 30 AS last FROM part)
SELECT r.range_id, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN r ON o.o_custkey BETWEEN r.first AND r.last GROUP BY 1""")
def interval_join(spark, d):
    ranges = load(spark, d, "part").select(F.col("p_partkey").alias("range_id"), (F.col("p_size") * 20).alias("first"), (F.col("p_size") * 20 + 30).alias("last"))
    met = op.range_join(load(spark, d, "orders"), ranges, "o_custkey", "first", "last", 64)
    return met.groupBy("range_id").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT a.doc_id, min(b.doc_id) AS reused_from FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) AND a.lang = b.lang AND a.source <> b.source GROUP BY 1""")
def reuse_lookup(spark, d):
    """The least document of another source with the same content. Sources of a content are few, so each content keeps
    its least document by source, and rows meet those."""
    from marginalia.functions.text import content_hash

    docs = load(spark, d, "documents").select("doc_id", "lang", "source", content_hash(F.col("text")).alias("hash"))
    least = docs.groupBy("hash", "lang", "source").agg(F.min("doc_id").alias("first"))
    other = least.groupBy("hash", "lang").agg(F.sort_array(F.collect_list(F.struct("first", "source"))).alias("firsts")).filter(F.size("firsts") > 1)
    found = F.get(F.filter("firsts", lambda x: x["source"] != F.col("source")), F.lit(0))["first"]
    return docs.join(other, ["hash", "lang"]).select("doc_id", found.alias("reused_from")).filter("reused_from IS NOT NULL")


@query("""
SELECT t.name AS dependent, t.n FROM (SELECT 'nation' AS name, count(*) AS n FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'supplier', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1
UNION ALL SELECT 'customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
UNION ALL SELECT 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1) t""")
def delete_impact_counts(spark, d):
    n = load(spark, d, "nation").filter("n_regionkey = 1")
    c = load(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    of = {"nation": n, "supplier": load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi"), "customer": c, "orders": load(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("dependent"), "n") for name, df in of.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("SELECT event_type, user_id % 3 AS stage, value > 50 AS high, count(*) AS n FROM events GROUP BY ALL")
def grouped_counts(spark, d):
    return load(spark, d, "events").groupBy("event_type", (F.col("user_id") % 3).alias("stage"), (F.col("value") > 50).alias("high")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2 ORDER BY n DESC, 1, 2")
def reasons_topn(spark, d):
    return load(spark, d, "lineitem").filter(F.col("l_returnflag").isin("R", "A")).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "l_returnflag", "l_linestatus")


@query("SELECT text, coalesce(lang, '') AS lang_key, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def dup_groups_having(spark, d):
    return op.duplicate_groups(load(spark, d, "documents"), F.col("text"), F.coalesce("lang", F.lit("")).alias("lang_key"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id, count(*) OVER (PARTITION BY text) AS group_size FROM documents")
def keep_min_id(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return op.keep_least_id(docs, ["hash"], "doc_id").select("doc_id", "kept_id", "group_size")


@query("SELECT max(v) AS newest FROM (SELECT max(o_orderdate) AS v FROM orders UNION ALL SELECT max(l_shipdate) FROM lineitem)")
def union_all_max(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderdate").alias("v")).union(load(spark, d, "lineitem").select("l_shipdate")).agg(F.max("v").alias("newest"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, d):
    return op.latest(load(spark, d, "events"), ["user_id"], [F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS last_value FROM events WHERE value > 10 GROUP BY 1, 2")
def last_success_map(spark, d):
    return load(spark, d, "events").filter("value > 10").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("last_value"))


@query("SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O') AS open_orders FROM customer c")
def correlated_count(spark, d):
    counts = load(spark, d, "orders").filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return load(spark, d, "customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("open_orders"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, string_agg(DISTINCT role, ',' ORDER BY role) AS distinct_roles FROM conversations GROUP BY 1")
def group_concat(spark, d):
    """Roles go by turn; a conversation's roles are kept as short codes in one row, as the report asks."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(ordered, ",").alias("roles"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("distinct_roles"))


@query("SELECT user_id, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, count(*) AS n, coalesce(sum(length(props)), 0)::BIGINT AS payload_chars FROM events WHERE value IS NOT NULL GROUP BY 1")
def time_extent(spark, d):
    return events(spark, d).filter("value IS NOT NULL").groupBy("user_id").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"), F.coalesce(F.sum(F.length("props")), F.lit(0)).alias("payload_chars"))


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_ids(spark, d):
    return load(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("""
WITH g AS (SELECT d.source, count(*) AS total, count(l.doc_id) AS labelled, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.toxic = 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)
SELECT *, CASE WHEN labelled <= 0 THEN 0.0 ELSE round(good / labelled, 6) END AS good_rate, CASE WHEN toxic <= 0 THEN 1.0 ELSE round(good / toxic, 6) END AS good_to_toxic FROM g""")
def conditional_counts_ratios(spark, d):
    from marginalia.functions.numeric import ratio

    joined = load(spark, d, "documents").join(load(spark, d, "labels").withColumn("has", F.lit(1)), "doc_id", "left")
    g = joined.groupBy("source").agg(F.count("*").alias("total"), F.count("has").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return g.withColumn("good_rate", ratio(F.col("good"), F.col("labelled"))).withColumn("good_to_toxic", ratio(F.col("good"), F.col("toxic"), 1.0))


@query("SELECT l_suppkey, count(*) AS n, array_to_string(list_sort(list_distinct(list(l_orderkey)))[1:5], ',') AS first_ids FROM lineitem GROUP BY 1")
def first_n_ids_per_group(spark, d):
    """The count of every row and the five least ids; a rank limits each partition before it shuffles."""
    lines = load(spark, d, "lineitem")
    first = op.top_per_key(lines.select("l_suppkey", "l_orderkey").distinct(), ["l_suppkey"], [F.col("l_orderkey")], 5)
    ids = first.groupBy("l_suppkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l_orderkey")), lambda x: x.cast("string")), ",").alias("first_ids"))
    return lines.groupBy("l_suppkey").agg(F.count("*").alias("n")).join(ids, "l_suppkey")


@query("SELECT lang, count(DISTINCT CASE WHEN n_chars % 10 <> 0 THEN n_chars % 10 ELSE doc_id % 7 END) AS pages FROM documents GROUP BY 1")
def page_coverage(spark, d):
    page = F.when(F.col("n_chars") % 10 != 0, F.col("n_chars") % 10).otherwise(F.col("doc_id") % 7)
    return load(spark, d, "documents").groupBy("lang").agg(F.count_distinct(page).alias("pages"))


@query("""
WITH u AS (SELECT user_id, sum(value) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 5 HOUR) AS five_hours, sum(value) FILTER (ts >= TIMESTAMP '2024-01-23') AS week, sum(value) AS month FROM events GROUP BY 1)
SELECT user_id, round(coalesce(five_hours, 0), 4) AS five_hours, round(coalesce(week, 0), 4) AS week, round(least(100.0, 100 * month / 5000), 4) AS percent,
  CASE WHEN least(100.0, 100 * month / 5000) >= 90 THEN 'critical' WHEN least(100.0, 100 * month / 5000) >= 70 THEN 'warning' ELSE 'normal' END AS bucket FROM u""")
def quota_windows(spark, d):
    from marginalia.functions.numeric import usage_bucket

    e = load(spark, d, "events")
    since = lambda t: F.round(F.coalesce(F.sum(F.when(F.col("ts") >= F.lit(t).cast("timestamp_ntz"), F.col("value"))), F.lit(0.0)), 4)
    percent = F.least(F.lit(100.0), 100 * F.sum("value") / 5000)
    g = e.groupBy("user_id").agg(since("2024-01-29 19:00:00").alias("five_hours"), since("2024-01-23").alias("week"), percent.alias("p"))
    return g.select("user_id", "five_hours", "week", F.round("p", 4).alias("percent"), usage_bucket(F.col("p")).alias("bucket"))


@query("""
WITH b AS (SELECT sha256(text) AS hash, min(doc_id) AS blob_id, count(*) AS ref_count, count(*) FILTER (source <> 'src0') AS live, max(n_chars) AS size FROM documents GROUP BY 1)
SELECT CASE WHEN live > 0 THEN 'live' WHEN ref_count > 1 THEN 'pending_delete' ELSE 'deleted' END AS gc_state, count(*) AS blobs, sum(ref_count)::BIGINT AS refs, (sum(size) FILTER (live > 0))::BIGINT AS live_chars, min(blob_id) AS first_blob FROM b GROUP BY 1""")
def blob_audit(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("hash"))
    b = docs.groupBy("hash").agg(F.min("doc_id").alias("blob_id"), F.count("*").alias("ref_count"), F.count_if(F.col("source") != "src0").alias("live"), F.max("n_chars").alias("size"))
    state = F.when(F.col("live") > 0, "live").when(F.col("ref_count") > 1, "pending_delete").otherwise("deleted")
    return b.groupBy(state.alias("gc_state")).agg(F.count("*").alias("blobs"), F.sum("ref_count").alias("refs"), F.sum(F.when(F.col("live") > 0, F.col("size"))).alias("live_chars"), F.min("blob_id").alias("first_blob"))


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_acctbal, c_mktsegment DESC, c_custkey LIMIT 50")
def topk_mixed_sort(spark, d):
    return load(spark, d, "customer").orderBy("c_acctbal", F.col("c_mktsegment").desc(), "c_custkey").limit(50).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '99:99') AS sort_key FROM events ORDER BY 2, 1 LIMIT 100")
def sentinel_sort(spark, d):
    key = F.coalesce(F.get_json_object("props", "$.k"), F.lit("99:99"))
    return load(spark, d, "events").select("event_id", key.alias("sort_key")).orderBy("sort_key", "event_id").limit(100)


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, d):
    return load(spark, d, "documents").select("doc_id").distinct().join(load(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersection(spark, d):
    return load(spark, d, "documents").filter("lang = 'en'").select("doc_id").distinct().join(load(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents)
SELECT doc_id, sha256(array_to_string(list_filter(words, lambda x, i: list_position(words, x) = i), ' ')) AS distinct_words FROM w""")
def ordered_distinct(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(F.array_join(F.array_distinct(F.split("text", " ")), " "), 256).alias("distinct_words"))


@query("""
WITH w AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS refs, ['the', 'of', 'and', 'de', 'la'] AS allowed FROM documents)
SELECT doc_id, array_to_string(list_sort(list_intersect(refs, allowed)), ',') AS kept, array_to_string(list_sort(list_filter(allowed, lambda a: NOT list_contains(refs, a))), ',') AS unreferenced,
  len(list_filter(refs, lambda r: NOT list_contains(allowed, r))) AS foreign_count FROM w""")
def ref_partition(spark, d):
    allowed = F.array(*map(F.lit, ("the", "of", "and", "de", "la")))
    refs = load(spark, d, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("refs"))
    return refs.select("doc_id", F.array_join(F.array_sort(F.array_intersect("refs", allowed)), ",").alias("kept"), F.array_join(F.array_sort(F.array_except(allowed, "refs")), ",").alias("unreferenced"), F.size(F.array_except("refs", allowed)).cast("long").alias("foreign_count"))
