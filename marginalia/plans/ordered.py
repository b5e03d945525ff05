"""Windows, timelines, numbering, schedules, reviews and merges."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import numeric as nm
from marginalia.functions.text import sequence_id
from marginalia.operators import folds
from marginalia.operators import windows as wn
from marginalia.operators.relational import top_per_key
from marginalia.plans.registry import query
from marginalia.tables import events, load, spans


@query("SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS ordinal FROM documents")
def dense_ordinal(spark, d):
    return wn.dense_ordinal(load(spark, d, "documents").select("doc_id", "source"), "doc_id")


@query("""
SELECT doc_id, upper(substr(lang, 1, 1)) || lpad(row_number() OVER (PARTITION BY lang, source ORDER BY doc_id)::VARCHAR, 6, '0') AS sequence_id FROM documents""")
def sequence_ids(spark, d):
    number = F.row_number().over(W.partitionBy("lang", "source").orderBy("doc_id"))
    return load(spark, d, "documents").select("doc_id", sequence_id(F.upper(F.substring("lang", 1, 1)), number).alias("sequence_id"))


@query("""
WITH i AS (SELECT doc_id, chr((65 + doc_id % 4)::INT) || (doc_id % 1000) || CASE WHEN doc_id % 2 = 0 THEN '.' || (doc_id % 13) ELSE '' END AS id FROM documents)
SELECT doc_id, id, row_number() OVER (PARTITION BY substr(id, 1, 1) ORDER BY regexp_extract(id, '([0-9]+)', 1)::INT, coalesce(nullif(regexp_extract(id, '\\.([0-9]+)', 1), '')::INT, 0), doc_id) AS place FROM i""".replace("\\\\", "\\"))
def natural_id_sort(spark, d):
    i = F.col("doc_id")
    id_ = F.concat(F.char(65 + i % 4), (i % 1000).cast("string"), F.when(i % 2 == 0, F.concat(F.lit("."), (i % 13).cast("string"))).otherwise(""))
    part = lambda p: F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(id, '{p}', 1), '') AS INT)"), F.lit(0))
    ids = load(spark, d, "documents").select("doc_id", id_.alias("id"))
    return ids.withColumn("place", F.row_number().over(W.partitionBy(F.substring("id", 1, 1)).orderBy(part("([0-9]+)"), part("[.]([0-9]+)"), "doc_id")))


@query("""
WITH last AS (SELECT user_id, max(event_id) FILTER (value > 60) AS last FROM events GROUP BY 1)
SELECT e.user_id, count(*) FILTER (l.last IS NULL OR e.event_id > l.last) AS streak FROM events e JOIN last l USING (user_id) GROUP BY 1""")
def trailing_wrong_streak(spark, d):
    return wn.trailing_streak(load(spark, d, "events"), "user_id", "event_id", F.col("value") > 60)


@query("""
WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS us, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) + 60000000 END AS e FROM events)
SELECT event_id, coalesce(e, first_value(us IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), us + 30000000) AS end_us FROM c""")
def next_non_null_end(spark, d):
    c = events(spark, d).withColumn("e", F.when(F.col("event_id") % 3 == 0, F.col("us") + 60000000))
    return c.select("event_id", F.coalesce("e", wn.next_known("us", "user_id", ["us", "event_id"]), F.col("us") + 30000000).alias("end_us"))


@query("""
WITH c AS (SELECT event_id, user_id, epoch_us(ts) % 100000000 AS s, epoch_us(ts) % 100000000 + event_id % 50000 AS e FROM events),
m AS (SELECT *, greatest(s, coalesce(max(greatest(s, e)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS start_us FROM c)
SELECT event_id, start_us, greatest(e, start_us) AS end_us FROM m""")
def monotone_clamp(spark, d):
    s = F.col("us") % 100000000
    c = events(spark, d).select("event_id", "user_id", s.alias("start_us"), (s + F.col("event_id") % 50000).alias("end_us"))
    return wn.clamp_monotone(c, "user_id", ["event_id"], "start_us", "end_us").select("event_id", "start_us", "end_us")


def _spans(spark, d):
    return events(spark, d).select("event_id", "user_id", F.col("us").alias("start_us"), (F.col("us") + (F.col("event_id") % 97) * 600000000).alias("end_us"))


@query("""
WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + (event_id % 97) * 600000000 AS b FROM events),
g AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM s)
SELECT event_id, user_id, reached AS gap_start, a - reached AS gap FROM g WHERE a - reached > 60000000""")
def timeline_gaps_running(spark, d):
    return wn.timeline_gaps(_spans(spark, d), "user_id", ["start_us", "event_id"], "start_us", "end_us", 60000000).select("event_id", "user_id", "gap_start", "gap")


@query("""
WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + (event_id % 97) * 600000000 AS b FROM events),
g AS (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY a, event_id) AS reached FROM s)
SELECT event_id, user_id, reached AS gap_start, a - reached AS gap FROM g WHERE a - reached > 60000000""")
def timeline_gaps_adjacent(spark, d):
    return wn.timeline_gaps(_spans(spark, d), "user_id", ["start_us", "event_id"], "start_us", "end_us", 60000000, adjacent=True).select("event_id", "user_id", "gap_start", "gap")


@query("""
SELECT conv_id, turn, coalesce(role <> lag(role) OVER w OR length(text) - lag(length(text)) OVER w >= 120, false) AS boundary FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def natural_boundaries(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    flag = (F.col("role") != F.lag("role").over(w)) | (F.length("text") - F.lag(F.length("text")).over(w) >= 120)
    return load(spark, d, "conversations").select("conv_id", "turn", F.coalesce(flag, F.lit(False)).alias("boundary"))


@query("""
WITH u AS (SELECT conv_id, turn * 3 + 1 AS a, turn * 3 + 3 + (conv_id + turn) % 5 // 4 AS b FROM conversations)
SELECT conv_id, a AS start_ordinal, b AS end_ordinal, lag(b) OVER (PARTITION BY conv_id ORDER BY a) + 1 = a AS contiguous FROM u""")
def contiguity_check(spark, d):
    a = F.col("turn") * 3 + 1
    b = F.col("turn") * 3 + 3 + F.floor((F.col("conv_id") + F.col("turn")) % 5 / 4)
    u = load(spark, d, "conversations").select("conv_id", a.alias("start_ordinal"), b.alias("end_ordinal"))
    return u.withColumn("contiguous", F.lag("end_ordinal").over(W.partitionBy("conv_id").orderBy("start_ordinal")) + 1 == F.col("start_ordinal"))


@query("""
WITH s AS (SELECT conv_id, turn, ceil(length(text) / 4.0)::BIGINT AS tokens, turn // 3 AS segment FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn DESC) AS back, sum(tokens) OVER (PARTITION BY conv_id, segment ORDER BY turn DESC) AS used FROM s)
SELECT conv_id, segment + 1 AS segment, turn, tokens FROM r WHERE back <= 3 AND used <= 300 AND EXISTS (SELECT 1 FROM s n WHERE n.conv_id = r.conv_id AND n.segment = r.segment + 1)""")
def overlap_tail(spark, d):
    """The last spans of each segment, at most three within the budget, that the next segment repeats."""
    s = spans(spark, d).select(F.col("domain_id").alias("conv_id"), (F.col("ordinal") - 1).alias("turn"), "tokens").withColumn("segment", F.floor(F.col("turn") / 3))
    back = W.partitionBy("conv_id", "segment").orderBy(F.col("turn").desc())
    tail = s.withColumn("back", F.row_number().over(back)).withColumn("used", F.sum("tokens").over(back)).filter("back <= 3 AND used <= 300")
    after = s.select("conv_id", (F.col("segment") - 1).alias("segment")).distinct()
    return tail.join(after, ["conv_id", "segment"], "left_semi").select("conv_id", (F.col("segment") + 1).alias("segment"), "turn", "tokens")


@query("""
WITH c AS (SELECT user_id, event_id, round(value) AS score FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rn FROM c),
t AS (SELECT *, CASE WHEN rn > 5 THEN row_number() OVER (PARTITION BY user_id, rn <= 5 ORDER BY event_id) END AS top_up FROM r)
SELECT user_id, event_id, CASE WHEN rn <= 5 THEN 'ranked' WHEN top_up <= 3 THEN 'top_up' ELSE 'not_selected' END AS outcome FROM t""")
def candidate_topup(spark, d):
    """The five best of each user, then three more in their own order; the rest is recorded as not selected."""
    c = load(spark, d, "events").select("user_id", "event_id", F.round("value").alias("score"))
    r = c.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("score").desc(), "event_id"))).withColumn("ranked", F.col("rn") <= 5)
    t = r.withColumn("place", F.row_number().over(W.partitionBy("user_id", "ranked").orderBy("event_id")))
    return t.select("user_id", "event_id", F.when(F.col("ranked"), "ranked").when(F.col("place") <= 3, "top_up").otherwise("not_selected").alias("outcome"))


@query("""
WITH e AS (SELECT event_id, user_id, value, event_id % 6 AS rating, event_id % 3 AS streak FROM events),
g AS (SELECT *, CASE WHEN rating <= 1 THEN 1 WHEN rating = 2 THEN 3 WHEN rating = 3 THEN value * 1.8 WHEN rating = 4 THEN value * 2.5 ELSE value * 3.2 END AS grown FROM e)
SELECT event_id, round(CASE WHEN streak >= 2 THEN 1 ELSE greatest(1, least(180, grown)) END, 6) AS days FROM g""")
def interval_sm2(spark, d):
    i = F.col("event_id")
    return load(spark, d, "events").select("event_id", F.round(nm.next_interval(F.col("value"), i % 6, i % 3), 6).alias("days"))


@query("""
WITH RECURSIVE o AS (SELECT user_id, value > 20 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id FROM events),
m AS (SELECT user_id, n, event_id, 0.5::DOUBLE AS before, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN ok THEN 0.15 ELSE -0.25 END)), 4)::DOUBLE AS after FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.n, o.event_id, m.after, round(greatest(0.0, least(1.0, m.after + CASE WHEN o.ok THEN 0.15 ELSE -0.25 END)), 4)::DOUBLE FROM m JOIN o ON o.user_id = m.user_id AND o.n = m.n + 1)
SELECT user_id, event_id, before, after FROM m""")
def review_attempt_chain(spark, d):
    """Mastery before and after each attempt."""
    return _attempts(spark, d).select("user_id", "event_id", "before", "after")


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id, value > 20 AS ok, event_id % 6 AS rating, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
m AS (SELECT user_id, n, event_id, CASE WHEN ok THEN 0 ELSE 1 END AS wrong, 1.0::DOUBLE AS days, CASE WHEN rating <= 1 THEN 1 WHEN rating = 2 THEN 3 WHEN rating = 3 THEN 1.8 WHEN rating = 4 THEN 2.5 ELSE 3.2 END::DOUBLE AS later FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.n, o.event_id, CASE WHEN o.ok THEN 0 ELSE m.wrong + 1 END, m.later, CASE WHEN NOT o.ok AND m.wrong >= 1 THEN 1 ELSE greatest(1, least(180, CASE WHEN o.rating <= 1 THEN 1 WHEN o.rating = 2 THEN 3 WHEN o.rating = 3 THEN m.later * 1.8 WHEN o.rating = 4 THEN m.later * 2.5 ELSE m.later * 3.2 END)) END::DOUBLE FROM m JOIN o ON o.user_id = m.user_id AND o.n = m.n + 1)
SELECT user_id, event_id, round(days, 6) AS interval_before, round(later, 6) AS interval_after FROM m""")
def attempt_intervals(spark, d):
    """Days to the next review before and after each attempt."""
    return _attempts(spark, d).select("user_id", "event_id", F.round("interval_before", 6).alias("interval_before"), F.round("interval_after", 6).alias("interval_after"))


def _attempts(spark, d):
    return folds.attempt_chain(load(spark, d, "events").select("user_id", "event_id", (F.col("value") > 20).alias("right"), (F.col("event_id") % 6).alias("rating")))


@query("""
WITH f AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 0.15 WHEN 'click' THEN 0.05 WHEN 'view' THEN 0.0 ELSE -0.25 END AS weight FROM events)
SELECT user_id, round(greatest(0, least(1, 0.5 + sum(weight))), 6) AS mastery, round(least(1, 0.2 * count(*)), 6) AS confidence FROM f GROUP BY 1""")
def mastery_recompute(spark, d):
    weight = F.when(F.col("event_type") == "purchase", 0.15).when(F.col("event_type") == "click", 0.05).when(F.col("event_type") == "view", 0.0).otherwise(-0.25)
    g = load(spark, d, "events").groupBy("user_id").agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    return g.select("user_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + F.col("w"))), 6).alias("mastery"), F.round(F.least(F.lit(1.0), F.lit(0.2) * F.col("n")), 6).alias("confidence"))


@query("""
WITH s AS (SELECT user_id, event_id, CASE WHEN value > 50 THEN '+1' ELSE '-1' END AS sign, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
SELECT user_id, string_agg(sign || ':' || event_id, ' ' ORDER BY event_id) AS explanation FROM s WHERE rn <= 12 GROUP BY 1""")
def learning_trace(spark, d):
    """The first twelve signed steps of each user, in order."""
    first = top_per_key(load(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.col("event_id")], 12)
    step = F.struct("event_id", F.concat(F.when(F.col("value") > 50, "+1").otherwise("-1"), F.lit(":"), F.col("event_id").cast("string")).alias("s"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(step)), lambda x: x["s"]), " ").alias("explanation"))


@query("""
SELECT lang, source, max(n_chars) AS most, arg_min(doc_id, doc_id) AS first_doc, arg_min(n_chars, doc_id) AS first_value, count(DISTINCT n_chars % 50) AS refs, count(DISTINCT n_chars) > 1 AS conflict FROM documents GROUP BY 1, 2""")
def merge_union_refs(spark, d):
    """A merge by key: the greatest emphasis, the first summary, the union of references and whether variants differ."""
    n = F.col("n_chars")
    return load(spark, d, "documents").groupBy("lang", "source").agg(F.max(n).alias("most"), F.min("doc_id").alias("first_doc"), F.min_by("n_chars", "doc_id").alias("first_value"), F.count_distinct(n % 50).alias("refs"), (F.count_distinct(n) > 1).alias("conflict"))


@query("""
WITH p AS (SELECT DISTINCT user_id, event_type, hour(ts) AS invocation FROM events),
s AS (SELECT user_id, event_type, string_agg(invocation::VARCHAR, ',' ORDER BY invocation) AS v FROM p GROUP BY 1, 2)
SELECT user_id, string_agg(event_type || '=' || v, ';' ORDER BY event_type) AS provenance FROM s GROUP BY 1""")
def provenance_map(spark, d):
    p = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.sort_array(F.collect_set(F.hour("ts"))).alias("v"))
    item = F.concat_ws("=", "event_type", F.array_join(F.transform("v", lambda x: x.cast("string")), ","))
    return p.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(item)), ";").alias("provenance"))


@query("""
WITH u AS (SELECT user_id % 40 AS key, event_type AS stage, event_id AS seq, round(value, 2) AS payload FROM events)
SELECT key, stage, arg_max(payload, seq) AS payload, max(seq) AS seq FROM u GROUP BY 1, 2""")
def upsert_last_wins(spark, d):
    """Old rows and new ones, in one pass: the last of each key stays."""
    u = load(spark, d, "events").select((F.col("user_id") % 40).alias("key"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), F.round("value", 2).alias("payload"))
    return u.groupBy("key", "stage").agg(F.max(F.struct("seq", "payload")).alias("m")).select("key", "stage", "m.payload", "m.seq")


@query("""
WITH old AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1), new AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE user_id NOT IN (SELECT user_id FROM old)""")
def insert_ignore(spark, d):
    """New rows of keys that are there already are left out."""
    e = load(spark, d, "events")
    old, new = (e.filter(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.min("event_id").alias("event_id")) for k in (0, 1))
    return old.unionByName(new.join(old, "user_id", "left_anti"))


@query("""
WITH q AS (SELECT event_id AS task_id, event_type AS queue, user_id % 4 AS attempts, CASE WHEN value < 40 THEN 'queued' WHEN value < 70 THEN 'running' ELSE 'done' END AS status FROM events)
SELECT queue, min(task_id) AS claimed FROM q WHERE status = 'queued' AND attempts < 3 GROUP BY 1""")
def queue_claim(spark, d):
    """First in, first out: the least queued task of each queue that has attempts left."""
    return _queue(spark, d).filter("status = 'queued' AND attempts < 3").groupBy("queue").agg(F.min("task_id").alias("claimed"))


def _queue(spark, d):
    status = F.when(F.col("value") < 40, "queued").when(F.col("value") < 70, "running").otherwise("done")
    return events(spark, d).select(F.col("event_id").alias("task_id"), F.col("event_type").alias("queue"), (F.col("user_id") % 4).alias("attempts"), status.alias("status"), (F.col("us") + 600000000).alias("lease_us"))


@query("""
WITH q AS (SELECT event_id AS task_id, user_id % 4 AS attempts, CASE WHEN value < 40 THEN 'queued' WHEN value < 70 THEN 'running' ELSE 'done' END AS status, epoch_us(ts) + 600000000 AS lease_us FROM events)
SELECT task_id, CASE WHEN status <> 'running' OR lease_us >= epoch_us(TIMESTAMP '2024-01-20') THEN status WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS status FROM q""")
def stale_lease_reclaim(spark, d):
    """Running tasks whose lease ran out before the instant given go back to the queue, or fail without attempts left."""
    now = F.lit(1705708800000000)
    stale = (F.col("status") == "running") & (F.col("lease_us") < now)
    return _queue(spark, d).select("task_id", F.when(~stale, F.col("status")).when(F.col("attempts") >= 3, "failed").otherwise("queued").alias("status"))


@query("""
WITH o AS (SELECT c.c_custkey, c.c_mktsegment, max(o.o_orderdate) AS last FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2)
SELECT c_custkey, CASE WHEN last IS NULL THEN 'enqueue' WHEN last < TIMESTAMP '1998-01-01' THEN 'requeue' ELSE 'keep' END AS action FROM o""")
def recovery_plan(spark, d):
    """What a restart does with each run: enqueue those without a task, requeue those interrupted, keep the rest."""
    last = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    action = F.when(F.col("last").isNull(), "enqueue").when(F.col("last") < F.lit("1998-01-01").cast("timestamp_ntz"), "requeue").otherwise("keep")
    return load(spark, d, "customer").join(last, "c_custkey", "left").select("c_custkey", action.alias("action"))
