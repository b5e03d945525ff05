"""Deletes along references and units projected from runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.blobs import blob_history
from marginalia.operators.references import Reference, delete_cascade, orphans, project_units
from marginalia.plans.registry import query
from marginalia.tables import load

KEYS = {"nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "orders": "o_orderkey"}
REFERENCES = [Reference("supplier", "s_nationkey", "nation"), Reference("customer", "c_nationkey", "nation"), Reference("orders", "o_custkey", "customer"), Reference("lineitem", "l_orderkey", "orders"), Reference("lineitem", "l_suppkey", "supplier", "clear")]


@query("""
WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1), s AS (SELECT * FROM supplier WHERE s_nationkey IN (FROM n)), c AS (SELECT * FROM customer WHERE c_nationkey IN (FROM n)),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT l_orderkey, CASE WHEN l_suppkey IN (SELECT s_suppkey FROM s) THEN l_suppkey END AS l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'nation' AS name, count(*) AS n, sum(n_nationkey)::BIGINT AS total, 0 AS loose FROM n UNION ALL SELECT 'supplier', count(*), sum(s_suppkey)::BIGINT, count(*) FILTER (s_nationkey NOT IN (FROM n)) FROM s
UNION ALL SELECT 'customer', count(*), sum(c_custkey)::BIGINT, count(*) FILTER (c_nationkey NOT IN (FROM n)) FROM c UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM c)) FROM o
UNION ALL SELECT 'lineitem', count(*), sum(l_suppkey)::BIGINT, count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM o)) + count(*) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM s)) FROM l""")
def delete_cascade_left(spark, d):
    """What is left of five tables once a region's nations go, and how many references then lead nowhere."""
    tables = {t: load(spark, d, t) for t in (*KEYS, "lineitem")}
    left = delete_cascade(tables, KEYS, REFERENCES, {"nation": tables["nation"].filter("n_regionkey = 1")})
    sums = {**KEYS, "lineitem": "l_suppkey"}
    counts = [left[t].agg(F.count("*").alias("n"), F.sum(F.col(c).cast("long")).alias("total")).select(F.lit(t).alias("name"), "n", "total") for t, c in sums.items()]
    loose = orphans(left, KEYS, REFERENCES).groupBy(F.col("child").alias("name")).agg(F.sum("n").alias("loose"))
    return reduce(DataFrame.unionByName, counts).join(loose, "name", "left").select("name", "n", "total", F.coalesce("loose", F.lit(0)).alias("loose"))


def _projected(spark, d):
    """Turns as units of their role: conversations of one remainder by 30 share a scope, and nations have older units."""
    talk = load(spark, d, "conversations")
    refs = F.array(F.concat(F.lit("T"), F.col("turn").cast("string")), F.concat(F.lit("T"), (F.col("turn") + 1).cast("string")), F.lit("X1"), F.concat(F.lit("T"), F.col("turn").cast("string")))
    made = talk.select(F.col("conv_id").alias("run_id"), (F.col("turn") + 1).alias("number"), F.col("conv_id").alias("domain_id"), (F.col("conv_id") % 30).alias("scope"), F.col("role").alias("key"), F.substring("text", 1, 20).alias("topic"), F.lit(None).cast("string").alias("kind"), F.md5("text").alias("summary"), (F.length("text") / 1000).alias("emphasis"), refs.alias("refs"))
    nations = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("scope"), (F.col("n_nationkey") * 2 + 1).cast("long").alias("unit_id"))
    units = nations.select("unit_id", "scope", F.explode(F.array(F.lit("user"), F.lit("gone"))).alias("key"), F.lit("old").alias("topic"), F.lit("term").alias("kind"), F.lit("").alias("summary"), F.lit(0.5).alias("emphasis"))
    units = units.withColumn("unit_id", F.col("unit_id") + (F.col("key") == "gone").cast("long"))
    spans = talk.select(F.col("conv_id").alias("domain_id"), F.concat(F.lit("T"), F.col("turn").cast("string")).alias("source_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("span_id"))
    return project_units(made, units, units.select("unit_id", (-F.col("unit_id")).alias("span_id")), spans)


PROJECTED = """
WITH m AS (SELECT conv_id % 30 AS scope, role AS key, conv_id, turn, text, row_number() OVER (PARTITION BY conv_id % 30, role ORDER BY conv_id DESC, turn DESC) AS back FROM conversations),
old AS (SELECT n_nationkey * 2 + 1 + k AS unit_id, n_nationkey AS scope, ['user', 'gone'][k + 1] AS key FROM nation, range(2) t(k)),
j AS (SELECT m.*, old.unit_id AS known FROM m LEFT JOIN old USING (scope, key) WHERE back = 1),
p AS (SELECT *, coalesce(known, (SELECT max(unit_id) FROM old) + row_number() OVER (PARTITION BY known IS NULL ORDER BY scope, key))::BIGINT AS unit_id FROM j)
"""


@query(PROJECTED + """
SELECT unit_id, scope, key, substr(text, 1, 20) AS topic, 'concept' AS kind, md5(text) AS summary, length(text) / 1000 AS emphasis FROM p
UNION ALL SELECT unit_id, scope, key, 'old', 'term', '', 0.5 FROM old WHERE unit_id NOT IN (SELECT unit_id FROM p)""")
def projected_units(spark, d):
    return _projected(spark, d)[0]


@query(PROJECTED + """
SELECT unit_id, c.conv_id * 1000 + c.turn AS span_id FROM p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn IN (p.turn, p.turn + 1)
UNION ALL SELECT unit_id, -unit_id FROM old WHERE unit_id NOT IN (SELECT unit_id FROM p)""")
def projected_links(spark, d):
    return _projected(spark, d)[1]


def _actions(spark, d):
    """Every user's events as actions on one blob: clicks and purchases add, views drop, other kinds collect, and fail if
    of a high value."""
    kind, user = F.col("event_type"), F.col("user_id")
    other = F.when(F.col("value") > 60, "collect_failed").otherwise("collect")
    action = F.when(kind.isin("click", "purchase"), "add").when(kind == "view", "drop").otherwise(other)
    return load(spark, d, "events").select(user.alias("blob"), "event_id", action.alias("action"))


@query("""
WITH RECURSIVE e AS (SELECT user_id AS blob, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'add' WHEN event_type = 'view' THEN 'drop' WHEN value > 60 THEN 'collect_failed' ELSE 'collect' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT blob, event_id, n, CASE WHEN action = 'add' THEN 'live' END AS state, CASE WHEN action = 'add' THEN 1 ELSE 0 END AS refs, CASE WHEN action = 'add' THEN 'created' ELSE 'missing' END AS result, 0 AS open_tasks FROM e WHERE n = 1
UNION ALL SELECT e.blob, e.event_id, e.n,
  CASE r.result WHEN 'created' THEN 'live' WHEN 'revived' THEN 'live' WHEN 'pending' THEN 'pending_delete' WHEN 'deleted' THEN 'deleted' ELSE f.state END,
  CASE r.result WHEN 'created' THEN 1 WHEN 'revived' THEN 1 WHEN 'reused' THEN f.refs + 1 WHEN 'pending' THEN f.refs - 1 WHEN 'released' THEN f.refs - 1 ELSE f.refs END, r.result,
  CASE r.result WHEN 'deleted' THEN 0 WHEN 'failed' THEN f.open_tasks + 1 ELSE f.open_tasks END
FROM f JOIN e ON e.blob = f.blob AND e.n = f.n + 1, LATERAL (SELECT CASE WHEN e.action = 'add' THEN CASE f.state WHEN 'live' THEN 'reused' WHEN 'pending_delete' THEN 'revived' WHEN 'deleted' THEN 'revived' ELSE 'created' END
  WHEN f.state IS NULL THEN 'missing' WHEN e.action = 'drop' THEN CASE WHEN f.refs <= 1 AND f.state = 'live' THEN 'pending' ELSE 'released' END
  WHEN f.state = 'deleted' THEN 'already_deleted' WHEN f.refs > 0 THEN 'still_referenced' WHEN e.action = 'collect' THEN 'deleted' ELSE 'failed' END AS result) r)
SELECT blob, event_id, state, refs::BIGINT AS refs, result, open_tasks::BIGINT AS open_tasks FROM f""")
def blob_lifecycle(spark, d):
    """Blobs that are created, shared, dropped, collected and brought back."""
    return blob_history(_actions(spark, d))
