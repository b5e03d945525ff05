"""Plans in rounds and merges in levels over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import planning, segmentation
from marginalia.plans.registry import query
from marginalia.tables import load, spans


def propose_threes(left, report, round_):
    """Units of three spans each; domains of number k modulo 5 lose the first one before round k."""
    first = F.col("ordinal") % 3 == 1
    top = left.groupBy("domain_id").agg(F.max("ordinal").alias("top"))
    units = left.filter(first).join(top, "domain_id").select("domain_id", F.col("ordinal").alias("a"), F.least(F.col("ordinal") + 2, F.col("top")).alias("b"))
    return units.filter((F.col("a") > 1) | (F.col("domain_id") % 5 <= round_)), units.limit(0).select("domain_id", F.col("a").alias("at"))


@query("""
WITH d AS (SELECT conv_id AS domain_id, count(*) AS top FROM conversations GROUP BY 1)
SELECT domain_id, CASE WHEN domain_id % 5 > 3 THEN 'fallback' ELSE 'succeeded' END AS status, greatest(least(domain_id % 5, 3), 1)::INT AS rounds, CASE WHEN domain_id % 5 <= 3 THEN '' WHEN top <= 3 THEN 'H0' ELSE 'H3' END AS hard,
  CASE WHEN domain_id % 5 > 3 THEN 0 ELSE (top + 2) // 3 END AS units FROM d""")
def boundary_plans(spark, d):
    """Plans that are accepted after one to three rounds, or never."""
    s = spans(spark, d).select("domain_id", "ordinal", "tokens")
    made = planning.plan_boundaries(s, propose_threes, 10**9, least=1)
    n = made.units.groupBy("domain_id").agg(F.count("*").alias("units"))
    return made.plans.join(n, "domain_id", "left").select("domain_id", "status", "rounds", "hard", F.coalesce("units", F.lit(0)).alias("units"))


SEGMENTS = """
WITH seg AS (SELECT l_suppkey % 7 AS domain_id, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey % 7 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos, CASE WHEN l_suppkey % 7 = 3 OR l_suppkey % 7 = 5 AND l_orderkey % 50 = 0 THEN 'failed' ELSE 'succeeded' END AS status, l_returnflag || l_linestatus AS key, l_quantity AS weight, l_partkey AS ref FROM lineitem),
size AS (SELECT domain_id, count(*) AS total, greatest(ceil(ln(count(*)) / ln(32) - 1e-9), 1) AS top FROM seg GROUP BY 1)
"""


def _segments(spark, d):
    from marginalia.operators.windows import group_ordinals

    key, part = F.col("l_orderkey"), F.col("l_suppkey") % 7
    rows = load(spark, d, "lineitem").select(part.alias("domain_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when((part == 3) | ((part == 5) & (key % 50 == 0)), "failed").otherwise("succeeded").alias("status"), F.concat("l_returnflag", "l_linestatus").alias("key"), F.col("l_quantity").alias("weight"))
    numbered = group_ordinals(rows, ["domain_id"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return planning.merge_levels(numbered.select("domain_id", "ordinal", "status"), numbered.select("domain_id", "ordinal", "key", "weight", F.col("l_partkey").alias("ref")), fan=32)


@query(SEGMENTS + """
SELECT domain_id, level::INT AS level, (pos // (32 ** level)::BIGINT)::BIGINT AS node, count(*) AS segments, count(*) FILTER (status = 'succeeded') AS consumed, count(DISTINCT pos // (32 ** (level - 1))::BIGINT) AS children, CASE WHEN count(*) FILTER (status <> 'succeeded') = 0 THEN 'succeeded' WHEN count(*) FILTER (status = 'succeeded') = 0 THEN 'failed' ELSE 'partial' END AS status
FROM seg JOIN size USING (domain_id), range(1, 9) t(level) WHERE level <= top GROUP BY 1, 2, 3""")
def merge_nodes(spark, d):
    """Merges of all levels over seven long domains, one of which failed and one in part."""
    return _segments(spark, d)[0]


@query(SEGMENTS + "SELECT domain_id, key, max(weight) AS weight, count(DISTINCT ref) AS refs FROM seg WHERE status = 'succeeded' GROUP BY 1, 2")
def merge_result(spark, d):
    """What the last merge of each domain holds."""
    return _segments(spark, d)[1]


@query("""
WITH RECURSIVE s AS (SELECT conv_id AS domain_id, turn + 1 AS ordinal, greatest(ceil(length(text) / 4.0)::BIGINT, 1) AS tokens, turn % 5 = 3 AS ends, role = 'user' AS boundary, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
w AS (SELECT domain_id, sum(tokens) AS total, max(tokens) AS largest, CASE WHEN max(tokens) + 70 > 440 AND max(tokens) + 70 <= 480 THEN max(tokens) + 70 ELSE 440 END AS budget FROM s GROUP BY 1),
r AS (SELECT s.*, lag(ends) OVER (PARTITION BY domain_id ORDER BY n) AS ended, budget, total + 40 <= budget AS whole FROM s JOIN w USING (domain_id) WHERE largest + 64 <= budget),
f AS (SELECT domain_id, ordinal, tokens, n, budget, whole, 1 AS part, tokens AS used FROM r WHERE n = 1
UNION ALL SELECT r.domain_id, r.ordinal, r.tokens, r.n, r.budget, r.whole, f.part + c.cut::INT, CASE WHEN c.cut THEN r.tokens ELSE f.used + r.tokens END FROM f JOIN r ON r.domain_id = f.domain_id AND r.n = f.n + 1,
  LATERAL (SELECT NOT r.whole AND (f.used + r.tokens > r.budget - 40 OR r.ended OR (r.boundary AND f.used >= 0.25 * (r.budget - 40))) AS cut) c),
p AS (SELECT domain_id, part, any_value(budget) AS budget, bool_and(whole) AS whole, list(ordinal ORDER BY n) AS o, list(tokens ORDER BY n) AS t, sum(tokens)::BIGINT AS used FROM f GROUP BY 1, 2),
q AS (SELECT *, lag(o) OVER v AS po, lag(t) OVER v AS pt FROM p WINDOW v AS (PARTITION BY domain_id ORDER BY part)),
k AS (SELECT *, coalesce(len(list_filter([1, 2, 3], lambda x: x <= len(pt) AND list_sum(pt[len(pt) - x + 1:]) <= least(floor(budget * 0.15), greatest(budget - 40 - used, 0)))), 0) AS n_tail FROM q),
tails AS (SELECT domain_id, o[1] AS first, unnest(po[len(po) - n_tail + 1:]) AS ordinal, unnest(pt[len(pt) - n_tail + 1:]) AS tokens FROM k WHERE n_tail > 0 AND 40 + 24 * (len(o) + n_tail) + used + list_sum(pt[len(pt) - n_tail + 1:]) <= budget),
h AS (SELECT domain_id, budget, whole, o, t FROM p
UNION ALL SELECT domain_id, budget, whole, CASE WHEN side = 1 THEN o[:cut] ELSE o[cut + 1:] END, CASE WHEN side = 1 THEN t[:cut] ELSE t[cut + 1:] END
FROM (SELECT *, len(list_filter(range(1, len(t)), lambda x: coalesce(list_sum(t[:x - 1]), 0) < greatest(list_sum(t)::BIGINT // 2, 1))) AS cut FROM h WHERE len(o) > 1 AND 40 + 24 * len(o) + list_sum(t) > budget), range(1, 3) sides(side)),
e AS (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY o[1]) AS segment, count(*) OVER (PARTITION BY domain_id) AS parts FROM h WHERE len(o) = 1 OR 40 + 24 * len(o) + list_sum(t) <= budget)
SELECT domain_id, ordinal, segment, tokens, false AS overlap, strategy FROM (SELECT domain_id, segment, unnest(o) AS ordinal, unnest(t) AS tokens, CASE WHEN whole AND parts = 1 THEN 'single_pass' ELSE 'segmented_map_merge' END AS strategy FROM e)
UNION ALL SELECT tails.domain_id, tails.ordinal, e.segment, tails.tokens, true, 'segmented_map_merge' FROM tails JOIN e ON e.domain_id = tails.domain_id AND e.o[1] = tails.first
UNION ALL SELECT s.domain_id, s.ordinal, NULL, s.tokens, false, 'failed' FROM s JOIN w USING (domain_id) WHERE largest + 64 > budget""")
def segment_plan(spark, d):
    """Segments of conversations with context and halved prompts; some domains fit as they are, some not at all."""
    s = spans(spark, d)
    flags = s.select("domain_id", "ordinal", "tokens", ((F.col("ordinal") - 1) % 5 == 3).alias("ends_unit"), (F.col("role") == "user").alias("boundary"))
    return segmentation.segment_plan(flags, 440, fixed=40, each=24, context=480, slack=30)
