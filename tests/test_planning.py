from pyspark.sql import functions as F

from marginalia.operators.planning import merge_levels, plan_boundaries
from marginalia.plans.planning import propose_threes


def spans_of(spark, tops, tokens=5):
    return spark.createDataFrame([(d, o, tokens) for d, top in tops.items() for o in range(1, top + 1)], "domain_id long, ordinal long, tokens long")


def test_only_open_domains_are_planned_again_and_plans_are_reused(spark):
    spans = spans_of(spark, {0: 6, 1: 6, 2: 7, 3: 9, 4: 9, 9: 2})
    seen = []

    def propose(left, report, round_):
        seen.append((round_, sorted(r[0] for r in left.select("domain_id").distinct().collect()), sorted(map(tuple, report.select("domain_id", "hard").collect())) if report else None))
        return propose_threes(left, report, round_)

    made = plan_boundaries(spans, propose, 10**6, least=1)
    assert seen == [(1, [0, 1, 2, 3, 4, 9], None), (2, [2, 3, 4, 9], [(2, "H3"), (3, "H3"), (4, "H3"), (9, "H0")]), (3, [3, 4, 9], [(3, "H3"), (4, "H3"), (9, "H0")])]
    got = {r["domain_id"]: (r["status"], r["rounds"], r["reused"], r["hard"]) for r in made.plans.collect()}
    assert got == {0: ("succeeded", 1, False, ""), 1: ("succeeded", 1, False, ""), 2: ("succeeded", 2, False, ""), 3: ("succeeded", 3, False, ""), 4: ("fallback", 3, False, "H3"), 9: ("fallback", 3, False, "H0")}
    seen.clear()
    changed = spans.filter("domain_id <> 1").unionByName(spans_of(spark, {1: 6}, tokens=6))
    again = plan_boundaries(changed, propose, 10**6, least=1, cache=made)
    assert seen[0][1] == [1, 4, 9]
    assert {r["domain_id"]: r["reused"] for r in again.plans.collect()} == {0: True, 1: False, 2: True, 3: True, 4: False, 9: False}
    rows = lambda p: sorted(map(tuple, p.units.collect()))
    assert rows(again) == rows(made)


def test_failing_proposers_and_soft_rules_never_raise(spark):
    spans = spans_of(spark, {1: 6, 2: 6})

    def broken(left, report, round_):
        if round_ == 2:
            return left.select("domain_id", F.raise_error(F.lit("no answer")).cast("long").alias("a"), F.col("ordinal").alias("b")), left.select("domain_id", F.col("ordinal").alias("at"))
        return propose_threes(left, report, round_)

    made = {r["domain_id"]: r for r in plan_boundaries(spans, broken, 10**6, least=1).plans.collect()}
    assert (made[1]["status"], made[2]["status"], made[2]["rounds"]) == ("succeeded", "fallback", 2) and "no answer" in made[2]["detail"]
    soft = plan_boundaries(spans, propose_threes, 10, least=1)  # over the limit without a break
    assert {(r["status"], r["soft"]) for r in soft.plans.collect()} == {("low_quality", "L3,L4")} and soft.units.count() == 4
    assert plan_boundaries(spans.limit(0), propose_threes, 10).plans.collect() == []


def test_each_segment_is_consumed_once_at_each_level(spark):
    statuses = {1: ["succeeded"] * 20, 2: ["succeeded", "failed"] * 3, 3: ["failed"], 4: ["succeeded"]}
    segments = spark.createDataFrame([(d, i + 1, s) for d, ss in statuses.items() for i, s in enumerate(ss)], "domain_id long, ordinal long, status string")
    items = spark.createDataFrame([(1, i, f"k{i % 3}", i % 5, i % 4) for i in range(1, 21)] + [(2, 1, "a", 1, 7), (2, 2, "a", 9, 8), (2, 3, "a", 2, 7)], "domain_id long, ordinal long, key string, weight int, ref int")
    nodes, merged = merge_levels(segments, items, fan=3)
    rows = nodes.collect()
    for d, ss in statuses.items():
        own = [r for r in rows if r["domain_id"] == d]
        for level in {r["level"] for r in own}:
            assert sum(r["segments"] for r in own if r["level"] == level) == len(ss)
            assert sum(r["consumed"] for r in own if r["level"] == level) == ss.count("succeeded")
        last = max(r["level"] for r in own)
        assert [r["node"] for r in own if r["level"] == last] == [0]
    of = lambda d: max((r["level"], r["status"]) for r in rows if r["domain_id"] == d)
    assert (of(1), of(2), of(3), of(4)) == ((3, "succeeded"), (2, "partial"), (1, "failed"), (1, "succeeded"))
    assert sorted(map(tuple, merged.collect())) == [(1, "k0", 4, 4), (1, "k1", 4, 4), (1, "k2", 4, 4), (2, "a", 2, 1)]
    assert [x.collect() for x in merge_levels(segments.limit(0), items.limit(0))] == [[], []]


def test_items_meet_their_segments_in_tasks_of_bounded_rows_and_are_written_for_no_level(spark, monkeypatch):
    from marginalia.operators import planning

    names, written = [], planning.written
    monkeypatch.setattr(planning, "written", lambda df, name: names.append(name) or written(df, name))
    segments = spark.range(1, 901).selectExpr("id % 2 AS domain_id", "(id + 1) div 2 AS ordinal", "IF(id % 7 = 0, 'failed', 'succeeded') AS status")
    items = spark.range(1, 901).selectExpr("id % 2 AS domain_id", "(id + 1) div 2 AS ordinal", "concat('k', id % 3) AS key", "id % 11 AS weight", "id % 50 AS ref")
    _, merged = planning.merge_levels(segments, items, fan=3, rows_a_task=100)
    want = {}
    for i in range(1, 901):
        if i % 7:
            want.setdefault((i % 2, f"k{i % 3}"), []).append((i % 11, i % 50))
    assert sorted(map(tuple, merged.collect())) == sorted((*k, max(w for w, _ in v), len({r for _, r in v})) for k, v in want.items())
    assert "merge-items" not in names
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
    assert "hashpartitioning(domain_id" in (plan := merged._jdf.queryExecution().executedPlan().toString()) and ", 10), REPARTITION_BY_NUM" in plan
