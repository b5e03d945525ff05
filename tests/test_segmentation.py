import random
import resource

from pyspark.sql import functions as F

from marginalia.operators import folds
from marginalia.operators.segmentation import segment_plan

SHAPE = "domain_id long, ordinal long, tokens long, ends_unit boolean, boundary boolean"


def by_hand(rows, budget, fixed, each, context, slack):
    """One domain's plan, step by step: drafts first, then context, then repairs of one draft after another."""
    weights = [max(r[2] or 0, 1) for r in rows]
    if max(weights) + fixed + slack > budget and max(weights) + fixed + slack <= context:
        budget = max(weights) + fixed + slack
    if max(weights) + fixed + each > budget:
        return {(None, r[1], False, "failed") for r in rows}
    single, drafts, ended = sum(weights) + fixed <= budget, [[]], False
    for (_, ordinal, _, ends, boundary), w in zip(rows, weights):
        used = sum(x for _, x in drafts[-1])
        if drafts[-1] and not single and (used + w > budget - fixed or ended or (boundary and used >= 0.25 * (budget - fixed))):
            drafts.append([])
        drafts[-1].append((ordinal, w))
        ended = ends
    plan = []
    for i, own in enumerate(drafts):
        cap = min(int(budget * 0.15), max(budget - fixed - sum(w for _, w in own), 0))
        tail = []
        for span in reversed(drafts[i - 1] if i else []):
            if len(tail) == 3 or sum(w for _, w in tail) + span[1] > cap:
                break
            tail.insert(0, span)
        plan.append((tail, own))
    cost = lambda draft: fixed + sum(each + w for part in draft for _, w in part)
    repaired = False
    while over := [i for i, draft in enumerate(plan) if cost(draft) > budget]:
        tail, own = plan[over[0]]
        repaired = True
        if tail:
            plan[over[0]] = ([], own)
            continue
        half, weight = max(sum(w for _, w in own) // 2, 1), 0
        for cut, (_, w) in enumerate(own[:-1], 1):
            weight += w
            if weight >= half:
                break
        plan[over[0]:over[0] + 1] = [([], own[:cut]), ([], own[cut:])]
    strategy = "single_pass" if single and not repaired else "segmented_map_merge"
    return {(n, o, overlap, strategy) for n, draft in enumerate(plan, 1) for part, overlap in zip(draft, (True, False)) for o, _ in part}


def test_plans_as_by_hand(spark):
    drawn, rows, want = random.Random(5), [], set()
    for domain in range(120):
        most = drawn.choice([4, 20, 60, 95])
        own = [(domain, o, drawn.choice([None, 0, 1, drawn.randint(1, most)]), drawn.choice([None, False, False, True]), drawn.random() < 0.3) for o in range(1, drawn.randint(2, 40))]
        rows += own
        want |= {(domain, *r) for r in by_hand([(d, o, t, bool(e), b) for d, o, t, e, b in own], 100, 10, 4, 105, 6)}
    drawn.shuffle(rows)
    wider = spark.createDataFrame(rows, SHAPE).withColumn("segment", F.lit("clash")).withColumn("strategy", F.lit(0))
    got = [(r["domain_id"], r["segment"], r["ordinal"], r["overlap"], r["strategy"]) for r in segment_plan(wider, 100, fixed=10, each=4, context=105, slack=6).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    kinds = {(g[3], g[4]) for g in got}
    assert kinds == {(False, "failed"), (False, "single_pass"), (False, "segmented_map_merge"), (True, "segmented_map_merge")}


def test_empty_and_unknown_domains(spark):
    none = spark.createDataFrame([], SHAPE)
    assert segment_plan(none, 100, fixed=10).count() == 0
    lone = spark.createDataFrame([(None, 1, 5, None, None), (None, 2, None, None, None)], SHAPE)
    got = sorted((r["ordinal"], r["segment"], r["tokens"], r["strategy"]) for r in segment_plan(lone, 100, fixed=10).collect())
    assert got == [(1, 1, 5, "single_pass"), (2, 1, 1, "single_pass")]


def test_a_long_domain_takes_little_memory(spark):
    """A million spans of one domain: the largest Python worker stays far below what the rows would take as objects."""
    spans = spark.range(1, 1_000_001).select(F.lit(7).cast("long").alias("domain_id"), F.col("id").alias("ordinal"), (F.col("id") % 90 + 1).alias("tokens"), (F.col("id") % 11 == 0).alias("ends_unit"), F.lit(False).alias("boundary"))

    def peak(batches):
        import pyarrow as pa

        for batch in batches:
            used = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "primary": [batch.num_rows - sum(batch.column("overlap").to_pylist())], "mb": [used]})

    row = segment_plan(spans, 400, fixed=20, each=2).mapInArrow(peak, "n long, primary long, mb long").agg(F.sum("primary").alias("primary"), F.max("mb").alias("mb")).first()
    assert row["primary"] == 1_000_000 and row["mb"] < 400


def test_refit_streams_segments(spark):
    planned = spark.range(1, 200_001).select(F.lit("a").alias("domain_id"), F.col("id").alias("ordinal"), ((F.col("id") - 1) / 10).cast("long").alias("segment"), (F.col("id") % 7).alias("tokens"), F.lit(False).alias("overlap"))
    fitted = folds.refit_segments(planned, 20).join(planned.select("ordinal", "tokens"), "ordinal")
    each = fitted.groupBy("segment").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), (F.max("ordinal") - F.min("ordinal") + 1).alias("run"))
    got = each.agg(F.max("t").alias("t"), F.sum("n").alias("n"), F.count_if(F.col("run") != F.col("n")).alias("broken"), F.max("segment").alias("last"), F.count("*").alias("segments")).first()
    assert got["t"] <= 20 and got["n"] == 200_000 and got["broken"] == 0 and got["last"] == got["segments"]
