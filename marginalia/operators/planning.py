"""Segment plans proposed in rounds, and segments merged in levels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.domain import content_hashes
from marginalia.operators.rules import boundary_report
from marginalia.streaming.tables import written

#: (open spans, reports of the round before or None, round) to (units, breaks), as ``boundary_report`` takes them.
Proposer = Callable[[DataFrame, DataFrame | None, int], tuple[DataFrame, DataFrame]]

#: Segments that one task joins with their items, on average: some ten MB of sorted rows and hash table.
ROWS_A_TASK = 1 << 18


@dataclass(frozen=True)
class Plans:
    """plans: domain_id, input_hash, status, rounds, reused, segments, hard, soft, detail; units and breaks of those that
    succeeded or are of low quality. What one run returns another takes as its cache."""

    plans: DataFrame
    units: DataFrame
    breaks: DataFrame


def plan_boundaries(spans: DataFrame, propose: Proposer, limit: int, rounds: int = 3, cache: Plans | None = None, least: int = 3, ratio: float = 0.3) -> Plans:
    """Plans of all domains of ``spans`` (domain_id, ordinal, tokens and what the proposer needs).

    A domain whose spans and limit are those of a plan that succeeded before takes that. For the others units and breaks
    are proposed and checked, up to ``rounds`` times, with the last report as a hint; only domains without an accepted
    plan are given to the proposer and checked again. What is left then is of low quality if only soft rules are broken,
    else a fallback. A proposer that fails ends the rounds: its domains are fallbacks, with the error as detail.
    """
    inputs = content_hashes(spans, "domain_id", spans.columns).select("domain_id", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(":", "hash", F.lit(limit).cast("string")), 256)).alias("input_hash"))
    open_ = inputs = written(inputs, "plan-inputs")
    no_units = spans.limit(0).select("domain_id", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    units, breaks, plans = [no_units], [no_units.select("domain_id", F.col("a").alias("at"))], []
    if cache is not None:
        same = written(inputs.join(cache.plans.filter("status = 'succeeded'").drop("reused"), ["domain_id", "input_hash"]).withColumn("reused", F.lit(True)), "plans-reused")
        plans.append(same)
        units.append(cache.units.join(same.select("domain_id"), "domain_id", "left_semi"))
        breaks.append(cache.breaks.join(same.select("domain_id"), "domain_id", "left_semi"))
        open_ = written(inputs.join(same, "domain_id", "left_anti"), "plans-open")
    report, detail, round_ = None, "", 0
    while round_ < rounds and open_.limit(1).count():
        round_ += 1
        left = spans.join(open_.select("domain_id"), "domain_id", "left_semi")
        try:
            made = propose(left, report, round_)
            own_units, own_breaks = (written(df.join(open_, "domain_id", "left_semi"), "proposed") for df in made)
            report = written(open_.join(boundary_report(left, own_units, own_breaks, limit, least, ratio), "domain_id"), "plan-report")
        except Exception as error:  # whatever a proposer does is a fallback; interrupts go through
            detail, report = str(error)[:300], None
            break
        last = F.lit(round_ == rounds)
        ended = report.filter((F.col("status") == "succeeded") | last).withColumn("status", F.when(F.col("status") == "rejected", "fallback").otherwise(F.col("status")))
        row = ended.select("domain_id", "input_hash", "status", F.lit(round_).alias("rounds"), F.lit(False).alias("reused"), "segments", "hard", "soft", F.lit("").alias("detail"))
        plans.append(row)
        usable = row.filter("status <> 'fallback'").select("domain_id")
        units.append(own_units.join(usable, "domain_id", "left_semi").select("domain_id", "a", "b"))
        breaks.append(own_breaks.join(usable, "domain_id", "left_semi").select("domain_id", "at"))
        open_ = written(open_.join(row, "domain_id", "left_anti"), "plans-open")
        report = report.join(open_.select("domain_id"), "domain_id", "left_semi")
    none = F.lit(None).cast("long")
    plans.append(open_.select("domain_id", "input_hash", F.lit("fallback").alias("status"), F.lit(round_).alias("rounds"), F.lit(False).alias("reused"), none.alias("segments"), F.lit("").alias("hard"), F.lit("").alias("soft"), F.lit(detail).alias("detail")))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return Plans(union(plans), union(units), union(breaks))


def merge_levels(segments: DataFrame, items: DataFrame, fan: int = 8, rows_a_task: int = ROWS_A_TASK) -> tuple[DataFrame, DataFrame]:
    """(nodes, merged). nodes: domain_id, level, node, segments, consumed, children and status of each merge, up to one
    for a domain; merged: domain_id, key, weight and refs of what is in the last one.

    ``segments``: domain_id, ordinal (from 1, without gaps), status. ``items``: domain_id, ordinal, key, weight, ref. Each
    level merges ``fan`` neighbours: items of one key become one, with the greatest weight and all references, each once;
    items of segments that didn't succeed take no part. A merge succeeded if all segments below did, failed if none did,
    else it is partial. Levels shrink by ``fan``, and rows are combined before each shuffle, so a domain of any length
    is merged by many tasks. Every segment is below one node of each level. The greatest weight and the references of a
    key are the same however merges are nested, so items are merged once for all levels, by key and reference: tables of
    each level that are read back would put ever more of them in one task's hash table.
    """
    good = F.col("status") == "succeeded"
    level0 = segments.select("domain_id", (F.col("ordinal") - 1).alias("node"), F.lit(1).cast("long").alias("segments"), good.cast("long").alias("consumed"))
    nodes, level, done = level0, 0, []
    while not done or nodes.filter("node > 0").limit(1).count():
        level += 1
        up = F.floor(F.col("node") / fan).alias("node")
        nodes = written(nodes.groupBy("domain_id", up).agg(F.sum("segments").alias("segments"), F.sum("consumed").alias("consumed"), F.count("*").alias("children")), "merge-nodes")
        done.append(nodes.withColumn("level", F.lit(level)))
    status = F.when(F.col("consumed") == F.col("segments"), "succeeded").when(F.col("consumed") == 0, "failed").otherwise("partial")
    every = reduce(DataFrame.unionByName, done).select("domain_id", "level", "node", "segments", "consumed", "children", status.alias("status"))
    # a domain with one node at some level has only copies of it above
    alone = every.filter("node = 0").groupBy("domain_id", "segments").agg(F.min("level").alias("top"))
    whole = segments.groupBy("domain_id").agg(F.count("*").alias("segments"))
    top = whole.join(alone, ["domain_id", "segments"]).select("domain_id", "top")
    place = ["domain_id", "ordinal"]
    parts = 1 + (nodes.agg(F.sum("segments")).first()[0] or 0) // rows_a_task
    content = items.repartition(parts, *place).join(segments.filter(good).select(*place).repartition(parts, *place), place, "left_semi").select("domain_id", "key", "weight", "ref")
    once = content.groupBy("domain_id", "key", "ref").agg(F.max("weight").alias("weight"))
    merged = once.groupBy("domain_id", "key").agg(F.max("weight").alias("weight"), F.count("*").alias("refs"))
    return every.join(top, "domain_id").filter("level <= top").drop("top"), merged
