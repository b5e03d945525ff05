"""The whole vector of a domain's coverage metrics, from its items, spans, ledger and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.numeric import ratio

#: Ledger stages.
UNDERSTOOD, LEGACY = "understand_segments", "legacy_candidate"


def coverage_vector(items: DataFrame, spans: DataFrame, ledger: DataFrame, segments: DataFrame, low: float = 0.3) -> DataFrame:
    """One row a domain of ``items`` with all metrics.

    ``items``: domain_id, ordinal, state, reason, required. ``spans``: domain_id, ordinal, item, kind, page_no, state,
    canonical_ordinal, start_ms, end_ms, assigned. ``ledger``: domain_id, ordinal, stage, outcome; rows may repeat, and a
    span may have rows of several stages. ``segments``: domain_id, status, merged, structures, structures_kept,
    refs_total, refs_used. An item is accounted for if it is included, a duplicate or has a reason. A required item that
    is no duplicate needs an included span or a duplicate of one. Rates are 0.0 without a denominator, accounting is 1.0;
    segments without references count in no reference rate. Missing tables' metrics are 0.

    The ledger becomes one row a span before it is joined; spans become one row an item, and those one a domain, always
    by sums that are combined before a shuffle, so a domain may hold any share of all spans.
    """
    key = ["domain_id", "ordinal"]
    done = lambda stage: F.max((F.col("stage") == stage) & (F.col("outcome") == "processed"))
    noted = ledger.groupBy(*key).agg(done(UNDERSTOOD).alias("processed"), done(LEGACY).alias("legacy"), F.lit(True).alias("noted"))
    no = F.lit(False)
    known = spans.join(noted, key, "left").withColumns({c: F.coalesce(c, no) for c in ("processed", "legacy", "noted")})
    roots = spans.filter("state = 'included'").select("domain_id", F.col("ordinal").alias("canonical_ordinal"), F.lit(True).alias("rooted"))
    known = known.join(roots, ["domain_id", "canonical_ordinal"], "left")
    of = items.select("domain_id", F.col("ordinal").alias("item"), "required")
    known = known.join(of, ["domain_id", "item"], "left")

    state, live = F.col("state"), F.col("state") == "included"
    n = lambda condition: F.count_if(condition)
    spoken, slide = live & (F.col("kind") == "transcript"), live & (F.col("kind") == "ppt")
    per_page = known.groupBy("domain_id", "item", F.when(slide, F.col("page_no")).alias("page")).agg(
        F.count("*").alias("spans"), n(live).alias("canonical"), n(state == "duplicate").alias("duplicates"), n(state == "noise").alias("noise"), n(state == "unsupported").alias("unsupported"), n(state == "failed").alias("failed"),
        n(state == "excluded_with_reason").alias("excluded"), n(F.col("assigned")).alias("planned"), n(live & ~F.col("assigned")).alias("unassigned"), n(live & F.col("processed")).alias("processed"), n(live & F.col("legacy")).alias("legacy"),
        n(live & ~F.col("noted")).alias("silent"), n(live & F.col("required") & ~F.col("processed")).alias("required_unprocessed"), n(live | ((state == "duplicate") & F.coalesce("rooted", no))).alias("standing"),
        n(spoken).alias("timeline"), n(spoken & F.col("processed")).alias("timeline_processed"), F.min(F.when(spoken, F.col("start_ms"))).alias("start_ms"), F.max(F.when(spoken, F.col("end_ms"))).alias("end_ms"), n(slide & F.col("processed")).alias("page_done"),
    )
    sums = ["spans", "canonical", "duplicates", "noise", "unsupported", "failed", "excluded", "planned", "unassigned", "processed", "legacy", "silent", "required_unprocessed", "timeline", "timeline_processed"]
    standing = per_page.groupBy("domain_id", "item").agg(F.sum("standing").alias("standing"))
    pages = per_page.groupBy("domain_id", "page").agg(F.max("page_done").alias("page_done"), *[F.sum(c).alias(c) for c in sums], F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    by_span = pages.groupBy("domain_id").agg(*[F.sum(c).alias(c) for c in sums], F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("page").alias("pages"), n(F.col("page").isNotNull() & (F.col("page_done") > 0)).alias("pages_processed"))

    needed = F.coalesce("required", no)
    own = items.join(standing.withColumnRenamed("item", "ordinal"), key, "left")
    by_item = own.groupBy("domain_id").agg(
        F.count("*").alias("items"), n(state != "duplicate").alias("unique_items"), n(state.isin("included", "duplicate") | (F.coalesce("reason", F.lit("")) != "")).alias("accounted_items"), n(needed).alias("required"), n(needed & (state == "failed")).alias("required_failed"),
        n(needed & (state == "unsupported")).alias("required_unsupported"), n(needed & (state == "excluded_with_reason")).alias("required_excluded"), n(needed & (state != "duplicate") & (F.coalesce("standing", F.lit(0)) == 0)).alias("required_bare"),
    )
    rate = F.when(F.col("refs_total") > 0, F.round(F.col("refs_used") / F.col("refs_total"), 6))
    by_segment = segments.withColumn("rate", rate).groupBy("domain_id").agg(
        F.count("*").alias("segments"), n(F.col("status") == "succeeded").alias("segments_succeeded"), n(F.col("status") == "failed").alias("segments_failed"), n("merged").alias("segments_merged"), F.sum("structures").alias("structures"),
        (F.sum("structures") - F.sum("structures_kept")).alias("structures_dropped"), F.min("rate").alias("ref_rate_min"), F.round(F.avg("rate"), 6).alias("ref_rate_mean"), n(F.col("rate") < low).alias("ref_rate_low"),
    )
    counts = [c for df in (by_span, by_segment) for c in df.columns if c not in ("domain_id", "start_ms", "end_ms", "ref_rate_min", "ref_rate_mean")]
    whole = by_item.join(by_span, "domain_id", "left").join(by_segment, "domain_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    part = lambda a, b, none=0.0: ratio(F.col(a), F.col(b), none)
    return whole.withColumns({
        "unaccounted_items": F.col("items") - F.col("accounted_items"), "refs_invalid": F.col("canonical") - F.col("processed"), "accounting": part("accounted_items", "items", 1.0), "semantic": part("processed", "canonical"),
        "timeline_rate": part("timeline_processed", "timeline"), "legacy_rate": part("legacy", "canonical"), "page_rate": part("pages_processed", "pages"), "merge_rate": part("segments_merged", "segments"),
    })
