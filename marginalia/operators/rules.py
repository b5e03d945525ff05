"""Rules that a domain's plan, coverage and evidence must keep, and the states and numbers of its items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import is_parse_marker

#: Kinds of sources that can be parsed, and what a span says of an item's reason.
PARSEABLE = ["pdf", "ppt", "doc", "text", "transcript"]
SPAN_REASONS = {
    "duplicate_content_hash": "duplicate_content_hash",
    "unsupported_file_type": "unsupported_file_type",
    "unsupported_parse_state": "unsupported_file_type",
    "material_not_in_scope": "excluded_unassigned",
    "optional_not_selected": "excluded_unassigned",
    "required_but_excluded": "excluded_unassigned",
    "transcript_empty": "noise_empty_text",
}


def named(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that are broken, in order, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules])), ",")


def boundary_report(spans: DataFrame, units: DataFrame, breaks: DataFrame, limit: int, least: int = 3, ratio: float = 0.3) -> DataFrame:
    """(domain_id, segments, hard, soft, oversized, status) of every domain with spans or units.

    ``spans``: domain_id, ordinal, tokens; ``units``: domain_id, a, b, ranges of ordinals; ``breaks``: domain_id, at,
    the last ordinals of segments. hard: H0 nothing there; H1 a range is no range; H2 neighbours overlap or leave a gap;
    H3 the ends aren't covered; H4 breaks repeat or cut a unit; H5 a break leaves no segment after it; H6 a unit crosses
    segments. soft: L1 units of fewer than ``least`` spans; L2 more segments than ``ratio`` of the spans; L3 over
    ``limit`` tokens and no break; L4 a segment over the limit that has two units. oversized: units over the limit.
    Domains of hard ones are rejected, of soft ones low_quality.
    """
    size = spans.groupBy("domain_id").agg(F.max("ordinal").alias("top"), F.sum("tokens").alias("total"))
    before = F.lag("b").over(W.partitionBy("domain_id").orderBy("a", "b"))
    about = units.withColumn("before", before).groupBy("domain_id").agg(
        F.count_if((F.col("a") < 1) | (F.col("b") < 1) | (F.col("a") > F.col("b"))).alias("h1"), F.count_if(F.col("a") != F.col("before") + 1).alias("h2"),
        F.min("a").alias("first"), F.max(F.struct("a", "b"))["b"].alias("last"), F.count_if(F.col("b") - F.col("a") + 1 < least).alias("small"),
    )
    known = breaks.join(units.select("domain_id", F.col("b").alias("at"), F.lit(True).alias("ends")).distinct(), ["domain_id", "at"], "left").join(size, "domain_id")
    cuts = known.groupBy("domain_id").agg((F.count("*") - F.count_distinct("at")).alias("twice"), F.count_if(F.col("ends").isNull()).alias("inside"), F.count_if(F.col("at") >= F.col("top")).alias("late"))
    valid = known.filter((F.col("at") >= 1) & (F.col("at") < F.col("top"))).select("domain_id", "at").distinct()

    # the segment of a place is one more than the breaks before it: one pass over spans, ends of units and breaks
    mark = lambda df, pos, what, a, b, tokens: df.select("domain_id", F.col(pos).alias("pos"), F.lit(what).alias("what"), a.alias("a"), b.alias("b"), tokens.alias("tokens"))
    none = F.lit(None).cast("long")
    marks = mark(spans, "ordinal", "span", none, none, F.col("tokens")).union(mark(units, "a", "start", F.col("a"), F.col("b"), none)).union(mark(units, "b", "stop", F.col("a"), F.col("b"), none)).union(mark(valid, "at", "break", none, none, none))
    is_break = (F.col("what") == "break").cast("int")
    placed = marks.withColumn("segment", F.sum(is_break).over(W.partitionBy("domain_id").orderBy("pos", is_break).rowsBetween(W.unboundedPreceding, W.currentRow)) + 1)
    inside = placed.filter("what IN ('start', 'stop')").groupBy("domain_id", "a", "b").agg(F.min(F.when(F.col("what") == "start", F.col("segment"))).alias("segment"), F.max(F.when(F.col("what") == "stop", F.col("segment"))).alias("to")).join(size, "domain_id")
    ends_inside = (F.col("a") >= 1) & (F.col("b") <= F.col("top"))
    weight = placed.filter("what = 'span'").groupBy("domain_id", "segment").agg(F.sum("tokens").alias("weight"))
    home = inside.filter(ends_inside & ((F.col("segment") == F.col("to")) | (F.col("a") > F.col("b"))))
    held = home.select("domain_id", F.explode(F.sequence("to", "segment")).alias("segment")).groupBy("domain_id", "segment").agg(F.count("*").alias("held"))
    parts = weight.join(held, ["domain_id", "segment"], "left").groupBy("domain_id").agg(F.count("*").alias("segments"), F.count_if((F.col("weight") > limit) & (F.col("held") >= 2)).alias("heavy"))
    crossing = inside.groupBy("domain_id").agg(F.count_if((F.col("a") <= F.col("b")) & (~ends_inside | (F.col("segment") != F.col("to")))).alias("h6"))

    upto = spans.select("domain_id", F.col("ordinal").alias("at"), F.sum("tokens").over(W.partitionBy("domain_id").orderBy("ordinal")).alias("sum"))
    clipped = units.join(size, "domain_id").select("domain_id", (F.greatest("a", F.lit(1)) - 1).alias("below"), F.least("b", "top").alias("at"))
    big = clipped.join(upto, ["domain_id", "at"]).join(upto.select("domain_id", F.col("at").alias("below"), F.col("sum").alias("less")), ["domain_id", "below"], "left")
    over = big.groupBy("domain_id").agg(F.count_if(F.col("sum") - F.coalesce("less", F.lit(0)) > limit).alias("oversized"))

    all_ = size.join(about, "domain_id", "full")
    for part in (cuts, parts, crossing, over):
        all_ = all_.join(part, "domain_id", "left")
    some = lambda name: F.coalesce(F.col(name), F.lit(0)) > 0
    empty = F.col("top").isNull() | F.col("first").isNull()
    hard = named(
        ("H1", some("h1")), ("H2", some("h2")), ("H3", (F.col("first") != 1) | (F.col("last") != F.col("top"))),
        ("H4", some("twice") | some("inside")), ("H5", some("late")), ("H6", some("h6")),
    )
    cut = F.coalesce("segments", F.lit(1)) > 1
    soft = named(("L1", some("small")), ("L2", F.col("segments") > F.greatest(F.floor(F.col("top") * ratio), F.lit(1))), ("L3", (F.col("total") > limit) & ~cut), ("L4", some("heavy")))
    out = all_.select("domain_id", F.when(~empty, F.col("segments")).alias("segments"), F.when(empty, "H0").otherwise(hard).alias("hard"), F.when(empty, "").otherwise(soft).alias("soft"), F.when(~empty, F.coalesce("oversized", F.lit(0))).alias("oversized"))
    return out.withColumn("status", F.when(F.col("hard") != "", "rejected").when(F.col("soft") != "", "low_quality").otherwise("succeeded"))


def whole_gate(metrics: DataFrame) -> DataFrame:
    """Adds gate and reasons, by all metrics of a domain: what blocks fails it; without such, what is left undone
    degrades it; else it passed."""
    over = lambda name: F.coalesce(F.col(name), F.lit(0)) > 0
    blocks = named(
        ("silent_dropped", over("silent")), ("domain_accounting_rate", F.coalesce(F.col("accounting"), F.lit(0.0)) < 1), ("required_items_failed", over("required_failed")),
        ("required_items_unsupported", over("required_unsupported")), ("required_items_without_canonical_span", over("required_bare")), ("unassigned_count", over("unassigned")),
    )
    lacks = named(
        ("canonical_non_noise_spans", F.coalesce(F.col("canonical"), F.lit(0)) == 0), ("semantic_processing_rate", F.coalesce(F.col("semantic"), F.lit(0.0)) + 1e-9 < 1), ("required_spans_unprocessed", over("required_unprocessed")),
        ("source_refs_invalid", over("refs_invalid")), ("segment_failed_count", over("segments_failed")), ("merge", over("segments") & (F.col("segments_merged") < F.col("segments"))), ("structures_dropped", over("structures_dropped")),
    )
    gate = F.when(blocks != "", "failed").when(lacks != "", "degraded").otherwise("passed")
    return metrics.withColumn("gate", gate).withColumn("reasons", F.when(blocks != "", blocks).otherwise(lacks))


def evidence_gate(report: DataFrame) -> DataFrame:
    """Adds gate and reasons: any broken reference or unproven claim fails it."""
    over = lambda name: F.coalesce(F.col(name), F.lit(0)) > 0
    blocks = named(
        ("invalid_source_refs", over("invalid")), ("cross_domain_refs", over("cross_domain")), ("unbound_source_refs", over("missing")), ("not_in_claim_producer_refs", over("not_shown")),
        ("claims_without_provenance", over("without_provenance")), ("unread_source_refs", over("unread")), ("failed_claims", over("failed_claims")), ("critical_claim_evidence_rate", over("critical") & (F.col("critical_bound") < F.col("critical"))),
    )
    return report.withColumn("gate", F.when(blocks != "", "failed").otherwise("passed")).withColumn("reasons", blocks)


def item_state(kind: Column, status: Column, error: Column) -> Column:
    """struct<state, reason>: an item whose parser failed is failed; one that waits for recognition, or of a kind that
    can't be parsed, unsupported; all else included."""
    of = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).cast("string").alias("reason"))
    failed = is_parse_marker(error) | (F.coalesce(F.lower(status), F.lit("")) == "failed")
    waits = F.coalesce(F.lower(status), F.lit("")).isin("needs_ocr", "transcribing")
    return F.when(failed, of("failed", "parse_failed")).when(waits, of("unsupported", "unsupported_parse_state")).when(~F.coalesce(kind, F.lit("unknown")).isin(PARSEABLE), of("unsupported", "unsupported_file_type")).otherwise(of("included", None))


def span_reason(reason: Column) -> Column:
    """What a span says of an item's reason; one that isn't known counts as a failed parse, none as none."""
    out = F.lit("failed_parse")
    for item, span in SPAN_REASONS.items():
        out = F.when(reason == item, span).otherwise(out)
    return F.when(F.coalesce(reason, F.lit("")) != "", out)


def duration_ms(start: Column, end: Column) -> Column:
    """Between two times to the second, with a blank or a T in the middle; not below 0, null for what is no time."""
    at = lambda c: F.coalesce(*[F.try_to_timestamp(F.substring(c, 1, 19), F.lit(form)) for form in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")])
    passed = F.unix_millis(at(end)) - F.unix_millis(at(start))
    return F.when(passed < 0, 0).otherwise(passed)


def terminal_ids(items: DataFrame, prefix_col: str, order_col: str, terminal: Column) -> DataFrame:
    """Adds source_id: prefix and six digits. Live items are numbered first in each prefix, terminal ones go on from
    there."""
    ended = F.coalesce(terminal, F.lit(False))
    at = F.row_number().over(W.partitionBy(prefix_col).orderBy(ended, order_col))
    return items.withColumn("source_id", F.concat(F.col(prefix_col), F.lpad(at.cast("string"), 6, "0")))
