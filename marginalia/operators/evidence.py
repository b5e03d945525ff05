"""Evidence of claims: sources bound to spans, what their producer was shown, and both per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.audit import bind_claims

#: Why a source doesn't count, by how it is bound.
WHY = {"invalid": "malformed_source_id", "cross_domain": "cross_domain_source_id", "missing": "source_not_in_domain"}
NOT_SHOWN = "source_not_presented_to_this_claim_producer"
FREE_TYPE = "ai_explanation"


def bound_sources(claims: DataFrame, refs: DataFrame, spans: DataFrame, producers: DataFrame, reads: DataFrame) -> DataFrame:
    """(claim_id, claim_type, ref, binding, known_producer, shown, read, failure) of each source that a claim names.

    ``claims``: claim_id, claim_type, domain_id. ``refs``: claim_id, ref. ``spans``: domain_id, ref. ``producers``:
    claim_id and the invocations that made it, several or none. ``reads``: invocation, ref: what each was shown. shown:
    one of the claim's own invocations was; read: any invocation was. A bound source counts against a claim that needs
    sources if its own producer wasn't shown it, whoever else was. Null refs and repeated ones drop out.
    """
    bound = bind_claims(claims, refs.filter("ref IS NOT NULL"), spans, spans)
    made = producers.filter("invocation IS NOT NULL").distinct()
    seen = reads.distinct()
    shown = bound.join(made, "claim_id").join(seen, ["invocation", "ref"], "left_semi").select("claim_id", "ref").distinct().withColumn("shown", F.lit(True))
    with_producer = made.select("claim_id").distinct().withColumn("known_producer", F.lit(True))
    anywhere = seen.select("ref").distinct().withColumn("read", F.lit(True))
    whole = bound.join(with_producer, "claim_id", "left").join(shown, ["claim_id", "ref"], "left").join(anywhere, "ref", "left")
    no = F.lit(False)
    flags = whole.select("claim_id", "claim_type", "ref", "binding", *[F.coalesce(c, no).alias(c) for c in ("known_producer", "shown", "read")])
    failure = F.when((F.col("binding") == "bound") & ~F.col("shown") & (F.col("claim_type") != FREE_TYPE), NOT_SHOWN)
    for binding, why in WHY.items():
        failure = F.when(F.col("binding") == binding, why).otherwise(failure)
    return flags.withColumn("failure", failure)


def claims_with_sources(claims: DataFrame, sources: DataFrame, producers: DataFrame) -> DataFrame:
    """(claim_id, claim_type, domain_id, status, reasons, sources) of every claim: its sources nested, by ref. A claim
    that needs sources passes with one that is bound and was shown to its producer; without a producer it fails."""
    each = F.sort_array(F.collect_list(F.struct("ref", "binding", "shown", "failure")))
    nested = sources.groupBy("claim_id").agg(each.alias("sources"), F.count_if((F.col("binding") == "bound") & F.col("failure").isNull()).alias("good"))
    made = producers.filter("invocation IS NOT NULL").select("claim_id").distinct().withColumn("made", F.lit(True))
    whole = claims.join(nested, "claim_id", "left").join(made, "claim_id", "left")
    none = F.col("sources").isNull()
    passed = (F.coalesce("good", F.lit(0)) > 0) & F.coalesce("made", F.lit(False))
    status = F.when(F.col("claim_type") == FREE_TYPE, "not_required").when(passed, "passed").otherwise("failed")
    needs = F.col("claim_type") != FREE_TYPE
    own = F.array_compact(F.array(F.when(needs & F.col("made").isNull(), "producer_visibility_missing"), F.when(needs & none, "classroom_claim_without_source")))
    wrong = F.transform(F.filter("sources", lambda s: s["failure"].isNotNull()), lambda s: F.concat(s["failure"], F.lit(":"), s["ref"]))
    reasons = F.concat(own, F.coalesce(wrong, F.array().cast("array<string>")))
    return whole.select("claim_id", "claim_type", "domain_id", status.alias("status"), reasons.alias("reasons"), F.coalesce("sources", F.slice(F.array(F.struct(F.lit("").alias("ref"), F.lit("").alias("binding"), F.lit(False).alias("shown"), F.lit(None).cast("string").alias("failure"))), 1, 0)).alias("sources"))


def evidence_report(claims: DataFrame, nested: DataFrame, sources: DataFrame, group: str, critical_type: str = "definition") -> DataFrame:
    """One row a group of claims, as ``rules.evidence_gate`` reads it. ``claims``: claim_id and the group."""
    n = lambda c: F.count_if(c)
    binding = F.col("binding")
    by_source = sources.join(claims.select("claim_id", group), "claim_id").groupBy(group).agg(
        n(binding == "invalid").alias("invalid"), n(binding == "cross_domain").alias("cross_domain"), n(binding == "missing").alias("missing"), n(F.col("failure") == NOT_SHOWN).alias("not_shown"),
        n((F.col("failure") == NOT_SHOWN) & ~F.col("read")).alias("unread"),
    )
    needs, critical = F.col("status") != "not_required", F.col("claim_type") == critical_type
    by_claim = nested.join(claims.select("claim_id", group), "claim_id").groupBy(group).agg(
        n(F.array_contains("reasons", "producer_visibility_missing")).alias("without_provenance"), n(F.col("status") == "failed").alias("failed_claims"), n(needs).alias("required"),
        n(critical).alias("critical"), n(critical & (F.col("status") == "passed")).alias("critical_bound"),
    )
    return by_claim.join(by_source, group, "left")
