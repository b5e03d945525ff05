"""Coverage accounting, gates and evidence verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.numeric import ratio
from marginalia.functions.text import normalize_text, noise_verdict
from marginalia.streaming.tables import written


def span_states(docs: DataFrame, id_col: str, text: Column, *scope: str) -> DataFrame:
    """(id, scope, state, reason, canonical_id): noise, duplicate of the first with the same text, or included."""
    clean = docs.select(id_col, *scope, normalize_text(text).alias("_text")).select(id_col, *scope, noise_verdict(F.col("_text")).alias("reason"), F.unhex(F.sha2("_text", 256)).alias("_hash"))
    clean = written(clean, "span-states")  # hashes of all texts, for the two uses below
    first = clean.filter("reason IS NULL").groupBy(*scope, "_hash").agg(F.min(id_col).alias("canonical_id"))
    joined = clean.join(first, [*scope, "_hash"], "left")
    state = F.when(F.col("reason").isNotNull(), "noise").when(F.col(id_col) != F.col("canonical_id"), "duplicate").otherwise("included")
    return joined.select(id_col, *scope, state.alias("state"), "reason", F.when(F.col("reason").isNull(), F.col("canonical_id")).alias("canonical_id"))


def coverage_metrics(states: DataFrame, ledger: DataFrame, id_col: str, scope: str) -> DataFrame:
    """One row a scope: counts by state, spans without any ledger row (silent), accounting and semantic rates.
    ``ledger``: (id, outcome), one row a span at most."""
    joined = states.join(ledger.select(id_col, "outcome"), id_col, "left")
    included = F.col("state") == "included"
    n = joined.groupBy(scope).agg(
        F.count("*").alias("total"),
        F.count_if(included).alias("canonical"),
        F.count_if(F.col("state") == "duplicate").alias("duplicates"),
        F.count_if(F.col("state") == "noise").alias("noise"),
        F.count_if(included & (F.col("outcome") == "processed")).alias("processed"),
        F.count_if(included & (F.col("outcome") == "failed")).alias("failed"),
        F.count_if(included & F.col("outcome").isNull()).alias("silent"),
        F.count_if(included | (F.col("state") == "duplicate") | F.col("reason").isNotNull()).alias("accounted"),
    )
    return n.withColumn("accounting", ratio(F.col("accounted"), F.col("total"), 1.0)).withColumn("semantic", ratio(F.col("processed"), F.col("canonical")))


def coverage_gate(metrics: DataFrame) -> DataFrame:
    """Adds gate and its reasons in order: failed by silent or failed spans and accounting, else degraded, else passed."""
    hard = F.array_compact(F.array(F.when(F.col("silent") > 0, "silent_drop"), F.when(F.col("accounting") < 1, "accounting"), F.when(F.col("failed") > 0, "failed_spans")))
    soft = F.array_compact(F.array(F.when(F.col("canonical") == 0, "no_canonical"), F.when(F.col("semantic") < 1 - 1e-9, "semantic")))
    gate = F.when(F.size(hard) > 0, "failed").when(F.size(soft) > 0, "degraded").otherwise("passed")
    return metrics.withColumn("gate", gate).withColumn("reasons", F.array_join(F.when(F.size(hard) > 0, hard).otherwise(soft), ","))


def bind_claims(claims: DataFrame, refs: DataFrame, spans: DataFrame, everywhere: DataFrame) -> DataFrame:
    """(claim_id, claim_type, ref, binding): refs that are no ids are invalid; those of the domain bound; those of
    another domain cross_domain; the rest missing. ``spans`` and ``everywhere`` have ref columns."""
    asked = claims.join(refs.distinct(), "claim_id")
    here = spans.select("domain_id", "ref").distinct().withColumn("_here", F.lit(True))
    known = everywhere.select("ref").distinct().withColumn("_known", F.lit(True))
    joined = asked.join(here, ["domain_id", "ref"], "left").join(known, "ref", "left")
    verdict = F.when(~F.coalesce(F.col("ref").rlike("^[TPDIS][0-9]{4,6}([.][0-9]{1,2})?$"), F.lit(False)), "invalid").when(F.col("_here"), "bound").when(F.col("_known"), "cross_domain").otherwise("missing")
    return joined.select("claim_id", "claim_type", "ref", verdict.alias("binding"))


def claim_status(claims: DataFrame, bound: DataFrame) -> DataFrame:
    """(claim_id, claim_type, status): explanations need no source; others pass with one bound source."""
    n = bound.groupBy("claim_id").agg(F.count_if(F.col("binding") == "bound").alias("_bound"))
    status = F.when(F.col("claim_type") == "ai_explanation", "not_required").when(F.coalesce("_bound", F.lit(0)) > 0, "passed").otherwise("failed")
    return claims.join(n, "claim_id", "left").select("claim_id", "claim_type", status.alias("status"))
