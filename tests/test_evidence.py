import pytest
from pyspark.sql import functions as F

from marginalia.operators import evidence, rules
from marginalia.sources import commits


def tables(spark):
    claims = spark.createDataFrame([(1, "fact", 1), (2, "definition", 1), (3, "ai_explanation", 1), (4, "fact", 1), (5, "fact", 2), (6, "fact", 2), (7, "fact", 2)], "claim_id long, claim_type string, domain_id long")
    refs = spark.createDataFrame([(1, "T000001"), (1, "T000001"), (1, "x"), (2, "T000002"), (3, "T000002"), (4, "T000001"), (5, "T000001"), (5, "T000009"), (6, "T000009"), (6, None)], "claim_id long, ref string")
    spans = spark.createDataFrame([(1, "T000001"), (1, "T000002"), (2, "T000009")], "domain_id long, ref string")
    producers = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 10), (5, 12), (6, 12), (7, 12), (4, None)], "claim_id long, invocation long")
    reads = spark.createDataFrame([(11, "T000001"), (13, "T000009")], "invocation long, ref string")
    return claims, refs, spans, producers, reads


def test_other_producers_reads_do_not_count(spark):
    claims, refs, spans, producers, reads = tables(spark)
    sources = evidence.bound_sources(claims, refs, spans, producers, reads)
    got = {(r["claim_id"], r["ref"]): (r["binding"], r["shown"], r["read"], r["failure"]) for r in sources.collect()}
    no = evidence.NOT_SHOWN
    assert got == {
        (1, "T000001"): ("bound", True, True, None),
        (1, "x"): ("invalid", False, False, "malformed_source_id"),
        (2, "T000002"): ("bound", False, False, no),
        (3, "T000002"): ("bound", False, False, None),
        (4, "T000001"): ("bound", False, True, no),
        (5, "T000001"): ("cross_domain", False, True, "cross_domain_source_id"),
        (5, "T000009"): ("bound", False, True, no),  # another producer was shown it
        (6, "T000009"): ("bound", False, True, no),
    }
    nested = evidence.claims_with_sources(claims, sources, producers)
    made = {r["claim_id"]: (r["status"], r["reasons"], [s["ref"] for s in r["sources"]]) for r in nested.collect()}
    assert made[1] == ("passed", ["malformed_source_id:x"], ["T000001", "x"])
    assert made[2] == ("failed", [f"{no}:T000002"], ["T000002"])
    assert made[3] == ("not_required", [], ["T000002"])
    assert made[4] == ("failed", ["producer_visibility_missing", f"{no}:T000001"], ["T000001"])
    assert made[7] == ("failed", ["classroom_claim_without_source"], [])
    gates = {r["domain_id"]: r["reasons"] for r in rules.evidence_gate(evidence.evidence_report(claims.select("claim_id", "domain_id"), nested.drop("domain_id"), sources, "domain_id")).collect()}
    assert gates == {
        1: "invalid_source_refs,not_in_claim_producer_refs,claims_without_provenance,unread_source_refs,failed_claims,critical_claim_evidence_rate",
        2: "cross_domain_refs,not_in_claim_producer_refs,failed_claims",
    }


def test_runs_are_rewritten_whole_or_not_at_all(spark, tmp_path):
    base = str(tmp_path / "runs")
    claims = lambda rows: spark.createDataFrame(rows, "run_id long, claim string")
    sources = lambda rows: spark.createDataFrame(rows, "run_id long, claim string, ref string")
    read = lambda name: sorted(map(tuple, commits.current_rows(spark, base, name, "run_id").collect()))
    assert commits.rewrite({"claims": claims([(1, "a"), (2, "b")]), "sources": sources([(1, "a", "T1"), (2, "b", "T2"), (3, "no", "T3")])}, base, "run_id") == 1
    assert (read("claims"), read("sources")) == ([(1, "a"), (2, "b")], [(1, "a", "T1"), (2, "b", "T2")])
    broken = sources([(1, "x", "T9")]).withColumn("ref", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        commits.rewrite({"claims": claims([(1, "x")]), "sources": broken}, base, "run_id")
    assert (read("claims"), read("sources")) == ([(1, "a"), (2, "b")], [(1, "a", "T1"), (2, "b", "T2")])
    assert commits.rewrite({"claims": claims([(1, "x"), (1, "y")]), "sources": sources([])}, base, "run_id") == 2
    assert (read("claims"), read("sources")) == ([(1, "x"), (1, "y"), (2, "b")], [(2, "b", "T2")])
    assert all(p.name.startswith("version-") or p.name.startswith("_staged") for p in (tmp_path / "runs").iterdir())
