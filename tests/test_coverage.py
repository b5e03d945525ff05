from marginalia.operators.coverage import LEGACY, UNDERSTOOD, coverage_vector

ITEMS = "domain_id long, ordinal long, state string, reason string, required boolean"
SPANS = "domain_id long, ordinal long, item long, kind string, page_no int, state string, canonical_ordinal long, start_ms long, end_ms long, assigned boolean"
LEDGER = "domain_id long, ordinal long, stage string, outcome string"
SEGMENTS = "domain_id long, status string, merged boolean, structures long, structures_kept long, refs_total long, refs_used long"


def test_metrics_of_small_domains(spark):
    items = spark.createDataFrame([(1, 1, "included", None, True), (1, 2, "duplicate", "duplicate_content_hash", True), (1, 3, "failed", "parse_failed", True), (1, 4, "included", None, True), (1, 5, "excluded_with_reason", "", None), (2, 1, "included", None, False)], ITEMS)
    spans = spark.createDataFrame(
        [
            (1, 1, 1, "ppt", 3, "included", None, None, None, True),
            (1, 2, 1, "ppt", 3, "included", None, None, None, False),
            (1, 3, 1, "ppt", 4, "included", None, None, None, True),
            (1, 4, 1, "ppt", None, "noise", None, None, None, True),
            (1, 5, 3, "pdf", None, "failed", None, None, None, True),
            (1, 6, 4, "ppt", 9, "duplicate", 1, None, None, True),
            (1, 7, 1, "transcript", None, "included", None, 500, 900, True),
        ],
        SPANS,
    )
    ledger = spark.createDataFrame([(1, 1, UNDERSTOOD, "processed"), (1, 1, UNDERSTOOD, "processed"), (1, 2, UNDERSTOOD, "not_used"), (1, 2, LEGACY, "processed"), (1, 4, UNDERSTOOD, "processed"), (3, 1, UNDERSTOOD, "processed")], LEDGER)
    segments = spark.createDataFrame([(1, "succeeded", True, 4, 3, 10, 1), (1, "failed", False, 0, 0, 0, 0), (1, "succeeded", False, 2, 2, 4, 4)], SEGMENTS)
    got = {r["domain_id"]: r.asDict() for r in coverage_vector(items, spans, ledger, segments).collect()}
    want = {
        "items": 5, "unique_items": 4, "accounted_items": 4, "unaccounted_items": 1, "required": 4, "required_failed": 1, "required_unsupported": 0, "required_excluded": 0, "required_bare": 1, "spans": 7, "canonical": 4, "duplicates": 1, "noise": 1,
        "failed": 1, "planned": 6, "unassigned": 1, "processed": 1, "legacy": 1, "silent": 2, "required_unprocessed": 3, "timeline": 1, "timeline_processed": 0, "start_ms": 500, "end_ms": 900, "pages": 2, "pages_processed": 1, "refs_invalid": 3,
        "segments": 3, "segments_succeeded": 2, "segments_failed": 1, "segments_merged": 1, "structures": 6, "structures_dropped": 1, "ref_rate_min": 0.1, "ref_rate_mean": 0.55, "ref_rate_low": 1, "accounting": 0.8, "semantic": 0.25, "page_rate": 0.5, "merge_rate": 0.333333,
    }
    assert {k: got[1][k] for k in want} == want
    bare = got[2]
    assert (bare["items"], bare["spans"], bare["segments"], bare["accounting"], bare["semantic"], bare["start_ms"], bare["ref_rate_min"]) == (1, 0, 0, 1.0, 0.0, None, None)
    assert coverage_vector(*(df.limit(0) for df in (items, spans, ledger, segments))).collect() == []
