import pytest
from pyspark.sql import functions as F

from marginalia.operators.domain import domain_members, source_map
from marginalia.operators.windows import group_ordinals
from marginalia.sources import commits

MATERIALS = "domain_id long, position long, material_id long, kind string, locator string, status string, error string, text string, extra int, ordinal string"
CHUNKS = "domain_id long, material_id long, place int, locator string, text string"


def members_of(spark, rows, said=()):
    made = spark.createDataFrame([(*r, 1, "x") for r in rows], MATERIALS).repartition(3)
    return domain_members(made, spark.createDataFrame(list(said), "domain_id long, text string"))


ROWS = [
    (1, 2, 11, "pdf", "a", "ready", None, "Same\r\ntext"),
    (1, 1, 10, "pdf", "b", "ready", None, "same text"),
    (1, 3, 12, "pdf", "c", "ready", None, " Same \n text"),
    (1, 4, 12, "pdf", "c", "ready", None, " Same \n text"),  # named again
    (1, 5, 13, "text", "d", "ready", None, "Same\ntext"),  # another kind
    (1, 6, 14, "image", "e", "ready", None, "x"),
    (1, 7, 15, "pdf", "f", "failed", None, None),
    (1, 8, 16, None, "g", "ready", None, ""),
    (1, 9, 17, "transcript", "h", "ready", None, "hello"),
    (2, 1, 11, "pdf", "a", "needs_ocr", None, "Same\ntext"),
    (None, 1, 1, "pdf", "", "", None, ""),
    (2, 1, None, "pdf", "", "", None, ""),
]


def test_members_are_numbered_once_and_copies_point_to_the_first(spark):
    made = {(r["domain_id"], r["ordinal"]): r for r in members_of(spark, ROWS, [(1, "hello"), (2, " "), (3, "alone"), (None, "x")]).collect()}
    of = lambda r: (r["material_id"], r["state"], r["reason"], r["canonical_ordinal"])
    assert {k: of(r) for k, r in made.items()} == {
        (1, 1): (10, "included", None, None),
        (1, 2): (11, "included", None, None),
        (1, 3): (12, "duplicate", "duplicate_content_hash", 2),
        (1, 4): (13, "included", None, None),
        (1, 5): (14, "unsupported", "unsupported_file_type", None),
        (1, 6): (15, "failed", "parse_failed", None),
        (1, 7): (16, "unsupported", "unsupported_file_type", None),
        (1, 8): (17, "included", None, None),
        (1, 9): (None, "duplicate", "duplicate_content_hash", 8),
        (2, 1): (11, "unsupported", "unsupported_parse_state", None),
        (3, 1): (None, "included", None, None),
    }
    assert members_of(spark, []).collect() == []


def test_source_map_numbers_pages_sequences_and_ended_items(spark):
    members = members_of(spark, ROWS, [(1, "hi there"), (3, "alone")])
    chunks = spark.createDataFrame([(1, 10, 0, "page:3", "First"), (1, 10, 1, "page:3", " First "), (1, 10, 2, "page:4", "N/A"), (1, 11, 0, "page:3", "First"), (1, 13, 0, "body", "First"), (1, 13, 1, None, None), (1, 17, 0, "cue:1", "again"), (1, 17, 1, "cue:2", "again"), (1, 15, 0, "page:1", "never read")], CHUNKS)
    statuses = spark.createDataFrame([(1, 12, "parsing"), (1, 16, "ready")], "domain_id long, material_id long, status string")
    cues = spark.createDataFrame([(1, 0, "cue:1", "again"), (3, 0, "cue:1", "alone")], "domain_id long, place int, locator string, text string")
    made = source_map(members, chunks, statuses, cues).orderBy("domain_id", "ordinal").collect()
    assert [(r["domain_id"], r["ordinal"], r["source_id"], r["state"], r["reason"], r["canonical_ordinal"]) for r in made] == [
        (1, 1, "D0003.01", "included", None, None),
        (1, 2, "D0003.02", "duplicate", "duplicate_content_hash", 1),
        (1, 3, "D0004.01", "noise", "noise_placeholder", None),
        (1, 4, "D0003.03", "duplicate", "duplicate_content_hash", 1),
        (1, 5, "S000001", "excluded_with_reason", "failed_parse", None),
        (1, 6, "T000001", "included", None, None),
        (1, 7, "T000002", "noise", "noise_empty", None),
        (1, 8, "S000002", "unsupported", "unsupported_file_type", None),
        (1, 9, "S000003", "failed", "failed_parse", None),
        (1, 10, "T000006", "unsupported", "unsupported_file_type", None),
        (1, 11, "T000003", "included", None, None),
        (1, 12, "T000004", "included", None, None),
        (1, 13, "T000005", "included", None, None),
        (2, 1, "S000001", "unsupported", "unsupported_file_type", None),
        (3, 1, "T000001", "included", None, None),
    ]


def test_ordinals_of_one_hot_group(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("p"), F.when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.least(F.col("id") % 4, F.lit(1))).alias("g"), (-F.col("id")).alias("o"))
    made = group_ordinals(df, ["g"], ["o"])
    groups = {}
    for r in made.collect():
        groups.setdefault(r["g"], []).append((r["o"], r["ordinal"]))
    assert len(groups) == 3
    for rows in groups.values():
        assert [n for _, n in sorted(rows)] == list(range(1, len(rows) + 1))


def frame(spark, rows):
    return spark.createDataFrame(rows, "domain long, value string")


def test_freezing_is_repeatable_and_conflicts_write_nothing(spark, tmp_path):
    base = str(tmp_path / "frozen")
    assert commits.frozen_hashes(spark, base) is None
    rows = [(1, "a"), (1, "b"), (2, None), (2, "c")]
    assert commits.freeze({"members": frame(spark, rows)}, base, "domain") == {"new": 2, "kept": 0}
    assert commits.freeze({"members": frame(spark, rows[::-1]).repartition(3)}, base, "domain") == {"new": 0, "kept": 2}
    assert commits.freeze({"members": frame(spark, rows[:2] + [(3, "z")])}, base, "domain") == {"new": 1, "kept": 1}
    for changed in ([(1, "a"), (1, "B")], [(1, "a")], [(1, "a"), (1, "b"), (1, "b")]):
        with pytest.raises(commits.FrozenConflict):
            commits.freeze({"members": frame(spark, changed + [(4, "new")])}, base, "domain")
    assert sorted(map(tuple, commits.frozen_rows(spark, base, "members").collect()), key=repr) == sorted(rows + [(3, "z")], key=repr)
    assert sorted(p.name[:6] for p in (tmp_path / "frozen").iterdir()) == ["batch-", "batch-"]


def test_a_job_that_fails_midway_leaves_readers_with_the_old(spark, tmp_path):
    base = str(tmp_path / "frozen")
    claims = lambda rows: spark.createDataFrame(rows, "domain long, claim string")
    commits.freeze({"members": frame(spark, [(1, "a")]), "claims": claims([(1, "x"), (9, "no such member")])}, base, "domain")
    broken = claims([(2, "y")]).select("domain", F.raise_error(F.lit("lost")).cast("string").alias("claim"))
    with pytest.raises(Exception, match="lost"):
        commits.freeze({"members": frame(spark, [(2, "b")]), "claims": broken}, base, "domain")
    assert [tuple(r) for r in commits.frozen_rows(spark, base, "members").collect()] == [(1, "a")]
    assert [tuple(r) for r in commits.frozen_rows(spark, base, "claims").collect()] == [(1, "x")]
    commits.freeze({"members": frame(spark, [(2, "b")]), "claims": claims([(2, "y")])}, base, "domain")
    assert commits.frozen_rows(spark, base, "claims").count() == 2


def test_a_calendar_is_seeded_once(spark, tmp_path):
    base = str(tmp_path / "calendar")
    rows = [(1, "2024-02-26", [("exam", 2, 3), ("exam", 2, 3), ("late", 0, 1), ("odd", 1, 8)]), (2, None, [("exam", 1, 1)]), (3, "2024-02-26", [("start", 1, 1)]), (4, "2024-02-26", [])]
    courses = spark.createDataFrame(rows, "course_id long, start string, events array<struct<name: string, week: int, weekday: int>>")
    seeds = commits.seeded_calendar(courses)
    assert commits.bootstrap(seeds, base, "event_id") and not commits.bootstrap(seeds, base, "event_id")
    assert not commits.bootstrap(seeds.withColumn("name", F.lit("other")), base, "event_id")
    got = sorted((r["course_id"], r["name"], str(r["date"])) for r in commits.current_rows(spark, base, "rows", "event_id").collect())
    assert got == [(1, "exam", "2024-03-06"), (3, "start", "2024-02-26")]
