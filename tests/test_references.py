import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators.references import Reference, delete_cascade, orphans, project_units

MADE = "run_id long, number long, domain_id long, scope long, key string, topic string, kind string, summary string, emphasis double, refs array<string>"
UNITS = "unit_id long, scope long, key string, topic string, kind string, summary string, emphasis double"


def test_deletes_follow_references_through_circles(spark):
    drawn = random.Random(2)
    people = [(i, drawn.choice([None, *range(60)])) for i in range(60)]
    notes = [(drawn.choice([None, *range(70)]), drawn.choice([None, *range(60)]), "clash") for _ in range(300)]
    tables = {"people": spark.createDataFrame(people, "id long, boss long"), "notes": spark.createDataFrame(notes, "owner long, reader long, _key string")}
    refs = [Reference("people", "boss", "people"), Reference("notes", "owner", "people"), Reference("notes", "reader", "people", "clear")]
    gone = {3, 11}
    while more := {i for i, boss in people if boss in gone} - gone:
        gone |= more
    left = delete_cascade(tables, {"people": "id"}, refs, {"people": spark.createDataFrame([(3,), (11,), (11,), (None,)], "id long")})
    assert sorted(r["id"] for r in left["people"].collect()) == sorted({i for i, _ in people} - gone)
    want = sorted([(o, None if r in gone else r, k) for o, r, k in notes if o not in gone], key=repr)
    assert sorted(map(tuple, left["notes"].collect()), key=repr) == want
    assert left["notes"].columns == ["owner", "reader", "_key"]
    before = {r["column"]: r["n"] for r in orphans(tables, {"people": "id"}, refs).collect()}
    after = {r["column"]: r["n"] for r in orphans(left, {"people": "id"}, refs).collect()}
    assert before["owner"] == sum(o is not None and o >= 60 for o, _, _ in notes) == after["owner"] and after["boss"] == after["reader"] == 0


def test_restricted_and_empty_deletes(spark):
    tables = {"a": spark.createDataFrame([(1,), (2,)], "id long"), "b": spark.createDataFrame([(1,), (None,)], "a long")}
    refs = [Reference("b", "a", "a", "restrict")]
    with pytest.raises(ValueError, match="b.a"):
        delete_cascade(tables, {"a": "id"}, refs, {"a": tables["a"].filter("id = 1")})
    left = delete_cascade(tables, {"a": "id"}, refs, {"a": tables["a"].filter("id = 2")})
    assert left["a"].collect() == [(1,)] and left["b"].count() == 2
    none = delete_cascade({t: df.limit(0) for t, df in tables.items()}, {"a": "id"}, refs, {"a": tables["a"].limit(0)})
    assert [df.count() for df in none.values()] == [0, 0]


def test_a_long_way_of_references_takes_few_rounds_when_nothing_is_doomed(spark):
    table = spark.createDataFrame([(i, i - 1 if i else None) for i in range(12)], "id long, up long")
    refs = [Reference("t", "up", "t")]
    assert delete_cascade({"t": table}, {"t": "id"}, refs, {"t": table.filter("id = 4")})["t"].count() == 4
    assert delete_cascade({"t": table}, {"t": "id"}, refs, {"t": table.filter("id = 99")})["t"].count() == 12


def test_projected_units_keep_ids_and_relink(spark):
    units = spark.createDataFrame([(5, 1, "a", "old", "term", "s", 0.1), (9, None, "b", "old", "term", "s", 0.1), (7, 2, "c", "stays", "term", "s", 0.1)], UNITS)
    links = spark.createDataFrame([(5, 100), (5, 101), (7, 102), (9, 103)], "unit_id long, span_id long")
    spans = spark.createDataFrame([(1, "T1", 11), (1, "T2", 12), (2, "T1", 21), (3, "T9", 39)], "domain_id long, source_id string, span_id long")
    made = spark.createDataFrame([
        (1, 1, 1, 1, "a", "first", "x", "", 0.2, ["T2"]), (1, 2, 1, 1, "a", "second", "", None, None, ["T1", "T9", None, "T1"]),
        (2, 1, 2, None, "b", None, None, "t", 0.3, ["T1", "T2"]), (2, 2, 2, None, None, "n", "k", "t", 0.4, None), (3, 1, 3, 4, "z", "n", "k", "t", 0.4, []),
    ], MADE)
    once, linked = project_units(made, units, links, spans)
    got = {r["unit_id"]: tuple(r)[1:] for r in once.collect()}
    assert got == {5: (1, "a", "second", "concept", "", 0.0), 9: (None, "b", "", "concept", "t", 0.3), 7: (2, "c", "stays", "term", "s", 0.1), 10: (None, "KU-0002", "n", "k", "t", 0.4), 11: (4, "z", "n", "k", "t", 0.4)}
    assert sorted(map(tuple, linked.collect())) == [(5, 11), (7, 102), (9, 21)]
    again, relinked = project_units(made, once, linked, spans)
    assert {r["unit_id"]: tuple(r)[1:] for r in again.collect()} == got and sorted(map(tuple, relinked.collect())) == [(5, 11), (7, 102), (9, 21)]
    empty = project_units(made, units.limit(0), links.limit(0), spans.limit(0))
    assert sorted(r["unit_id"] for r in empty[0].collect()) == [1, 2, 3, 4] and empty[1].count() == 0
    same = project_units(made.limit(0), units, links, spans)
    assert same[0].count() == 3 and same[1].count() == 4
