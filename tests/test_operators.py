import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions.json_text import first_json
from marginalia.operators import chunking as ch
from marginalia import plans
from marginalia.plans import application
from marginalia.operators import dedup, folds, graph, retrieval, rules, sorted_runs
from marginalia.operators import relational as op
from marginalia.operators import windows as wn
from marginalia.sources import files
from marginalia.streaming import events as ev


def test_cues_of_all_styles(spark):
    text = "intro\n\n[00:05]\nfirst\nline\n00:00:10 --> 00:00:12.5 second\n00:08 back in time\n1:00:00 late"
    df = spark.createDataFrame([(1, text), (2, "no times\nat all"), (3, ""), (4, None)], "id long, t string")
    got = [tuple(r) for r in ch.parse_cues(df, "id", F.col("t")).orderBy("id", "cue").collect()]
    assert got == [
        (1, 0, None, None, "intro"),
        (1, 1, 5000, 10000, "first line"),
        (1, 2, 10000, 12500, "second"),
        (1, 3, 12500, 3600000, "back in time"),
        (1, 4, 3600000, 3630000, "late"),
        (2, 0, None, None, "no times at all"),
    ]


def test_packing_of_sentences(spark):
    df = spark.createDataFrame([("One two. Three! Four five six? " + "x" * 30,)], "t string")
    assert df.select(ch.packed(ch.sentences(F.col("t")), 16)).first()[0] == ["One two. Three!", "Four five six?", "x" * 30]
    assert df.select(ch.split_cue(F.col("t"), 16)).first()[0] == ["One two. Three!", "Four five six?", "x" * 16, "x" * 14]


def test_folds(spark):
    rows = [("a", i + 1, t, c) for i, (t, c) in enumerate([(30, 300), (80, 1200), (200, 2000), (10, 900), (70, 100)])]
    df = spark.createDataFrame(rows, "domain_id string, ordinal long, tokens long, chars long")
    assert [r["segment"] for r in folds.budget_segments(df, 100).orderBy("ordinal").collect()] == [1, 2, None, 2, 3]
    assert [r["batch"] for r in folds.unit_batches(df, 100, 2).orderBy("ordinal").collect()] == [1, 2, 3, 4, 4]
    assert [r["status"] for r in folds.excerpts(df, 3, 2000, 400).orderBy("ordinal").collect()] == ["sent", "truncated", "char_budget_exceeded", "char_budget_exceeded", "sent"]
    wide = df.withColumns({"preferred": F.col("ordinal") == 4, "boundary": F.lit(False)})
    assert [r["segment"] for r in folds.planned_segments(wide, 250).orderBy("ordinal").collect()] == [1, 1, 2, 3, 3]
    with pytest.raises(Exception, match="over the segment capacity"):
        folds.planned_segments(wide, 150).collect()


def test_ordinals_and_ranges(spark):
    ids = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    got = {r["id"]: r["ordinal"] for r in wn.dense_ordinal(df, "id").collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(ids))}
    ranges = spark.createDataFrame([(1, 10, 300), (2, 250, 900), (3, 5, 5)], "r long, a long, b long")
    met = op.range_join(df, ranges, "id", "a", "b", 100).select("id", "r").collect()
    assert sorted(map(tuple, met)) == sorted((i, r) for i in ids for r, a, b in [(1, 10, 300), (2, 250, 900), (3, 5, 5)] if a <= i <= b)


def test_prefix_containment(spark):
    base = "the quick brown fox " * 10
    df = spark.createDataFrame([(1, base + "tail"), (2, base), (3, base.upper()), (4, "short"), (5, "x" + base), (6, None)], "id long, t string")
    assert sorted(map(tuple, dedup.prefix_contained(df, "id", F.col("t")).collect())) == [(2, 1), (3, 1)]
    assert dedup.prefix_contained(df.limit(0), "id", F.col("t")).count() == 0
    kinds = df.withColumn("k", F.when(F.col("id") != 2, "x")).unionByName(df.filter("id = 2").withColumn("id", F.lit(7)).withColumn("k", F.lit("y")))
    assert sorted(map(tuple, dedup.prefix_contained(kinds, "id", F.col("t"), kind="k").collect())) == [(3, "x", 1)]


def test_prefix_runs_over_many_ranges(spark):
    """Texts of two letters after one head, so that runs nest, cover whole ranges and end inside them."""
    drawn = random.Random(8)
    texts = sorted({b"h" * 5 + bytes(drawn.choice(b"ab") for _ in range(drawn.randint(0, 9))) for _ in range(500)} | {"hhhhh\u00e9".encode(), "hhhhh\u00e9\U0001f600".encode()})
    ids = drawn.sample(range(10_000), len(texts))
    df = spark.createDataFrame([(bytearray(t), bytearray(t[::-1]), i) for t, i in zip(texts, ids)], "text binary, hash binary, first long").repartition(5)
    want = {}
    for t, i in zip(texts, ids):
        inside = [j for u, j in zip(texts, ids) if u != t and u.startswith(t) and j < i]
        if inside:
            want[t[::-1]] = min(inside)
    for ranges in (1, 3, 40, 300):
        got = [(bytes(r["hash"]), r["best"]) for r in sorted_runs.least_in_runs(df, ranges).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_prefix_containment_of_one_head_is_no_square(spark):
    """40,000 texts of one head: as pairs they would be 1.6 billion."""
    df = spark.range(40_000).select("id", F.concat(F.lit("licence " * 40), F.sha2(F.col("id").cast("string"), 256), F.when(F.col("id") % 100 == 0, F.lit("")).otherwise("more")).alias("t"))
    more = df.unionByName(df.filter("id % 1000 = 500").select((F.col("id") + 100_000).alias("id"), F.substring("t", 1, 370).alias("t")))
    got = dict(map(tuple, dedup.prefix_contained(more, "id", F.col("t")).collect()))
    assert got == {i + 100_000: i for i in range(500, 40_000, 1000)}


def test_layers_refuse_cycles_and_gaps(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    chain = spark.createDataFrame([(2, 1), (3, 2), (3, 1)], "node long, needs long")
    assert sorted(map(tuple, graph.layers(nodes, chain).collect())) == [(1, 0), (2, 1), (3, 2)]
    for bad in ([(1, 2), (2, 1)], [(1, 9)]):
        with pytest.raises(ValueError):
            graph.layers(nodes, spark.createDataFrame(bad, "node long, needs long"))


def test_json_from_noise():
    assert first_json('say {"a": "}\\"", "b": [1, 2,]} end') == '{"a":"}\\"","b":[1,2]}'
    assert first_json("```json\n[1]\n```") == "[1]" and first_json("{") is None and first_json(None) is None
    assert first_json('x [note] then {"a":1}') == '{"a":1}' and first_json('{"a":1} and more') == '{"a":1}'
    assert first_json('```json\n{"b": [1,2,],}\n') == '{"b":[1,2]}' and first_json('<thinking>{"z":1}</thinking>[3]') == "[3]"
    assert first_json('[1, {"a":2}') == '{"a":2}' and first_json("[" * 100_000) is None


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("00:00:01 hi\nthere")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in" / "c.pdf").write_bytes(b"nope")
    (tmp_path / "in" / "d.json").write_text('{"courses": [{"name": "x", "code": "1"}, {"name": "y"}]}')
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["state"]) for r in files.ingest(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.srt": ("transcript", "parsing"), "b.pdf": ("pdf", "parsing"), "c.pdf": ("pdf", "wrong_content"), "d.json": ("unknown", "unsupported")}
    cues = files.read_transcripts(spark, str(tmp_path / "in" / "a.srt")).select("cue", "start_ms", "text").collect()
    assert [tuple(c) for c in cues] == [(1, 1000, "hi there")]
    rows = files.read_json_lists(spark, str(tmp_path / "in" / "d.json"), "courses", "struct<name: string, code: string>").collect()
    assert sorted((r["name"], r["code"]) for r in rows) == [("x", "1"), ("y", None)]
    calls = spark.createDataFrame([(1, "secret prompt")], "id long, prompt string")
    files.append_audit(calls, str(tmp_path / "audit"), "prompt", "id")
    files.append_audit(calls, str(tmp_path / "audit"), "prompt", "id")
    assert spark.read.parquet(str(tmp_path / "audit")).select("id", "chars").collect() == [(1, 13)] * 2
    notes = files.vault_notes(calls.withColumn("title", F.lit("a: b")), "id", "title", "prompt")
    files.write_vault(notes, str(tmp_path / "vault"))
    assert notes.first()["file_name"] == "a_ b-N000001.md"
    target = spark.createDataFrame([], "prompt string, id int, other int")
    assert files.copy_common(calls, target).dtypes == [("prompt", "string"), ("id", "int")]


def test_streams_end_and_merge(spark, sf_dir):
    stream = ev.event_stream(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert ev.run_updates(ev.tumbling(stream, "1 day"), ["start_us", "event_type"]).agg(F.sum("n")).first()[0] == n
    assert ev.run_updates(ev.lease_state(stream), ["user_id"]).agg(F.sum("tasks")).first()[0] == n


def test_refit(spark):
    rows = [("a", 1, o, t, v) for o, t, v in [(1, 40, True), (2, 50, False), (3, 60, False), (4, 10, False)]] + [("a", 2, 5, 20, False)]
    df = spark.createDataFrame(rows, "domain_id string, segment long, ordinal long, tokens long, overlap boolean")
    got = sorted((r["segment"], r["ordinal"]) for r in folds.refit_segments(df, 70).collect())
    sums = {}
    for segment, ordinal in got:
        sums[segment] = sums.get(segment, 0) + {2: 50, 3: 60, 4: 10, 5: 20}[ordinal]
    assert max(sums.values()) <= 70 and [g[1] for g in got] == [2, 3, 4, 5]
    with pytest.raises(Exception, match="over the budget"):
        folds.refit_segments(df, 30).collect()


def test_every_query_vector_in_blocks(spark):
    drawn = random.Random(3)
    rows = [(i, [drawn.choice([-1.0, 0.5, 2.0]) for _ in range(3 if i % 9 else 2)]) for i in range(90)] + [(90, []), (91, None), (92, [1.0, None, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    queries = df.filter("id % 20 = 0")

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a + b:
            return 0.0
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5 + 1e-9)

    want = {(q, n + 1, i) for q, a in rows if q % 20 == 0 for n, (_, i) in enumerate(sorted((-round(cosine(a, b), 9), i) for i, b in rows if i != q)[:7])}
    for block in (8, 2048):
        assert {(r["query_id"], r["rank"], r["id"]) for r in retrieval.cosine_best(df, queries, "id", "v", 7, block).collect()} == want
    assert {r["query_id"] for r in retrieval.cosine_scores(df, queries, "id", "v").collect()} == {0, 20, 40, 60, 80}
    scored = retrieval.cosine_scores(df, queries, "id", "v")
    assert scored.count() == 5 * len(rows)
    assert {r["query_id"]: r["n"] for r in retrieval.two_stage(scored, "id", F.col("id"), 3, "query_id").groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {q: 3 for q in (0, 20, 40, 60, 80)}


def test_bm25_counts_terms_beyond_the_fifth(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = plans.QUERIES["bm25_topk_whole"](spark, sf_dir).filter("rank = 1").collect()
    said = {r["doc_id"]: re.findall("[a-z0-9]+", r["text"].lower()) for r in docs.collect()}
    asked = {r["item_id"]: re.findall("[a-z0-9]+", r["text"].lower()) for r in items.collect()}
    n, mean = len(said), sum(map(len, said.values())) / len(said)
    df = {t: sum(t in s for s in map(set, said.values())) for t in {t for a in asked.values() for t in a}}
    for r in got[:5]:
        words = said[r["doc_id"]]
        score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * words.count(t) * 2.5 / (words.count(t) + 1.5 * (0.25 + 0.75 * len(words) / mean)) for t in asked[r["item_id"]])
        assert r["score"] == pytest.approx(score, abs=2e-6)


def test_rebuild_sees_edits_of_equal_length(spark):
    old = [(1, "a", "abc"), (2, "a", "de"), (3, "b", "abc"), (4, "b", "x"), (5, "c", "same"), (6, "c", ""), (8, "e", None)]
    new = [(2, "a", "ed"), (1, "a", "abc"), (3, "b", "ab"), (4, "b", "xy"), (6, "c", ""), (5, "c", "same"), (7, "d", "new"), (8, "e", "")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["source"]: (r["action"], r["n"]) for r in application._rebuild(frame(old), frame(new)).collect()}
    assert got == {"a": ("rebuild", 2), "b": ("rebuild", 2), "c": ("reuse", 2), "d": ("build", 1), "e": ("rebuild", 1)}


def test_postings_keep_rare_terms_and_ideographs(spark, tmp_path):
    rows = [(1, "Once twice twice 中文中"), (2, "twice")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, plans.QUERIES["postings_whole"](spark, str(tmp_path)).select("term", "doc_id", "tf").collect()))
    assert got == [("once", 1, 1), ("twice", 1, 2), ("twice", 2, 1), ("中", 1, 2), ("文", 1, 1)]


def test_streams_of_folders_in_any_order(spark, tmp_path):
    day = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i)
    rows = [(i, day(i * 37 % 100), i % 5, "x", 1.0) for i in range(100)]
    for i in range(0, 100, 10):  # files come in the order they were written
        spark.createDataFrame(rows[i : i + 10], "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    late = spark.createDataFrame([(100, day(-300), 9, "x", 1.0)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = lambda: ev.event_stream(spark, str(tmp_path), files_a_batch=3)
    assert ev.run_updates(ev.tumbling(stream(), "1 day"), ["start_us", "event_type"]).agg(F.sum("n")).first()[0] == 101
    assert ev.run_updates(ev.sliding(stream(), "12 hours", "6 hours"), ["start_us"]).agg(F.sum("n")).first()[0] == 202
    assert sorted(r["user_id"] for r in ev.run_updates(ev.first_of_key(stream(), "user_id"), [], "append").collect()) == [0, 1, 2, 3, 4, 9]
    assert ev.run_updates(ev.ledger(stream()), ["user_id", "event_type"]).count() == 6
    assert ev.run_updates(ev.lease_spans(stream(), "100 days"), [], "complete").count() == 6


def test_streams_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_tumbling", "stream_sliding", "stream_enqueue_once", "stream_lease_state", "stream_lease_spans", "stream_ledger"):
        assert plans.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_boundary_rules_one_by_one(spark):
    spans = [(i, o, 100) for i in range(9) for o in range(1, 9)] + [(9, 1, 5)]
    plans_ = {  # units, breaks, what they break
        0: ([(1, 4), (5, 8)], [4], ("", "")), 1: ([(1, 4), (6, 8)], [4], ("H2", "")), 2: ([(2, 4), (5, 8)], [4], ("H3", "")), 3: ([(1, 4), (5, 8)], [3], ("H4,H6", "")),
        4: ([(1, 4), (5, 8)], [4, 8], ("H5", "")), 5: ([(1, 2), (3, 4), (5, 8)], [4], ("", "L1")), 6: ([(1, 4), (5, 8)], [], ("", "L3,L4")), 7: ([(1, 8)], [], ("", "L3")), 8: ([(1, 4), (8, 5)], [4, 4], ("H1,H2,H3,H4", "L1")),
    }
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    units = frame([(i, a, b) for i, (us, _, _) in plans_.items() for a, b in us], "domain_id long, a long, b long")
    breaks = frame([(i, at) for i, (_, bs, _) in plans_.items() for at in bs], "domain_id long, at long")
    got = {r["domain_id"]: r for r in rules.boundary_report(frame(spans, "domain_id long, ordinal long, tokens long"), units, breaks, 500, least=3, ratio=0.3).collect()}
    assert {i: (got[i]["hard"], got[i]["soft"]) for i in plans_} == {i: want for i, (_, _, want) in plans_.items()}
    assert got[7]["oversized"] == 1 and got[0]["oversized"] == 0 and got[9]["hard"] == "H0"
    assert {i: got[i]["status"] for i in (0, 1, 5)} == {0: "succeeded", 1: "rejected", 5: "low_quality"}


def test_gates_of_domains_without_numbers(spark):
    names = ("silent", "required_failed", "required_unsupported", "required_bare", "unassigned", "canonical", "required_unprocessed", "refs_invalid", "segments_failed", "segments", "segments_merged", "structures_dropped")
    one = lambda **set_: spark.range(1).select(*[F.lit(set_.get(n, 0)).alias(n) for n in names], F.lit(set_.get("accounting", 1.0)).alias("accounting"), F.lit(set_.get("semantic", 1.0)).alias("semantic"))
    gate = lambda **set_: tuple(rules.whole_gate(one(**set_)).select("gate", "reasons").first())
    assert gate(canonical=3) == ("passed", "") and gate() == ("degraded", "canonical_non_noise_spans")
    assert gate(canonical=3, semantic=0.5, segments=2, segments_merged=1) == ("degraded", "semantic_processing_rate,merge")
    assert gate(canonical=3, semantic=0.5, unassigned=1, accounting=0.9) == ("failed", "domain_accounting_rate,unassigned_count")
    assert gate(accounting=None, semantic=None, canonical=None)[0] == "failed"


def test_postings_leave_no_row_and_repeated_ids_are_added_up(spark):
    from marginalia.operators.retrieval import postings

    rows = [(1, "One one İ two 漢漢 x"), (2, None), (3, ""), (4, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = postings(docs, "doc_id", F.col("text"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.collect())) == [("one", 1, 2), ("one", 4, 1), ("two", 1, 1), ("x", 1, 1), ("漢", 1, 2)]
    again = postings(docs.union(docs.filter("doc_id = 4")), "doc_id", F.col("text"))
    assert sorted(map(tuple, again.filter("term = 'one'").collect())) == [("one", 1, 2), ("one", 4, 2)]


def test_layers_send_no_side_of_a_join_through_the_driver(spark, monkeypatch):
    from marginalia.operators import graph

    plans, plain = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    nodes = spark.range(1, 40).withColumnRenamed("id", "node")
    made = graph.layers(nodes, nodes.filter("node > 1").selectExpr("node", "node div 2 AS needs"))
    assert made.agg(F.max("layer")).first()[0] == 5 and made.count() == 39
    assert plans and not any("Broadcast" in p for p in plans)


def test_hashed_vectors_of_nulls_and_any_characters(spark):
    from marginalia.functions import vectors

    rows = [(0, "ü光"), (1, None), (2, ""), (3, "ü光")]
    made = dict(map(tuple, spark.createDataFrame(rows, "i int, t string").coalesce(1).select("i", vectors.hashed_vector(F.col("t"), 10)).collect()))
    assert made[1] is None and made[0] == made[3] != made[2]
    assert made[0] == vectors.text_vector("ü光".encode(), 10, b"marginalia").tolist() and abs(sum(x * x for x in made[2]) - 1) < 1e-12
