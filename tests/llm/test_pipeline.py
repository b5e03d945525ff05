import corpus_pipeline
from marginalia.llm.secret_scan import automaton, scan_text
from tests.llm.test_jaccard_join import brute_force, shingles
from tests.llm.test_packing import check


def test_stages_on_whole_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages, states = dict(corpus_pipeline.STAGES), [docs]
    assert list(stages) == ["quality", "near_duplicates", "secrets", "packing"]
    for name in list(stages)[:-1]:
        states.append(stages[name](spark, states[-1], sf_dir).cache())
        assert states[-1].columns == docs.columns
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} for s in states]

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = [q for d, q in labels.items() if d in texts[1]]
    assert sum(kept) >= 0.95 * sum(labels.values()) and kept.count(0) <= 0.3 * list(labels.values()).count(0)

    roots = {d: root for d, _, root in brute_force(sorted(texts[1].items()), 5, 80)}
    assert sorted(texts[2]) == sorted(set(roots.values()))
    assert all(shingles(texts[2][d], 5) == shingles(texts[1][d], 5) for d in texts[2])

    words = automaton()
    assert sorted(texts[3]) == sorted(texts[2])
    assert all((texts[3][d] == texts[2][d]) == (not scan_text(texts[2][d], words)) for d in texts[2])
    assert all(r["n_chars"] == len(r["text"]) for r in states[3].collect())

    used, least = check(sorted(texts[3].items()), stages["packing"](spark, states[3], sf_dir).collect(), 1024)
    assert used <= least * 1.02 + 1
    assert corpus_pipeline.run(spark, sf_dir).count() == stages["packing"](spark, states[3], sf_dir).count()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"w{i}" for i in range(40))


def odd_documents(spark):
    secret = "api_key = AbCdEf123456"
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n", "en", "a", 2), (None, WORDS, "en", "a", 7),
        (5, WORDS, "en", "b", 7), (5, WORDS, "en", "a", 7), (5, "other words", "en", "a", 7), (6, WORDS, None, "a", 7),
        (7, WORDS + " one more", "en", "a", 7), (8, secret, "en", "a", 1), (8, secret, "en", "a", 1), (9, "x " * 60_000, "en", "a", None),
    ]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def test_stages_over_odd_rows(spark, sf_dir):
    docs, stages = odd_documents(spark), dict(corpus_pipeline.STAGES)
    once = stages["quality"](spark, docs, sf_dir)
    assert once.columns == docs.columns
    kept = sorted(map(repr, once.collect()))
    assert kept == sorted(map(repr, stages["quality"](spark, docs.repartition(1), sf_dir).collect())) and len(kept) <= 12

    near = sorted(((r["doc_id"], r["text"], r["source"]) for r in stages["near_duplicates"](spark, docs, sf_dir).collect()), key=repr)
    assert [(d, s) for d, _, s in near] == [(1, None), (2, "a"), (3, "a"), (5, "a"), (8, "a"), (9, "a"), (None, "a")]
    assert {d: t for d, t, _ in near}[5] == "other words"

    clean = stages["secrets"](spark, docs, sf_dir)
    assert clean.columns == docs.columns and clean.count() == 12
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert texts[1][0] is None and texts[2] == ("", 0) and "AbCdEf123456" not in texts[8][0] and texts[9] == ("x " * 60_000, 120_000)

    packed = stages["packing"](spark, docs, sf_dir).collect()
    assert max(r["length"] for r in packed) <= 1024 and {r["doc_id"] for r in packed} == {1, 2, 3, None, 5, 6, 7, 8, 9}
    assert [r["length"] for r in packed if r["doc_id"] in (1, 2)] == [1, 1]
    held = {}
    for r in packed:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:i]) for i in range(len(v))] for v in held.values())


def test_stages_over_empty_and_wider_tables(spark, sf_dir):
    empty = odd_documents(spark).filter("false")
    wide = odd_documents(spark).selectExpr("*", "1 AS class", "'x' AS component_id", "2 AS label", "3 AS vector", "4 AS score")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        got = stage(spark, wide, sf_dir)
        assert got.count() and (name == "packing" or got.columns == wide.columns)
