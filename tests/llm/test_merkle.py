import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from marginalia.llm import merkle
from marginalia.llm.merkle import WIDTH, build, document_leaves, proofs, proven_documents
from marginalia.llm.queries import op11_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, for each leaf its runs: (place, run) from the leaf up), level by level."""
    ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for leaf, place in enumerate(at):
            ways[leaf].append((place % 3, runs[place // 3]))
        level, at = [h(*run) for run in runs], [place // 3 for place in at]
    return level[0] if level else None, ways


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, text, lang, source, n: h(*map(field, (d, source, lang, n, text)))
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    each = {s: tree([x[2] for x in sorted(sources[s])]) for s in names}
    root, upper = tree([each[s][0] for s in names])
    out = []
    for s, above in zip(names, upper):
        for (_, _, own, r), way in zip(sorted(sources[s]), each[s][1]):
            levels = way + above
            proof = h(*(d for place, run in levels for i, d in enumerate(run) if i != place))
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                node = leaf(r[0], r[1].replace("\n", ""), *r[2:])
            for place, run in levels:
                node = h(*run[:place], node, *run[place + 1 :])
            out.append((r[0], own, each[s][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    made = op11_merkle_manifest(spark, sf_dir)
    assert made.columns == COLUMNS
    assert got(made) == brute(list(map(tuple, docs.collect())))
    assert {True, False} == {r["verified"] for r in made.collect()}


@pytest.mark.parametrize("width, levels", [(3, 1), (9, 2)])
def test_trees_of_many_sizes_and_rounds(spark, monkeypatch, width, levels):
    monkeypatch.setattr(merkle, "WIDTH", width)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng, rows = random.Random(width), []
    for s, n in enumerate((1, 2, 3, 4, 9, 10, 27, 28, 81, 82, 200)):
        rows += [(rng.randrange(10**6), rng.choice(["a\nb", "plain", "", "é\n"]), None, f"s{s}", i) for i in range(n)]
    rng.shuffle(rows)
    assert got(proven_documents(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_odd_rows_copies_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (None, "x\ny", "de", None, 3), (3, "", "", "", 0), (4, "long " * 40_000 + "\n", "en", "ü", 200_001), (4, "a", "en", "ü", 1), (4, "b", "en", "ü", 1), (-7, "\n", "en", "z", 1), (2**62, "\r\n", "en", "Z", 2)]
    rows += [(9, "again\n", "en", "hot", 6)] * 300 + [(8, None, "en", "hot", None)] * 100
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", leaf string, tree int").repartition(7)
    assert got(proven_documents(docs)) == brute(rows)
    assert got(proven_documents(spark.createDataFrame(rows[3:4], SCHEMA))) == brute(rows[3:4])
    assert proven_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_some_rows_alone_and_other_groups(spark):
    rows = [(i, f"text {i}", "en", "one" if i % 3 else "two", 6) for i in range(2 * WIDTH)]
    manifest = build(document_leaves(spark.createDataFrame(rows, SCHEMA)), "source", ["doc_id", "digest"])
    asked = manifest.leaves.filter(F.col("doc_id").isin(5, 6, 7))
    want = {r[0]: r for r in brute(rows)}
    made = proofs(manifest, asked, ["doc_id"]).collect()
    assert {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], r["proof"]) for r in made} == {i: want[i][1:5] for i in (5, 6, 7)}
    assert all(r["folded"] == r["root"] for r in made)
    once = [r["n"] for b in (*manifest.blocks, *manifest.top) for r in b.groupBy("digest").agg(F.count("*").alias("n")).collect()]
    assert set(once) == {1}
    assert proofs(manifest, manifest.leaves.limit(0), ["doc_id"]).collect() == []
