import hashlib
import random

import numpy as np
import pyarrow as pa

from marginalia.llm.fingerprint import Fingerprinter, compare_with_edited, edited_text, fingerprint_documents
from marginalia.llm.shingles import row_shingles, word_hashes


def likeness(a, b):
    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_exact_likeness(spark, sf_dir):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, range string, after int").repartition(5)
    got = {r["doc_id"]: r for r in compare_with_edited(df).collect()}
    assert len(got) == len(rows)
    off = []
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        edited, r = edited_text(text, following), got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        off.append((r["near_edited"] - likeness(text, edited), r["near_next"] - likeness(text, following)))
    assert np.abs(off).mean() < 0.02 and np.abs(np.mean(off, axis=0)).max() < 0.01


def test_edges(spark):
    rows = [(1, None), (5, "é" * 9), (3, ""), (7, "a b c d e f g"), (9, "a b c d e f g"), (9, "a b c d e f g"), (None, "z"), (11, "w " * 60_000)]
    got = sorted(((r["doc_id"], r["n_chars"], r["near_next"]), r["fingerprint"]) for r in compare_with_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert [g[0] for g in got] == [(1, 0, 1.0), (3, 0, 0.0), (5, 9, 0.0), (7, 13, 1.0), (9, 13, 0.0), (9, 13, 1.0), (11, 120_000, 0.0)]
    assert got[3][1] == got[4][1] == got[5][1] and got[0][1] == ""
    one = compare_with_edited(spark.createDataFrame([(4, "only one text")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0
    for f in (compare_with_edited, fingerprint_documents):
        assert f(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimates_are_unbiased_for_long_and_short_sets():
    rng, own = random.Random(1), Fingerprinter()
    for n in (12, 300):
        off = []
        for _ in range(60):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            other = words[: n // 2] + [f"v{rng.randrange(10**6)}" for _ in range(n - n // 2)]
            a, b = own.low_bits(pa.array([" ".join(words), " ".join(other)]))
            off.append(own.likeness(a, b) - likeness(" ".join(words), " ".join(other)))
        assert abs(np.mean(off)) < 0.03


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    from marginalia.llm import shingles

    rng = random.Random(2)
    texts = pa.array(["".join(rng.choice("ab cd\n É") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", "x" * 500])
    whole = word_hashes(texts, True)
    for size in (7, 64):
        monkeypatch.setattr(shingles, "SLICE", size)
        again = word_hashes(texts, True)
        assert (whole[0] == again[0]).all() and (whole[1] == again[1]).all()
    assert sum(len(s) for s in row_shingles(*whole, 3))
