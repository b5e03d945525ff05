import math
import re
import zlib

import numpy as np
import pyarrow as pa

from marginalia.llm import quality
from marginalia.llm.quality import accepted_documents, scored_documents
from marginalia.llm.shingles import WORDS_AND_SIGNS, word_hashes


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = scored_documents(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.98


def test_accepted_rows_keep_their_columns_and_match_scores(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    kept = accepted_documents(docs, labels)
    assert kept.columns == docs.columns
    want = sorted(r["doc_id"] for r in scored_documents(docs, labels).filter("predicted = 1").collect())
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "word", "x"), (4, "w " * 50_000, "x")], "doc_id long, text string, vector string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1)], "doc_id long, quality int")
    got = scored_documents(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    none = scored_documents(docs, labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert scored_documents(docs.filter("false"), labels).collect() == []


def plain_words(text):
    """Runs of letters, digits and bytes beyond ASCII, and runs of other signs."""
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+", text.encode())


def bucket(word, buckets):
    hashes, _ = word_hashes(pa.array([word], pa.binary()).view(pa.string()), kinds=WORDS_AND_SIGNS)
    assert len(hashes) == 1
    return int(hashes[0]) % buckets


def test_features_match_loops_over_words(spark):
    texts = ["the cat, the dog; the end!", "A dog sat (twice) on the cat. 3 4 5", "", "one", "été... ok?!", "x " * 300]
    buckets = 50
    cut = [[bucket(w, buckets) for w in plain_words(t)] for t in texts]
    places, signs = quality.sparse_marks(buckets)
    table = np.zeros((buckets, quality.DIMENSIONS))
    for words in cut:
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.WINDOW), min(len(words), i + quality.WINDOW + 1)):
                if j != i:
                    for m in range(quality.MARKS):
                        table[w, places[words[j], m]] += signs[words[j], m]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert (quality.context_table(df.select("text"), buckets) == table).all()

    vectors = quality.unit_vectors(table)
    got = {r["doc_id"]: r["vector"] for r in quality.document_vectors(df, vectors).collect()}
    for i, words in enumerate(cut):
        own = [vectors[w].tolist() for w in words]
        if not own:
            assert not any(got[i])
            continue
        mean = [sum(v[d] for v in own) / len(own) for d in range(quality.DIMENSIONS)]
        spread = [math.sqrt(sum((v[d] - mean[d]) ** 2 for v in own) / len(own)) for d in range(quality.DIMENSIONS)]
        alike = [sum(sum(x * y for x, y in zip(a, b)) for a, b in zip(own[s:], own)) / (len(own) - s) if len(own) > s else 0 for s in (1, 2)]
        want = [*mean, *spread, math.sqrt(sum(x * x for x in mean)), *alike, math.log1p(len(words))]
        assert np.allclose(got[i], want, atol=1e-5)


def test_network_matches_loops_and_its_temperature_is_the_best():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + 0.2 * rng.normal(size=400) > 0).astype(float)
    net = quality.Network(x, y)
    w1, b1, w2, b2 = net.weights
    for row, score in zip(x[:20], net.scores(x[:20])):
        z = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(row, net.mean, net.scale)]
        hidden = [math.tanh(sum(z[i] * w1[i, h] for i in range(5)) + b1[h]) for h in range(quality.HIDDEN)]
        assert math.isclose(score, 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, w2)) + b2[0]) / net.temperature)), rel_tol=1e-9)
    assert ((net.scores(x) >= 0.5) == y).mean() > 0.85
    kept = np.random.default_rng(7).random(400) < 0.2
    loss = lambda t: -np.mean(np.log(np.where(y[kept] == 1, 1 / (1 + np.exp(-net.logits(net.standard(x[kept])) / t)), 1 / (1 + np.exp(net.logits(net.standard(x[kept])) / t)))))
    assert loss(net.temperature) <= min(loss(t) for t in np.geomspace(0.25, 8, 30)) + 1e-3


def test_repeated_ids_with_other_texts_give_the_same_scores(spark):
    rows = [(i % 40, f"w{i} " * (i % 7 + 1), i) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    one, two = (sorted(map(tuple, scored_documents(spark.createDataFrame(r, "doc_id long, text string, d int").repartition(n), labels).select("doc_id", "score").collect())) for r, n in ((rows, 2), (rows[::-1], 5)))
    assert one == two
