import math
import random

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import topk
from marginalia.llm.topk import CoverTree, search_counts, top_k


def brute_force(rows, k, asks=lambda i: i % 3 == 0):
    kept = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [min(max(math.floor(1024 * x), -(2**63)), 2**63 - 1) for x in v]
        kept[i] = min(kept.get(i, v), v)
    out = []
    for q, v in kept.items():
        if asks(q):
            scores = [(sum(a * b for a, b in zip(v, w)), i) for i, w in kept.items() if i != q and len(w) == len(v)]
            best = sorted((-float(s), -min(max(s, -(2**63)), 2**63 - 1), i) for s, i in scores)[:k]
            out += [(q, r + 1, i, -s) for r, (_, s, i) in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, dim int, cell string").repartition(5)


def test_matches_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_BLOCK", 16)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(120)]  # ties, more than a block holds
    rows += [(0, rows[0][1]), (3, [9.0] * 6), (500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6), (505, [1.0, 2.0]), (508, [2.0, 1.0]), (511, []), (514, [3e9] * 6), (517, [-3e9] * 6)]
    for k in (1, 10):
        got = top_k(frame(spark, rows), F.col("vec_id") % 3 == 0, k)
        assert sorted(map(tuple, got.collect())) == brute_force(rows, k)


def test_scores_beyond_doubles_and_longs(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice((-1, 1)) * rng.random() * 3e6 for _ in range(4)]) for i in range(40)]  # beyond 2**53
    rows += [(40 + i, [rng.choice((-1, 1)) * 10.0 ** (7 + i) for _ in range(4)]) for i in range(9)]  # beyond a long
    rows += [(60, [1e300] * 4), (63, [1e300] * 4)]
    assert sorted(map(tuple, top_k(frame(spark, rows), F.col("vec_id") % 3 == 0, 5).collect())) == brute_force(rows, 5)


def test_empty_table(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect() == []


def test_cover_tree_nests_separates_and_covers():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(400, 5)), rng.normal(size=(300, 5)) * 0.05 + 4, np.ones((50, 5))])
    tree = CoverTree(points)
    assert sorted(tree.order) == list(range(750))
    for node in range(len(tree.start)):
        s, e, children = tree.start[node], tree.end[node], range(tree.low[node], tree.high[node])
        assert np.linalg.norm(tree.points[s:e] - tree.centre[node], axis=1).max() <= tree.radius[node]
        assert (tree.points[s] == tree.centre[node]).all()
        if children:
            centres = tree.centre[children]
            apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)[~np.eye(len(children), dtype=bool)]
            assert (centres[0] == tree.centre[node]).all() and apart.min() > tree.radius[node] / topk.BASE * (1 - 1e-6)
            assert tree.radius[children].max() <= tree.radius[node] / topk.BASE * (1 + 1e-6)
            assert [*tree.start[children], e] == [s, *tree.end[children]]
        else:
            assert e - s <= topk.LEAF or tree.radius[node] == 0


def test_pairs_are_left_out_of_blocks_that_spark_makes(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    points = centres[rng.integers(20, size=6000)] + rng.normal(size=(6000, 16)) * 0.02
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    asks = lambda i: i % 30 == 0
    got = top_k(frame(spark, rows), asks(F.col("vec_id")), 10)
    assert sorted(map(tuple, got.collect())) == brute_force(rows, 10, asks)
    met = search_counts(frame(spark, rows), asks(F.col("vec_id")), 10).collect()
    assert all(r["pruned"] for r in met if r["pairs"] > 2)
    assert sum(r["products"] for r in met) < 200 * 6000 / 3  # of all pairs
    assert sum(r["queries"] for r in met if r["round"] == 2) < 200 * (len({(r["cell"], r["sub"]) for r in met}) - 1)  # queries that weren't sent at all


def test_rows_for_other_blocks_come_in_bounded_parts(spark, monkeypatch):
    """Queries of one batch that go to many blocks each: no more than some thousand rows wait at once."""
    import pyarrow as pa

    queries, blocks, caught = 2_000, 3_000, {}
    class Source:
        def mapInArrow(self, run, schema):
            caught["run"] = run
    topk.elsewhere(Source(), {2: np.array([[0.0, 0.0], [50.0, 0.0]])})
    cells = [[{"cell": 0, "subs": blocks - 1, "radius": 9.0}, {"cell": 1, "subs": 1, "radius": 1.0}]] * queries
    rng = np.random.default_rng(1)
    columns = {"vec_id": pa.array(range(queries)), "vector": pa.array(rng.integers(0, 9, size=(queries, 2)).tolist(), pa.list_(pa.int64())), "dim": pa.array([2] * queries, pa.int32()), "cell": pa.array([0] * queries, pa.int32()), "sub": pa.array([i % (blocks - 1) for i in range(queries)], pa.int32()), "least": pa.array([-1e9] * (queries - 1) + [1e9]), "cells": pa.array(cells)}
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    rows = largest = 0
    seen = set()
    for part in caught["run"](iter([batch])):
        rows, largest = rows + part.num_rows, max(largest, part.num_rows)
        if len(seen) < 20_000:
            seen |= set(zip(*(part.column(c).to_pylist() for c in ("vec_id", "cell", "sub"))))
    assert rows == (queries - 1) * (blocks - 1) and largest <= 4096
    assert (0, 0, 0) not in seen and (0, 0, 1) in seen and (0, 1, 0) in seen
