import hashlib

import numpy as np

from marginalia.llm.ball_codes import Balls, part_bounds, squared_distances, trained, vector_codes, whole_components
from marginalia.llm.queries import op12_ball_codes


def brute(rows, parts=4, k=256, rounds=4, scale=1024):
    """rows: (id, label, list of floats) without odd ones; every part is compared with every entry."""
    v = np.floor(scale * np.array([r[2] for r in rows], dtype=np.float64)).astype(np.int64)
    first = [i for i in sorted(range(len(rows)), key=lambda i: rows[i][0])][:k]
    bounds = part_bounds(v.shape[1], parts)
    books = [v[first, a:b].copy() for a, b in zip(bounds, bounds[1:])]
    for turn in range(rounds + 1):
        codes, errors = [], np.zeros(len(rows), dtype=np.int64)
        for (a, b), book in zip(zip(bounds, bounds[1:]), books):
            x = v[:, a:b]
            gaps = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
            near = gaps.argmin(axis=1)
            codes.append(near)
            errors += gaps.min(axis=1)
            for e in range(len(book)):
                if turn < rounds and (near == e).any():
                    book[e] = x[near == e].sum(axis=0) // (near == e).sum()
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.reshape(-1)).encode()).hexdigest()
    labels = {}
    for r, e in zip(rows, errors.tolist()):
        labels[r[1]] = labels.get(r[1], 0) + e
    return sorted((r[0], "".join(f"{int(c[i]):02x}" for c in codes), int(errors[i]), labels[r[1]], digest) for i, r in enumerate(rows))


def clustered(n, dim, groups, seed, spread=0.02):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    return (middle[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dim))).tolist()


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = op12_ball_codes(spark, sf_dir)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_ties_copies_and_uneven_parts(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.integers(-2, 3, size=(900, 10)) / 1024).tolist()  # few values: many ties, equal entries and unused ones
    rows = [(i, None if i % 3 == 0 else f"l{i % 5}", v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label string, embedding array<double>, code string, entries int").repartition(5)
    for parts, k, rounds in ((4, 256, 4), (3, 20, 6), (1, 1, 2), (10, 7, 0)):
        got = [(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes(df, parts, k, rounds).collect()]
        assert sorted(got) == brute(rows, parts, k, rounds)


def test_balls_give_the_nearest_entries_with_less_work():
    rng = np.random.default_rng(8)
    points = np.floor(1024 * np.array(clustered(6000, 8, 60, 5))).astype(np.int64)
    last = points[:128]
    entry, away = Balls(last, None).first(points)
    book = last.copy()
    for e in np.unique(entry):
        book[e] = points[entry == e].sum(axis=0) // (entry == e).sum()
    balls = Balls(book, last)
    got, gaps = balls.again(points, entry, away)
    every = squared_distances(points, book)
    assert (got == every.argmin(axis=1)).all() and (gaps == every.min(axis=1)).all()
    assert balls.made < every.size / 5
    still = Balls(book, book)
    assert (still.again(points, got, gaps)[0] == got).all() and still.made == 0  # nothing moved: no ball is looked at
    one = book.copy()
    one[got[0]] += 1
    few = Balls(one, book)
    again, gaps = few.again(points, got, gaps)
    every = squared_distances(points, one)
    assert (again == every.argmin(axis=1)).all() and (gaps == every.min(axis=1)).all()
    assert few.made < balls.made
    wide = rng.integers(-(1 << 24), 1 << 24, size=(50, 8))
    assert (squared_distances(wide, wide[:9]) == ((wide[:, None] - wide[None, :9]) ** 2).sum(axis=2)).all()


def test_odd_rows_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    schema = "vec_id long, label int, embedding array<double>, away int"
    fine = [(5, 1, [0.5, 1.0, -1.0, 2.0], 0), (5, 1, [0.5, 1.0, -1.0, 2.0], 0), (7, None, [1e300, -1e300, 0.0, -0.0001], 0), (None, None, [0.5, 1.0, -1.0, 2.0], 0)]
    bad = [(1, 1, None, 0), (2, 1, [1.0, None, 0.0, 0.0], 0), (3, 1, [nan, 0.0, 0.0, 0.0], 0), (4, 1, [inf, 0.0, 0.0, 0.0], 0)]
    got = sorted(vector_codes(spark.createDataFrame(fine + bad + [(9, 1, [0.5], 0)], schema)).collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))
    assert [(r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in got] == [(5, 1, "00000000", 0, 0), (5, 1, "00000000", 0, 0), (7, None, "01010101", 0, 0), (9, 1, None, None, 0), (None, None, "00000000", 0, 0)]
    for rows in ([], bad, [(None, 1, [1.0], 0)]):
        assert vector_codes(spark.createDataFrame(rows, schema)).collect() == []
    flat = vector_codes(spark.createDataFrame([(1, 1, [], 0), (2, 1, [], 0)], schema)).collect()
    assert [(r["code"], r["error"]) for r in flat] == [("00000000", 0)] * 2


def test_one_label_of_a_third_of_all_rows_and_rounds_until_nothing_moves(spark):
    from pyspark.sql import functions as F

    rows = [(i, 0 if i % 3 else i, v) for i, v in enumerate(clustered(3000, 6, 12, 9))]
    df = spark.createDataFrame(rows, "id long, label long, vector array<double>")
    whole = df.select("id", "label", whole_components(F.col("vector"), 1024).alias("vector"))
    state, _ = trained(whole, 2, 12, 12)
    assert state.filter("before <> entries").count() == 0
    got = vector_codes(df, 2, 12, 12, id_col="id", vector_col="vector")
    assert sorted(map(tuple, got.select("id", "code", "error", "label_error", "codebooks_sha256").collect())) == brute(rows, 2, 12, 12)
