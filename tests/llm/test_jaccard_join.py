import random
import re

import pytest

from marginalia.llm.jaccard_join import similarity_components


def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute_force(rows, width, percent):
    sets = [(d, shingles(t, width)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(s), find(d)) for d, s in sets)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = [f"w{rng.randrange(400)}"]
    return words


def chains(seed):
    """Bases, copies of copies ever further from them, unrelated texts, a passage that all of one group share."""
    rng = random.Random(seed)
    texts = []
    for _ in range(8):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 14)):
            texts.append(" ".join(words))
            if rng.random() < 0.8:
                words = edited(rng, words, rng.randrange(4))
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join(passage + [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30))]) for _ in range(25)]
    texts += ["", None, " \t\n", "one", "One", "one two", "ONE two", "x " * 3000]
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("large", "most"), [(512, 65_536), (3, 65_536), (512, 20)])
@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 60)])
def test_components_match_all_pairs(spark, seed, width, percent, large, most):
    rows = chains(seed)
    df = spark.createDataFrame([(d, t, "a", 1) for d, t in rows], "doc_id long, text string, class string, fragment int").repartition(3)
    got = similarity_components(df, width, percent, large_bucket=large, most_rows=most).collect()
    assert sorted(map(tuple, got)) == brute_force(rows, width, percent)


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert similarity_components(spark.createDataFrame([], schema)).collect() == []
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (7, None)]
    got = sorted(map(tuple, similarity_components(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(2, 2, 2), (5, 2, 2), (5, 2, 2), (7, 0, 7)]


def test_template_documents_and_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    lines = [" ".join(f"t{i}x{j}" for j in range(6)) for i in range(25)]
    texts = [" ".join(x for x in lines if rng.random() < 0.7) for _ in range(150)]
    base = [f"b{i}" for i in range(80)]
    texts += [" ".join(edited(rng, base, rng.randrange(5))) for _ in range(150)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for most in (30, 65_536):
        assert sorted(map(tuple, similarity_components(df, 5, 80, most_rows=most).collect())) == brute_force(rows, 5, 80)


def test_pairs_whose_ends_are_alone_in_their_parts(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):  # links of two, and of lengths that no leader is near
        words = [f"v{i}x{j}" for j in range(rng.randrange(12, 60))]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words + ["tail"])), (3 * i + 2, " ".join(words[: len(words) // 2]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for most in (1, 3):
        assert sorted(map(tuple, similarity_components(df, 3, 90, most_rows=most).collect())) == brute_force(rows, 3, 90)


def test_codes_of_prefixes_never_drop_a_pair_and_keep_the_order():
    import numpy as np

    from marginalia.llm.jaccard_join import SLOT_BITS, Order

    rng = np.random.default_rng(5)
    order = Order(rng.integers(0, 50, 1 << SLOT_BITS), 90, 128)
    ngrams = np.unique(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64) * np.uint64(2))
    ngrams, _ = order.sorted(np.unique(np.concatenate([ngrams, ngrams + np.uint64(1)])))  # neighbours have one code
    codes = order.codes(ngrams)
    assert codes.dtype == np.uint32 and (codes[1:] >= codes[:-1]).all() and len(np.unique(codes)) <= len(ngrams) // 2


def shuffled(spark, run):
    """MB that the tasks of a run write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: store.stageList(None, False, False, none, None)
    before = stages().size()
    out = run()
    after = stages()
    known = sorted(((s.stageId(), s.shuffleWriteBytes()) for s in (after.apply(i) for i in range(after.size()))))
    return out, sum(b for _, b in known[before:]) / 1e6


def test_prefixes_are_shuffled_of_classes_that_repeat_only(spark):
    from marginalia.llm.jaccard_join import one_of_each_class

    rng = random.Random(6)
    rows = [(i, 4, rng.randbytes(16), rng.randbytes(20_000)) for i in range(200)]
    rows += [(i + 1000, *r[1:]) for i, r in enumerate(rows[:5])] + [(-1, *rows[7][1:]), (5000, 0, None, None)]
    df = spark.createDataFrame([(d, n, bytearray(c) if c else None, bytearray(p) if p else None) for d, n, c, p in rows], "doc_id long, n long, class binary, prefix binary")
    got, mb = shuffled(spark, lambda: one_of_each_class(df).collect())
    assert sorted((r["doc_id"], r["n"], bytes(r["class"]), bytes(r["prefix"])) for r in got) == sorted([(-1, *rows[7][1:])] + [r for r in rows[:200] if r[0] != 7])
    assert mb < 1, mb  # all prefixes are 4 MB
