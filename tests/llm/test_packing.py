import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from marginalia.llm.packing import cut_points, pack_documents, pack_sizes

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def check(rows, got, capacity):
    """Every piece of every row, once, gapless in sequences of at most the capacity; how many sequences there are."""
    want = []
    for doc, text in rows:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        n = len(ids)
        first = n % capacity or capacity
        cuts = [0, *range(first, n, capacity), n] if n > capacity else [0, n]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4"))))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), -(-sum(w[3] for w in want) // capacity)


def test_pieces_and_sequences(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, "<|endoftext|>x"), (9004, "word " * 5000), (9005, "a"), (9005, "a"), (None, "b"), (9006, "日本 \x1c")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, piece int, offset string").repartition(6)
    for capacity in (1024, 64):
        used, least = check(rows, pack_documents(df, PATH, capacity).collect(), capacity)
        assert used <= least * 1.02 + 1


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_sizes_fill_sequences():
    rng = random.Random(3)
    sizes = np.array([rng.randrange(1, 1025) for _ in range(3000)])
    bins = pack_sizes(sizes, 1024)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all(sizes[b].sum() <= 1024 for b in bins)
    assert len(bins) <= max(-(-sizes.sum() // 1024), (sizes > 512).sum()) * 1.01
    assert pack_sizes(np.array([], dtype=np.int64), 8) == []
    assert cut_points(8, 8) == [(0, 8)] and cut_points(9, 8) == [(0, 1), (1, 8)] and cut_points(3, 8) == [(0, 3)]
