import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from marginalia.llm.token_counts import SPACE, UnigramTrie, count_tokens, ranked_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plain_count(pieces, unknown, word):
    """The same recurrence, a word at a time, over a dictionary."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        found = None
        for start in range(end):
            score = pieces.get(word[start:end])
            tokens = 1
            if score is None and end - start == 1:
                score, tokens = unknown, len(word[start:end].encode())
            if score is not None and (found is None or best[start][0] + score > found[0]):
                found = (best[start][0] + score, best[start][1] + tokens)
        best.append(found)
    return best[-1][1]


def test_counts_match_plain_recurrence_and_library(spark, sf_dir):
    ranked = ranked_pieces(MODEL)
    own, pieces = UnigramTrie(ranked), dict(ranked)
    rng = random.Random(2)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()
    words = {SPACE + w for r in rows for w in r["text"].split()} | {SPACE + "".join(rng.choice("abcdethinég日本́\U0001f600") for _ in range(rng.randrange(1, 15))) for _ in range(500)}
    counted = own.count_words(words)
    assert all(counted[w] == plain_count(pieces, own.unknown, w) for w in words)

    library = Tokenizer(models.Unigram([("<unk>", 0.0), *ranked], unk_id=0))
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    covered = [w for w in words if all(c in pieces for c in w)]
    assert len(covered) > 100
    assert all(len(library.encode(w).ids) == counted[w] for w in covered)


@pytest.mark.parametrize("text", [None, "", " \n\t ", "word", "word " * 30_000])
def test_edge_rows(spark, text):
    df = spark.createDataFrame([(1, text, "x", 3), (1, text, "x", 3)], "doc_id long, text string, n_tokens string, vector int")
    n = len((text or "").split())
    got = [tuple(r) for r in count_tokens(df, MODEL).collect()]
    assert [g[:2] for g in got] == [(1, n)] * 2
    assert all((g[2] == 0) == (n == 0) for g in got)


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
