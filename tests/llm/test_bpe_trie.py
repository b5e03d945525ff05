import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from marginalia.llm.bpe_trie import TextCodec, decode_ids, digest_documents, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
EDGES = [None, "", "  \n", "a<|endoftext|>b <|startoftext|>", "x" * 5000, "it's WE'LL", "ΑΣ ΣΑΣ İstanbul", "\x1c a\x1fb", "a\u0085b c​d", "日本語 １２３", "é Å", "՘b \U0001f600"]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)


def test_random_and_edge_texts_match_the_library():
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x600)] + list("aaabbcdeeee   \n\t''sstm!!??..1234") * 10
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdeth in") for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [t or "" for t in EDGES]
    assert TextCodec(PATH).encode(texts) == list(map(expected, texts))


def test_documents_digests_and_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(10_000 + i, t, "x", 1) for i, t in enumerate(EDGES)] + [(10_000, None, "x", 1)]
    more = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    docs = docs.selectExpr("doc_id", "text", "'y' AS ids", "2 AS n_tokens").union(more)
    texts = docs.select("doc_id", "text").collect()
    want = sorted((d, *(hashlib.sha256(x.encode()).hexdigest() for x in expected(t))) for d, t in texts)
    got = digest_documents(docs, PATH).collect()
    assert sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    encoded = encode_documents(more, PATH)
    assert all(r["n_tokens"] == len(r["ids"].split()) for r in encoded.collect())
    assert sorted(map(tuple, decode_ids(encoded, PATH).collect())) == sorted((r["doc_id"], r["decoded"]) for r in encoded.collect())


def test_empty_table(spark):
    assert digest_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_special_tokens_can_be_ordinary_text():
    plain = TextCodec(PATH, parse_special=False).encode(["<|endoftext|>"])[0][0]
    assert "49407" not in plain.split()
