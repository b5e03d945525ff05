import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from marginalia.llm.byte_bpe import ByteCodec, decode_ids, digest_documents, encode_documents, read_ranks
from marginalia.llm.queries import op13_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
EDGES = [None, "", " ", "  \n\t ", "a<|endoftext|>b", "x" * 5000, "it's WE'LL  ' s", "\x1c a\x1fb\x85c", "日本語 １２３", "é Å é", "\U0001f600\U0001f1e9\U0001f1ea", "�​­", "ab" * 3000 + " " * 3000]


@pytest.fixture(scope="module")
def own():
    return ByteCodec(PATH, placed=True)


def test_random_texts_match_the_rank_based_library(own):
    rng = random.Random(13)
    alphabets = ["aaaab ", "abcdeth in\n", "a!?.'s \t\r\n1230", "".join(map(chr, range(1, 0x600))), "".join(chr(c) for c in range(0x4E00, 0x4F00)) + " あいう", "".join(chr(c) for c in (*range(0x0900, 0x0980), *range(0x1F600, 0x1F650), 32)), "=-_*/ 　  "]
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(80))) for a in alphabets for _ in range(700)]
    texts += [a * n for a in ("a", "ab", "aab", "=", " ", "\n", "0", "é", "ああい", "haha") for n in range(1, 200, 7)]
    texts += [t or "" for t in EDGES]
    made = [m[0] for m in own.encode(texts)]
    assert made == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [own.decode(ids) for ids in made] == [t.encode() for t in texts]


def test_each_token_alone_and_each_byte(own):
    listed = read_ranks(PATH)
    assert {b for t in listed for b in t} == set(range(256))
    assert all(own.decode([i]) == t for t, i in listed.items())


def test_offsets_cover_the_text_and_split_characters_share_theirs(own):
    text = "Grüße 日本 \U0001f9ffඞ end"
    ids, starts, ends = next(own.encode([text]))
    assert len(ids) == len(starts) == len(ends)
    covered = sorted({i for s, e in zip(starts, ends) for i in range(s, e)})
    assert covered == list(range(len(text)))
    for i, s, e in zip(ids, starts, ends):
        assert own.decode([i]) in text[s:e].encode()
    assert any(starts[k] == starts[k + 1] for k in range(len(ids) - 1))  # a character over two tokens
    pieces = own.pieces(ids)
    assert "".join(pieces) == text and "" in pieces


def test_parts_of_long_texts_change_nothing():
    small, rng = ByteCodec(PATH, placed=True, part=7, kept=40), random.Random(2)
    texts = ["".join(rng.choice("ab c  \n 　é'1.\x1c") for _ in range(rng.randrange(200))) for _ in range(600)]
    for text in texts:
        assert "".join(p for _, p in small.parts(text)) == text
    assert [m[0] for m in small.encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]
    whole = ByteCodec(PATH, placed=True)
    assert list(small.encode(texts)) == list(whole.encode(texts))
    assert list(ByteCodec(PATH, part=7, kept=40).digests(texts)) == list(ByteCodec(PATH).digests(texts))


def test_whole_table_against_the_library(spark, sf_dir):
    want = sorted((r["doc_id"], len(ids := LIBRARY.encode_ordinary(r["text"] or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = op13_byte_bpe(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and dict(got.dtypes)["n_tokens"] == "bigint"
    assert sorted(map(tuple, got.collect())) == want


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(EDGES)] + [(0, None, "x", 1), (None, "no id", "x", 1), (3, EDGES[3], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    encoded = encode_documents(docs, PATH)
    made = encoded.collect()
    key = lambda x: repr((x[0] is None, x[0] or 0, *x[1:]))
    assert sorted(((r["doc_id"], r["ids"]) for r in made), key=key) == sorted(((d, LIBRARY.encode_ordinary(t or "")) for d, t, _, _ in rows), key=key)
    back = decode_ids(encoded, PATH).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=key) == sorted(((d, t or "") for d, t, _, _ in rows), key=key)
    assert all(bytes(r["data"]).decode() == r["text"] == "".join(r["pieces"]) for r in back)
    digests = digest_documents(docs, PATH)
    assert digests.count() == len(rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert digest_documents(none, PATH).collect() == encode_documents(none, PATH).collect() == []


def test_broken_characters_stay_bytes(spark):
    (ids, _, _), listed = next(ByteCodec(PATH, placed=True).encode(["\U0001f9ff"])), read_ranks(PATH)
    assert len(ids) > 1
    e = listed[b"\xc3"]
    rows = [(1, ids[:-1]), (2, ids[1:]), (3, [listed[b"a"], None, e]), (4, None), (5, [e, listed[b"a"]])]
    got = {r["doc_id"]: r for r in decode_ids(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()}
    whole = "\U0001f9ff".encode()
    assert whole.startswith(bytes(got[1]["data"])) and whole.endswith(bytes(got[2]["data"]))
    assert "�" in got[1]["text"] and "�" in got[2]["text"]
    assert (got[3]["text"], got[3]["pieces"]) == ("a�", ["a", "�"])
    assert (got[4]["text"], got[4]["pieces"]) == ("", [])
    assert got[5]["pieces"] == ["", "�a"]
