"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file lists byte strings. The library's BPE model merges pairs of strings of characters, so every byte gets a
printable stand-in, and every way to cut a listed string into two listed ones becomes a merge with the string's rank:
rank-based merging takes any pair that makes a listed string, not only the pair it was learned from. Of the cuts of one
string that with the longer left part comes first. A match of the word pattern that is listed itself is that token.

The library gives offsets in characters. Tokens may end inside a character; each of them then has the whole
character's offsets. Decoding looks every id's bytes up and joins them, so characters split over tokens become whole
again; what isn't whole at either end of a token list is kept as bytes, and is U+FFFD in a text.

The word pattern always has a border where white space follows something else, and where something else follows a
letter. Texts are cut there into chunks; a task remembers the chunks it has met, and the library encodes those that are
new, a batch at a time. Long texts go in parts, so the memory a task needs is bounded by ``PART``, ``KEPT`` and the
longest run without white space.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from marginalia.llm.bpe_trie import SPACE, byte_alphabet
from marginalia.llm.common import keyed_text, map_batches

#: Characters in a part of a text, and in the texts that are encoded at once.
PART = 1 << 18
#: Characters of chunks that a task remembers.
KEPT = 4_000_000
#: Latin letters up to where something else than a letter or number follows (``\\w`` has every letter, so that is a
#: border whatever the script), or all up to white space; each with the white space before.
CHUNK = re.compile(f"[{SPACE}]*+(?:[A-Za-zÀ-ÖØ-öø-ɏ]++(?!\\w)|[^{SPACE}]+)|[{SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a rank file: a line each, in base 64, with its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class ByteCodec:
    """Encoder and decoder of one rank file. placed: chunks are remembered with what ``encode`` needs (ids, and the
    characters inside the chunk that each token covers), otherwise with what ``digests`` needs (decimal ids joined by
    commas, and the bytes that the ids decode to)."""

    def __init__(self, path: str, placed: bool = False, part: int = PART, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        ranks = read_ranks(path)
        stand_in = {b: c for c, b in byte_alphabet().items()}
        name = {token: "".join([stand_in[b] for b in token]) for token in ranks}
        cuts = [(token[:i], token[i:]) for token in sorted(ranks, key=ranks.__getitem__) for i in range(len(token) - 1, 0, -1)]
        merges = [(name[a], name[b]) for a, b in cuts if a in ranks and b in ranks]
        self.library = Tokenizer(BPE(vocab={name[token]: rank for token, rank in ranks.items()}, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=True)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.ids: dict[str, list[int]] = {}
        self.offsets: dict[str, list[tuple[int, int]]] = {}
        self.decimal: dict[str, str] = {}
        self.data: dict[str, bytes] = {}
        self.placed, self.part, self.kept, self.held = placed, part, kept, 0

    def parts(self, text: str) -> Iterator[tuple[int, str]]:
        """Parts of a text with their start. Each ends where a character that isn't white space stands before a space or
        a line feed: no match of the word pattern goes over that border, and none looks over it."""
        start = 0
        while len(text) - start > self.part:
            cut = start + self.part
            while cut < len(text) and (text[cut] not in " \n" or text[cut - 1].isspace()):
                cut += 1
            yield start, text[start:cut]
            start = cut
        if start < len(text):
            yield start, text[start:]

    def learn(self, chunks: set[str]) -> None:
        """Encodes the chunks that are new. Those before are forgotten when there are too many."""
        if self.held > self.kept:
            for known in (self.ids, self.offsets, self.decimal, self.data):
                known.clear()
            self.held = 0
        fresh = list(chunks.difference(self.ids if self.placed else self.decimal))
        for chunk, made in zip(fresh, self.library.encode_batch(fresh, add_special_tokens=False)):
            ids = made.ids
            if self.placed:
                self.ids[chunk], self.offsets[chunk] = ids, made.offsets
            else:
                self.decimal[chunk], self.data[chunk] = ",".join(map(str, ids)), self.decode(ids)
        self.held += sum(map(len, fresh))

    def chunked(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text, which are known from then on."""
        cut = [CHUNK.findall(t) for t in texts]
        self.learn(set().union(*cut))
        return cut

    def encoded(self, texts: list[str]) -> Iterator[Iterable[list[str]]]:
        """For each text its parts' chunks, each part before the next is cut; about ``part`` characters are worked on at once."""
        waiting: list[str] = []
        held = 0
        for text in texts:
            if held + len(text) > self.part:
                yield from ([chunks] for chunks in self.chunked(waiting))
                waiting, held = [], 0
            if len(text) > self.part:
                yield (self.chunked([part])[0] for _, part in self.parts(text))
            else:
                waiting.append(text)
                held += len(text)
        yield from ([chunks] for chunks in self.chunked(waiting))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], list[int]]]:
        """For each text its ids, and the characters at which each token starts and ends."""
        for parts in self.encoded(texts):
            ids: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            at = 0
            for chunks in parts:
                for chunk in chunks:
                    ids += self.ids[chunk]
                    starts += [at + x for x, _ in self.offsets[chunk]]
                    ends += [at + y for _, y in self.offsets[chunk]]
                    at += len(chunk)
            yield ids, starts, ends

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text how many ids it has, and the digests of these and of the bytes that they decode to."""
        for parts in self.encoded(texts):
            n, ids, data = 0, hashlib.sha256(), hashlib.sha256()
            for chunks in parts:
                joined = ",".join(map(self.decimal.__getitem__, chunks))
                ids.update(f",{joined}".encode() if n else joined.encode())
                n += joined.count(",") + 1 if joined else 0
                data.update(b"".join(map(self.data.__getitem__, chunks)))
            yield n, ids.hexdigest(), data.hexdigest()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def pieces(self, ids: list[int]) -> list[str]:
        """What each token adds to the text: a character split over tokens comes with the token that completes it, and
        bytes that never become one are U+FFFD as soon as that is clear."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        return [decoder.decode(self.bytes_of[i], final=k == len(ids) - 1) for k, i in enumerate(ids)]


@lru_cache(maxsize=2)
def codec(path: str, placed: bool = False) -> ByteCodec:
    """One codec for each Python worker and file."""
    return ByteCodec(path, placed)


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, starts, ends) of every row. starts and ends: the characters (code points, end exclusive)
    that a token covers; tokens that share a character all have that character's whole range.

    A null text is empty and has no tokens. Repeated rows are encoded each by itself, rows without a doc_id too. Whole
    texts are encoded, however long; special tokens' strings are ordinary text. An empty table gives no rows.
    """
    def make():
        own = codec(ranks_path, placed=True)

        def step(batch: pa.RecordBatch) -> dict:
            made = list(own.encode(batch.column("text").to_pylist()))
            return {"doc_id": batch.column("doc_id"), "n_tokens": [len(m[0]) for m in made], "ids": [m[0] for m in made], "starts": [m[1] for m in made], "ends": [m[2] for m in made]}

        return step

    return map_batches(keyed_text(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids array<int>, starts array<int>, ends array<int>")


def digest_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, as ``encode_documents`` and then ``decode_ids`` give
    them: digests of the decimal ids joined by commas and of the bytes that the ids decode to. No ids leave the task."""
    def make():
        own = codec(ranks_path)

        def step(batch: pa.RecordBatch) -> dict:
            made = list(own.digests(batch.column("text").to_pylist()))
            return {"doc_id": batch.column("doc_id"), "n_tokens": [m[0] for m in made], "ids_sha256": [m[1] for m in made], "decoded_sha256": [m[2] for m in made]}

        return step

    return map_batches(keyed_text(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_ids(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data, text, pieces) from arrays of ids. data: the bytes; text: these as UTF-8, U+FFFD where they are
    none; pieces: what each token adds to the text, a split character with the token that completes it.

    Null ids, and null elements, count as absent; an id that the file lacks is an error. An empty table gives no rows.
    """
    def make():
        own = codec(ranks_path)

        def step(batch: pa.RecordBatch) -> dict:
            every = [ids or [] for ids in batch.column("ids").to_pylist()]
            data = [own.decode(ids) for ids in every]
            return {"doc_id": batch.column("doc_id"), "data": data, "text": [d.decode("utf-8", "replace") for d in data], "pieces": [own.pieces(ids) for ids in every]}

        return step

    keyed = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.array_compact(F.col(ids_col).cast("array<int>")).alias("ids"))
    return map_batches(keyed, make, "doc_id long, data binary, text string, pieces array<string>")
