"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

Every item goes where the sum, over all residual gaps, of the squared number of open bins with that gap becomes
smallest. That keeps the gaps varied, so that later items find one that fits.

Packing runs in levels. Each task packs what its own documents leave after their whole pieces, largest first, and
closes the sequences that are full or nearly so. The items of the others, a few for each task, move on to fewer tasks
and are packed again, until one task has them all. No level holds more than ``ITEMS_A_TASK`` items in a task at a time,
and what moves on shrinks by orders of magnitude.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm.common import arrow_schema, checkpoint, keyed_text

ITEMS_A_TASK = 100_000
#: Pieces, then the sequence each went to; closed says whether that is final.
LEVEL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, closed boolean"


class SumOfSquares:
    """Open bins by fill level; bins are numbered in the order they open."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(2 * capacity + 1, dtype=np.int64)  # bins with a fill of 1..capacity-1
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.members: list[list[int]] = []

    def place(self, item: int, size: int) -> None:
        """The change of the sum is 2 * (count at the new level - count at the old level) + 2, where a full bin has no
        new level. Ties go to the fullest bin. A bin is opened only where no open one has room: the sum alone would
        open some needlessly, and few sequences are the aim."""
        cap, count = self.capacity, self.open
        old = count[1 : cap - size + 1]
        level = 0
        if old.any():
            change = 2 * (count[1 + size : cap + 1] - old) + 2
            change[-1] -= 1  # it becomes full: one open bin fewer, none more
            change[old == 0] = np.iinfo(np.int64).max
            level = len(change) - int(np.argmin(change[::-1]))
        if level:
            bin_ = self.bins[level].pop()
            count[level] -= 1
        else:
            bin_ = len(self.members)
            self.members.append([])
        self.members[bin_].append(item)
        if level + size < cap:
            count[level + size] += 1
            self.bins[level + size].append(bin_)


def pack_sizes(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item positions. Items of one size are alike, so the largest come first and ties keep their order."""
    bins = SumOfSquares(capacity)
    for item in np.argsort(-sizes, kind="stable").tolist():
        bins.place(item, int(sizes[item]))
    return bins.members


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones, but for the first, which has the rest."""
    rest = n % capacity
    head = [(0, rest)] if rest else []
    return head + [(s, capacity) for s in range(rest, n, capacity)]


class IdEncoder:
    """Ids of a byte-level BPE file. Ordinary text goes through the rank-based encoder, which gives the same ids several
    times as fast; what the two may see differently (scripts whose classes depend on the Unicode version) goes through
    the tokenizer file itself."""

    UNSETTLED = re.compile("[Ԁ-\U0010ffff\x1c-\x1f]")

    def __init__(self, tokenizer_path: str):
        self.library = Tokenizer.from_file(tokenizer_path)
        self.library.no_truncation()
        self.library.no_padding()
        specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.specials = specials
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = iter(range(256, 512))
        byte_of = {chr(b) if b in plain else chr(next(rest)): b for b in range(256)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.library.get_vocab(with_added_tokens=False).items()}
        #: The word pattern of this tokenizer family.
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.ordinary = tiktoken.Encoding("words", pat_str=words, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        if self.UNSETTLED.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        if self.special is None or not self.special.search(text):
            return self.ordinary(text)
        out: list[int] = []
        for i, part in enumerate(self.special.split(text)):
            out += [self.specials[part]] if i % 2 else self.ordinary(part)
        return out


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str) -> IdEncoder:
    return IdEncoder(tokenizer_path)


class _Level:
    """Packs the pieces a task gathers and writes them out as rows of LEVEL."""

    def __init__(self, schema: pa.Schema, capacity: int, last: bool, salt: int):
        self.schema, self.capacity, self.last = schema, capacity, last
        #: Numbers of sequences differ between levels and tasks.
        self.next_id = (salt << 58) | (TaskContext.get().partitionId() << 32)
        self.rows: list[tuple[int | None, int, int, int, int]] = []

    def add(self, row) -> None:
        self.rows.append(row)

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [()] * 5
        sizes = np.array(cols[3], dtype=np.int64)
        n = len(sizes)
        sequence, offset, closed = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        for members in pack_sizes(sizes, self.capacity):
            at = 0
            for item in members:
                sequence[item], offset[item] = self.next_id, at
                at += int(sizes[item])
            self.next_id += 1
            if not self.last and self.capacity - at > self.capacity // 64:
                closed[members] = False
        self.rows = []
        kinds = [f.type for f in self.schema]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip([*cols, sequence, offset, closed], kinds)], schema=self.schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A document is its ids and then ``end_id``, so a null or empty text is that one id. Only documents of more than
    ``capacity`` tokens are cut. Repeated rows are packed each by itself. An empty table gives no rows.
    """
    schema = arrow_schema(LEVEL)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, level = encoder(tokenizer_path), _Level(schema, capacity, False, 0)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc, text in zip(ids, batch.column("text")):
                tokens = np.array([*own.encode(text.as_py()), end_id], dtype="<u4")
                for piece, (start, length) in enumerate(cut_points(len(tokens), capacity)):
                    level.add((doc, piece, start, length, zlib.crc32(tokens[start : start + length])))
                if len(level.rows) >= ITEMS_A_TASK:
                    yield level.flush()
        yield level.flush()

    def again(salt: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            level = _Level(schema, capacity, last, salt)
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in schema.names[:5])):
                    level.add(row)
                    if len(level.rows) >= ITEMS_A_TASK:
                        yield level.flush()
            yield level.flush()

        return run

    done: list[DataFrame] = []
    level = checkpoint(keyed_text(docs, id_col, text_col).mapInArrow(first, LEVEL))
    for salt in range(1, 16):
        rest = level.filter(~F.col("closed"))
        tasks = -(-rest.count() // (ITEMS_A_TASK // 2))
        done.append(level.filter("closed"))
        if not tasks:
            break
        packed = rest.repartition(tasks).mapInArrow(again(salt, tasks == 1), LEVEL)
        if tasks == 1:
            done.append(packed)
            break
        level = checkpoint(packed)
    else:
        done.append(level.filter(~F.col("closed")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("closed")
