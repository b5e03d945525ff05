"""Document fingerprints: one-permutation MinHash with optimal densification, kept as packed low-order bits.

Each distinct five-word shingle is hashed once. The high bits of the hash choose one of ``BINS`` bins and the rest are
its value there; a bin keeps its least value. An empty bin borrows from the bin that a hash of (bin, attempt) names, at
the first attempt that names a filled one. Of every bin, ``BITS`` low-order bits are stored. Two unrelated bins agree in
them once in 2**BITS, which the likeness corrects for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_schema, keyed_text, map_batches, shuffle_width
from marginalia.llm.shingles import mixed, row_shingles, word_hashes

BINS = 512
BITS = 4
SHINGLE_WORDS = 5
EMPTY = np.uint64(2**64 - 1)
#: Bounds of the ranges of doc_id that neighbours are looked up in; no more are collected, whatever the input.
MAX_RANGES = 20_000


def borrow_order(bins: int, attempts: int) -> np.ndarray:
    at = np.arange(bins, dtype=np.uint64)[None, :] + (np.arange(1, attempts + 1, dtype=np.uint64)[:, None] << np.uint64(32))
    return (mixed(at) % np.uint64(bins)).astype(np.int32)


class Fingerprinter:
    def __init__(self, bins: int = BINS, bits: int = BITS):
        self.bins, self.bits = bins, bits
        self.borrow = borrow_order(bins, 64)

    def bin_values(self, shingles: np.ndarray) -> np.ndarray:
        """Least value of each bin, empty ones filled; all EMPTY if there are no shingles."""
        least = np.full(self.bins, EMPTY, dtype=np.uint64)
        if not len(shingles):
            return least
        shift = np.uint64(64 - int(self.bins).bit_length() + 1)
        np.minimum.at(least, (shingles >> shift).astype(np.int64), shingles << np.uint64(int(self.bins).bit_length() - 1))
        filled = least != EMPTY
        empty = np.flatnonzero(~filled)
        own = least.copy()
        attempt, to = 0, 4
        while len(empty):
            if to > len(self.borrow):
                self.borrow = borrow_order(self.bins, to)
            # some attempts of all empty bins at once: the first that names a filled bin counts
            block = self.borrow[attempt:to, empty]
            hit = filled[block]
            first = hit.argmax(axis=0)
            at = np.arange(len(empty))
            found = hit[first, at]
            least[empty[found]] = own[block[first, at][found]]
            empty = empty[~found]
            attempt, to = to, 2 * to
        return least

    def low_bits(self, texts: pa.Array) -> list[np.ndarray | None]:
        """For each text the stored bits of its bins, or None of one without words."""
        return [self.kept(self.bin_values(s)) if len(s) else None for s in row_shingles(*word_hashes(texts), SHINGLE_WORDS)]

    def kept(self, values: np.ndarray) -> np.ndarray:
        return (mixed(values) & np.uint64(2**self.bits - 1)).astype(np.uint8)

    def packed(self, bits: np.ndarray | None) -> str:
        """Lower-case hexadecimal of the packed bits; empty for a text without words."""
        if bits is None:
            return ""
        flat = np.unpackbits(bits[:, None], axis=1, bitorder="little")[:, : self.bits]
        return np.packbits(flat.reshape(-1), bitorder="little").tobytes().hex()

    def likeness(self, a: np.ndarray | None, b: np.ndarray | None) -> float:
        """Estimated Jaccard likeness of the shingle sets: agreement without what chance adds. Two texts without words
        are alike; one without and one with words are not."""
        if a is None or b is None:
            return float(a is None and b is None)
        chance = 2.0**-self.bits
        return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row. Null and empty texts, and those of white space only, have the empty
    fingerprint. Repeated rows are each fingerprinted. Texts shorter than a shingle are one shingle."""
    def make():
        own = Fingerprinter(bins, bits)

        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text")
            return {"doc_id": batch.column("doc_id"), "n_chars": pc.utf8_length(texts).cast("int64"), "fingerprint": [own.packed(b) for b in own.low_bits(texts)]}

        return step

    return map_batches(keyed_text(docs, id_col, text_col), make, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """Rows dealt into ranges of doc_id; the first row of each range also stands, marked, after the last of the one
    before it, and the very first after the last of all. Only range bounds and least ids are collected."""
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []))

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, dtype=np.int64), doc_id.to_numpy(dtype=np.int64), side="left").astype(np.int32))

    dealt = docs.filter("doc_id IS NOT NULL").withColumn("range", range_of("doc_id"))
    firsts = ids.withColumn("range", range_of("doc_id")).groupBy("range").agg(F.min("doc_id").alias("doc_id")).orderBy("range").collect()
    if not firsts:
        return dealt.withColumn("after", F.lit(False)), 0
    previous = [(r["doc_id"], firsts[i - 1]["range"]) for i, r in enumerate(firsts)]
    marks = docs.sparkSession.createDataFrame(previous, "doc_id long, before int")  # a row for each range: bounded by MAX_RANGES
    marked = dealt.join(F.broadcast(marks), "doc_id", "left")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("after"))
    copy = F.struct(F.col("before").alias("range"), F.lit(True).alias("after"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))
    return marked.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.range", "at.after"), len(firsts)


PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many first ones of the following text, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """One row for each row of ``docs``: its fingerprint, that of its edited text, and the likeness of its fingerprint
    to the edited text's and to the next document's.

    The next document is that with the next greater doc_id, and the first after the last; rows of one doc_id go by
    text. A single row is followed by itself. A null text is empty; rows without a doc_id have no place in the order
    and are left out.
    """
    width = shuffle_width(docs.sparkSession)
    placed, _ = with_next(keyed_text(docs, id_col, text_col), min(MAX_RANGES, 8 * width))
    schema = arrow_schema(PAIRED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fingerprinter(bins, bits)
        held, over = None, None  # the row before; the range whose following row is through
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                kept = [] if held is None else [held]
                for row in zip(batch.column("range").to_pylist(), batch.column("after").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    if row[0] != over:  # else a repeated first row: one following row is enough
                        kept.append(row)
                    over = row[0] if row[1] else None
                marks = own.low_bits(pa.array([r[3] for r in kept], type=pa.string()))
                pairs = [i for i in range(len(kept) - 1) if not kept[i][1]]
                edited = [edited_text(kept[i][3], kept[i + 1][3]) for i in pairs]
                changed = own.low_bits(pa.array(edited, type=pa.string()))
                rows = [(kept[i][2], len(kept[i][3]), hashlib.sha256(e.encode()).hexdigest(), own.packed(marks[i]), own.packed(m), own.likeness(marks[i], m), own.likeness(marks[i], marks[i + 1])) for i, e, m in zip(pairs, edited, changed)]
                held = None if not kept or kept[-1][1] else kept[-1]
                columns = list(zip(*rows)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return placed.repartition(width, "range").sortWithinPartitions("range", "after", "doc_id", "text").mapInArrow(run, PAIRED)
