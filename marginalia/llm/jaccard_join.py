"""Similarity join of documents on word n-grams by vertical partitioning.

All n-grams stand in one global order, rare ones first. The order is cut into fragments, and so is every document's set.
Documents that may be alike share an n-gram among the first of their sets (their prefixes), so the prefix segments of a
fragment, brought together, give candidates. A candidate pair's overlap is counted in each fragment by itself, and the
partial counts are summed per pair.

Groups of any size stay linear where they can:

* Equal sets are one class, found by partial aggregation; only one member of a class goes on.
* In the first round, documents that share a prefix n-gram are compared with one of them, not with each other; what
  that links is one component.
* In the second round, only pairs across components are compared. Pairs that lengths, positions or the overlap of the
  prefixes rule out, and those compared before, are left out. After both rounds each pair that could be linked is
  linked, inside one component or compared, so the components are exact.
* N-grams that the same documents hold, as those of a repeated passage are, give pairs once.
* A fragment of more rows than a task should hold is dealt over parts. In the first round each part has documents of its
  own to compare with, and these meet once more. In the second round most of such a fragment is one component: its rows
  stay in their parts, and rows of other components, which all pairs to look at have at one end, come to every part.

The order of n-grams is by counts in hash slots, which every document's n-grams fill. Any order gives the same result; a
slot's count only has to tell frequent from rare ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_schema, checkpoint, keyed_text, stored
from marginalia.llm.components import connected_components
from marginalia.llm.shingles import mixed, row_shingles, word_hashes

SLOT_BITS = 17
#: Fragments that an overlap is counted in; prefixes are cut finer, by the number of tasks.
OVERLAP_FRAGMENTS = 4
PREFIX = "doc_id long, n long, class binary, prefix binary"
SEGMENT = "fragment int, key long, n long, start int, tokens binary, label long"
#: Rows of a fragment that meet in one task, at most, before it is dealt over parts: some ten times what fragments of
#: DOCUMENTS_A_FRAGMENT have on average, as a document has n-grams in many, and some hundred MB.
MOST_ROWS = 1 << 20
#: How a fragment's rows are dealt: parts, blocks of rows of other components, and the component of most rows.
DEALT = ("parts", "blocks", "most")
#: Pairs by the numbers of their classes, as rows that go for each n-gram are shorter by these than by classes.
PAIR = "a long, b long, a_n long, b_n long"
#: Pairs by class, from when their prefixes have met.
LIKELY = "a binary, b binary, a_doc long, b_doc long, a_n long, b_n long"
#: Fragments that prefixes are cut into, at least; beyond, one for so many documents, so that each holds a bounded share.
PREFIX_FRAGMENTS = 128
DOCUMENTS_A_FRAGMENT = 4096
PAIR_KEY = ("a", "b", "a_doc", "b_doc", "a_n", "b_n")
#: Documents of one n-gram that are looked at pair by pair before any link is known.
LARGE_BUCKET = 512
#: Bits that tell which documents' sets are compared: 64 and more for each, in these bounds, as those whose bit is set in
#: vain are shuffled too; that costs work only.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 30


class Order:
    """The global order: slots by count, then n-grams by hash; and its cuts."""

    def __init__(self, counts: np.ndarray, percent: int, fragments: int):
        by_rank = np.argsort(counts, kind="stable")
        self.rank = np.empty(len(counts), dtype=np.int32)
        self.rank[by_rank] = np.arange(len(counts), dtype=np.int32)
        mass = np.cumsum(counts[by_rank]) / max(1, counts.sum())
        # Prefixes are about the first 1 - percent/100 of the order, so most cuts fall there; the rest is cut coarser.
        dense = min(1.0, 1.5 * (1 - percent / 100))
        many = max(1, fragments * 4 // 5)
        at = np.where(mass <= dense, mass / dense * many, many + (mass - dense) / max(1e-9, 1 - dense) * (fragments - many))
        self.prefix_fragment = np.minimum(at, fragments - 1).astype(np.int32)
        self.overlap_fragment = np.minimum(mass * OVERLAP_FRAGMENTS, OVERLAP_FRAGMENTS - 1).astype(np.int32)

    def ranks(self, ngrams: np.ndarray) -> np.ndarray:
        return self.rank[(ngrams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]

    def codes(self, ngrams: np.ndarray) -> np.ndarray:
        """N-grams in 32 bits that keep their order: ranks, and the next bits of the hashes. Different ones may be alike."""
        rest = (ngrams >> np.uint64(32)) & np.uint64((1 << (32 - SLOT_BITS)) - 1)
        return (self.ranks(ngrams).astype(np.uint32) << np.uint32(32 - SLOT_BITS)) | rest.astype(np.uint32)

    def sorted(self, ngrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A set in the global order, from one sorted by hash, and its ranks."""
        ranks = self.ranks(ngrams)
        at = np.argsort(ranks, kind="stable")
        return ngrams[at], ranks[at]


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, and where the last one ends."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def ngram_sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    texts = batch.column("text")
    for at in range(0, len(texts), 512):
        for ngrams in row_shingles(*word_hashes(texts.slice(at, 512), lower=True), width):
            yield np.unique(ngrams)


def slot_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many n-grams of all texts fall in each slot; the slots are a fixed number, whatever the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for ngrams in row_shingles(*word_hashes(batch.column("text").slice(at, 512), lower=True), width):
                    total += 0 if not len(ngrams) else np.bincount((ngrams >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["slot", "n"])

    found = texts.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return counts


def set_class(ngrams: np.ndarray) -> bytes:
    return hashlib.blake2b(ngrams.tobytes(), digest_size=16).digest()


def prefixes(texts: DataFrame, order: Order, width: int, percent: int) -> DataFrame:
    """For each row the size and class of its set, and as many first n-grams as any partner must share one of."""
    schema = arrow_schema(PREFIX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, firsts = [], [], []
            for ngrams in ngram_sets(batch, width):
                n = len(ngrams)
                sizes.append(n)
                classes.append(set_class(ngrams) if n else None)
                firsts.append(order.sorted(ngrams)[0][: n + (-percent * n // 100) + 1].tobytes() if n else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(firsts, pa.binary())], schema=schema)

    return texts.mapInArrow(run, schema=PREFIX)


def one_of_each_class(rows: DataFrame) -> DataFrame:
    """Of the rows of each class the one with the least doc_id. Prefixes are shuffled only of classes that repeat, and of
    those whose bit is set in vain."""
    some = rows.filter("n > 0")
    repeated = stored(some.groupBy("class").count().filter("count > 1").select("class"))
    if not repeated.limit(1).count():
        return some
    marked = has_bit(F.col("class"), marked_bits(repeated, "class"))
    least = some.filter(marked).groupBy("class").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("of"))
    return some.filter(~marked).select("class", "doc_id", "n", "prefix").union(least.select("class", "of.*"))


def prefix_segments(classes: DataFrame, order: Order) -> DataFrame:
    """A row for each class and fragment that its prefix has n-grams in; start: how many of the set come before."""
    schema = arrow_schema(SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, prefix, label in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "prefix", "label"))):
                tokens = np.frombuffer(prefix, dtype=np.uint64)
                fragment = order.prefix_fragment[order.ranks(tokens)]
                cut = runs(fragment)
                rows += [(int(fragment[s]), key, n, s, tokens[s:e].tobytes(), label) for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())]
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return classes.mapInArrow(run, SEGMENT)


def may_link(na, nb, i, j, percent: int) -> np.ndarray:
    """Whether sets of na and nb n-grams can link whose first shared one is at places i and j: what comes before is
    missing from the other, and a link allows only so much. Every pair that links shares a first n-gram, in the
    prefixes of both, so asking this at each shared n-gram loses none."""
    least = -(-percent * (na + nb) // (100 + percent))
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (i <= na - least) & (j <= nb - least)


def posting_runs(tokens: np.ndarray, own: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the rows of each n-gram that two and more documents hold; of n-grams that the same documents
    hold only the first in the order, as the places there decide what they decide at the others."""
    cut = runs(tokens)
    begin, end = cut[:-1], cut[1:]
    if not len(tokens):
        return begin[:0], end[:0]
    same = np.add.reduceat(mixed(own.astype(np.uint64) + np.uint64(1)), begin)
    some = np.flatnonzero(end - begin > 1)
    some = some[np.lexsort((place[begin[some]], end[some] - begin[some], same[some]))]
    fresh = np.ones(len(some), dtype=bool)
    fresh[1:] = (same[some][1:] != same[some][:-1]) | ((end - begin)[some][1:] != (end - begin)[some][:-1])
    return begin[some[fresh]], end[some[fresh]]


class Bucket:
    """The rows of one fragment, or of a part of it, by n-gram and length."""

    def __init__(self, table: pa.Table, percent: int):
        self.percent = percent
        self.n_row, self.key, label_row = (table[c].to_numpy() for c in ("n", "key", "label"))
        parts = [np.frombuffer(x, dtype=np.uint64) for x in table["tokens"].to_pylist()]
        own = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        place = np.concatenate([np.arange(s, s + len(p)) for s, p in zip(table["start"].to_pylist(), parts)]) if parts else np.zeros(0, np.int64)
        at = np.lexsort((self.key[own], self.n_row[own], tokens))
        self.tokens, self.own, self.place = tokens[at], own[at], place[at]
        self.n, self.label = self.n_row[self.own], label_row[self.own]
        self.visits = table["visits"].to_numpy(zero_copy_only=False)[self.own] if "visits" in table.column_names else None
        self.begin, self.end = posting_runs(self.tokens, self.own, self.place)

    def may_link(self, i, j) -> np.ndarray:
        return may_link(self.n[i], self.n[j], self.place[i], self.place[j], self.percent)

    def across(self, s: int, e: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows s to e of different labels that may link; where the fragment is dealt over parts, those of a
        row that visits and one of the part."""
        reach = np.searchsorted(self.n[s:e], -(-100 * self.n[s:e] // self.percent), "right") + s  # the first that is too long for each
        for at in range(s, e - 1, 64):
            i = np.arange(at, min(at + 64, e - 1))
            j = np.arange(at + 1, int(reach[i[-1] - s]))
            ok = (j > i[:, None]) & (self.label[j] != self.label[i][:, None])
            if self.visits is not None:
                ok &= self.visits[j] != self.visits[i][:, None]
            x, y = np.nonzero(ok)
            x, y = i[x], j[y]
            ok = self.may_link(x, y)
            yield x[ok], y[ok]

    def leaders(self, s: int, e: int) -> Iterator[tuple[int, np.ndarray]]:
        """The row with the fewest rarer n-grams, which is the likeliest to be what the others were made from, and those
        in reach of its length; then the same of the rest."""
        rest = np.arange(s, e)
        while len(rest):
            lead = rest[np.argmin(self.place[rest])]
            near = 100 * np.minimum(self.n[lead], self.n[rest]) >= self.percent * np.maximum(self.n[lead], self.n[rest])
            yield int(lead), rest[near & (rest != lead)]
            rest = rest[~near]


def bucket_pairs(table: pa.Table, percent: int, across: bool, schema: pa.Schema, large: int) -> pa.Table:
    """Candidate pairs of one fragment, of those whose lengths and places allow a link. across: all pairs of different
    labels; otherwise each n-gram's documents against their leaders. There, a row without b names a document that may
    link with one that it isn't compared with yet."""
    bucket = Bucket(table, percent)
    left, right, alone = [], [], []
    for s, e in zip(bucket.begin.tolist(), bucket.end.tolist()):
        if across:
            if (bucket.label[s:e] != bucket.label[s]).any():
                for i, j in bucket.across(s, e):
                    left.append(i)
                    right.append(j)
            continue
        for lead, j in bucket.leaders(s, e):
            j = j[bucket.may_link(lead, j)]
            left.append(np.minimum(lead, j))
            right.append(np.maximum(lead, j))
        if e - s > large:
            alone.append(np.arange(s, e))  # too many pairs to look at
        elif e - s > 2:
            alone += [x for both in bucket.across(s, e) for x in both]
    none = np.zeros(0, np.int64)
    i, j = (bucket.own[np.concatenate(x)] if x else none for x in (left, right))
    rows, key, n = len(bucket.key), bucket.key, bucket.n_row
    first, second = np.divmod(np.unique(np.minimum(i, j) * rows + np.maximum(i, j)), rows) if rows else (none, none)
    first, second = first[first != second], second[first != second]
    rest = np.setdiff1d(bucket.own[np.concatenate(alone)], np.concatenate([first, second])) if alone else none
    swap = key[first] > key[second]  # one order, so that a pair found in several parts is one
    first, second = np.where(swap, second, first), np.where(swap, first, second)
    first, second, gone = np.concatenate([first, rest]).tolist(), second.tolist(), [None] * len(rest)
    columns = [key[first], key[second].tolist() + gone, n[first], n[second].tolist() + gone]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def part_leaders(table: pa.Table, percent: int, schema: pa.Schema) -> pa.Table:
    """SEGMENT rows of the documents that lead an n-gram in a part, with the n-grams that they lead."""
    bucket, leads = Bucket(table, percent), {}
    for s, e in zip(bucket.begin.tolist(), bucket.end.tolist()):
        for lead, _ in bucket.leaders(s, e):
            leads.setdefault(int(bucket.own[lead]), []).append((int(bucket.place[lead]), int(bucket.tokens[lead])))
    # places of a row's n-grams follow one another, so each goes as a row of its own
    at = [(row, place, token) for row, found in leads.items() for place, token in found]
    of = table.take(pa.array([x[0] for x in at], pa.int64()))
    of = of.set_column(of.column_names.index("start"), "start", pa.array([x[1] for x in at], pa.int32()))
    of = of.set_column(of.column_names.index("tokens"), "tokens", pa.array([np.uint64(x[2]).tobytes() for x in at], pa.binary()))
    return of.select(schema.names).cast(schema)


def sharing(segments: DataFrame, percent: int) -> DataFrame:
    """PAIR rows without b of the documents that hold an n-gram which another one holds too, and that may link with one
    of its lengths. A part of a fragment doesn't see what its documents share with those of other parts; all that do are
    named, so that the second round compares them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, dtype=np.int64) for x in batch.column("tokens").to_pylist()]
            row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            place = np.concatenate([np.arange(s, s + len(p)) for s, p in zip(batch.column("start").to_pylist(), parts)]) if parts else row
            tokens = np.concatenate(parts) if parts else row
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(place, pa.int64()), *(batch.column(c).take(pa.array(row)) for c in ("key", "n"))], names=["token", "place", "key", "n"])

    postings = segments.mapInArrow(run, "token long, place long, key long, n long")
    held = postings.groupBy("token").agg(F.count("*").alias("documents"), F.min("n").alias("shortest")).filter("documents > 1").drop("documents")
    n, shortest = F.col("n"), F.greatest("shortest", F.ceil(F.col("n") * percent / 100))
    least = F.ceil((n + shortest) * percent / (100 + percent))
    gone = [F.lit(None).cast("long").alias(c) for c in ("b", "b_n")]
    of = postings.join(held, "token").filter(F.col("place") <= n - least).select(F.col("key").alias("a"), gone[0], n.alias("a_n"), gone[1])
    return of.distinct()


def fragment_rows(classes: DataFrame, order: Order) -> DataFrame:
    """(fragment, rows): how many classes have n-grams of their prefix in each fragment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(order.prefix_fragment.max(initial=0)) + 1, dtype=np.int64)
        for batch in batches:
            for prefix in batch.column("prefix").to_pylist():
                total[np.unique(order.prefix_fragment[order.ranks(np.frombuffer(prefix, dtype=np.uint64))])] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["fragment", "rows"])

    return classes.select("prefix").mapInArrow(run, "fragment int, rows long").groupBy("fragment").agg(F.sum("rows").alias("rows"))


def dealt(segments: DataFrame, hot: DataFrame) -> DataFrame:
    """Segments with the part and block that they go to and whether they visit; ``hot``: (fragment, parts, blocks, most)
    of the fragments that are dealt. Rows of the component of most rows go to their part's blocks, others to all parts
    too."""
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    block = F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    at_home = F.transform(upto("blocks"), lambda b: F.struct(own.alias("part"), b.alias("block"), F.lit(False).alias("visits")))
    away = F.transform(upto("parts"), lambda p: F.struct(p.alias("part"), block.alias("block"), F.lit(True).alias("visits")))
    places = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("block"), F.lit(None).cast("boolean").alias("visits"))))
    places = places.when(F.col("label") == F.col("most"), at_home).otherwise(F.concat(at_home, away))
    return segments.join(hot, "fragment", "left").withColumn("to", F.explode(places)).select(*segments.columns, "to.*")


def candidate_pairs(segments: DataFrame, percent: int, across: bool, large: int, rows: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """PAIR rows, each once. rows: (fragment, rows), not less than there are of each fragment."""
    schema, plain = arrow_schema(PAIR), arrow_schema(SEGMENT)
    pairs = lambda table: bucket_pairs(table, percent, across, schema, large)
    hot = rows.filter(F.col("rows") > most_rows).select("fragment", F.ceil(F.col("rows") / most_rows).cast("int").alias("parts"))
    if not hot.limit(1).count():
        return segments.groupBy("fragment").applyInArrow(pairs, PAIR).distinct()
    if not across:
        split = segments.join(hot, "fragment", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")), F.lit(0)))
        found = split.drop("parts").groupBy("fragment", "part").applyInArrow(pairs, PAIR)
        leading = split.filter("parts IS NOT NULL").drop("parts").groupBy("fragment", "part").applyInArrow(lambda table: part_leaders(table, percent, plain), SEGMENT)
        named = sharing(segments.join(F.broadcast(hot.select("fragment")), "fragment", "left_semi"), percent)
        return found.union(leading.groupBy("fragment").applyInArrow(pairs, PAIR)).union(named).distinct()
    labels = segments.join(hot.select("fragment"), "fragment", "left_semi").groupBy("fragment", "label").count()
    shares = labels.groupBy("fragment").agg(F.max_by("label", "count").alias("most"), F.sum("count").alias("all"), F.max("count").alias("top"))
    ways = stored(shares.join(hot, "fragment").select("fragment", "parts", F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("top")) / most_rows)).cast("int").alias("blocks"), "most"))
    spread = dealt(segments, ways)

    def either(table: pa.Table) -> pa.Table:
        return pairs(table.drop_columns(["visits"]) if table["visits"].null_count else table)

    return spread.groupBy("fragment", "part", "block").applyInArrow(either, PAIR).distinct()


def prefix_survivors(pairs: DataFrame, classes: DataFrame, order: Order, percent: int) -> DataFrame:
    """LIKELY rows of the pairs that can still link by their overlap in the first part of the order, as far as both
    prefixes reach: there, no more of either set may be missing from the other than a link allows in all. Prefixes meet
    as codes of half their size. Each code that only one has stands for an n-gram that the other doesn't have, so codes
    that are alike by chance keep a pair and never drop one."""
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.unique(order.codes(np.frombuffer(x, np.uint64))).tobytes() for x in batch.column("prefix").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "class", "doc_id")), pa.array(codes, pa.binary())], names=["key", "class", "doc_id", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("a_n", "b_n", "left", "right"))):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                least, last = -(-percent * (na + nb) // (100 + percent)), min(x[-1], y[-1])
                x, y = (codes[: np.searchsorted(codes, last, "right")] for codes in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(len(x) - shared <= na - least and len(y) - shared <= nb - least)
            yield batch.filter(pa.array(keep, pa.bool_())).select(list(PAIR_KEY))

    codes = classes.select("key", "class", "doc_id", "prefix").mapInArrow(coded, "key long, class binary, doc_id long, codes binary")
    of = lambda end, side: codes.select(F.col("key").alias(f"{end}_key"), F.col("class").alias(end), F.col("doc_id").alias(f"{end}_doc"), F.col("codes").alias(side))
    by_key = pairs.select(F.col("a").alias("a_key"), F.col("b").alias("b_key"), "a_n", "b_n")
    return by_key.join(of("a", "left"), "a_key").join(of("b", "right"), "b_key").select(*PAIR_KEY, "left", "right").mapInArrow(run, LIKELY)


def marked_bits(ends: DataFrame, key: str = "doc_id") -> np.ndarray:
    """A bit for the hash of every ``key``, gathered as bitmaps of a bounded total size."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (64 * ends.count()).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(size)) + 1  # bitmap positions count from 1
    parts = ends.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros(size // 8, dtype=np.uint8)
    for row in parts:
        bits[4096 * (row["part"] - 1) :][:4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    return bits


def has_bit(key: Column, bits: np.ndarray) -> Column:
    """Whether the bit of a key is set; those of ``marked_bits`` are, and a few others."""
    def run(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return F.pandas_udf(run, "boolean")(F.pmod(F.xxhash64(key), F.lit(8 * len(bits))))


def overlap_segments(texts: DataFrame, ends: DataFrame, order: Order, width: int) -> DataFrame:
    """The sets of marked documents, cut into the fragments that overlaps are counted in, keyed by class. No text is
    shuffled: each task passes over its own and skips what isn't marked."""
    bits = marked_bits(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            marked = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            batch, rows = batch.take(pa.array(np.flatnonzero(marked))), []
            for ngrams in ngram_sets(batch, width):
                if len(ngrams):
                    key, fragment = set_class(ngrams), order.overlap_fragment[order.ranks(ngrams)]
                    rows += [(key, f, ngrams[fragment == f].tobytes()) for f in np.unique(fragment).tolist()]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.binary()))], names=["class", "fragment", "segment"])

    return texts.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(8 * len(bits))).alias("place")).mapInArrow(run, "class binary, fragment int, segment binary")


def verified(pairs: DataFrame, texts: DataFrame, order: Order, width: int, percent: int) -> DataFrame:
    """The pairs that link: overlaps counted in each fragment of the whole sets, and summed. The first fragment, which has
    the rare n-grams, goes by itself: pairs of which it rules out that they link have no others brought together."""
    ends = pairs.select(F.col("a_doc").alias("doc_id")).union(pairs.select("b_doc")).distinct()
    sets = stored(overlap_segments(texts, ends, order, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, can_link = [], []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("a_n", "b_n", "left", "right"))):
                x, y = (np.frombuffer(z or b"", np.uint64) for z in (x, y))
                least, both = -(-percent * (na + nb) // (100 + percent)), len(np.intersect1d(x, y, assume_unique=True))
                shared.append(both)
                can_link.append(len(x) - both <= na - least and len(y) - both <= nb - least)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*PAIR_KEY, "fragment")), pa.array(shared, pa.int64()), pa.array(can_link, pa.bool_())], names=[*PAIR_KEY, "fragment", "shared", "can_link"])

    def overlaps(pairs: DataFrame, fragments: range) -> DataFrame:
        # pairs go with each fragment, so both joins have the same keys and the sets are shuffled once for the two
        each = pairs.select(*PAIR_KEY).withColumn("fragment", F.explode(F.array([F.lit(f) for f in fragments])))
        of = sets.filter(F.col("fragment").between(fragments[0], fragments[-1]))
        ours = of.select(F.col("class").alias("a"), "fragment", F.col("segment").alias("left"))
        theirs = of.select(F.col("class").alias("b"), "fragment", F.col("segment").alias("right"))
        met = each.join(ours, ["a", "fragment"], "left").join(theirs, ["b", "fragment"], "left").select(*PAIR_KEY, "fragment", "left", "right")
        partial = met.mapInArrow(run, f"{LIKELY}, fragment int, shared long, can_link boolean").filter("can_link")
        return partial.groupBy(*PAIR_KEY, "fragment").agg(F.max("shared").alias("shared"))  # sets of repeated rows are there more than once

    first = checkpoint(overlaps(pairs, range(1)))
    total = first.union(overlaps(first, range(1, OVERLAP_FRAGMENTS))).groupBy(*PAIR_KEY).agg(F.sum("shared").alias("shared"))
    return total.filter(F.col("shared") * 100 >= percent * (F.col("a_n") + F.col("b_n") - F.col("shared")))


def without_documents(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id isn't in ``ids`` (doc_id). Rows whose bit isn't set stay
    where they are; only the others are shuffled and looked up."""
    marked = has_bit(F.col(id_col).cast("long"), marked_bits(ids))
    gone = ids.select(F.col("doc_id").alias("_gone")).distinct()
    looked_up = docs.filter(marked)
    return docs.filter(~marked).union(looked_up.join(gone, looked_up[id_col] == gone["_gone"], "left_anti"))


def one_row_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of rows with the same id the least one by text and then the other columns; rows without an id all stay. Only rows
    whose id repeats, and those whose bit is set in vain, are shuffled."""
    repeated = stored(docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).count().filter("count > 1").select("doc_id"))
    if not repeated.limit(1).count():
        return docs
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    again = docs.join(repeated.withColumnRenamed("doc_id", "_again"), F.col(id_col) == F.col("_again"), "left_semi")
    one = again.groupBy(id_col).agg(F.min(F.struct(text_col, *others)).alias("_of"))
    return without_documents(docs, repeated, id_col).unionByName(one.select(id_col, "_of.*"))


def similarity_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", large_bucket: int = LARGE_BUCKET, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row that has a doc_id.

    Words are runs of bytes other than space and tab to carriage return, with A-Z in lower case. A set has the distinct
    n-grams of ``width`` words, or the whole of a shorter text as one. Two sets link when 100 times their intersection
    is at least ``percent`` times their union. component_id: the smallest doc_id that links reach, the row's own
    included. Texts that are null, empty or without words have no n-grams and no links. Repeated rows are equal texts;
    rows of one doc_id with different texts count as one document that has the links of all of them.
    """
    texts = keyed_text(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    order = Order(slot_counts(texts, width), percent, max(PREFIX_FRAGMENTS, texts.count() // DOCUMENTS_A_FRAGMENT))
    rows = stored(prefixes(texts, order, width, percent))
    classes = stored(one_of_each_class(rows).withColumn("key", F.monotonically_increasing_id()))
    sizes = stored(fragment_rows(classes, order))

    own = classes.withColumn("label", F.col("key"))
    first = stored(candidate_pairs(prefix_segments(own, order), percent, False, large_bucket, sizes, most_rows))
    pairs = first.filter("b IS NOT NULL")
    ends = stored(first.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    # no other prefixes are looked at from here on; stored, so that no stage runs this filter beside another Python step
    met = stored(classes.filter(has_bit(F.col("key"), marked_bits(ends, "key"))))
    likely = checkpoint(prefix_survivors(pairs, met, order, percent))
    links = checkpoint(verified(likely, texts, order, width, percent).select("a_doc", "b_doc"))
    labels = connected_components(links, "a_doc", "b_doc")
    open_ = ends.join(met.select("key", "doc_id"), "key").join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("key", F.coalesce("component", "doc_id").alias("label"))
    second = candidate_pairs(prefix_segments(met.join(open_, "key"), order), percent, True, large_bucket, sizes, most_rows).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    likely = checkpoint(prefix_survivors(second, met, order, percent))
    more = checkpoint(verified(likely, texts, order, width, percent).select("a_doc", "b_doc"))
    # Links across components join components, so only those go through again.
    of = labels.select(F.col("node").alias("doc"), "component")
    raised = more.join(of.withColumnsRenamed({"doc": "a_doc", "component": "a_component"}), "a_doc", "left").join(of.withColumnsRenamed({"doc": "b_doc", "component": "b_component"}), "b_doc", "left")
    joined = connected_components(raised.select(F.coalesce("a_component", "a_doc").alias("a"), F.coalesce("b_component", "b_doc").alias("b")))
    final = labels.select("node", "component").union(joined.join(labels, joined.node == labels.node, "left_anti").select("node", F.col("node").alias("component")))
    final = final.join(joined.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))

    by_class = classes.select("class", "doc_id").join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    by_class = by_class.select("class", F.coalesce("component", "doc_id").alias("component_id"))
    full = rows.filter("n > 0").select("doc_id", "n", "class").join(by_class, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.filter("n = 0").select("doc_id", "n", "doc_id"))
