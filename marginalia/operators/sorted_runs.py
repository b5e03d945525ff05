"""The least id among all texts that a text starts, by walks over ranges of the sorted texts.

Sorted, the texts that start with t are a run right after t. A walk keeps the texts whose run it is in: all of them start
the current text, so their lengths suffice. A run may go on in later ranges. For these, each range leaves its first and
last text, what is still open at its end, and for each length how far the run of its first text's prefix of that length
goes (whole ranges, or part of them) with the least id there. One task walks these rows, whose number depends on ranges
and not on texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from marginalia.streaming.tables import written

DONE, HEAD, LAST, STEP, OPEN = range(5)
BATCH = 1_000
#: Whole texts are sampled for the bounds of ranges and sent to the driver: a few for each range, not Spark's hundred.
SAMPLE, SAMPLED = "spark.sql.execution.rangeExchange.sampleSizePerPartition", 8
NAMES = ["part", "what", "hash", "size", "low", "first", "best", "text"]


def shared(a: bytes, b: bytes) -> int:
    """How many leading bytes are the same."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # the first ``low`` are the same, the first ``high`` are not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def least(*ids):
    return min((i for i in ids if i is not None), default=None)


def walk(rows: Iterator[tuple], part: int) -> Iterator[tuple]:
    """Rows as ``NAMES`` of one range's sorted (text, hash, first)."""
    open_, head, top, same, running = [], None, b"", 0, None  # open_: [length, hash, first, best]
    for text, digest, first in rows:
        if head is None:
            head, same = text, len(text)
        else:
            common = shared(top, text)
            while open_ and open_[-1][0] > common:
                _, done, own, best = open_.pop()
                if open_:
                    open_[-1][3] = least(open_[-1][3], own, best)
                if best is not None and best < own:
                    yield part, DONE, done, None, None, None, best, None
            if common < same:
                yield part, STEP, None, same, common, None, running, None
                same = common
        running, top = least(running, first), text
        open_.append([len(text), digest, first, None])
    if head is None:
        return
    yield part, STEP, None, same, 0, None, running, None
    yield part, HEAD, None, same, None, None, None, head
    yield part, LAST, None, None, None, None, None, top
    inside = None
    for size, digest, own, best in reversed(open_):
        inside = least(inside, best)
        yield part, OPEN, digest, size, None, own, inside, None
        inside = least(inside, own)


def settle(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(hash, best) of what ranges left open; rows by range, heads and last texts first."""
    carried, last = [], None  # carried: [length, hash, first, best], all of which start ``last``
    for _, own in groupby(rows, key=itemgetter(0)):
        head, covered, after, steps, opened = b"", 0, None, [], []
        for _, what, digest, size, low, first, best, text in own:
            if what == HEAD:
                head, covered = text, size
            elif what == LAST:
                after = text
            elif what == STEP:
                steps.append((low, size, best))
            else:
                opened.append([size, digest, first, best])
        common = shared(last, head) if last is not None else 0
        kept = []
        for entry in carried:
            size = entry[0]
            if size <= common:
                entry[3] = least(entry[3], next(best for low, high, best in steps if low < size <= high))
                if size <= covered:
                    kept.append(entry)
                    continue
            if entry[3] is not None and entry[3] < entry[2]:
                yield entry[1], entry[3]
        carried, last = kept + opened, after
    for _, digest, first, best in carried:
        if best is not None and best < first:
            yield digest, best


def least_in_runs(texts: DataFrame, ranges: int | None = None) -> DataFrame:
    """(hash, best): for each text the least ``first`` of the texts that it starts and isn't, where that is below its own.
    ``texts``: text (binary), hash, first, each text once; a table that gives the same rows when it is read again."""
    kind = texts.schema["first"].dataType.simpleString()
    schema = f"part long, what int, hash binary, size long, low long, first {kind}, best {kind}, text binary"

    def batches_of(found: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        while held := list(islice(found, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held), types)], names=names)

    def rows_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
        return (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names)))

    ids = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = walk(rows_of(batches, ["text", "hash", "first"]), TaskContext.get().partitionId())
        yield from batches_of(found, NAMES, [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), ids, ids, pa.binary()])

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(settle(rows_of(batches, NAMES)), ["hash", "best"], [pa.binary(), ids])

    dealt = texts.repartitionByRange(ranges, "text") if ranges else texts.repartitionByRange("text")
    conf = texts.sparkSession.conf
    before = conf.get(SAMPLE)
    conf.set(SAMPLE, SAMPLED)
    try:
        runs = written(dealt.sortWithinPartitions("text").mapInArrow(first_pass, schema), "prefix-runs")
    finally:
        conf.set(SAMPLE, before)
    ends = runs.filter(f"what <> {DONE}").repartition(1).sortWithinPartitions("part", "what")
    return runs.filter(f"what = {DONE}").select("hash", "best").unionByName(ends.mapInArrow(second_pass, f"hash binary, best {kind}"))
