"""Vector codes: product quantisation by Ball k-means over integer components.

Every vector is cut into consecutive parts, each with a codebook of its own. The parts at one entry are a ball, whose
radius is the greatest distance of any of them to the entry. Entries within twice that radius are its neighbours; no
other can be nearer to any part of the ball. A part at distance r from its entry has only the neighbours within 2r as
candidates: sorted by distance, neighbours divide the ball into a core, whose parts stay, and rings, whose parts are
compared with the neighbours up to their ring. A ball whose entry and neighbours have all stayed where they were isn't
looked at again. Halves of distances never occur: squares are compared with four times squares, so all is exact, and
where two entries are equally far the lower index wins.

A task's vectors make balls of their own, block by block, so no pass over all rows is needed for the radii. Each round
writes the assignments, then only parts that moved change the codebooks' sums, which are as large as the codebooks: that
is what goes to the driver and to tasks, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marginalia.llm.common import arrow_schema, stored

#: Vectors that make balls together.
BLOCK = 1 << 16
#: Components are cut here, so that squared distances of up to 8,192 components are exact in 64 bits.
LARGEST = 1 << 24
#: Whole numbers below this are exact in doubles.
EXACT = 1 << 53
#: What a round writes beside a row's id and label: its vector, the nearest entry of each part, the squared distances to
#: these, and the entries of the round before.
STATE = "vector array<int>, entries array<int>, away array<bigint>, before array<int>"


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all integer points to all integer entries."""
    widest = 2 * max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if points.shape[1] * int(widest) ** 2 < EXACT:
        points, entries = points.astype(np.float64), entries.astype(np.float64)
    own, other = (points * points).sum(axis=1), (entries * entries).sum(axis=1)
    return (own[:, None] + other[None, :] - 2 * (points @ entries.T)).astype(np.int64)


class Balls:
    """One part's codebook: which entries lie how near to each other, and which have moved since the last round."""

    def __init__(self, entries: np.ndarray, last: np.ndarray | None):
        self.entries = entries
        self.moved = np.ones(len(entries), dtype=bool) if last is None else (entries != last).any(axis=1)
        gaps = squared_distances(entries, entries)
        self.nearest = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.nearest, axis=1)
        #: Distances worked out, for reports.
        self.made = 0

    def first(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point, and how far that is."""
        gaps = squared_distances(points, self.entries)
        self.made += gaps.size
        entry = gaps.argmin(axis=1)
        return entry, gaps[np.arange(len(points)), entry]

    def again(self, points: np.ndarray, entry: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``first``, from the nearest entries before these moved and the distances to them."""
        entry, away = entry.copy(), away.copy()
        order = np.argsort(entry, kind="stable")
        cuts = np.searchsorted(entry[order], np.arange(len(self.entries) + 1))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            ball = order[cuts[i] : cuts[i + 1]]
            if self.moved[i]:
                gone = points[ball] - self.entries[i]
                away[ball] = (gone * gone).sum(axis=1)
                self.made += len(ball)
            own = away[ball]
            neighbours = self.nearest[i, : np.searchsorted(self.gaps[i], 4 * own.max(), side="right")]
            if not self.moved[neighbours].any():
                continue  # neither the entry, which is its own neighbour, nor any other has moved
            ring = np.searchsorted(self.gaps[i, : len(neighbours)], 4 * own, side="right")
            for low in 2 ** np.arange(1, int(ring.max()).bit_length()):
                at = ball[(ring >= low) & (ring < 2 * low)]
                if len(at):
                    candidates = np.sort(neighbours[: 2 * low - 1])
                    gaps = squared_distances(points[at], self.entries[candidates])
                    self.made += gaps.size
                    best = gaps.argmin(axis=1)
                    entry[at], away[at] = candidates[best], gaps[np.arange(len(at)), best]
        return entry, away


def part_bounds(dim: int, parts: int) -> list[int]:
    """Where each of the parts starts, and where the last one ends; they differ by one component at most."""
    return [p * dim // parts for p in range(parts + 1)]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of a task, some thousand rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list of each row."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.reshape(-1), type=kind))


def numbers(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of a column of lists of one length."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def assigned(state: DataFrame, books: list[np.ndarray], last: list[np.ndarray] | None) -> DataFrame:
    """id, label and STATE with each part at the nearest entry of ``books``; ``last``: those that ``state`` was assigned
    to."""
    fields = [state.schema["id"], state.schema["label"], *StructType.fromDDL(STATE).fields]
    schema, bounds = to_arrow_schema(StructType(fields)), np.cumsum([0] + [b.shape[1] for b in books]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [Balls(b, last[p] if last else None) for p, b in enumerate(books)]
        for table in blocks(batches):
            vectors = numbers(table["vector"], bounds[-1])
            cut = [vectors[:, a:b] for a, b in zip(bounds, bounds[1:])]
            if last is None:
                made = [b.first(x) for b, x in zip(balls, cut)]
                before = pa.nulls(len(vectors), pa.list_(pa.int32()))
            else:
                entries, away = numbers(table["entries"], len(books)), numbers(table["away"], len(books))
                made = [b.again(x, entries[:, p], away[:, p]) for p, (b, x) in enumerate(zip(balls, cut))]
                before = lists(entries, pa.int32())
            columns = [*(table[c].combine_chunks() for c in ("id", "label", "vector")), lists(np.stack([m[0] for m in made], axis=1), pa.int32()), lists(np.stack([m[1] for m in made], axis=1), pa.int64()), before]
            yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema).to_batches(max_chunksize=8192)

    return state.mapInArrow(run, StructType(fields))


def moved_sums(state: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """(part, entry) to how the number of its parts and the sums of their components changed in this round. One row for
    each entry comes from a task, and one for each in all."""
    bounds, sizes = np.cumsum([0] + [b.shape[1] for b in books]).tolist(), [len(b) for b in books]
    schema = arrow_schema("part int, entry int, n long, sums array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(k, dtype=np.int64) for k in sizes]
        total = [np.zeros(b.shape, dtype=np.int64) for b in books]
        for batch in batches:
            table = pa.Table.from_batches([batch])
            vectors, now = numbers(table["vector"], bounds[-1]), numbers(table["entries"], len(books))
            known = table["before"].is_valid()
            was = np.full(now.shape, -1)
            was[known.to_numpy()] = numbers(table["before"].filter(known), len(books))
            for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
                changed = np.flatnonzero(now[:, p] != was[:, p])
                left = changed[was[changed, p] >= 0]
                for rows, entry, sign in ((changed, now[changed, p], 1), (left, was[left, p], -1)):
                    np.add.at(count[p], entry, sign)
                    np.add.at(total[p], entry, sign * vectors[rows, a:b])
        for p, k in enumerate(sizes):
            columns = [np.full(k, p, dtype=np.int32), np.arange(k, dtype=np.int32), count[p], lists(total[p], pa.int64())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)

    moved = state.filter(F.col("before").isNull() | (F.col("before") != F.col("entries"))).select("vector", "entries", "before")
    partial = moved.mapInArrow(run, "part int, entry int, n long, sums array<bigint>")
    each = partial.select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "x"))
    whole = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    rows = whole.groupBy("part", "entry").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "x"))).alias("sums")).collect()  # as many as there are entries
    return {(r["part"], r["entry"]): (r["n"], np.array([s["x"] for s in r["sums"] if s["at"] is not None], dtype=np.int64)) for r in rows}


def first_entries(whole: DataFrame, k: int) -> list[list[int]]:
    """The vectors of the k smallest ids, ascending. Of rows with one id the least vector stands for it."""
    ids = whole.filter("id IS NOT NULL").select("id").distinct().orderBy("id").limit(k)
    low = [r[0] for r in ids.collect()]
    if not low:
        return []
    least = whole.filter(F.col("id") <= low[-1]).groupBy("id").agg(F.min("vector").alias("vector"))
    return [r["vector"] for r in sorted(least.collect())]


def trained(whole: DataFrame, parts: int, k: int, rounds: int) -> tuple[DataFrame | None, list[np.ndarray]]:
    """(STATE, codebooks) after the rounds and a last assignment; ``whole``: id, label and integer vector."""
    start = first_entries(whole, k)
    if not start:
        return None, []
    dim = len(start[0])
    alike = [v for v in start if len(v) == dim]
    entries = np.array(alike, dtype=np.int64).reshape(len(alike), dim)
    bounds = part_bounds(dim, parts)
    books = [entries[:, a:b] for a, b in zip(bounds, bounds[1:])]
    state = whole.filter(F.size("vector") == dim).select("id", "label", "vector")
    last: list[np.ndarray] | None = None
    count = [np.zeros(len(b), dtype=np.int64) for b in books]
    total = [np.zeros(b.shape, dtype=np.int64) for b in books]
    for _ in range(rounds):
        state = stored(assigned(state, books, last))
        for (p, entry), (n, sums) in moved_sums(state, books).items():
            count[p][entry] += n
            total[p][entry] += sums
        last = books
        books = [np.where(n[:, None] > 0, t // np.maximum(n, 1)[:, None], b) for n, t, b in zip(count, total, books)]
    return stored(assigned(state, books, last)), books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def whole_components(raw: Column, scale: int) -> Column:
    """floor(scale * x) of each, within ``LARGEST``."""
    return F.transform(raw, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))


def vector_codes(vectors: DataFrame, parts: int = 4, k: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, label, code, error, label_error, codebooks_sha256) of every row with a vector of finite components.

    code: the nearest entry's index in each part's codebook, two hex digits each. error: squared distances, summed over
    the parts; label_error: the errors of all rows of one label, rows without a label together (the greatest long where
    the sum is beyond it). Codebooks start as the parts of the k smallest ids' vectors (fewer, if there are fewer ids)
    and are replaced ``rounds`` times.

    Vectors that are null or hold nulls, NaN or infinite components drop out. Components are cut at ``LARGEST``. The
    vector of the smallest id sets the length; vectors of other lengths have no code and no error. Lengths that ``parts``
    doesn't divide are cut as evenly as they can. Repeated rows are coded each by itself; of an id that repeats the least
    vector is the entry. Rows without an id are coded too. Without any id, and of an empty table, no row comes out.
    """
    if k > 256:
        raise ValueError("an index has two hex digits")
    raw = F.col(vector_col).cast("array<double>")
    bad = F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = stored(vectors.filter(raw.isNotNull() & ~bad).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole_components(raw, scale).alias("vector")))
    state, books = trained(whole, parts, k, rounds)
    code = F.array_join(F.transform("entries", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")), "")
    error = F.aggregate("away", F.lit(0).cast("long"), lambda a, x: a + x)
    none = F.lit(None)
    odd = whole.filter(F.size("vector") != sum(b.shape[1] for b in books)).select("id", "label", none.cast("string").alias("code"), none.cast("long").alias("error"))
    coded = state.select("id", "label", code.alias("code"), error.alias("error")).unionByName(odd) if state is not None else odd.limit(0)
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), most).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
