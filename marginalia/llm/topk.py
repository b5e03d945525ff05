"""Exact top-k search by inner product: a dual-tree traversal of cover trees.

Vectors are dealt to cells by the nearest of some centres, which farthest-first selection takes from a bounded sample,
and large cells to blocks by hash. A block's task indexes its candidates in one cover tree and its queries, which come
in bounded chunks, in another. Nodes of a cover tree are points: the centre is a child of itself (nesting), children lie
apart by more than the next smaller radius (separation), and all points of a node lie within it (covering); a node has
as many children as that takes. With <c, c'> of two centres and their covering radii r and r', no score of the two
nodes' points exceeds <c, c'> + r |c'| + r' |c| + r r'. A pair of nodes is left out where that is below the worst kth
score of the queries under the query node; in query leaves each query has a bound of its own.

Every query first meets the block of its own cell. What it finds there is its kth score wherever it goes next: cells
whose bound lies below are left out before the shuffle, and in the blocks that stay pruning starts from it. Candidates
move once a round and queries to the blocks that may have better partners. A block's candidates have a bounded number
and queries stream past them, so memory doesn't grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_schema, shuffle_width, stored

#: A node's points are covered by children of this part of its radius.
BASE = 1.3
LEAF = 4
#: Queries whose leaves go together, at most.
TOGETHER = 8
#: Points that a net grows by at once, and that a query leaf is multiplied with at once.
STEP = 256
#: Candidates of a block: as many as give each shuffle partition one, within these bounds.
LEAST_BLOCK, MOST_BLOCK = 1024, 32_768
QUERIES_AT_ONCE = 1024
#: Rows for other blocks that a task makes at once.
PENDING = 4096
#: Vectors that centres are taken from (those whose vec_id has the least hash), and centres of one length, at most.
SAMPLE_ROWS, MOST_CELLS = 1024, 256
EXACT = 2.0**53
LONG = (-(2**63), 2**63 - 1)
NONE = -np.inf
PLACED = "vec_id long, vector array<bigint>, dim int, asks boolean, cell int, away double"
WANTED = "dim int, cell int, sub int, vec_id long, vector array<bigint>, least double, asks boolean"
FOUND = "query_id long, vec_id long, score long, rough double"
COUNTS = "dim int, cell int, sub int, queries long, candidates long, pairs long, pruned long, products long"


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0))


def net(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(members, home): points farther apart than ``radius``, the first one among them, that leave none farther from
    all of them than that; and for each point the nearest member's place."""
    members = np.zeros(1, dtype=np.int64)
    for at in range(0, len(points), STEP):
        part = points[at : at + STEP]
        free = np.flatnonzero(gaps(part, points[members]).min(axis=1) > radius)
        apart = gaps(part[free], part[free]) > radius
        left, taken = np.ones(len(free), dtype=bool), []
        for i in range(len(free)):
            if left[i]:
                taken.append(i)
                left &= apart[i]
        members = np.concatenate([members, free[taken] + at])
    home = np.full(len(points), -1)
    home[members] = np.arange(len(members))
    others = np.flatnonzero(home < 0)
    for at in range(0, len(others), STEP):
        some = others[at : at + STEP]
        home[some] = gaps(points[some], points[members]).argmin(axis=1)
    return members, home


class CoverTree:
    """Arrays over nodes: centre, norm, radius, the points below as start to end in tree order, children as low to
    high. Node 0 is the root; a node without children is a leaf."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.start, self.end, self.low, self.high, centre, self.radius = [0], [len(points)], [0], [0], [0], [0.0]
        node = 0
        while node < len(self.start):
            s, e = self.start[node], self.end[node]
            at = self.order[s:e].copy()
            own = points[at]
            away = np.linalg.norm(own - points[centre[node]], axis=1)
            self.radius[node] = float(away.max()) * (1 + 1e-9)
            self.low[node] = self.high[node] = len(self.start)
            if e - s > LEAF and self.radius[node] > 0:
                first = int(away.argmin())  # the centre, or a point equal to it
                at[[0, first]], own[[0, first]] = at[[first, 0]], own[[first, 0]]
                members, home = net(own, self.radius[node] / BASE)
                if len(members) > 1:
                    sort = np.lexsort((~np.isin(np.arange(len(own)), members), home))
                    self.order[s:e] = at[sort]
                    cuts = np.concatenate([[0], np.cumsum(np.bincount(home, minlength=len(members)))])
                    self.start += (s + cuts[:-1]).tolist()
                    self.end += (s + cuts[1:]).tolist()
                    centre += at[members].tolist()
                    for values in (self.low, self.high, self.radius):
                        values += [0] * len(members)
                    self.high[node] = len(self.start)
            node += 1
        self.start, self.end, self.low, self.high, self.radius = map(np.array, (self.start, self.end, self.low, self.high, self.radius))
        self.points, self.centre = points[self.order], points[centre]
        self.norm = np.linalg.norm(self.centre, axis=1) if len(points) else np.zeros(1)
        self.norms = np.linalg.norm(self.points, axis=1)


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from each low to below its high, one range after another."""
    size = high - low
    return np.repeat(high - np.cumsum(size), size) + np.arange(size.sum())


class BestK:
    """The k best scores of each query so far, ties to the smaller id, and the kth score known beforehand. wide: scores
    are Python's integers, for those beyond the doubles' ones."""

    def __init__(self, least: np.ndarray, k: int, wide: bool):
        self.wide, self.least = wide, least
        self.scores = np.full((len(least), k), NONE, dtype=object if wide else np.float64)
        self.ids = np.full((len(least), k), np.iinfo(np.int64).max)

    def kth(self, rows: slice) -> np.ndarray:
        return np.maximum(self.scores[rows, -1].astype(np.float64), self.least[rows])

    def add(self, rows: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero(scores.max(axis=1) >= self.scores[rows, -1]) + rows.start
        if not len(at):
            return
        both = np.concatenate([self.scores[at], scores[at - rows.start]], axis=1)
        names = np.concatenate([self.ids[at], np.broadcast_to(ids, (len(at), len(ids)))], axis=1)
        k = self.scores.shape[1]
        if self.wide:
            best = np.array([sorted(range(len(b)), key=lambda j: (-b[j], n[j]))[:k] for b, n in zip(both, names)])
        else:
            best = np.lexsort((names, -both), axis=-1)[:, :k]
        self.scores[at] = np.take_along_axis(both, best, axis=1)
        self.ids[at] = np.take_along_axis(names, best, axis=1)


def with_margin(most: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bounds that rounding can't bring below a score."""
    return most + 1e-9 * (np.abs(most) + size) + 1e-6


class DualSearch:
    """The candidates of one block, searched by chunks of queries. pairs, pruned: node pairs met and left out; products:
    inner products made, with centres and with points."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int):
        self.tree, self.k = CoverTree(vectors.astype(np.float64)), k
        self.vectors, self.ids = vectors[self.tree.order], ids[self.tree.order]
        self.largest = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        self.pairs = self.pruned = self.products = 0

    def search(self, vectors: np.ndarray, ids: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, BestK]:
        """(the queries' order, their best). Pairs of one id don't count."""
        left, right = CoverTree(vectors.astype(np.float64)), self.tree
        vectors, ids = vectors[left.order], ids[left.order]
        wide = self.largest * float(np.abs(left.points).max(initial=0)) * max(1, vectors.shape[1]) >= EXACT
        best = BestK(least[left.order], self.k, wide)
        todo = [(0, np.zeros(1, dtype=np.int64))]
        while todo:
            q, near = todo.pop()
            rows = slice(int(left.start[q]), int(left.end[q]))
            most = right.centre[near] @ left.centre[q] + left.radius[q] * right.norm[near] + right.radius[near] * left.norm[q] + left.radius[q] * right.radius[near]
            self.products += len(near)
            near = near[self._kept(with_margin(most, left.norm[q] * right.norm[near]) >= best.kth(rows).min())]
            children = np.arange(left.low[q], left.high[q])
            if left.end[q] - left.start[q] <= TOGETHER or not len(children):
                self._leaf(left, rows, near, best, vectors, ids)
                continue
            split = (right.high[near] > right.low[near]) & (right.radius[near] >= left.radius[q])
            near = np.concatenate([near[~split], ranges(right.low[near[split]], right.high[near[split]])])
            alone = left.high[children] == left.low[children]
            todo += [(child, near) for child in children[~alone].tolist()]
            for s, e in chunks(left.start[children[alone]], left.end[children[alone]], TOGETHER):  # leaves side by side go together
                self._leaf(left, slice(s, e), near, best, vectors, ids)
        return left.order, best

    def _kept(self, keep: np.ndarray) -> np.ndarray:
        self.pairs += len(keep)
        self.pruned += int(len(keep) - keep.sum())
        return keep

    def _leaf(self, left: CoverTree, rows: slice, near: np.ndarray, best: BestK, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Each query with a bound of its own. A centre is its node's first point and its first child's centre, so what
        is known of it goes on."""
        right, own, norms = self.tree, left.points[rows], left.norms[rows][:, None]
        dots = self._dots(own, right.centre[near])
        leaves, known = [near[:0]], [dots[:, :0]]
        over = lambda near, dots: with_margin(dots + norms * right.radius[near], norms * right.norm[near]) - best.kth(rows)[:, None]
        while len(near):
            keep = self._kept((over(near, dots) >= 0).any(axis=0))
            near, dots = near[keep], dots[:, keep]
            inner = right.high[near] > right.low[near]
            leaves.append(near[~inner])
            known.append(dots[:, ~inner])
            low, high, dots = right.low[near[inner]], right.high[near[inner]], dots[:, inner]
            near = ranges(low, high)
            first = np.cumsum(high - low) - (high - low)
            rest = np.ones(len(near), dtype=bool)
            rest[first] = False
            below = np.empty((len(own), len(near)))
            below[:, first], below[:, rest] = dots, self._dots(own, right.centre[near[rest]])
            dots = below
        near, dots = np.concatenate(leaves), np.concatenate(known, axis=1)
        sort = np.argsort(-over(near, dots).max(axis=0), kind="stable")  # likeliest first, so that the others can go
        near, dots = near[sort], dots[:, sort]
        size = right.end[near] - right.start[near]
        for s, e in chunks(np.cumsum(size) - size, np.cumsum(size), STEP):
            a, b = np.searchsorted(np.cumsum(size), [s, e], "right")
            some, held = near[a:b], dots[:, a:b]
            if a:  # the kth scores have grown since
                keep = self._kept((over(some, held) >= 0).any(axis=0))
                some, held = some[keep], held[:, keep]
            centre, others = right.start[some], ranges(right.start[some] + 1, right.end[some])
            cols = np.concatenate([centre, others])
            if not len(cols):
                continue
            if best.wide:
                scores = vectors[rows].astype(object) @ self.vectors[cols].T.astype(object) if vectors.shape[1] else np.zeros((len(own), len(cols)), dtype=object)
            else:
                scores = np.concatenate([held, self._dots(own, right.points[others])], axis=1)
            scores[ids[rows, None] == self.ids[None, cols]] = NONE
            best.add(rows, scores, self.ids[cols])

    def _dots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        self.products += len(a) * len(b)
        return a @ b.T


def chunks(start: np.ndarray, end: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Neighbouring ranges, in order, joined up to a size where one isn't larger by itself."""
    a = b = None
    for s, e in zip(start.tolist(), end.tolist()):
        if a is not None and (s != b or e - a > size):
            yield a, b
            a = s
        a, b = (s if a is None else a), e
    if a is not None:
        yield a, b


def matrix(vectors: pa.Array, rows: int) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def search_blocks(rows: DataFrame, k: int, counts: bool = False) -> DataFrame:
    """FOUND for rows of WANTED, or COUNTS of each block. In each block candidates come first, then its queries."""
    schema = arrow_schema(COUNTS if counts else FOUND)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, queries = [], None, 0
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            held.append(batch.filter(pa.array(~asks)).select(["vec_id", "vector"]))
            asked = batch.filter(pa.array(asks))
            for at in range(0, asked.num_rows, QUERIES_AT_ONCE):
                if block is None:
                    table = pa.Table.from_batches(held)
                    if not table.num_rows:
                        return
                    block = DualSearch(matrix(table["vector"], table.num_rows), table["vec_id"].to_numpy(), k)
                some = asked.slice(at, QUERIES_AT_ONCE)
                ids = some.column("vec_id").to_numpy()
                order, best = block.search(matrix(some.column("vector"), some.num_rows), ids, some.column("least").to_numpy())
                queries += some.num_rows
                there = best.scores > NONE
                scores = best.scores[there].tolist()
                if not counts:
                    columns = [np.broadcast_to(ids[order][:, None], there.shape)[there], best.ids[there], [min(max(int(s), LONG[0]), LONG[1]) for s in scores], list(map(float, scores))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
        if counts and block:
            row = [*(x.as_py() for x in key), queries, len(block.ids), block.pairs, block.pruned, block.products]
            yield pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip(row, schema)], schema=schema)

    keys = ["dim", "cell", "sub"]
    dealt = rows.repartition(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys, "asks")
    return dealt.groupBy(*keys).applyInArrow(run, COUNTS if counts else FOUND)


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """floor(scale * x) of every component, the nearest long where that is beyond one; vectors that are null or hold a
    null, NaN or infinite component drop out."""
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("raw"))
    bad = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = whole.filter(F.col("vec_id").isNotNull() & F.col("raw").isNotNull() & ~bad)
    return fine.select("vec_id", F.transform("raw", lambda x: F.floor(x * scale).cast("long")).alias("vector"))


def sampled_centres(vectors: DataFrame, cells: int) -> dict[int, np.ndarray]:
    """For each vector length some centres, each the vector of the sample that is farthest from those before."""
    sample: dict[int, list] = {}
    for (vector,) in vectors.orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS).select("vector").collect():
        sample.setdefault(len(vector), []).append(vector)
    out = {}
    for dim, rows in sample.items():
        points = np.array(rows, dtype=np.float64).reshape(len(rows), dim)
        picks, nearest = [0], np.full(len(points), np.inf)
        while len(picks) < cells:
            nearest = np.minimum(nearest, np.linalg.norm(points - points[picks[-1]], axis=1))
            if nearest.max() == 0:
                break
            picks.append(int(nearest.argmax()))
        out[dim] = points[picks]
    return out


def centres_of(centres: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """Lengths that the sample lacks have one cell, about the origin."""
    return centres.get(dim, np.zeros((1, dim)))


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors as doubles) of a batch."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, matrix(batch.column("vector").take(pa.array(at)), len(at)).astype(np.float64)


def placed(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Adds the nearest centre's number and the distance to it."""
    schema = arrow_schema(PLACED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            for dim, at, own in by_dim(batch):
                middle = centres_of(centres, dim)
                cell[at] = gaps(own, middle).argmin(axis=1)
                away[at] = np.linalg.norm(own - middle[cell[at]], axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "vector", "dim", "asks")), pa.array(cell), pa.array(away)], schema=schema)

    return vectors.mapInArrow(run, PLACED)


def elsewhere(queries: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """WANTED rows of queries for every block but their own whose cell may hold a better score than their kth."""
    schema = arrow_schema(WANTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = batch.column("least").to_numpy()
            for dim, at, own in by_dim(batch):
                middle, norms = centres_of(centres, dim), np.linalg.norm(own, axis=1)
                scores, sizes = own @ middle.T, norms[:, None] * np.linalg.norm(middle, axis=1)
                there = batch.column("cells")[int(at[0])].as_py()  # those of the length, alike in all its rows
                cells, subs, radius = (np.array([t[f] for t in there]) for f in ("cell", "subs", "radius"))
                first, homes, own_subs = np.cumsum(subs) - subs, batch.column("cell").to_numpy()[at], batch.column("sub").to_numpy()[at]
                some = max(1, PENDING // int(subs.sum()))
                for a in range(0, len(at), some):
                    rows = slice(a, a + some)
                    better = with_margin(scores[rows][:, cells] + norms[rows, None] * radius * (1 + 1e-9), sizes[rows][:, cells]) >= least[at[rows], None]
                    query, cell = np.nonzero(better)
                    blocks = ranges(first[cell], first[cell] + subs[cell])  # each cell's blocks, numbered through
                    query, cell = np.repeat(query, subs[cell]), np.repeat(cell, subs[cell])
                    sub = blocks - first[cell]
                    away = (cells[cell] != homes[rows][query]) | (sub != own_subs[rows][query])
                    query, cell, sub = query[away], cell[away], sub[away]
                    for low in range(0, len(query), PENDING):
                        part = slice(low, low + PENDING)
                        took = pa.array(at[rows][query[part]])
                        columns = [pa.array(np.full(len(took), dim, dtype=np.int32)), pa.array(cells[cell[part]].astype(np.int32)), pa.array(sub[part].astype(np.int32)), *(batch.column(c).take(took) for c in ("vec_id", "vector", "least")), pa.array(np.ones(len(took), dtype=bool))]
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return queries.mapInArrow(run, WANTED)


def rounds(vectors: DataFrame, is_query: Column, k: int, scale: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first, found, second): WANTED rows of the round in the queries' own cells, what that finds, and the rows of the
    round in other cells."""
    whole, width = quantised(vectors, scale, id_col, vector_col), shuffle_width(vectors.sparkSession)
    rows = whole.count()
    block = min(MOST_BLOCK, max(LEAST_BLOCK, -(-rows // width)))
    centres = sampled_centres(whole, min(MOST_CELLS, max(1, rows // block)))
    one = whole.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    dealt = stored(placed(one.select("vec_id", "vector", F.size("vector").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks")), centres))

    cells = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("subs"), F.max("away").alias("radius"))
    inside = dealt.join(cells.select("dim", "cell", "subs"), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int"))
    plain = lambda df, least, asks: df.select("dim", "cell", "sub", "vec_id", "vector", least.alias("least"), F.lit(asks).alias("asks"))
    none = F.lit(float("-inf"))
    candidates = plain(inside, none, False)
    first = candidates.union(plain(inside.filter("asks"), none, True))
    found = stored(search_blocks(first, k))

    kth = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("rough")).alias("least"))
    reach = cells.groupBy("dim").agg(F.collect_list(F.struct("cell", "subs", "radius")).alias("cells"))  # MOST_CELLS at most
    asking = inside.filter("asks").join(kth, "vec_id", "left").join(reach, "dim")
    asking = asking.select("vec_id", "vector", "dim", "cell", "sub", F.coalesce("least", none).alias("least"), "cells")
    return first, found, candidates.union(elsewhere(asking, centres))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of every query with all rows but its own.

    ``is_query``: a column over ``vec_id``. Ties go to the smaller vec_id; a query with fewer than k partners has all of
    them. A vec_id that repeats counts once, with its smallest vector. Vectors meet only those of their own length.
    Scores beyond a long are given as the nearest long, and rank by their doubles. Null, null-holding and non-finite
    vectors and rows without an id take no part; an empty table gives no rows.
    """
    _, found, second = rounds(vectors, is_query, k, scale, id_col, vector_col)
    every = found.union(search_blocks(second, k))
    best = W.partitionBy("query_id").orderBy(F.col("rough").desc(), F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_counts(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(round, dim, cell, sub, queries, candidates, pairs, pruned, products) of every block that ``top_k`` searches."""
    first, _, second = rounds(vectors, is_query, k, scale, id_col, vector_col)
    one, two = (search_blocks(rows, k, counts=True).select(F.lit(i).alias("round"), "*") for i, rows in ((1, first), (2, second)))
    return one.union(two)
