"""A Merkle manifest of a dataset: a content-addressed DAG of digests, descended to prove single rows.

Every row is a leaf, each group's leaves are a tree, and the groups' roots are the leaves of one more tree, whose root
stands for the dataset. A node is the digest of up to ``FAN`` children. What is stored are records, from a node's digest
to its children's; nothing else leads from a root to a leaf. A leaf is asked for by its rank: the rank's digits to the
base ``FAN`` name the child to go to at each level. The children not selected on the way are the proof; they come root
first, so each stretch of the way is a path segment, and the segments are reversed at the end.

Records are kept in blocks of ``LEVELS`` levels, found by the digest of their top node. So a tree of n leaves is built
and descended in log(n) / log(FAN ** LEVELS) rounds; each round joins by digest and rank only. Asked leaves go down
together, as far as their ranks have the same digits: a block is descended once, with a list of the children asked of
it, and the proofs of its leaves are made where it is read, without a shuffle of their own.

Ranks come from one range-partitioned sort, numbered inside partitions and shifted by the partitions before. Texts are
read once, for the leaves' digests; from there on rows are some hundred bytes. All per-row and per-block work is bounded
by ``FAN ** LEVELS`` entries and the height of the trees, however large one group is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import map_batches, stored

FAN, LEVELS = 3, 4
WIDTH = FAN**LEVELS
#: A block: its tree, place among the blocks of its round, how many blocks or nodes that round has, and its top node's
#: digest, height and records.
RECORD = "struct<digest: binary, children: array<binary>>"
BLOCK = f"tree long, place long, n long, height int, digest binary, records array<{RECORD}>"
#: The way from the root: at each level the selected child's place among its siblings, and the others' digests.
PATH = "array<struct<place: int, others: array<binary>>>"


def digest_of(children: list[bytes]) -> bytes:
    """A node: SHA-256 of its children's digests as hexadecimal text."""
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def height_of(n: int) -> int:
    """How many levels are above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def field(value: Column) -> Column:
    """A column's value in a leaf: ``-`` for null, else its bytes in UTF-8, counted, after a colon."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """A row's leaf over the values of its columns."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def ranked(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with part and at, spread): rows in the order of group and ``order``, null first; ``spread`` has group,
    part, first, before and n of each group in each part, so that a row's rank in its group is at - first + before.
    Equal rows are dealt over partitions like any other."""
    kept = stored(rows)
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "_tie")]
    dealt = kept.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    placed = stored(dealt.withColumn("_id", F.monotonically_increasing_id()).select("*", F.shiftright("_id", 33).alias("part"), F.col("_id").alias("at")).drop("_id"))
    spread = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    return placed, spread.select("*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


@dataclass(frozen=True)
class Manifest:
    """leaves: tree, rank, n and the leaf's digest, with the columns carried along. trees: group, tree (the group's
    number, null first, then bytewise), n and subroot. root: one row. blocks: the records of each round of the leaves'
    trees, from the leaves up; top: those of the tree of the groups."""

    leaves: DataFrame
    trees: DataFrame
    root: DataFrame
    blocks: list[DataFrame]
    top: list[DataFrame]


def raised(nodes: DataFrame) -> DataFrame:
    """BLOCK rows over nodes (tree, rank, n, digest): ``LEVELS`` levels, or those that are left to the root."""
    grouped = nodes.groupBy("tree", F.floor(F.col("rank") / WIDTH).alias("place")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("nodes"))  # WIDTH at most

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            heights, tops, records, left = [], [], [], []
            for n, nodes in zip(batch.column("n").to_pylist(), batch.column("nodes").to_pylist()):
                level, own = [x["digest"] for x in nodes], {}
                height = min(LEVELS, height_of(n))
                for _ in range(height):
                    runs = [level[i : i + FAN] for i in range(0, len(level), FAN)]
                    level = [digest_of(run) for run in runs]
                    own.update(zip(level, runs))
                heights.append(height)
                tops.append(level[0])
                records.append([{"digest": d, "children": c} for d, c in own.items()])
                left.append(-(-n // FAN**height))
            return {"tree": batch.column("tree"), "place": batch.column("place"), "n": left, "height": heights, "digest": tops, "records": records}

        return step

    return map_batches(grouped, make, BLOCK)


def rounds_up(leaves: DataFrame) -> list[DataFrame]:
    """The blocks of each round, until every tree has one node."""
    done: list[DataFrame] = []
    nodes = leaves.select("tree", "rank", "n", "digest")
    while not done or nodes.limit(1).count():
        done.append(stored(raised(nodes)))
        nodes = done[-1].filter("n > 1").select("tree", F.col("place").alias("rank"), "n", "digest")
    return done


def roots(blocks: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree: the one block of its last round."""
    last = [b.filter("n = 1").select("tree", F.col("digest").alias("root")) for b in blocks]
    every = last[0]
    for more in last[1:]:
        every = every.unionByName(more)
    return every


def build(leaves: DataFrame, group: str, order: list[str]) -> Manifest:
    """The manifest of ``leaves``: a column ``digest`` (binary), the group's column, ``order`` (null first; equal rows in
    any order, which their digests don't tell) and others that are carried along."""
    rows, spread = ranked(leaves, group, order)
    sizes = spread.groupBy(group).agg(F.sum("n").alias("n"))
    groups, of_all = ranked(sizes.withColumn("all", F.lit(0)), "all", [group])
    each = groups.join(of_all.drop("n"), ["all", "part"])
    trees = stored(each.select(F.col(group).alias("group"), (F.col("at") - F.col("first") + F.col("before")).alias("tree"), "n"))
    where = spread.drop("n").join(trees, F.col(group).eqNullSafe(F.col("group")))
    shift = where.select(F.col("part").alias("_part"), "group", "tree", "n", (F.col("before") - F.col("first")).alias("shift"))
    numbered = rows.join(shift, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("group")))
    kept = stored(numbered.select("tree", (F.col("at") + F.col("shift")).alias("rank"), "n", *(c for c in leaves.columns if c != group)))
    blocks = rounds_up(kept)
    subroots = stored(trees.join(roots(blocks), "tree").withColumnRenamed("root", "subroot"))
    count = subroots.agg(F.count("*").alias("n"))
    top = rounds_up(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("subroot").alias("digest")).crossJoin(F.broadcast(count)))  # one row
    return Manifest(kept, subroots, roots(top).select("root"), blocks, top)


def rounds_of(n: Column) -> Column:
    """In how many rounds a tree of n leaves was built."""
    return sum([F.when(n > WIDTH**r, 1).otherwise(0) for r in range(1, 10)], F.lit(1))


def descended(ways: DataFrame, blocks: DataFrame, asked: DataFrame, carried: list[str]) -> DataFrame:
    """From a block's top node to its children: ``ways`` (tree, place, digest, path and ``carried``), ``asked`` (tree,
    place, low: ranks inside the block, as a list). One row comes for each of these: tree, place (the child's), digest,
    path and ``carried``."""
    once = blocks.select("digest", "height", "records").dropDuplicates(["digest"])  # equal content has one record
    met = ways.join(asked, ["tree", "place"]).join(once, "digest")
    kept = [met.schema[c] for c in carried]
    schema = f"tree long, place long, digest binary, path {PATH}" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            source, places, digests, paths = [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("place", "digest", "path", "low", "height", "records")]
            for row, (place, digest, path, low, height, records) in enumerate(zip(*columns)):
                for rank, (node, segment) in zip(low, segments(digest, low, height, records)):
                    source.append(row)
                    places.append(place * WIDTH + rank)
                    digests.append(node)
                    paths.append(path + segment)
            rows = pa.array(source, pa.int64())
            return {"tree": batch.column("tree").take(rows), "place": places, "digest": digests, "path": paths, **{f.name: batch.column(f.name).take(rows) for f in kept}}

        return step

    return map_batches(met.select("tree", "place", "digest", "path", "low", "height", "records", *carried), make, schema)


def segments(digest: bytes, low: list[int], height: int, records: list[dict]) -> Iterator[tuple[bytes, list[dict]]]:
    """For each rank inside a block the node there and the path segment to it, root first."""
    children = {r["digest"]: r["children"] for r in records}
    for rank in low:
        node, segment = digest, []
        for level in range(height - 1, -1, -1):
            place = rank // FAN**level % FAN
            run = children[node]
            segment.append({"place": place, "others": run[:place] + run[place + 1 :]})
            node = run[place]
        yield node, segment


def ways_down(blocks: list[DataFrame], starts: DataFrame, asked: DataFrame, carried: list[str], last: int = 0) -> DataFrame:
    """The ways from ``starts`` (tree, n, digest, path, ``carried``) to the blocks of round ``last`` that hold an asked
    leaf, or to the leaves themselves (-1); ``asked``: tree and rank."""
    begun = starts.withColumn("round", rounds_of(F.col("n")) - 1).withColumn("place", F.lit(0).cast("long"))
    columns = ["tree", "place", "digest", "path", *carried]
    ways = begun.filter(F.col("round") == len(blocks) - 1).select(*columns)
    for r in range(len(blocks) - 1, last, -1):
        needed = asked.select("tree", F.floor(F.col("rank") / WIDTH**r).alias("child")).distinct()
        low = needed.groupBy("tree", F.floor(F.col("child") / WIDTH).alias("place")).agg(F.collect_list((F.col("child") % WIDTH).cast("int")).alias("low"))  # WIDTH at most
        below = stored(descended(ways, blocks[r], low, carried))
        ways = below if r == 0 else below.unionByName(begun.filter(F.col("round") == r - 1).select(*columns))
    return ways


def proofs(manifest: Manifest, asked: DataFrame, carried: list[str], offered: str | None = None) -> DataFrame:
    """(``carried``, leaf, subroot, root, proof, folded) of the asked rows of ``manifest.leaves``. leaf: what the descent
    finds. proof: digest of the siblings, level by level from the leaf up, left to right. folded: the root that the
    column ``offered`` (null: the leaf) leads to with these siblings. ``asked`` has each row once at most."""
    trees = manifest.trees.join(asked.select("tree").distinct(), "tree", "left_semi")
    none = F.array().cast(PATH)
    zero = F.lit(0).cast("long")
    at_top = manifest.trees.agg(F.count("*").alias("n")).crossJoin(F.broadcast(manifest.root)).select(zero.alias("tree"), "n", F.col("root").alias("digest"), none.alias("path"), "root")
    to_trees = ways_down(manifest.top, at_top, trees.select(zero.alias("tree"), F.col("tree").alias("rank")), ["root"], last=-1)
    starts = stored(to_trees.select(F.col("place").alias("tree"), F.col("digest").alias("subroot"), "path", "root").join(manifest.trees.select("tree", "n"), "tree").withColumn("digest", F.col("subroot")))
    ways = ways_down(manifest.blocks, starts, asked, ["subroot", "root"])
    own = F.struct((F.col("rank") % WIDTH).cast("int").alias("low"), (F.col(offered) if offered else F.lit(None).cast("binary")).alias("offered"), *carried)
    wanted = asked.groupBy("tree", F.floor(F.col("rank") / WIDTH).alias("place")).agg(F.collect_list(own).alias("wanted"))  # WIDTH at most
    once = manifest.blocks[0].select("digest", "height", "records").dropDuplicates(["digest"])
    met = ways.join(wanted, ["tree", "place"]).join(once, "digest")
    kept = [met.schema["wanted"].dataType.elementType[c] for c in carried]
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept) + "leaf string, subroot string, root string, proof string, folded string"

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {name: [] for name in (*carried, "leaf", "subroot", "root", "proof", "folded")}
            for row in batch.to_pylist():
                folds = Folds(row["path"])
                wanted = row["wanted"]
                for want, (leaf, segment) in zip(wanted, segments(row["digest"], [w["low"] for w in wanted], row["height"], row["records"])):
                    for c in carried:
                        out[c].append(want[c])
                    out["leaf"].append(leaf.hex())
                    out["subroot"].append(row["subroot"].hex())
                    out["root"].append(row["root"].hex())
                    out["proof"].append(folds.proof(segment))
                    out["folded"].append(folds.root(segment, leaf if want["offered"] is None else want["offered"]))
            return out

        return step

    return map_batches(met.select("digest", "height", "records", "path", "subroot", "root", "wanted"), make, schema)


class Folds:
    """Proofs and roots of the leaves below one path; what lies above their block is folded once for each node there."""

    def __init__(self, path: list[dict]):
        self.above = path[::-1]
        self.siblings = "".join([o.hex() for level in self.above for o in level["others"]])
        self.known: dict[bytes, str] = {}

    def proof(self, segment: list[dict]) -> str:
        own = "".join([o.hex() for level in reversed(segment) for o in level["others"]])
        return hashlib.sha256((own + self.siblings).encode()).hexdigest()

    def root(self, segment: list[dict], leaf: bytes) -> str:
        top = self.folded(reversed(segment), leaf)
        if top not in self.known:
            self.known[top] = self.folded(self.above, top).hex()
        return self.known[top]

    @staticmethod
    def folded(levels, node: bytes) -> bytes:
        for level in levels:
            at, others = level["place"], level["others"]
            node = digest_of([*others[:at], node, *others[at:]])
        return node


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest (of doc_id, source, lang, n_chars and text) and forged: the digest without the text's line
    feeds where the CRC-32 of the decimal doc_id is even, else null."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    bare = [F.col(c) for c in columns[:-1]] + [F.replace("text", F.lit("\n"), F.lit(""))]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return docs.select("doc_id", "source", leaf_digest(*map(F.col, columns)).alias("digest"), F.when(even, leaf_digest(*bare)).alias("forged"))


def proven_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document: its proof in the manifest of
    all, by source and doc_id, and whether its copy still leads to the root; see ``document_leaves`` for the copies.

    Null values have a form of their own; a null source is a group, the first, and rows without a doc_id come first in
    theirs. Repeated rows are leaves of their own, next to each other; of rows with one doc_id the lesser digest comes
    first. Empty texts, texts of any length and further columns need nothing special. An empty table gives no rows.
    """
    manifest = build(document_leaves(docs), "source", ["doc_id", "digest"])
    made = proofs(manifest, manifest.leaves, ["doc_id"], offered="forged")
    return made.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
