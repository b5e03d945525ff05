"""BM25, cosine and fused ranking as joins and aggregates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.numeric import cosine
from marginalia.operators.relational import top_per_key
from marginalia.streaming.tables import written

K1, B = 1.5, 0.75
#: The tokens of ``char_tokens``: these are ASCII letters and digits, or one ideograph each.
TOKEN = re.compile("[A-Za-z0-9]+|[\u4E00-\u9FFF]")


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text: Column, query_col: str, terms_col: str) -> DataFrame:
    """(query, id, score) of every document that has a query term. Terms that a query repeats count as often.

    Only postings of terms that some query has leave the scan; lengths and counts are of all documents.
    """
    asked = queries.select(query_col, F.explode(terms_col).alias("_term")).groupBy(query_col, "_term").agg(F.count("*").alias("_times"))
    counted = term_counts(docs, id_col, text).withColumnsRenamed({"term": "_term", "tf": "_tf", "length": "_len"})
    sought = asked.select("_term", F.lit(True).alias("_asked")).distinct()
    kept = written(counted.join(sought, "_term", "left").filter("_asked OR _term IS NULL").drop("_asked"), "postings")  # a document's stay together
    size = kept.filter("_term IS NULL").agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"))
    postings = kept.filter("_term IS NOT NULL")
    if repeated_ids(docs, id_col) is not None:
        postings = postings.groupBy(id_col, "_len", "_term").agg(F.sum("_tf").alias("_tf"))
    df = postings.groupBy("_term").agg(F.count("*").alias("_df"))
    met = postings.join(asked.join(df, "_term"), "_term").crossJoin(F.broadcast(size))  # one row of totals
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weight = F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_len") / F.greatest(F.col("_avg"), F.lit(1.0))))
    return met.groupBy(query_col, id_col).agg(F.sum(F.col("_times") * idf * weight).alias("score"))


def term_counts(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(term, id, tf, length) of each distinct token (``char_tokens``) of each row, which no row leaves for that; length:
    how many tokens the row has. A row without term stands for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                terms, counts, lengths, rows = [], [], [], []
                for row, t in enumerate(part.column(1).to_pylist()):
                    tokens = [w.lower() for w in TOKEN.findall(t)] if t else []
                    found = Counter(tokens)
                    terms += [None, *found]
                    counts += [0, *found.values()]
                    lengths += [len(tokens)] * (len(found) + 1)
                    rows += [row] * (len(found) + 1)
                columns = [pa.array(terms, pa.string()), part.column(0).take(pa.array(rows, pa.int64())), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["term", id_col, "tf", "length"])

    return docs.select(id_col, text.alias("_text")).mapInArrow(run, f"term string, {id_col} {kind}, tf long, length long")


def repeated_ids(docs: DataFrame, id_col: str) -> DataFrame | None:
    """Ids of more than one row, if there are any; only ids are looked at."""
    again = written(docs.groupBy(id_col).count().filter("count > 1").select(id_col), "repeated")
    return again if again.limit(1).count() else None


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(term, id, tf) of all terms. Terms are counted in their rows; only where ids repeat are rows brought together."""
    found = term_counts(docs, id_col, text).filter("term IS NOT NULL").drop("length")
    return found if repeated_ids(docs, id_col) is None else found.groupBy("term", id_col).agg(F.sum("tf").alias("tf"))


def updated_postings(index: DataFrame, gone: DataFrame, changed: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The index without the postings of ``gone`` documents, and with those of ``changed`` ones as they read now: only
    their texts are looked at. gone: ids; changed: ids and texts, new documents too."""
    out = gone.select(id_col).union(changed.select(id_col)).distinct()
    return index.join(out, id_col, "left_anti").select("term", id_col, "tf").unionByName(postings(changed, id_col, text))


def best(scored: DataFrame, query_col: str, id_col: str, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller id; scores count to nine places, so that sums in another order
    rank alike."""
    return top_per_key(scored, [query_col], [F.round("score", 9).desc(), F.col(id_col)], k)


def cosine_scores(vectors: DataFrame, query: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(query_id, id, score) of every vector against every query vector."""
    asked = query.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("_query"))
    return vectors.crossJoin(asked).select("query_id", id_col, cosine(F.col(vector_col), F.col("_query")).alias("score"))


def _by_length(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the rows that have it, their values and norms; without empty vectors and missing numbers."""
    rows: dict[int, tuple[list, list]] = {}
    for i, v in enumerate(vectors.to_pylist()):
        if v and None not in v and np.isfinite(v).all():
            at, values = rows.setdefault(len(v), ([], []))
            at.append(i)
            values.append(v)
    return {n: (np.array(at), m := np.array(values), np.sqrt((m * m).sum(axis=1))) for n, (at, values) in rows.items()}


def cosine_best(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, block: int = 2048) -> DataFrame:
    """(query_id, rank, id, score): for each query vector the k nearest of the others, ties to the smaller id. Vectors
    and queries meet in pairs of blocks, each of which leaves k rows a query. Vectors without values score 0."""
    schema = "query_id long, id long, score double"
    side = lambda df: df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    v, q = side(vectors), side(queries)
    v_blocks, q_blocks = (max(1, -(-df.count() // block)) for df in (v, q))
    one = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.select("*", one(v_blocks).cast("int").alias("v_block"), every(q_blocks).alias("q_block"))
    q = q.select("*", one(q_blocks).cast("int").alias("q_block"), every(v_blocks).alias("v_block"))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("id")
        ids, asked = left["id"].to_numpy(), right["id"].to_numpy()
        score = np.zeros((len(asked), len(ids)))
        mine = _by_length(left["vector"])
        for n, (at, values, norms) in _by_length(right["vector"]).items():
            if n in mine:
                to, others, theirs = mine[n]
                score[np.ix_(at, to)] = values @ others.T / (norms[:, None] * theirs[None, :] + 1e-9)
        rounded = np.where(asked[:, None] == ids[None, :], -np.inf, np.round(score, 9))
        least = np.partition(rounded, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(asked), -np.inf)
        found = [[], [], []]
        for i, row in enumerate(rounded):
            near = np.flatnonzero((row >= least[i]) & (row > -np.inf))
            near = near[np.argsort(-row[near], kind="stable")][:k]
            for to, part in zip(found, (np.full(len(near), asked[i]), ids[near], score[i, near]), strict=True):
                to.append(part)
        flat = [np.concatenate(f) if f else [] for f in found]
        return pa.table({"query_id": pa.array(flat[0], pa.int64()), "id": pa.array(flat[1], pa.int64()), "score": pa.array(flat[2], pa.float64())})

    keys = ["v_block", "q_block"]
    return best(v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(pair, schema), "query_id", "id", k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def fused(bm25_score: Column, most: Column, near: Column | None, hierarchy: Column, phrase: Column) -> Column:
    """Weights of the hybrid mode where there is a vector similarity, else those of the keyword mode."""
    part = F.when(most > 0, bm25_score / most).otherwise(0.0)
    if near is None:
        return 0.60 * part + 0.30 * hierarchy + 0.10 * phrase
    return 0.45 * part + 0.40 * F.greatest(near, F.lit(0.0)) + 0.10 * hierarchy + 0.05 * phrase


def two_stage(scored: DataFrame, id_col: str, rerank: Column, k: int, query_col: str | None = None) -> DataFrame:
    """max(4k, 12) candidates by score, then the k best by ``rerank``; of each query where a query column is named."""
    score = F.round("score", 9).desc()
    if query_col:
        first = top_per_key(scored, [query_col], [score, F.col(id_col)], max(4 * k, 12)).drop("rank").withColumn("rerank", rerank)
        return top_per_key(first, [query_col], [F.col("rerank").desc(), score, F.col(id_col)], k)
    first = scored.orderBy(score, id_col).limit(max(4 * k, 12))
    return first.withColumn("rerank", rerank).orderBy(F.col("rerank").desc(), score, id_col).limit(k)
