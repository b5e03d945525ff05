"""Exact and prefix de-duplication with a canonical row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import normalize_text
from marginalia.operators import sorted_runs
from marginalia.streaming.tables import written


def exact_canonical(df: DataFrame, id_col: str, text: Column, *kinds: str) -> DataFrame:
    """(id, canonical_id, state) by hash of the normalised text within a kind; the first of each group is canonical. The
    least id is joined back, so that a text that very many rows share is dealt over tasks."""
    hashed = written(df.select(id_col, *kinds, F.unhex(F.sha2(normalize_text(text), 256)).alias("_hash")), "hashes")
    first = hashed.groupBy(*kinds, "_hash").agg(F.min(id_col).alias("canonical_id"))
    state = F.when(F.col(id_col) == F.col("canonical_id"), "included").otherwise("duplicate")
    return hashed.join(first, [*kinds, "_hash"]).select(id_col, *kinds, "canonical_id", state.alias("state"))


def prefix_contained(df: DataFrame, id_col: str, text: Column, least: int = 120, kind: str | None = None) -> DataFrame:
    """(id, container_id): rows whose whole compact text of at least ``least`` characters starts an earlier row's of the
    same kind; of several, the first. Equal texts count as contained in the first of them. Rows without an id, a text or
    (if asked for) a kind take no part.

    In sorted order a text's containers follow it without a gap, so each task walks one range of the sorted texts once,
    and what ranges leave open is settled from a few rows a range. Texts are grouped and sorted once each; nothing grows
    with the number of pairs that share a head.
    """
    compact = F.lower(F.regexp_replace(text, r"\s+", ""))
    rows = df.select(id_col, *([kind] if kind else []), compact.alias("_text")).filter((F.length("_text") >= least) & F.col(id_col).isNotNull())
    if kind:  # a fixed length before each text keeps kinds apart
        rows = rows.filter(F.col(kind).isNotNull()).withColumn("_text", F.concat(F.md5(F.col(kind).cast("string")), "_text"))
    rows = rows.withColumn("_hash", F.unhex(F.sha2("_text", 256)))
    one = written(rows.groupBy("_hash", "_text").agg(F.min(id_col).alias("_first")), "prefix-texts")
    best = sorted_runs.least_in_runs(one.select(F.col("_text").cast("binary").alias("text"), F.col("_hash").alias("hash"), F.col("_first").alias("first")))
    keys = [id_col, *([kind] if kind else [])]
    found = rows.select(*keys, "_hash").join(one.select("_hash", "_first"), "_hash").join(best.withColumnsRenamed({"hash": "_hash", "best": "_best"}), "_hash", "left")
    return found.select(*keys, F.coalesce("_best", F.when(F.col("_first") < F.col(id_col), F.col("_first"))).alias("container_id")).filter("container_id IS NOT NULL")
