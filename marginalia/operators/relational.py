"""Filters, joins and grouped counts that application queries are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def optional_filters(df: DataFrame, **wanted) -> DataFrame:
    """One equality for each argument that isn't None; all of them push down."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), ((k, v) for k, v in wanted.items() if v is not None), df)


def in_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Both ends optional and included."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    return df if end is None else df.filter(F.col(column) <= F.lit(end))


def narrowest_scope(df: DataFrame, **scopes) -> DataFrame:
    """Filters by the first scope given that isn't None, from narrow to wide."""
    return next((df.filter(F.col(k) == v) for k, v in scopes.items() if v is not None), df)


def scope_violations(df: DataFrame, **declared) -> DataFrame:
    """Rows of which some declared dimension is missing or another."""
    wrong = reduce(lambda a, b: a | b, (~F.col(k).eqNullSafe(F.lit(v)) for k, v in declared.items()))
    return df.filter(wrong)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key. The order should be total."""
    last = W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their rank; Spark limits each partition before it shuffles."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key no parent has; null keys are orphans too."""
    return child.join(parent.select(F.col(parent_key).alias("_parent")).distinct(), F.col(child_key) == F.col("_parent"), "left_anti")


def reconcile(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Full outer comparison of two answers for each key."""
    both = left.select(key, F.col(a).alias("left_value")).join(right.select(key, F.col(b).alias("right_value")), key, "full_outer")
    verdict = F.when(F.col("left_value").isNull(), "right_only").when(F.col("right_value").isNull(), "left_only").when(F.col("left_value") == F.col("right_value"), "agree").otherwise("conflict")
    return both.withColumn("verdict", verdict)


def range_join(rows: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: int, keys: list[str] = []) -> DataFrame:
    """Rows with the ranges that hold their point: ranges are dealt into buckets of ``width``, so the join is an
    equality with a filter, and no side is broadcast."""
    cut = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    dealt = rows.withColumn("_bucket", F.floor(F.col(point) / width))
    return dealt.join(cut, [*keys, "_bucket"]).filter(F.col(point).between(F.col(start), F.col(end))).drop("_bucket")


def duplicate_groups(df: DataFrame, *keys: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def keep_least_id(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Every row with the id that its group keeps. The least id of each group is joined back rather than windowed, so
    a group of any size is dealt over tasks."""
    kept = df.groupBy(*keys).agg(F.min(id_col).alias("kept_id"), F.count("*").alias("group_size"))
    return df.join(kept, keys)
