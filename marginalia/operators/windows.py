"""Ordered operators: numbering, streaks, gaps and clamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.streaming.tables import written


def range_of(column: Column, bounds: list, first: int = 0) -> Column:
    """How many of the sorted bounds are below: a comparison for each halving of them."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(column > F.lit(bounds[middle]), range_of(column, bounds[middle + 1 :], first + middle + 1)).otherwise(range_of(column, bounds[:middle], first))


def dense_ordinal(df: DataFrame, order_col: str, name: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """Numbers from 1 in the order of a unique whole-number column over the whole table, without one task that sees all
    rows: ranges of the column are numbered each by itself, and the counts of the ranges before are added. Only one
    count a range is collected in a broadcast join, whatever the input."""
    width = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.agg(F.percentile_approx(order_col, [i / width for i in range(1, width)], 100 * width)).first()[0] or [])) if width > 1 else []
    dealt = df.withColumn("_range", range_of(F.col(order_col), bounds))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.alias("c").join(counts.select(F.col("_range").alias("_earlier"), F.col("_n").alias("_m")), F.col("_earlier") < F.col("_range"), "left").groupBy("_range").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(order_col))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_before")


def group_ordinals(df: DataFrame, groups: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Numbers from 1 inside each group, in an order (null first), without one task that sees a whole group: rows are
    dealt to ranges of group and order, numbered inside these as they are written, and shifted by what the ranges before
    hold of the group. Rows alike in group and order are numbered in any order."""
    by = [F.col(c).asc_nulls_first() for c in (*groups, *order)]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    placed = written(dealt.withColumn("_part", F.shiftright("_id", 33)), "ordinals")
    held = placed.groupBy("_part", *groups).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    shift = held.select(F.col("_part").alias("_at"), *[F.col(g).alias(f"_of_{g}") for g in groups], (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = F.col("_part") == F.col("_at")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return placed.join(shift, same).select(*df.columns, (F.col("_id") + F.col("_shift")).alias(name))


def trailing_streak(df: DataFrame, key: str, order_col: str, breaks: Column) -> DataFrame:
    """For each key how many rows come after its last row that breaks the streak."""
    last = df.groupBy(key).agg(F.max(F.when(breaks, F.col(order_col))).alias("_last"))
    after = F.col("_last").isNull() | (F.col(order_col) > F.col("_last"))
    return df.join(last, key).groupBy(key).agg(F.count_if(after).alias("streak"))


def next_known(value: str, key: str, order: list[str]) -> Column:
    """The next value that isn't null, in the rows after."""
    return F.first(value, ignorenulls=True).over(W.partitionBy(key).orderBy(*order).rowsBetween(1, W.unboundedFollowing))


def clamp_monotone(df: DataFrame, key: str, order: list[str], start: str, end: str) -> DataFrame:
    """Starts not before the greatest end so far (from 0), ends not before their start."""
    before = F.max(F.greatest(start, end)).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("_s", F.greatest(F.col(start), F.coalesce(before, F.lit(0)))).withColumn("_e", F.greatest(F.col(end), F.col("_s"))).drop(start, end).withColumnsRenamed({"_s": start, "_e": end})


def timeline_gaps(df: DataFrame, key: str, order: list[str], start: str, end: str, least: int, adjacent: bool = False) -> DataFrame:
    """Gaps of more than ``least`` between a row and the greatest end before it, or (adjacent) the end of the row before."""
    w = W.partitionBy(key).orderBy(*order)
    reached = F.lag(end).over(w) if adjacent else F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("gap_start", reached).withColumn("gap", F.col(start) - F.col("gap_start")).filter(F.col("gap") > least)
