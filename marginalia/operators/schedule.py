"""Timetables: rules expanded over days, with holidays, moved days and partial days off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.numeric import week_number


def days_between(spark, first: str, days: int) -> DataFrame:
    """One row a day, from 1 to 31 of them."""
    n = max(1, min(31, days))
    return spark.range(n).select(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("day"))


def effective_schedule(days: DataFrame, rules: DataFrame, adjustments: DataFrame, term_start: str) -> DataFrame:
    """(day, rule_id, first_period): what takes place.

    ``rules``: rule_id, weekday 1-7, start_week, end_week, parity (all, odd, even), periods, enabled. ``adjustments``:
    day, kind (holiday, day_off, workday), periods, source_date. A holiday, or a day off without periods, clears the
    day; a workday stands in for the weekday and week of its source date; a day off with periods takes out what overlaps.
    """
    off = adjustments.filter((F.col("kind") == "holiday") | ((F.col("kind") == "day_off") & (F.coalesce(F.size("periods"), F.lit(0)) <= 0))).select("day").distinct()
    moved = adjustments.filter("kind = 'workday' AND source_date IS NOT NULL").groupBy("day").agg(F.min("source_date").alias("as_of"))
    open_ = days.join(off, "day", "left_anti").join(moved, "day", "left").withColumn("as_of", F.coalesce("as_of", "day"))
    dated = open_.withColumn("weekday", F.weekday("as_of") + 1).withColumn("week", week_number(F.col("as_of"), F.lit(term_start).cast("date")))
    parity = (F.col("parity") == "all") | ((F.col("parity") == "odd") == (F.col("week") % 2 == 1))
    met = dated.join(rules.filter("enabled"), "weekday").filter(F.col("week").between(F.col("start_week"), F.col("end_week")) & parity)
    partial = adjustments.filter((F.col("kind") == "day_off") & (F.size("periods") > 0)).select(F.col("day").alias("off_day"), F.col("periods").alias("off_periods"))
    left = met.join(partial, (F.col("day") == F.col("off_day")) & F.arrays_overlap("periods", "off_periods"), "left_anti")
    return left.select("day", "rule_id", F.coalesce(F.array_min("periods"), F.lit(99)).alias("first_period"))
