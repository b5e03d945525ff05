"""Ratios, clamps, vectors, ranking weights, review intervals and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """Rounded to six places; ``empty`` where there is no whole (0.0 for rates, 1.0 for accounting)."""
    return F.when(whole <= 0, F.lit(empty)).otherwise(F.round(part / whole, 6))


def exact_sum(value: Column, window: WindowSpec) -> Column:
    """A sum of the decimal numbers that doubles are written as, which no order of adding changes, so that a sum that
    meets a cap isn't beyond it by a rounding error. Windows with numbers that 38 digits don't hold are added as doubles."""
    number = value.try_cast("decimal(38,15)")
    exact = F.when(F.count_if(value.isNotNull() & number.isNull()).over(window) == 0, F.try_sum(number).over(window))
    return F.coalesce(exact.cast("double"), F.sum(value).over(window))


def clamp01(value: Column) -> Column:
    """Into 0..1; what isn't a number is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(value.try_cast("double"), F.lit(0.0)), F.lit(0.0))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors and for unequal lengths."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9))).otherwise(0.0)


def importance(emphasis: Column) -> Column:
    return F.when(emphasis >= 0.85, "high").when(emphasis >= 0.6, "medium").otherwise("low")


def usable_budget(window: Column) -> Column:
    """Nine tenths of the window, without what prompt (2048) and answer (4096) take; not below 0."""
    return F.greatest((window * 0.9).cast("long") - 2048 - 4096, F.lit(0).cast("long"))


def next_interval(previous: Column, rating: Column, wrong_streak: Column) -> Column:
    """Days to the next review: two wrongs in a row start over; else 1, 3, or the last interval times 1.8, 2.5 or 3.2;
    from 1 to 180."""
    grown = F.when(rating <= 1, 1.0).when(rating == 2, 3.0).when(rating == 3, previous * 1.8).when(rating == 4, previous * 2.5).otherwise(previous * 3.2)
    base = F.when(rating <= 0, 1.0).when(rating == 1, 1.0).otherwise(grown)
    return F.when(wrong_streak >= 2, 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(180.0), base)))


def mastery_step(mastery: Column, right: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mastery + F.when(right, 0.15).otherwise(-0.25))), 4)


def week_number(day: Column, first: Column) -> Column:
    """1 for the week that starts on ``first``; null before it."""
    days = F.datediff(day, first)
    return F.when(days >= 0, (F.floor(days / 7) + 1).cast("int"))


def usage_bucket(used_percent: Column) -> Column:
    return F.when(used_percent >= 90, "critical").when(used_percent >= 70, "warning").otherwise("normal")


def week_spec(spec: Column) -> Column:
    """``a-b`` or one week, with an odd or even mark: (first, last, parity); null for all else."""
    form = r"(?i)^\s*([0-9]{1,2})\s*(?:-\s*([0-9]{1,2}))?\s*(odd|even)?\s*$"
    first, last, mark = (F.regexp_extract(spec, form, i) for i in (1, 2, 3))
    parsed = F.struct(first.cast("int").alias("first"), F.coalesce(F.when(last != "", last.cast("int")), first.cast("int")).alias("last"), F.coalesce(F.when(mark != "", F.lower(mark)), F.lit("all")).alias("parity"))
    return F.when(first != "", parsed)
