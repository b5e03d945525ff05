"""Texts into segments, cues and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import clock_ms, ms_clock
from marginalia.operators.windows import clamp_monotone

#: A sentence with the marks and blanks that end it, or the rest of the text.
SENTENCE = r"[^.!?。！？]*[.!?。！？]+\s*|[^.!?。！？]+$"
CLOCK = r"\[?((?:[0-9]{1,2}:)?[0-9]{1,2}:[0-9]{2}(?:[.,][0-9]{1,3})?)\]?"


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def packed(parts: Column, most: int) -> Column:
    """Neighbouring parts joined while they stay within ``most`` characters; a longer part stands alone, uncut."""
    start = F.struct(F.lit("").alias("held"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc, part):
        fits = (F.length(acc["held"]) + F.length(part) <= most) | (acc["held"] == "")
        return F.struct(F.when(fits, F.concat(acc["held"], part)).otherwise(part).alias("held"), F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["held"]))).alias("out"))

    done = lambda acc: F.filter(F.transform(F.concat(acc["out"], F.array(acc["held"])), lambda s: F.trim(s)), lambda s: s != "")
    return F.aggregate(parts, start, step, done)


def hard_cut(parts: Column, most: int) -> Column:
    """Parts of at most ``most`` characters each."""
    pieces = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(p) - 1) / most), F.lit(0)).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
    return F.flatten(F.transform(parts, pieces))


def split_segments(df: DataFrame, id_col: str, text: Column, most: int = 900, paragraph: str = r"\n\s*\n") -> DataFrame:
    """(id, paragraph, segment, text): paragraphs, the long ones packed by sentence."""
    paras = df.select(id_col, F.posexplode(F.split(text, paragraph)).alias("paragraph", "_p")).withColumn("_p", F.trim("_p")).filter("_p <> ''")
    cut = F.when(F.length("_p") <= most, F.array("_p")).otherwise(packed(sentences(F.col("_p")), most))
    return paras.select(id_col, "paragraph", F.posexplode(cut).alias("segment", "text"))


def split_cue(text: Column, most: int = 1200) -> Column:
    """A cue's text in pieces of at most ``most`` characters, at sentences where it can be."""
    return F.when(F.length(text) <= most, F.array(text)).otherwise(packed(hard_cut(sentences(text), most), most))


def _ms(clock: Column) -> Column:
    """MM:SS and HH:MM:SS alike."""
    full = F.when(F.length(clock) - F.length(F.replace(clock, F.lit(":"), F.lit(""))) == 1, F.concat(F.lit("00:"), clock)).otherwise(clock)
    return clock_ms(F.regexp_replace(full, r"^([0-9]):", "0$1:"))


def parse_cues(df: DataFrame, id_col: str, text: Column, default_ms: int = 30_000) -> DataFrame:
    """(id, cue, start_ms, end_ms, text). A line that starts with a time, or a range of times, starts a cue; others
    belong to the cue before. Without any time the text is one cue without times. Missing ends are the next start, if
    not before the own, else a default later; times never go back."""
    lines = df.select(id_col, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("_at", "_line")).withColumn("_line", F.trim("_line")).filter("_line <> ''")
    head = rf"^{CLOCK}(?:\s*(?:-->|-|–)\s*{CLOCK})?\s*(.*)$"
    part = lambda i: F.regexp_extract("_line", head, i)
    timed = lines.withColumn("_start", F.when(part(1) != "", _ms(part(1)))).withColumn("_end", F.when(part(2) != "", _ms(part(2))))
    timed = timed.withColumn("_body", F.when(F.col("_start").isNotNull(), part(3)).otherwise(F.col("_line")))
    cue = F.count("_start").over(W.partitionBy(id_col).orderBy("_at"))
    joined = timed.withColumn("cue", cue).groupBy(id_col, "cue").agg(F.max("_start").alias("start_ms"), F.max("_end").alias("_own"), F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_body"))), lambda x: x["_body"]), lambda x: x != ""), " ").alias("text"))
    after = F.first("start_ms", ignorenulls=True).over(W.partitionBy(id_col).orderBy("cue").rowsBetween(1, W.unboundedFollowing))
    ended = joined.withColumn("end_ms", F.coalesce("_own", F.when(after >= F.col("start_ms"), after), F.col("start_ms") + default_ms)).drop("_own")
    with_time = clamp_monotone(ended.filter("start_ms IS NOT NULL"), id_col, ["cue"], "start_ms", "end_ms")
    return with_time.unionByName(ended.filter("start_ms IS NULL")).select(id_col, "cue", "start_ms", "end_ms", "text")


def cue_locator(start: Column, end: Column) -> Column:
    return F.concat(ms_clock(start), F.lit("-"), ms_clock(end))


def split_questions(text: Column) -> Column:
    """Questions that start with a numbered heading, in order; the whole text if there is none."""
    parts = F.filter(F.transform(F.split(text, r"(?m)(?=^\s*(?:[0-9]{1,3}[.、)]|Q[0-9]{1,3}[.:]?)\s)"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(text)))
