"""Reply-ordered chats from quoted messages, with DataFrame functions only.

A message's lines carry their quote level in leading ``>`` marks. Neighbouring lines of one level are a passage. A
quoted passage, without marks, white space collapsed and in lower case, is hashed and joined to the first message of the
thread that has it as a passage of its own, if that came before. Replies whose nearest quotes don't all name one message
that way (they quote parts, or answer between them) are joined by paragraph and line too, and the message that covers
most quoted lines is taken. The least quoted level that links names the message replied to.

Messages are parsed once, to their own text and the hashes of their passages, paragraphs and lines, and stored by column;
quoted text goes no further. All joins are of hashes and numbers on (thread, message) or (thread, passage), so a thread
of any length is dealt over tasks, and texts move once, to the paths of their messages. Chains of replies become paths by
pointer doubling, so joins grow with the logarithm of a thread's depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import checkpoint, stored

MARKS = r"^(?:[ \t]*>)+"


def marked_lines(body: Column) -> Column:
    """array<struct<level, line, plain>>: each line without its marks, and that with white space collapsed and in lower
    case."""
    lines = F.transform(F.split(body, r"\r\n|\n|\r"), lambda x: F.struct(F.regexp_extract(x, MARKS, 0).alias("marks"), x.alias("x")))
    bare = F.transform(lines, lambda y: F.struct(F.length(F.regexp_replace(y["marks"], "[^>]", "")).alias("level"), F.when(y["marks"] == "", y["x"]).otherwise(F.regexp_replace(y["x"], MARKS + " ?", "")).alias("line")))
    return F.transform(bare, lambda z: F.struct(z["level"].alias("level"), z["line"].alias("line"), F.lower(F.trim(F.regexp_replace(z["line"], r"\s+", " "))).alias("plain")))


def unit_key(plain: Column) -> Column:
    """Hash of lines without marks, white space and case: the same wherever the line ends fall."""
    return F.unhex(F.md5(F.array_join(plain, " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """(thread, turn, role, digest, text, units) of each message. text: what it doesn't quote. units: structs of level,
    place, at, key and whole for each passage, paragraph and line that has words, those with the same lines once. place:
    the passage's number; at: the lines' numbers; whole: the unit is all of its passage.

    Work grows in proportion with a message: its lines' numbers are written one after another with a mark where a
    passage or paragraph starts, and that is split at the marks. What lambdas look up by a line's number are columns that
    Spark keeps apart: lists made by a function and used more than once. A field of ``lines`` would be made anew for each
    line.
    """
    cut = messages.select("thread", "turn", "role", F.unhex(F.md5("body")).alias("digest"), marked_lines(F.col("body")).alias("lines"))
    flat = cut.withColumns({"level": F.transform("lines", lambda x: x["level"]), "plain": F.transform("lines", lambda x: x["plain"])})
    edge = lambda i: (i == 0) | (F.get("level", i) != F.get("level", i - 1))
    # a paragraph starts with a line that has words where a passage starts or a blank line stands before
    starts = lambda i: edge(i) | (F.get("plain", i - 1) == "")
    number = lambda i: F.when(F.get("plain", i) == "", "").otherwise(F.concat(F.when(starts(i), ";").otherwise(","), i.cast("string")))
    marked = F.transform(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.concat(F.when(edge(i) & (i > 0), "|").otherwise(""), number(i)))
    nested = flat.withColumn("nested", F.split(F.array_join(marked, ""), r"\|"))
    numbers = lambda block: F.transform(F.split(block, ","), lambda i: i.cast("int"))
    blocks = lambda passage: F.transform(F.filter(F.split(passage, ";"), lambda b: b != ""), numbers)
    passages = nested.withColumn("passages", F.filter(F.transform("nested", lambda x, place: F.struct(place.alias("place"), blocks(x).alias("blocks"))), lambda p: F.size(p["blocks"]) > 0))

    def units(p: Column) -> Column:
        unit = lambda at, whole: F.struct(F.get("level", F.get(at, 0)).alias("level"), p["place"].alias("place"), at.alias("at"), unit_key(F.transform(at, lambda i: F.get("plain", i))).alias("key"), F.lit(whole).alias("whole"))
        several = F.filter(p["blocks"], lambda at: F.size(at) > 1)
        paragraphs = F.when(F.size(p["blocks"]) > 1, p["blocks"]).otherwise(F.slice(p["blocks"], 1, 0))
        return F.concat(F.array(unit(F.flatten(p["blocks"]), True)), F.transform(paragraphs, lambda at: unit(at, False)), F.transform(F.flatten(several), lambda i: unit(F.array(i), False)))

    text = F.trim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"))
    return passages.select("thread", "turn", "role", "digest", text.alias("text"), F.flatten(F.transform("passages", units)).alias("units"))


def part_parents(each: DataFrame, replies: DataFrame) -> DataFrame:
    """(thread, turn, parent) of ``replies`` (thread, turn) by units: of the least level that links, the earlier message
    whose own units cover most quoted lines; then one whose whole passage is quoted, the later quote, the earlier
    message. ``each``: (thread, turn) and the fields of one unit.

    Messages of a thread that share the same asked units differ in nothing but their turn, so the first of them stands
    for all: a line that many repeat is joined once for each such set.
    """
    asked = each.filter("level > 0").join(replies, ["thread", "turn"], "left_semi")
    own = each.filter("level = 0").join(asked.select("thread", "key").distinct(), ["thread", "key"], "left_semi")
    met = own.groupBy("thread", "turn", "key").agg(F.max("whole").alias("own_whole"))
    alike = met.groupBy("thread", "turn").agg(F.sort_array(F.collect_list(F.struct("key", "own_whole"))).alias("units")).groupBy("thread", "units").agg(F.min("turn").alias("origin"))
    links = asked.join(alike.select("thread", "origin", F.inline("units")), ["thread", "key"]).filter("origin < turn")
    lines = F.flatten(F.collect_list("at"))
    scored = links.groupBy("thread", "turn", "level", "origin").agg(F.size(F.array_distinct(lines)).alias("covered"), F.max(F.col("whole") & F.col("own_whole")).alias("whole"), F.max("place").alias("place"))
    first = scored.groupBy("thread", "turn", F.struct(-F.col("level"), "covered", "whole", "place").alias("rank")).agg(F.min("origin").alias("origin"))
    return first.groupBy("thread", "turn").agg(F.max_by("origin", "rank").alias("parent"))


def reply_paths(parents: DataFrame) -> DataFrame:
    """(thread, turn, path) from (thread, turn, parent): the turns from the thread's start to the message. Each round
    doubles the length of path that every message knows."""
    state = checkpoint(parents.select("thread", "turn", F.array("turn").alias("path"), F.col("parent").alias("up")))
    while state.filter("up IS NOT NULL").limit(1).count():
        above = state.select("thread", F.col("turn").alias("up"), F.col("path").alias("head"), F.col("up").alias("next"))
        longer = state.filter("up IS NOT NULL").join(above, ["thread", "up"]).select("thread", "turn", F.concat("head", "path").alias("path"), F.col("next").alias("up"))
        state = checkpoint(state.filter("up IS NULL").unionByName(longer))
    return state.select("thread", "turn", "path")


def reply_parents(slim: DataFrame) -> DataFrame:
    """(thread, turn, parent) of messages that quote an earlier one; ``slim``: thread, turn and units of each."""
    each = slim.select("thread", "turn", F.inline("units"))
    runs = each.filter("whole").select("thread", "turn", "level", "place", "key").distinct()  # a passage of one paragraph is there once
    origin = runs.filter("level = 0").groupBy("thread", "key").agg(F.min("turn").alias("origin"))
    asked = runs.filter("level > 0").join(origin, ["thread", "key"], "left").select("thread", "turn", "level", F.when(F.col("origin") < F.col("turn"), F.col("origin")).alias("origin"))
    of = F.struct(F.min("origin").alias("low"), F.max("origin").alias("high"), F.count_if(F.col("origin").isNull()).alias("lost"))
    near = asked.groupBy("thread", "turn", "level").agg(of.alias("of")).groupBy("thread", "turn").agg(F.min_by("of", "level").alias("of"))
    named = checkpoint(near.select("thread", "turn", F.when((F.col("of.lost") == 0) & (F.col("of.low") == F.col("of.high")), F.col("of.low")).alias("parent")))
    known, open_ = named.filter("parent IS NOT NULL"), named.filter("parent IS NULL").select("thread", "turn")
    return known.unionByName(part_parents(each, open_)) if open_.limit(1).count() else known


def one_each(cut: DataFrame, repeated: DataFrame, column: str) -> DataFrame:
    """(thread, turn, role, column): of repeated messages the one of the least (role, digest); the others stay where
    they are as long as few are repeated."""
    keys = ["thread", "turn"]
    least = cut.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct("role", "digest", column)).alias("of")).select(*keys, "of.role", f"of.{column}")
    return cut.join(repeated, keys, "left_anti").select(*keys, "role", column).unionByName(least)


def reply_ordered(messages: DataFrame, thread_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", body_col: str = "text") -> DataFrame:
    """(thread, turn, role, parent, depth, path, reply_path, text, rendered); sorted by thread and path, each reply
    stands below what it answers.

    text: the message without quotes. parent: the turn replied to; null where nothing quoted links. depth: 1 for those.
    path: the turns from there; reply_path: the same joined by dots, so both grow with a message's depth. rendered: role
    and text as one chat turn. A null body is empty and a null role reads ``unknown``. Messages without a thread or turn
    are left out; of repeated (thread, turn) the one of the least (role, MD5 of the body) stays. An empty table gives no
    rows.
    """
    whole = messages.select(F.col(thread_col).alias("thread"), F.col(order_col).alias("turn"), F.coalesce(role_col, F.lit("unknown")).alias("role"), F.coalesce(body_col, F.lit("")).alias("body"))
    cut = stored(parsed(whole.filter("thread IS NOT NULL AND turn IS NOT NULL")))
    counted = cut.groupBy("thread", "turn").count()
    repeated = stored(counted.filter("count > 1").select("thread", "turn"))  # a table's size is known, so a small one is broadcast
    parents = reply_parents(one_each(cut, repeated, "units"))
    known = counted.select("thread", "turn").join(parents, ["thread", "turn"], "left")
    return one_each(cut, repeated, "text").join(reply_paths(known), ["thread", "turn"]).select(
        "thread", "turn", "role", F.get("path", F.size("path") - 2).alias("parent"), F.size("path").alias("depth"), "path",
        F.array_join(F.transform("path", lambda t: t.cast("string")), ".").alias("reply_path"), "text", F.concat(F.lit("### "), "role", F.lit("\n"), "text").alias("rendered"),
    )


def quoted_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as messages that quote what they answer: message t answers (t - 1) div 2, quotes it and, a level
    deeper, what that one quotes."""
    own = conversations.select("conv_id", "turn", "role", "text")
    marked = lambda text, mark: F.regexp_replace(F.coalesce(text, F.lit("")), "(?m)^", mark)
    up = lambda t: F.when(t >= 1, F.floor((t - 1) / 2).cast("long"))
    first = own.select("conv_id", F.col("turn").alias("t1"), F.col("text").alias("text1"), F.lit(1).alias("there1"))
    second = own.select("conv_id", F.col("turn").alias("t2"), F.col("text").alias("text2"), F.lit(1).alias("there2"))
    joined = own.withColumn("t1", up(F.col("turn"))).join(first, ["conv_id", "t1"], "left").withColumn("t2", F.when(F.col("there1") == 1, up(F.col("t1")))).join(second, ["conv_id", "t2"], "left")
    body = F.concat_ws("\n", F.when(F.col("there2") == 1, marked(F.col("text2"), "> > ")), F.when(F.col("there1") == 1, marked(F.col("text1"), "> ")), F.coalesce("text", F.lit("")))
    return joined.select("conv_id", "turn", "role", body.alias("text"))


def interleaved_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as messages that answer between quotes: message t quotes every other line of message t - 1, each
    followed by a line of its own."""
    own = conversations.select("conv_id", "turn", "role", F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r").alias("own"))
    above = own.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("own").alias("above"))
    both = own.join(above, ["conv_id", "turn"], "left").withColumn("above", F.coalesce("above", F.array().cast("array<string>")))
    step = lambda i: F.array_compact(F.array(F.when(i % 2 == 0, F.concat(F.lit("> "), F.get("above", i))), F.get("own", i)))
    body = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size("own"), F.size("above")) - 1), step)), "\n")
    return both.select("conv_id", "turn", "role", body.alias("text"))
