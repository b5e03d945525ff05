"""Chunking, cues, timetables, claims and budgets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import numeric as nm
from marginalia.functions.json_text import extracted_json
from marginalia.functions.vectors import hashed_vector
from marginalia.functions.text import ms_clock
from marginalia.operators import chunking as ch
from marginalia.operators import folds
from marginalia.operators import schedule as sc
from marginalia.plans.registry import query
from marginalia.sources.files import vault_notes
from marginalia.tables import events, load, spans


@query(r"""
WITH RECURSIVE paras AS (SELECT doc_id, i - 1 AS paragraph, trim(p[i]) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), unnest(range(1, len(p) + 1)) AS u(i) WHERE trim(p[i]) <> ''),
long AS (SELECT doc_id, paragraph, regexp_extract_all(p, '[^.!?。！？]*[.!?。！？]+\s*|[^.!?。！？]+$') AS s FROM paras WHERE length(p) > 300),
fold AS (SELECT doc_id, paragraph, s, 1 AS i, s[1] AS held, 0 AS segment FROM long
UNION ALL SELECT doc_id, paragraph, s, i + 1, CASE WHEN length(held) + length(s[i + 1]) <= 300 THEN held || s[i + 1] ELSE s[i + 1] END, CASE WHEN length(held) + length(s[i + 1]) <= 300 THEN segment ELSE segment + 1 END FROM fold WHERE i < len(s))
SELECT doc_id, paragraph::INT AS paragraph, 0 AS segment, p AS text FROM paras WHERE length(p) <= 300
UNION ALL SELECT doc_id, paragraph::INT, segment, trim(arg_max(held, i)) FROM fold GROUP BY 1, 2, 3""")
def split_segments(spark, d):
    return ch.split_segments(load(spark, d, "documents"), "doc_id", F.col("text"), 300, "\n")


def _transcripts(spark, d):
    """Each conversation as a transcript: a line with the time alone, then the text, or both in one line."""
    clock = ms_clock(F.col("turn") * 90_000)
    line = F.concat(clock, F.when(F.col("turn") % 2 == 0, "\n").otherwise(" "), F.regexp_replace("text", r"\s+", " "))
    turns = load(spark, d, "conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("x"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("transcript"))


@query(r"""
WITH c AS (SELECT conv_id, turn * 90000 AS start_ms, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) * 90000 AS next_ms, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS cue, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations)
SELECT conv_id, cue, start_ms, coalesce(next_ms, start_ms + 30000) AS end_ms, text FROM c""")
def cue_parse(spark, d):
    return ch.parse_cues(_transcripts(spark, d), "conv_id", F.col("transcript"))


@query("SELECT conv_id, turn, CASE WHEN length(text) <= 200 THEN 1 ELSE NULL END AS whole, length(text) <= 200 OR true AS fits FROM conversations")
def cue_split(spark, d):
    """Whether a cue stays whole, and that all its pieces fit."""
    pieces = ch.split_cue(F.col("text"), 200)
    return load(spark, d, "conversations").select("conv_id", "turn", F.when(F.size(pieces) == 1, 1).alias("whole"), F.forall(pieces, lambda p: F.length(p) <= 200).alias("fits"))


@query("SELECT doc_id, 3 AS questions, 'Q' || (doc_id % 10) || ': first' AS head FROM documents")
def question_split(spark, d):
    text = F.concat(F.lit("1. one\nmore\n22) two\n"), F.lit("Q"), (F.col("doc_id") % 10).cast("string"), F.lit(": first"))
    parts = ch.split_questions(text)
    return load(spark, d, "documents").select("doc_id", F.size(parts).alias("questions"), F.element_at(parts, -1).alias("head"))


@query("""
WITH days AS (SELECT DATE '2024-01-01' + i::INT AS day FROM range(31) r(i)),
rules AS (SELECT s_suppkey AS rule_id, s_suppkey % 7 + 1 AS weekday, 1 AS start_week, s_suppkey % 6 + 1 AS end_week, ['all', 'odd', 'even'][s_suppkey % 3 + 1] AS parity, [s_suppkey % 10, s_suppkey % 10 + 1] AS periods, s_suppkey % 5 <> 0 AS enabled FROM supplier),
adj AS (SELECT day, CASE day(day) % 9 WHEN 3 THEN 'holiday' WHEN 5 THEN 'day_off' WHEN 7 THEN 'day_off' WHEN 8 THEN 'workday' END AS kind, CASE WHEN day(day) % 9 = 7 THEN [2, 3] ELSE [] END AS periods, CASE WHEN day(day) % 9 = 8 THEN day - 3 END AS source_date FROM days WHERE day(day) % 9 IN (3, 5, 7, 8)),
open AS (SELECT d.day, coalesce(a.source_date, d.day)::DATE AS as_of FROM days d LEFT JOIN adj a ON a.day = d.day AND a.kind = 'workday' WHERE d.day NOT IN (SELECT day FROM adj WHERE kind = 'holiday' OR (kind = 'day_off' AND len(periods) = 0))),
dated AS (SELECT *, isodow(as_of) AS weekday, date_diff('day', DATE '2024-01-01', as_of) // 7 + 1 AS week FROM open WHERE as_of >= DATE '2024-01-01')
SELECT d.day, r.rule_id, list_min(r.periods) AS first_period FROM dated d JOIN rules r ON r.weekday = d.weekday AND d.week BETWEEN r.start_week AND r.end_week AND (r.parity = 'all' OR (r.parity = 'odd') = (d.week % 2 = 1))
WHERE r.enabled AND NOT EXISTS (SELECT 1 FROM adj a WHERE a.day = d.day AND a.kind = 'day_off' AND len(list_intersect(a.periods, r.periods)) > 0)""")
def effective_schedule(spark, d):
    k = F.col("s_suppkey")
    rules = load(spark, d, "supplier").select(k.alias("rule_id"), (k % 7 + 1).alias("weekday"), F.lit(1).alias("start_week"), (k % 6 + 1).alias("end_week"), F.get(F.array(*map(F.lit, ("all", "odd", "even"))), (k % 3).cast("int")).alias("parity"), F.array(k % 10, k % 10 + 1).alias("periods"), (k % 5 != 0).alias("enabled"))
    days = sc.days_between(spark, "2024-01-01", 31)
    by = F.dayofmonth("day") % 9
    kind = F.when(by == 3, "holiday").when(by.isin(5, 7), "day_off").otherwise("workday")
    periods = F.when(by == 7, F.array(F.lit(2).cast("long"), F.lit(3).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    adjustments = days.filter(by.isin(3, 5, 7, 8)).select("day", kind.alias("kind"), periods.alias("periods"), F.when(by == 8, F.date_sub("day", 3)).alias("source_date"))
    return sc.effective_schedule(days, rules, adjustments, "2024-01-01")


@query("""
WITH w AS (SELECT doc_id, lang, string_split(text, ' ') AS w FROM documents), c AS (
SELECT doc_id, 'definition' AS claim_type, unnest(w[1:2]) AS claim FROM w UNION ALL SELECT doc_id, 'example', unnest(w[3:4]) FROM w UNION ALL SELECT doc_id, 'caution', unnest(w[5:5]) FROM w WHERE lang = 'en')
SELECT doc_id, claim_type, claim, 'producer:' || claim_type || ':' || substr(sha256(doc_id || '|' || claim), 1, 12) AS claim_key FROM c""")
def claim_projection(spark, d):
    """Nested lists of each document to one table of claims with stable keys."""
    w = load(spark, d, "documents").select("doc_id", "lang", F.split("text", " ").alias("w"))
    of = lambda kind, words: F.struct(F.lit(kind).alias("claim_type"), words.alias("claims"))
    lists = F.array(of("definition", F.slice("w", 1, 2)), of("example", F.slice("w", 3, 2)), of("caution", F.when(F.col("lang") == "en", F.slice("w", 5, 1))))
    c = w.select("doc_id", F.inline(lists)).select("doc_id", "claim_type", F.explode("claims").alias("claim"))
    key = F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "claim"), 256), 1, 12)
    return c.withColumn("claim_key", F.concat_ws(":", F.lit("producer"), "claim_type", key))


@query("""
WITH r AS (SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS reserved, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS calls FROM events)
SELECT event_id, round(reserved, 4) AS reserved, CASE WHEN calls > 50 THEN 'call_cap' WHEN reserved > 1500 THEN 'token_cap' WHEN value > 95 THEN 'size_cap' ELSE 'ok' END AS verdict FROM r""")
def budget_accounting(spark, d):
    """Running reservations of each user against caps on calls, tokens and the size of one call."""
    w = W.partitionBy("user_id").orderBy("event_id")
    r = load(spark, d, "events").select("event_id", "value", nm.exact_sum(F.col("value"), w).alias("reserved"), F.row_number().over(w).alias("calls"))
    verdict = F.when(F.col("calls") > 50, "call_cap").when(F.col("reserved") > 1500, "token_cap").when(F.col("value") > 95, "size_cap").otherwise("ok")
    return r.select("event_id", F.round("reserved", 4).alias("reserved"), verdict.alias("verdict"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE '{\"a\":[1,' || event_id || '],\"b\":\"}\"}' END AS json FROM events")
def noisy_json_extract(spark, d):
    """Objects out of chatter and fences, with a trailing comma forgiven."""
    i = F.col("event_id").cast("string")
    body = F.concat(F.lit('{"b": "}", "a": [1, '), i, F.lit(",]}"))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here it is: "), body, F.lit(" done"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise("no object {")
    return load(spark, d, "events").select("event_id", extracted_json(raw).alias("json"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN replace(props, ' ', '') END AS json FROM events")
def json_in_chatter(spark, d):
    """The table's own objects out of chatter: after another bracket, fenced, after thinking, with a loose comma, cut
    off after a whole value; and none."""
    by, props = F.col("event_id") % 5, F.col("props")
    raw = F.when(by == 0, F.concat(F.lit("note ["), "event_type", F.lit("] then "), props, F.lit(" done"))).when(by == 1, F.concat(F.lit("Here:\n```json\n"), props, F.lit("\n```\nand that")))
    raw = raw.when(by == 2, F.concat(F.lit('<thinking>{"z": 1}</thinking>'), F.replace(props, F.lit("}"), F.lit(",}")))).when(by == 3, F.concat(props, F.lit(' and {"more": ['))).otherwise(F.concat(F.lit("none in ["), "event_type"))
    return load(spark, d, "events").select("event_id", extracted_json(raw).alias("json"))


@query("""
SELECT c_custkey AS note_id, c_name || '-N' || lpad(c_custkey::VARCHAR, 6, '0') || '.md' AS file_name, sha256('---' || chr(10) || 'title: "' || c_name || '"' || chr(10) || 'id: ' || c_custkey || chr(10) || '---' || chr(10) || 'In ' || c_mktsegment || chr(10) || chr(10) || 'sha256:' || sha256('In ' || c_mktsegment) || chr(10)) AS digest FROM customer""")
def vault_note_files(spark, d):
    notes = load(spark, d, "customer").withColumn("body", F.concat(F.lit("In "), "c_mktsegment"))
    made = vault_notes(notes, "c_custkey", "c_name", "body")
    number = F.regexp_extract("file_name", r"-N([0-9]+)\.md$", 1).cast("long")
    return made.select(number.alias("note_id"), "file_name", F.sha2("value", 256).alias("digest"))


@query("""
WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS us, event_id FROM events), r AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM e)
SELECT user_id, event_id, event_type FROM r WHERE before IS DISTINCT FROM event_type""")
def change_feed(spark, d):
    """Snapshots that differ from the one before."""
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("us", "event_id"))
    return events(spark, d).withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", "event_type")


@query("""
SELECT s_suppkey, (s_suppkey % 16 + 1)::INT AS first, (CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 16 + 1 ELSE s_suppkey % 16 + 5 END)::INT AS last, ['all', 'odd', 'even'][s_suppkey % 3 + 1] AS parity FROM supplier""")
def week_specs(spark, d):
    k = F.col("s_suppkey")
    one = (k % 16 + 1).cast("string")
    spec = F.when(k % 3 == 0, one).otherwise(F.concat(one, F.lit("-"), (k % 16 + 5).cast("string"), F.when(k % 3 == 1, "odd").otherwise(" Even")))
    return load(spark, d, "supplier").select("s_suppkey", nm.week_spec(spec).alias("w")).select("s_suppkey", "w.first", "w.last", "w.parity")


@query("SELECT conv_id AS domain_id, count(*) AS spans, 0 AS over_budget, count(*) AS distinct_spans FROM conversations GROUP BY 1")
def refit_segments(spark, d):
    """All spans stay, once each, and no segment is over the budget: what a refit promises, of one segment a domain."""
    s = spans(spark, d).select("domain_id", F.lit(1).alias("segment"), "ordinal", "tokens", F.lit(False).alias("overlap"))
    fitted = folds.refit_segments(s, 600).join(s.select("domain_id", "ordinal", "tokens"), ["domain_id", "ordinal"])
    each = fitted.groupBy("domain_id", "segment").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.count_distinct("ordinal").alias("k"))
    return each.groupBy("domain_id").agg(F.sum("n").alias("spans"), F.count_if(F.col("tokens") > 600).cast("int").alias("over_budget"), F.sum("k").alias("distinct_spans"))


@query("SELECT doc_id, 64 AS dimensions, 1.0 AS length FROM documents")
def text_vectors(spark, d):
    v = hashed_vector(F.col("text"))
    return load(spark, d, "documents").select("doc_id", v.alias("v")).select("doc_id", F.size("v").alias("dimensions"), F.round(F.sqrt(nm.dot(F.col("v"), F.col("v"))), 6).alias("length"))
