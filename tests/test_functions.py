import math

import pytest
from pyspark.sql import functions as F

from marginalia.functions import numeric as nm
from marginalia.functions import text as tx


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", list: "array<double>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "clean"), [
    ("a\r\nb\rc", "a\nb\nc"), ("inter-\nnal", "internal"), ("so\xad\nft", "so\xad\nft"), ("Anti-\nHero", "AntiHero"), ("é-\nt 1-\n2", "é-\nt 1-\n2"), ("\u2003a\u2003\n\x85b\x1c", "a\nb"), ("光\u2003的", "光的"), ("​x﻿ y　z", "x y z"),
    ("  a  \n\n\n\n b ", "a\n\nb"), ("中 文 x", "中文 x"), ("", ""), (" \n ", ""),
])
def test_normalize_text(spark, raw, clean):
    assert one(spark, tx.normalize_text(F.col("t")), t=raw) == clean


@pytest.mark.parametrize(("text", "tokens"), [("abcd", 1), ("abcde", 2), ("中文", 2), ("中a", 2), ("", 0)])
def test_estimate_tokens(spark, text, tokens):
    assert one(spark, tx.estimate_tokens(F.col("t")), t=text) == tokens


@pytest.mark.parametrize(("raw", "locator"), [("Page 07", "page:7"), ("slide:3", "slide:3"), ("BODY", "body"), ("seg#12", "seg:12"), ("cue 4", "cue:4"), ("00:01:02-00:01:03.5#02", "time:00:01:02-00:01:03.5#02"), ("p", "unknown")])
def test_canonical_locator(spark, raw, locator):
    assert one(spark, tx.canonical_locator(F.col("t")), t=raw) == locator


@pytest.mark.parametrize(("clock", "ms"), [("01:02:03", 3723000), ("00:00:01.5", 1500), ("00:60:00", None), ("x", None), ("00:00:00.007", 7)])
def test_clock(spark, clock, ms):
    assert one(spark, tx.clock_ms(F.col("t")), t=clock) == ms
    if ms is not None:
        assert one(spark, tx.clock_ms(tx.ms_clock(F.col("m"))), m=ms) == ms


def test_terms_and_tokens(spark):
    assert one(spark, tx.char_tokens(F.col("t")), t="Ab1 中 c文") == ["ab1", "c", "中", "文"]
    assert one(spark, tx.term_set(F.col("t")), t="ab A 中文字 AB") == ["ab", "中文字", "中文", "文字"]


@pytest.mark.parametrize(("rating", "streak", "previous", "days"), [(0, 0, 10.0, 1), (1, 0, 10.0, 1), (2, 0, 10.0, 3), (3, 0, 10.0, 18), (4, 0, 10.0, 25), (5, 0, 10.0, 32), (5, 2, 50.0, 1), (5, 1, 50.0, 160), (5, 0, 100.0, 180)])
def test_next_interval(spark, rating, streak, previous, days):
    assert one(spark, nm.next_interval(F.col("p"), F.col("r"), F.col("s")), p=previous, r=rating, s=streak) == days


def test_mastery_ratio_and_clamp(spark):
    assert one(spark, nm.mastery_step(F.col("m"), F.lit(True)), m=0.5) == 0.65
    assert one(spark, nm.mastery_step(F.col("m"), F.lit(False)), m=0.5) == 0.25
    assert one(spark, nm.mastery_step(F.col("m"), F.lit(True)), m=0.95) == 1.0
    assert one(spark, nm.ratio(F.lit(1), F.lit(0))) == 0.0 and one(spark, nm.ratio(F.lit(1), F.lit(0), 1.0)) == 1.0
    assert one(spark, nm.clamp01(F.col("t")), t="nan") == 0.0 and one(spark, nm.clamp01(F.col("t")), t="2") == 1.0 and one(spark, nm.clamp01(F.col("t")), t="x") == 0.0


def test_vectors(spark):
    assert math.isclose(one(spark, nm.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]), 0.5**0.5, rel_tol=1e-6)
    assert one(spark, nm.cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 1.0]) == 0.0
    assert one(spark, nm.jaccard(F.array(), F.array())) == 0.0


def test_answers_names_and_thinking(spark):
    assert one(spark, tx.answer_is_right(F.col("g"), F.col("e")), g="The answer is: Forty-two!", e="forty two")
    assert not one(spark, tx.answer_is_right(F.col("g"), F.col("e")), g="abc d", e="abc")
    assert one(spark, tx.safe_file_name(F.col("t")), t=' a<b>:"c?. ') == "a_b___c_"
    assert one(spark, tx.yaml_quoted(F.col("t")), t='a: "b"') == '"a: \\"b\\""' and one(spark, tx.yaml_quoted(F.col("t")), t="plain") == "plain"
    assert one(spark, tx.without_thinking(F.col("t")), t="<think>x\ny</think> z <think>open") == "z"
    assert one(spark, tx.fuzzy_contains(F.col("h"), F.col("n")), h="He llo w0rld", n="hello world")


@pytest.mark.parametrize(("text", "verdict"), [
    ("", "empty"), (" \n", "empty"), ("-----", "placeholder"), ("· · ·", "placeholder"), ("=== ***", "placeholder"), ("[ 图片 ]", "placeholder"), ("(TODO)", "placeholder"), ("【空】", "placeholder"),
    ("N/A", "placeholder"), ("na", "placeholder"), ("No Content", "placeholder"), ("此页无文字", "placeholder"), ("none", None), ("todo", None), ("placeholder", None), ("[x] todo", None), ("-" * 201, None),
    ("[docx 解析失败: bad zip]", "parse_marker"), ("[Slide parse FAILED]", "parse_marker"), ("[parse error: 3]", "parse_marker"), ("[" + "x" * 41 + "parse error]", None), ("[parse error]\nmore", None),
    ("Error: no such file", "parse_marker"), ("error: " + "x" * 121, None), ("an error: x", None),
])
def test_noise_verdict(spark, text, verdict):
    assert one(spark, tx.noise_verdict(F.col("t")), t=text) == verdict


@pytest.mark.parametrize(("text", "marker"), [(" [pdf 解析失败：" + "x" * 250, True), ("[pdf 解析失败：" + "x" * 300, False), ("[zip 解析失败: x]", True), ("[zip 解析失败: x", False), ("error: x", True), ("", False)])
def test_parse_marker(spark, text, marker):
    assert one(spark, tx.is_parse_marker(F.col("t")), t=text) is marker


def test_rare_ideographs_are_wide_and_close(spark):
    assert one(spark, tx.normalize_text(F.col("t")), t="㐀 ䷀ 中\n文") == "㐀䷀中文"
    assert one(spark, tx.estimate_tokens(F.col("t")), t="㐀䷀x") == 3


def test_thinking_of_both_spellings(spark):
    assert one(spark, tx.without_thinking(F.col("t")), t="<thinking>a</thinking>b<thinking>c </ thinking >d<THINK>e") == "bc d"


def test_a_sum_that_meets_a_cap_is_not_over_it(spark, tmp_path):
    from marginalia.plans import QUERIES

    values = {1: [155.41, 411.15, 410.45, 509.6, 13.39], 2: [0.1, 0.2, 1e300, -1e300]}
    rows = [(10 * u + i, u, v) for u, of in values.items() for i, v in enumerate(of)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    made = {r["event_id"]: (r["reserved"], r["verdict"]) for r in QUERIES["budget_accounting"](spark, str(tmp_path)).collect()}
    assert made[14] == (1500.0, "ok")
    assert made[21][0] == 0.3 and made[22] == (1e300, "token_cap")


def test_normalisation_looks_at_most_texts_once(spark):
    """Patterns over each text took some 13 s for 173 MB; searches tell the texts that none of them matches."""
    import time

    plain = spark.range(4000).select(F.concat(F.repeat(F.lit("Words and a line.\nAnother, ünïcode line\n"), 250), F.col("id").cast("string")).alias("t")).cache()
    plain.count()
    def seconds(column):
        at = time.monotonic()
        plain.select(column.alias("v")).write.format("noop").mode("overwrite").save()
        return time.monotonic() - at

    odd = F.regexp_replace("t", f"[{tx.SPACES[5:10]}{tx.SPACES[11:-1]}]", "")  # one of the old patterns
    seconds(odd), seconds(tx.normalize_text(F.col("t")))
    assert min(seconds(tx.normalize_text(F.col("t"))) for _ in range(3)) < 1.2 * seconds(odd)
