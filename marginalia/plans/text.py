"""Normalisation, hashes, locators, term sets, answers and de-duplication over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.functions.numeric import jaccard
from marginalia.operators import dedup
from marginalia.plans.registry import query
from marginalia.tables import events, load, load_texts

#: DuckDB's form of text normalisation, for texts without ideographs, hyphens at line ends and rare white space.
NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\r\f\x0B\x{A0}\x{3000}]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(rf"SELECT doc_id, length({NORMAL}) AS chars, length(text) AS raw_chars, sha256({NORMAL}) AS digest FROM documents")
def text_normalize(spark, d):
    clean = tx.normalize_text(F.col("text"))
    return load_texts(spark, d).select("doc_id", F.length(clean).alias("chars"), F.length("text").alias("raw_chars"), F.sha2(clean, 256).alias("digest"))


#: Texts with line ends, blanks, hyphens and ideographs of every kind around what documents hold.
RARE_TEXTS = """CASE doc_id % 9 WHEN 0 THEN 'Anti-' || chr(10) || 'Hero ' || source || '-' || chr(13) || chr(10) || lang WHEN 1 THEN 'é-' || chr(10) || 'tag' || chr(173) || chr(10) || lang WHEN 2 THEN chr(8195) || source || chr(8195) || chr(10) || chr(133) || lang || chr(28) || chr(10) || chr(10) || chr(10) || chr(10) || 'x'
  WHEN 3 THEN '光' || chr(8195) || '的 ' || chr(10) || '反 射' || source WHEN 4 THEN 'a-' || chr(10) || 'b-' || chr(10) || 'c' || chr(8203) || lang WHEN 5 THEN chr(160) || chr(12288) || source || '  ' || chr(9) || lang || chr(31) WHEN 6 THEN 'x' || chr(8203) || '-' || chr(10) || chr(65279) || 'y' WHEN 7 THEN '漢字 abc 漢 ' || chr(8232) || ' 字' ELSE substr(text, 1, 200) END"""
LINE_SPACE = r" \t\r\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _closed(sql: str) -> str:
    return rf"regexp_replace({sql}, '([\x{{3400}}-\x{{9FFF}}])[\n{LINE_SPACE}]+([\x{{3400}}-\x{{9FFF}}])', '\1\2', 'g')"


@query(rf"""
WITH o AS (SELECT doc_id, {RARE_TEXTS} AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}\x{{FEFF}}]', '', 'g') AS t FROM o),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([A-Za-z])-\n([A-Za-z])', '\1\2', 'g'), '[ \t\r\f\x0B\x{{A0}}\x{{3000}}]+', ' ', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '[{LINE_SPACE}]*\n[{LINE_SPACE}]*', chr(10), 'g') AS t FROM b)
SELECT doc_id, regexp_replace(regexp_replace({_closed(_closed("t"))}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\n{LINE_SPACE}]+|[\n{LINE_SPACE}]+$', '', 'g') AS clean FROM c""")
def text_normalize_rare(spark, d):
    """Normalised forms of texts with rare white space, hyphens at line ends and ideographs."""
    at = lambda n: F.lit(chr(n))
    lf, source, lang, by = at(10), F.col("source"), F.col("lang"), F.col("doc_id") % 9
    forms = [
        F.concat(F.lit("Anti-\nHero "), source, F.lit("-\r\n"), lang), F.concat(F.lit("é-\ntag\xad\n"), lang), F.concat(at(8195), source, at(8195), lf, at(133), lang, at(28), F.lit("\n\n\n\nx")),
        F.concat(F.lit("光\u2003的 \n反 射"), source), F.concat(F.lit("a-\nb-\nc\u200b"), lang), F.concat(at(160), at(12288), source, F.lit("  \t"), lang, at(31)), F.lit("x\u200b-\n\ufeffy"), F.lit("漢字 abc 漢 \u2028 字"),
    ]
    made = F.substring("text", 1, 200)
    for i, form in enumerate(forms):
        made = F.when(by == i, form).otherwise(made)
    return load_texts(spark, d).select("doc_id", tx.normalize_text(made).alias("clean"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, sha256(concat_ws('|', doc_id::VARCHAR, lang, source)) AS scope_hash FROM documents")
def content_hashes(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"), F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source"), 256).alias("scope_hash"))


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return load_texts(spark, d).select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


#: DuckDB's form of the noise verdict on a normalised text ``t``: sets and string functions in place of most patterns.
NOISE = r"""CASE WHEN trim(t, ' ' || chr(9) || chr(10)) = '' THEN 'empty' WHEN length(t) > 200 THEN NULL
  WHEN translate(t, '.-_=*~#·—– ' || chr(9) || chr(10), '') = '' OR lower(t) IN ('无内容', '没有内容', '此页无文字', 'no content', 'empty', 'n/a', 'na') THEN 'placeholder'
  WHEN substr(t, 1, 1) IN ('[', '(', '（', '【') AND right(t, 1) IN (']', ')', '）', '】') AND lower(trim(substr(t, 2, length(t) - 2), ' ' || chr(9) || chr(10))) IN ('空', '无', '略', '图片', 'image', 'figure', 'table', '图表', '公式', 'equation', '待补充', 'todo', 'tbd') THEN 'placeholder'
  WHEN starts_with(lower(t), 'error:') AND length(ltrim(substr(t, 7), ' ' || chr(10))) <= 120 AND NOT contains(ltrim(substr(t, 7), ' ' || chr(10)), chr(10)) THEN 'parse_marker'
  WHEN starts_with(t, '[') AND instr(t, ']') = length(t) AND NOT contains(t, chr(10)) AND len(list_filter(['解析失败', 'parse failed', 'parse error'], lambda m: instr(lower(t), m) BETWEEN 2 AND 42 AND length(t) - 1 - instr(lower(t), m) - length(m) <= 119)) > 0 THEN 'parse_marker' END"""

ODD_TEXTS = """CASE doc_id % 11 WHEN 0 THEN substr(text, 1, 3) WHEN 1 THEN repeat('-', n_chars::INT % 30 + 1) || '  ==' WHEN 2 THEN '[' || source || ' parse failed: ' || lang || ']' WHEN 3 THEN '(' || CASE WHEN n_chars % 2 = 0 THEN 'ToDo' ELSE '图表' END || ' ]'
  WHEN 4 THEN 'Error: ' || substr(text, 1, 40) WHEN 5 THEN '[' || lang || ' 解析失败: ' || source || ']' WHEN 6 THEN 'N/A' WHEN 7 THEN 'placeholder' WHEN 8 THEN chr(10) || ' ' ELSE text END"""


@query(rf"WITH o AS (SELECT doc_id, {ODD_TEXTS} AS text FROM documents), s AS (SELECT doc_id, {NORMAL} AS t FROM o) SELECT doc_id, {NOISE} AS verdict FROM s")
def noise_classify(spark, d):
    """Verdicts on texts, and on stand-ins for them of every kind."""
    text, by = F.col("text"), F.col("doc_id") % 11
    said = F.concat(F.repeat(F.lit("-"), (F.col("n_chars") % 30 + 1).cast("int")), F.lit("  =="))
    t = F.when(by == 0, F.substring(text, 1, 3)).when(by == 1, said).when(by == 2, F.concat(F.lit("["), "source", F.lit(" parse failed: "), "lang", F.lit("]")))
    t = t.when(by == 3, F.concat(F.lit("("), F.when(F.col("n_chars") % 2 == 0, "ToDo").otherwise("图表"), F.lit(" ]"))).when(by == 4, F.concat(F.lit("Error: "), F.substring(text, 1, 40)))
    t = t.when(by == 5, F.concat(F.lit("["), "lang", F.lit(" 解析失败: "), "source", F.lit("]"))).when(by == 6, "N/A").when(by == 7, "placeholder").when(by == 8, "\n ").otherwise(text)
    return load_texts(spark, d).select("doc_id", tx.noise_verdict(tx.normalize_text(t)).alias("verdict"))


@query("""
WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '.pdf' WHEN 1 THEN url || '.PPTX' WHEN 2 THEN url || '.srt' WHEN 3 THEN url || '.htm' ELSE url || '/' END AS name, CASE WHEN page_id % 7 = 0 THEN ' Text ' END AS kind FROM pages)
SELECT page_id, coalesce(lower(trim(kind)), CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'ppt' WHEN 2 THEN 'transcript' WHEN 3 THEN 'html' ELSE 'unknown' END) AS source_kind FROM p""")
def source_kind_infer(spark, d):
    by, url = F.col("page_id") % 5, F.col("url")
    name = F.concat(url, F.when(by == 0, ".pdf").when(by == 1, ".PPTX").when(by == 2, ".srt").when(by == 3, ".htm").otherwise("/"))
    return load(spark, d, "pages").select("page_id", tx.infer_kind(F.when(F.col("page_id") % 7 == 0, " Text "), name).alias("source_kind"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'page:' || user_id WHEN 1 THEN 'slide:' || user_id WHEN 2 THEN 'body' WHEN 3 THEN 'cue:' || user_id ELSE 'unknown' END AS locator,
  CASE WHEN event_id % 5 < 2 THEN user_id::INT END AS page, (epoch_us(ts) // 1000000 % 86400 * 1000 + event_id % 1000)::BIGINT AS ms
FROM events""")
def locator_parse(spark, d):
    by, user = F.col("event_id") % 5, F.col("user_id").cast("string")
    raw = F.when(by == 0, F.concat(F.lit("Page "), user)).when(by == 1, F.concat(F.lit("slide: 0"), user)).when(by == 2, " Body").when(by == 3, F.concat(F.lit("cue#"), user)).otherwise("?")
    clock = tx.ms_clock(F.floor(F.col("us") / 1000000) % 86400 * 1000 + F.col("event_id") % 1000)
    return events(spark, d).select("event_id", tx.canonical_locator(raw).alias("locator"), tx.page_number(F.trim(raw)).alias("page"), tx.clock_ms(clock).alias("ms"))


@query("""
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::INT AS n, sha256(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)), ' ')) AS digest FROM documents""")
def char_tokenize(spark, d):
    tokens = tx.char_tokens(F.col("text"))
    return load_texts(spark, d).select("doc_id", F.size(tokens).alias("n"), F.sha2(F.array_join(tokens, " "), 256).alias("digest"))


@query("""
SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]{2,}'), lambda x: lower(x))))::INT AS terms FROM documents""")
def term_sets(spark, d):
    return load_texts(spark, d).select("doc_id", F.size(tx.term_set(F.col("text"))).alias("terms"))


@query(r"""
WITH a AS (SELECT conv_id, turn, substr(text, 1, 12) AS expected, CASE turn % 3 WHEN 0 THEN '-' || text WHEN 1 THEN substr(text, 1, 12) || '!' ELSE 'no' END AS given FROM conversations),
n AS (SELECT *, lower(regexp_replace(expected, '[\s\p{P}]+', '', 'g')) AS e, lower(regexp_replace(given, '[\s\p{P}]+', '', 'g')) AS g FROM a)
SELECT conv_id, turn, e <> '' AND (g = e OR (length(e) >= 4 AND contains(g, e))) AS is_right FROM n""")
def answer_grading(spark, d):
    by, text = F.col("turn") % 3, F.col("text")
    given = F.when(by == 0, F.concat(F.lit("-"), text)).when(by == 1, F.concat(F.substring(text, 1, 12), F.lit("!"))).otherwise("no")
    return load(spark, d, "conversations").select("conv_id", "turn", tx.answer_is_right(given, F.substring(text, 1, 12)).alias("is_right"))


@query(r"""
WITH n AS (SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS f, url FROM pages)
SELECT page_id, CASE WHEN f = '' THEN 'untitled' ELSE f END AS file_name, CASE WHEN regexp_matches(url, '[:#\[\]{}",''&*!|>%@`]|^\s|\s$|^$') THEN '"' || replace(replace(url, '\', '\\'), '"', '\"') || '"' ELSE url END AS yaml FROM n""")
def name_sanitize(spark, d):
    return load(spark, d, "pages").select("page_id", tx.safe_file_name(F.col("url")).alias("file_name"), tx.yaml_quoted(F.col("url")).alias("yaml"))


@query(r"""
SELECT doc_id, 'T' || lpad(doc_id::VARCHAR, 6, '0') AS sequence_id, 'P' || lpad((n_chars % 100)::VARCHAR, 4, '0') || '.' || lpad((doc_id % 100)::VARCHAR, 2, '0') AS paged_id,
  regexp_matches(CASE WHEN doc_id % 3 = 0 THEN 'X1' WHEN doc_id % 3 = 1 THEN 'T' || lpad(doc_id::VARCHAR, 6, '0') ELSE 'S' || doc_id END, '^[TPDIS][0-9]{4,6}(\.[0-9]{1,2})?$') AS valid FROM documents""")
def source_ids(spark, d):
    i = F.col("doc_id")
    some = F.when(i % 3 == 0, "X1").when(i % 3 == 1, tx.sequence_id(F.lit("T"), i)).otherwise(F.concat(F.lit("S"), i.cast("string")))
    return load(spark, d, "documents").select("doc_id", tx.sequence_id(F.lit("T"), i).alias("sequence_id"), tx.paged_id(F.lit("P"), F.col("n_chars") % 100, i % 100).alias("paged_id"), tx.is_source_id(some).alias("valid"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text) ELSE '' END AS visible FROM conversations")
def thinking_removal(spark, d):
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>first\nthen</think>\n"), "text", F.lit(" <THINK>x</Think>"))).otherwise(F.concat(F.lit("<think>"), "text"))
    return load(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(tx.without_thinking(raw), r"^\n+", "").alias("visible"))


@query(r"""
WITH h AS (SELECT doc_id, lang, """ + NORMAL + r""" AS t FROM documents)
SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY lang, t) AS canonical_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY lang, t) THEN 'included' ELSE 'duplicate' END AS state FROM h""")
def dedup_exact(spark, d):
    return dedup.exact_canonical(load_texts(spark, d), "doc_id", F.col("text"), "lang")


@query(r"""
WITH c AS (SELECT doc_id, lower(regexp_replace(text, '\s+', '', 'g')) AS t FROM documents WHERE length(regexp_replace(text, '\s+', '', 'g')) >= 120)
SELECT a.doc_id, min(b.doc_id) AS container_id FROM c a JOIN c b ON substr(a.t, 1, 120) = substr(b.t, 1, 120) AND b.doc_id < a.doc_id AND starts_with(b.t, a.t) GROUP BY 1""")
def dedup_prefix_containment(spark, d):
    return dedup.prefix_contained(load_texts(spark, d), "doc_id", F.col("text"))


@query("""
SELECT DISTINCT d.doc_id, d.doc_id IN (SELECT kept FROM (SELECT min(doc_id) AS kept FROM documents GROUP BY text)) AS canonical
FROM documents d WHERE EXISTS (SELECT 1 FROM documents o WHERE o.text = d.text AND o.doc_id <> d.doc_id)""")
def exists_self_join_canonical(spark, d):
    docs = load_texts(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))
    groups = docs.groupBy("hash").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).filter("n > 1")
    return docs.join(groups, "hash").select("doc_id", (F.col("doc_id") == F.col("kept")).alias("canonical"))


@query(r"""
WITH t AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]{2,}'), lambda x: lower(x))) AS s FROM documents),
l AS (SELECT doc_id, lead(doc_id) OVER (ORDER BY doc_id) AS other FROM documents)
SELECT a.doc_id, round(CASE WHEN len(list_distinct(list_concat(a.s, b.s))) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END, 6) AS similarity
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def jaccard_match(spark, d):
    t = load_texts(spark, d).select("doc_id", tx.term_set(F.col("text")).alias("s"))
    other = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("o"))
    return t.join(other, "doc_id").select("doc_id", F.round(jaccard(F.col("s"), F.col("o")), 6).alias("similarity"))


@query(r"""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day FROM orders)
SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)<h[1-6][^>]*>'), '') AS headings, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_chars FROM pages""")
def page_outline(spark, d):
    return load(spark, d, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(r"(?i)<h[1-6][^>]*>"), F.lit(0)), "").alias("headings"), F.length(F.regexp_replace("html", r"<[^>]*>", "")).alias("text_chars"))
