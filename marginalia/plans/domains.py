"""Domains of materials: members, source maps and content digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import coverage, domain
from marginalia.sources import commits
from marginalia.streaming.tables import new_folder, written
from marginalia.plans.registry import query
from marginalia.plans.text import NOISE, NORMAL
from marginalia.tables import load, load_texts

MEMBERS = rf"""
WITH own AS (SELECT doc_id % 5 AS domain_id, doc_id AS material_id, n_chars * 7 % 1000 AS position, CASE WHEN doc_id % 17 = 3 THEN 'image' ELSE ['pdf', 'ppt', 'doc', 'text', 'transcript'][n_chars % 5 + 1] END AS kind,
  CASE WHEN doc_id % 13 = 1 THEN 'needs_ocr' WHEN doc_id % 13 = 2 THEN 'FAILED' ELSE 'ready' END AS status, CASE WHEN doc_id % 29 = 5 THEN '[' || source || ' parse failed: ' || lang || ']' END AS error, text FROM documents),
said AS (SELECT conv_id % 5 AS domain_id, conv_id, turn, text FROM conversations WHERE conv_id < 5),
spoken AS (SELECT domain_id, string_agg(text, chr(10) ORDER BY conv_id, turn) AS text FROM said GROUP BY 1),
clean AS (SELECT *, {NORMAL} AS t FROM own),
every AS (SELECT domain_id, false AS inline, position, material_id, kind, length(text) AS raw_chars, CASE WHEN t <> '' THEN 'sha256:' || sha256(t) END AS content_hash,
    CASE WHEN error IS NOT NULL OR status = 'FAILED' THEN 'parse_failed' WHEN status = 'needs_ocr' THEN 'unsupported_parse_state' WHEN kind = 'image' THEN 'unsupported_file_type' END AS reason, status FROM clean
  UNION ALL SELECT domain_id, true, NULL, NULL, 'transcript', length(text), 'sha256:' || sha256({NORMAL}), NULL, NULL FROM spoken WHERE trim(text) <> ''),
placed AS (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY inline, position, material_id) AS ordinal FROM every),
known AS (SELECT *, min(ordinal) FILTER (reason IS NULL AND content_hash IS NOT NULL) OVER (PARTITION BY domain_id, kind, content_hash) AS first FROM placed),
members AS (SELECT domain_id, ordinal, material_id, kind, raw_chars, content_hash, status, reason IS NULL AND first < ordinal AS again, CASE WHEN reason IS NULL AND first < ordinal THEN 'duplicate' WHEN reason IS NULL THEN 'included' WHEN reason = 'parse_failed' THEN 'failed' ELSE 'unsupported' END AS state,
  CASE WHEN reason IS NULL AND first < ordinal THEN 'duplicate_content_hash' ELSE reason END AS reason, CASE WHEN reason IS NULL AND first < ordinal THEN first END AS canonical_ordinal FROM known)
"""


def _materials(spark, d):
    i, n = F.col("doc_id"), F.col("n_chars")
    kinds = F.array(*map(F.lit, ["pdf", "ppt", "doc", "text", "transcript"]))
    kind = F.when(i % 17 == 3, "image").otherwise(F.get(kinds, (n % 5).cast("int")))
    status = F.when(i % 13 == 1, "needs_ocr").when(i % 13 == 2, "FAILED").otherwise("ready")
    error = F.when(i % 29 == 5, F.concat(F.lit("["), "source", F.lit(" parse failed: "), "lang", F.lit("]")))
    return load_texts(spark, d).select((i % 5).alias("domain_id"), (n * 7 % 1000).alias("position"), i.alias("material_id"), kind.alias("kind"), F.concat(F.lit("file:"), i.cast("string")).alias("locator"), status.alias("status"), error.alias("error"), "text")


def _said(spark, d):
    return load(spark, d, "conversations").filter("conv_id < 5").select((F.col("conv_id") % 5).alias("domain_id"), "conv_id", "turn", "text")


def _members(spark, d):
    turns = F.sort_array(F.collect_list(F.struct("conv_id", "turn", "text")))
    spoken = _said(spark, d).groupBy("domain_id").agg(F.array_join(F.transform(turns, lambda x: x["text"]), "\n").alias("text"))  # one conversation each
    materials = _materials(spark, d)
    twice = materials.unionByName(materials.filter("material_id % 50 = 0").withColumn("position", F.col("position") + 1000))
    return domain.domain_members(twice, spoken)


@query(MEMBERS + "SELECT domain_id, ordinal, material_id, kind, raw_chars, content_hash, state, reason, canonical_ordinal FROM members")
def domain_members(spark, d):
    """Members of five domains: documents of several kinds, some of them named twice, and a conversation."""
    return _members(spark, d).drop("locator")


FROZEN = ["domain_id", "ordinal", "material_id", "kind", "content_hash", "state", "canonical_ordinal"]


@query(MEMBERS + """,
fields AS (SELECT domain_id, sha256(array_to_string(list_transform([domain_id::VARCHAR, ordinal::VARCHAR, material_id::VARCHAR, kind, content_hash, state, canonical_ordinal::VARCHAR], lambda x: coalesce(length(x) || ':' || x, '-')), '')) AS d FROM members),
lanes AS (SELECT domain_id, i, count(*) AS rows, sum(('0x' || substr(d, 8 * i + 1, 8))::BIGINT)::BIGINT AS s FROM fields, range(8) t(i) GROUP BY ALL)
SELECT domain_id, any_value(rows) AS rows, 'sha256:' || sha256(any_value(rows) || ':' || string_agg(s::VARCHAR, ':' ORDER BY i)) AS hash FROM lanes GROUP BY 1""")
def domain_freeze(spark, d):
    """Digests of the five domains' members, frozen twice: the second time changes nothing."""
    members, base = written(_members(spark, d).select(*FROZEN), "members"), new_folder(spark, "frozen")
    first = commits.freeze({"members": members}, base, "domain_id")
    again = commits.freeze({"members": members.orderBy("kind")}, base, "domain_id")
    if again["new"] or again["kept"] != first["new"]:
        raise AssertionError(f"a repeated freeze changed domains: {first}, {again}")
    return commits.frozen_hashes(spark, base).select("domain_id", "rows", "hash")


SPANS = MEMBERS + rf""",
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents WHERE doc_id % 11 <> 4),
parts AS (SELECT m.domain_id, m.ordinal AS item, m.kind, l.place, l.text, CASE m.kind WHEN 'pdf' THEN 'page:' || (l.place // 3 + 1 + m.material_id * 10) WHEN 'ppt' THEN 'slide:' || (l.place + 1) WHEN 'doc' THEN 'body' ELSE 'seg:' || (l.place + 1) END AS locator, NULL AS ended FROM members m JOIN lines l ON l.doc_id = m.material_id WHERE m.state IN ('included', 'duplicate')
  UNION ALL SELECT m.domain_id, m.ordinal, m.kind, row_number() OVER (PARTITION BY m.domain_id ORDER BY s.turn) - 1, s.text, 'cue:' || (s.turn + 1), NULL FROM members m JOIN said s USING (domain_id) WHERE m.material_id IS NULL),
spans AS (SELECT *, {NORMAL} AS t, NULL AS why FROM parts
  UNION ALL SELECT domain_id, ordinal, kind, 0, '', 'file:' || material_id, CASE WHEN state IN ('failed', 'unsupported') THEN state ELSE 'excluded_with_reason' END, '', CASE WHEN state = 'unsupported' THEN 'unsupported_file_type' ELSE 'failed_parse' END FROM members WHERE material_id IS NOT NULL AND (state IN ('failed', 'unsupported') OR material_id % 11 = 4)),
judged AS (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY item, place) AS ordinal, CASE WHEN ended IS NOT NULL THEN why ELSE 'noise_' || {NOISE} END AS reason, CASE WHEN regexp_matches(locator, '^(page|slide):') AND ended IS NULL THEN string_split(locator, ':')[2]::INT END AS page FROM spans),
series AS (SELECT *, CASE WHEN page IS NOT NULL THEN CASE kind WHEN 'ppt' THEN 'P' ELSE 'D' END WHEN kind IN ('transcript', 'text', 'doc') THEN 'T' ELSE 'S' END AS prefix,
  min(ordinal) FILTER (reason IS NULL AND kind <> 'transcript') OVER (PARTITION BY domain_id, kind, t) AS first FROM judged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY domain_id, prefix, page ORDER BY ended IS NOT NULL, ordinal)::VARCHAR AS n, reason IS NULL AND kind <> 'transcript' AND first < ordinal AS again FROM series)
"""

MAP = SPANS + """SELECT domain_id, ordinal, CASE WHEN page IS NOT NULL THEN prefix || lpad(page::VARCHAR, greatest(4, length(page::VARCHAR))::INT, '0') || '.' || lpad(n, greatest(2, length(n))::INT, '0') ELSE prefix || lpad(n, greatest(6, length(n))::INT, '0') END AS source_id, item, kind, locator, page AS page_no, length(t) AS chars, ceil(length(t) / 4.0)::BIGINT AS tokens, 'sha256:' || sha256(t) AS text_hash,
  coalesce(ended, CASE WHEN reason IS NOT NULL THEN 'noise' WHEN again THEN 'duplicate' ELSE 'included' END) AS state, CASE WHEN again THEN 'duplicate_content_hash' ELSE reason END AS reason, CASE WHEN again THEN first END AS canonical_ordinal FROM numbered
"""


def _spans(spark, d, members):
    materials = _materials(spark, d)
    lines = materials.filter("material_id % 11 <> 4").select("domain_id", "material_id", "kind", F.posexplode(F.split("text", "\n")).alias("place", "text"))
    place, kind = F.col("place"), F.col("kind")
    locator = F.when(kind == "pdf", F.concat(F.lit("page:"), (F.floor(place / 3) + 1 + F.col("material_id") * 10).cast("string"))).when(kind == "ppt", F.concat(F.lit("slide:"), (place + 1).cast("string"))).when(kind == "doc", "body").otherwise(F.concat(F.lit("seg:"), (place + 1).cast("string")))
    cues = _said(spark, d).select("domain_id", F.col("turn").alias("place"), F.concat(F.lit("cue:"), (F.col("turn") + 1).cast("string")).alias("locator"), "text")
    return domain.source_map(members, lines.select("domain_id", "material_id", "place", locator.alias("locator"), "text"), materials.select("domain_id", "material_id", "status"), cues)


@query(MAP)
def source_map(spark, d):
    """The spans of these domains: each line of a document, each turn of the conversation."""
    return _spans(spark, d, written(_members(spark, d), "members"))


VECTOR = SPANS + """,
sp AS (SELECT domain_id, ordinal, item, kind, CASE WHEN page IS NOT NULL THEN page END AS page_no, coalesce(ended, CASE WHEN reason IS NOT NULL THEN 'noise' WHEN again THEN 'duplicate' ELSE 'included' END) AS state, length(t) % 9 <> 4 AS assigned, CASE WHEN kind = 'transcript' THEN ordinal * 1000 END AS start_ms, CASE WHEN kind = 'transcript' THEN ordinal * 1000 + length(t) END AS end_ms FROM numbered),
x AS (SELECT sp.*, m.material_id % 3 <> 1 OR m.material_id IS NULL AS required, l.quality = 1 AS good, l.toxic = 0 AS clean, l.doc_id IS NOT NULL AS noted FROM sp JOIN members m ON m.domain_id = sp.domain_id AND m.ordinal = sp.item LEFT JOIN labels l ON l.doc_id = m.material_id),
bs AS (SELECT domain_id, count(*) AS spans, count(*) FILTER (state = 'included') AS canonical, count(*) FILTER (state = 'duplicate') AS duplicates, count(*) FILTER (state = 'noise') AS noise, count(*) FILTER (state = 'unsupported') AS unsupported, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'excluded_with_reason') AS excluded,
  count(*) FILTER (assigned) AS planned, count(*) FILTER (state = 'included' AND NOT assigned) AS unassigned, count(*) FILTER (state = 'included' AND good) AS processed, count(*) FILTER (state = 'included' AND clean) AS legacy, count(*) FILTER (state = 'included' AND NOT noted) AS silent, count(*) FILTER (state = 'included' AND required AND good IS NOT TRUE) AS required_unprocessed,
  count(*) FILTER (state = 'included' AND kind = 'transcript') AS timeline, count(*) FILTER (state = 'included' AND kind = 'transcript' AND good) AS timeline_processed, min(start_ms) FILTER (state = 'included') AS start_ms, max(end_ms) FILTER (state = 'included') AS end_ms,
  count(DISTINCT page_no) FILTER (state = 'included' AND kind = 'ppt') AS pages, count(DISTINCT page_no) FILTER (state = 'included' AND kind = 'ppt' AND good) AS pages_processed FROM x GROUP BY 1),
st AS (SELECT domain_id, item, count(*) FILTER (state IN ('included', 'duplicate')) AS standing FROM x GROUP BY 1, 2),
mi AS (SELECT m.*, m.material_id % 3 <> 1 OR m.material_id IS NULL AS required, coalesce(st.standing, 0) AS standing FROM members m LEFT JOIN st ON st.domain_id = m.domain_id AND st.item = m.ordinal),
bi AS (SELECT domain_id, count(*) AS items, count(*) FILTER (state <> 'duplicate') AS unique_items, count(*) FILTER (state IN ('included', 'duplicate') OR reason IS NOT NULL) AS accounted_items, count(*) FILTER (required) AS required, count(*) FILTER (required AND state = 'failed') AS required_failed, count(*) FILTER (required AND state = 'unsupported') AS required_unsupported,
  count(*) FILTER (required AND state = 'excluded_with_reason') AS required_excluded, count(*) FILTER (required AND state <> 'duplicate' AND standing = 0) AS required_bare FROM mi GROUP BY 1),
sg AS (SELECT domain_id, item, CASE WHEN bool_or(good) THEN 'succeeded' WHEN bool_or(noted) THEN 'failed' ELSE 'planned' END AS status, coalesce(bool_and(clean), false) AS merged, count(DISTINCT t_state) AS structures, count(DISTINCT t_state) FILTER (t_state <> 'noise') AS structures_kept, count(*) FILTER (state = 'included') AS refs_total, count(*) FILTER (state = 'included' AND assigned) AS refs_used FROM (SELECT *, state AS t_state FROM x) GROUP BY 1, 2),
rt AS (SELECT *, CASE WHEN refs_total > 0 THEN round(refs_used / refs_total, 6) END AS rate FROM sg),
bg AS (SELECT domain_id, count(*) AS segments, count(*) FILTER (status = 'succeeded') AS segments_succeeded, count(*) FILTER (status = 'failed') AS segments_failed, count(*) FILTER (merged) AS segments_merged, sum(structures)::BIGINT AS structures, (sum(structures) - sum(structures_kept))::BIGINT AS structures_dropped, min(rate) AS ref_rate_min, round(avg(rate), 6) AS ref_rate_mean, count(*) FILTER (rate < 0.3) AS ref_rate_low FROM rt GROUP BY 1)
SELECT bi.*, bs.* EXCLUDE (domain_id), bg.* EXCLUDE (domain_id), items - accounted_items AS unaccounted_items, canonical - processed AS refs_invalid, round(accounted_items / items, 6) AS accounting, coalesce(round(processed / nullif(canonical, 0), 6), 0.0) AS semantic, coalesce(round(timeline_processed / nullif(timeline, 0), 6), 0.0) AS timeline_rate,
  coalesce(round(legacy / nullif(canonical, 0), 6), 0.0) AS legacy_rate, coalesce(round(pages_processed / nullif(pages, 0), 6), 0.0) AS page_rate, coalesce(round(segments_merged / nullif(segments, 0), 6), 0.0) AS merge_rate FROM bi LEFT JOIN bs USING (domain_id) LEFT JOIN bg USING (domain_id)
"""


@query(VECTOR)
def coverage_vector(spark, d):
    """All metrics of the five domains: labels are what the ledger says of a document's spans, and each item is a
    segment."""
    i = F.col("material_id")
    members = written(_members(spark, d), "members")
    items = members.select("domain_id", "ordinal", "material_id", "state", "reason", ((i % 3 != 1) | i.isNull()).alias("required"))
    ms = F.when(F.col("kind") == "transcript", F.col("ordinal") * 1000)
    spans = written(_spans(spark, d, members), "spans").select("domain_id", "ordinal", "item", "kind", F.when(F.col("kind").isin("pdf", "ppt", "doc"), F.col("page_no")).alias("page_no"), "state", "canonical_ordinal", ms.alias("start_ms"), (ms + F.col("chars")).alias("end_ms"), (F.col("chars") % 9 != 4).alias("assigned"))
    labels = load(spark, d, "labels").select(F.col("doc_id").alias("material_id"), "quality", "toxic")
    marked = spans.join(items.select("domain_id", F.col("ordinal").alias("item"), "material_id"), ["domain_id", "item"]).join(labels, "material_id", "left")
    noted = marked.filter("quality IS NOT NULL")
    understood = noted.select("domain_id", "ordinal", F.lit(coverage.UNDERSTOOD).alias("stage"), F.when(F.col("quality") == 1, "processed").otherwise("not_used").alias("outcome"))
    legacy = noted.filter("toxic = 0").select("domain_id", "ordinal", F.lit(coverage.LEGACY).alias("stage"), F.lit("processed").alias("outcome"))
    live = F.col("state") == "included"
    status = F.when(F.max("quality") == 1, "succeeded").when(F.count("quality") > 0, "failed").otherwise("planned")
    segments = marked.groupBy("domain_id", "item").agg(
        status.alias("status"), F.coalesce(F.max("toxic") == 0, F.lit(False)).alias("merged"), F.count_distinct("state").alias("structures"), F.count_distinct(F.when(F.col("state") != "noise", F.col("state"))).alias("structures_kept"),
        F.count_if(live).alias("refs_total"), F.count_if(live & F.col("assigned")).alias("refs_used"),
    )
    return coverage.coverage_vector(items, spans, understood.union(understood).union(legacy), segments)
