"""The queries of this subpackage: thin calls of its operators over whole tables, with the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import ball_codes, bpe_trie, byte_bpe, chat_quotes, fingerprint, jaccard_join, merkle, packing, quality, secret_scan, token_counts, topk, warc
from marginalia.llm.common import load, load_texts

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MULTI_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.digest_documents(load_texts(spark, sf_dir), WORD_BPE)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load_texts(spark, sf_dir), BYTE_BPE)


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edited(load(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored_documents(load_texts(spark, sf_dir), load(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.convert_pages(load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_documents(load_texts(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_checked")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(load_texts(spark, sf_dir), width=3, percent=90)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's messages quote nothing, so Spark first makes them quote what they answer."""
    out = chat_quotes.reply_ordered(chat_quotes.quoted_messages(load(spark, sf_dir, "conversations")))
    return out.select(F.col("thread").alias("conv_id"), "turn", "role", "parent", "depth", "reply_path", "text", "rendered")


def op9_quoted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9_chat_formatting, where each message quotes parts of the one before and answers between them."""
    out = chat_quotes.reply_ordered(chat_quotes.interleaved_messages(load(spark, sf_dir, "conversations")))
    return out.select(F.col("thread").alias("conv_id"), "turn", "role", "parent", "depth", "reply_path", "text", "rendered")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load_texts(spark, sf_dir), PIECES)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proven_documents(load_texts(spark, sf_dir))


def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.vector_codes(load(spark, sf_dir, "embeddings")).drop("label")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest_documents(load_texts(spark, sf_dir), MULTI_BPE)


QUERIES = {f.__name__: f for f in (op1_bpe_encoding, op2_exact_topk, op3_best_fit_packing, op4_document_fingerprints, op5_quality_classifier, op6_warc, op7_secret_scans, op8_ngram_jaccard_join, op9_chat_formatting, op9_quoted_parts, op10_token_counts, op11_merkle_manifest, op12_ball_codes, op13_byte_bpe)}


def ball_codes_sql(rounds: int = 4) -> str:
    """The same codebooks round by round, each part compared with all entries. Whole numbers this small are exact as
    doubles."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT p, row_id, x, best.e AS e, best.gap AS gap FROM (
    SELECT v.p, v.row_id, v.x, min({{'gap': list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, b.c) + list_inner_product(b.c, b.c), 'e': b.e}}) AS best
    FROM parts v JOIN book{r} b ON b.p = v.p GROUP BY ALL))""")
        if r < rounds:
            steps.append(f"""sums{r} AS (
  SELECT p, e, i, floor(sum(y) / count(*)) AS c FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS i FROM near{r}) GROUP BY ALL
), book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM book{r} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS c FROM sums{r} GROUP BY ALL) s ON s.p = b.p AND s.e = b.e)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS row_id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS MATERIALIZED (
  SELECT row_id, vec_id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM (SELECT *, unnest(range(4)) AS p FROM kept)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 256
), {", ".join(steps)}, coded AS (
  SELECT row_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(gap)::BIGINT AS error FROM near{rounds} GROUP BY ALL
), digest AS (
  SELECT sha256(string_agg(y, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c)::BIGINT::VARCHAR AS y, unnest(range(len(c))) AS i FROM book{rounds})
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row_id) CROSS JOIN digest
"""


ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS (
  SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM whole
), scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, sum(q.x * p.x)::BIGINT AS score
  FROM parts q JOIN parts p ON q.i = p.i AND q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
""",
    "op6_warc": """
WITH payload AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages WHERE page_id IS NOT NULL
), numbered AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS least,
    list_transform(range(8), lambda g: ('0x' || substr(hex, 5 * g + 1, 5))::INT) AS twenty
  FROM payload
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((twenty[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM numbered
""",
    "op8_ngram_jaccard_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g
  FROM words
), entries AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM grams
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY gram) AS df FROM entries
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, gram) AS place FROM counted
), prefix AS (
  SELECT doc_id, n, gram FROM ranked WHERE df > 1 AND place <= n - ceil(n * 90 / 100.0) + 1
), candidates AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS a_n, b.n AS b_n FROM prefix a JOIN prefix b USING (gram)
  WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
), shared_counts AS (
  SELECT c.a, c.b, c.a_n, c.b_n, len(list_intersect(x.g, y.g)) AS shared
  FROM candidates c JOIN grams x ON x.doc_id = c.a JOIN grams y ON y.doc_id = c.b
), links AS (
  SELECT a, b FROM shared_counts WHERE 100 * shared >= 90 * (a_n + b_n - shared)
  UNION SELECT b, a FROM shared_counts WHERE 100 * shared >= 90 * (a_n + b_n - shared)
), reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM grams g JOIN reach r ON r.node = g.doc_id GROUP BY ALL
""",
    "op9_chat_formatting": """
WITH RECURSIVE own AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, trim(coalesce(text, '')) AS text,
    lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS plain,
    CASE WHEN turn >= 1 THEN (turn - 1) // 2 END AS answers
  FROM conversations
), origin AS (
  SELECT conv_id, plain, min(turn) AS origin FROM own WHERE plain <> '' GROUP BY ALL
), parents AS (
  SELECT o.conv_id, o.turn, o.role, o.text,
    coalesce(CASE WHEN f1.origin < o.turn THEN f1.origin END, CASE WHEN f2.origin < o.turn THEN f2.origin END) AS parent
  FROM own o
  LEFT JOIN own p1 ON p1.conv_id = o.conv_id AND p1.turn = o.answers
  LEFT JOIN own p2 ON p2.conv_id = o.conv_id AND p2.turn = p1.answers
  LEFT JOIN origin f1 ON f1.conv_id = o.conv_id AND f1.plain = p1.plain
  LEFT JOIN origin f2 ON f2.conv_id = o.conv_id AND f2.plain = p2.plain
), paths AS (
  SELECT conv_id, turn, 1 AS depth, turn::VARCHAR AS reply_path FROM parents WHERE parent IS NULL
  UNION ALL
  SELECT p.conv_id, p.turn, q.depth + 1, q.reply_path || '.' || p.turn
  FROM parents p JOIN paths q ON q.conv_id = p.conv_id AND q.turn = p.parent
)
SELECT p.conv_id, p.turn, p.role, p.parent, q.depth, q.reply_path, p.text, '### ' || p.role || chr(10) || p.text AS rendered
FROM parents p JOIN paths q ON q.conv_id = p.conv_id AND q.turn = p.turn
""",
    "op11_merkle_manifest": """
WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, doc_id::VARCHAR AS id,
    list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda x: coalesce(octet_length(encode(x))::VARCHAR || ':' || x, '-')) AS f,
    replace(text, chr(10), '') AS bare
  FROM documents
), digests AS (
  SELECT row_id, doc_id, source, sha256(array_to_string(f, '')) AS leaf,
    CASE WHEN id IS NOT NULL AND list_reduce([4294967295::BIGINT] || list_transform(range(1, length(id) + 1), lambda i: ascii(id[i])::BIGINT),
        lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) % 2 = 1
      THEN sha256(array_to_string(f[1:4], '') || coalesce(octet_length(encode(bare))::VARCHAR || ':' || bare, '-')) END AS forged
  FROM fields
), leaves AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM digests
), nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3, n
), subroots AS (
  SELECT tree, digest AS subroot, level AS height, (SELECT count(DISTINCT tree) FROM leaves) AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, tree AS pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n
), whole AS (
  SELECT digest AS root, level AS top_height FROM tops WHERE n = 1
), siblings AS (
  SELECT l.row_id, n.level, n.pos, n.digest FROM leaves l JOIN subroots s USING (tree) JOIN nodes n ON n.tree = l.tree AND n.level < s.height
    AND n.pos // 3 = l.pos // (3 ** (n.level + 1))::BIGINT AND n.pos <> l.pos // (3 ** n.level)::BIGINT
  UNION ALL
  SELECT l.row_id, 1000 + t.level, t.pos, t.digest FROM leaves l CROSS JOIN whole w JOIN tops t ON t.level < w.top_height
    AND t.pos // 3 = l.tree // (3 ** (t.level + 1))::BIGINT AND t.pos <> l.tree // (3 ** t.level)::BIGINT
), proof AS (
  SELECT row_id, string_agg(digest, '' ORDER BY level, pos) AS way FROM siblings GROUP BY ALL
), folds AS (
  SELECT row_id, tree, 0 AS level, pos, coalesce(forged, leaf) AS node, height FROM leaves JOIN subroots USING (tree)
  UNION ALL
  SELECT f.row_id, f.tree, f.level + 1, f.pos // 3, sha256(string_agg(CASE WHEN c.pos = f.pos THEN f.node ELSE c.digest END, '' ORDER BY c.pos)), f.height
  FROM folds f JOIN nodes c ON c.tree = f.tree AND c.level = f.level AND c.pos // 3 = f.pos // 3 WHERE f.level < f.height
  GROUP BY f.row_id, f.tree, f.level, f.pos, f.height
), upper_folds AS (
  SELECT row_id, 0 AS level, tree AS pos, node, top_height FROM folds CROSS JOIN whole WHERE level = height
  UNION ALL
  SELECT f.row_id, f.level + 1, f.pos // 3, sha256(string_agg(CASE WHEN c.pos = f.pos THEN f.node ELSE c.digest END, '' ORDER BY c.pos)), f.top_height
  FROM upper_folds f JOIN tops c ON c.level = f.level AND c.pos // 3 = f.pos // 3 WHERE f.level < f.top_height
  GROUP BY f.row_id, f.level, f.pos, f.top_height
)
SELECT l.doc_id, l.leaf, s.subroot, w.root, sha256(coalesce(p.way, '')) AS proof_sha256, u.node AS folded_root, u.node = w.root AS verified
FROM leaves l JOIN subroots s USING (tree) CROSS JOIN whole w LEFT JOIN proof p USING (row_id) JOIN upper_folds u ON u.row_id = l.row_id AND u.level = u.top_height
""",
    "op12_ball_codes": ball_codes_sql(),
}
