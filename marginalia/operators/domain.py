"""Domains: which materials belong to one, the map of their spans, and freezing both by content.

Materials and chunks are tables; a domain may be as large as they are. Ordinals come from one range-partitioned sort
(`windows.group_ordinals`), first occurrences from aggregates, so no domain is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import content_hash, estimate_tokens, is_parse_marker, noise_verdict, normalize_text, page_number, paged_id, sequence_id
from marginalia.operators.rules import item_state, span_reason
from marginalia.operators.windows import group_ordinals
from marginalia.streaming.tables import written

#: Prefixes of source ids, by kind, for spans with and without a page.
PAGE_PREFIXES = {"ppt": "P", "pdf": "D", "doc": "D"}
SEQUENCE_PREFIXES = {"transcript": "T", "ocr": "I", "text": "T", "doc": "T", "unknown": "T"}
OTHER_PREFIX = "S"


def by_kind(kind: Column, prefixes: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, prefix in prefixes.items():
        out = F.when(kind == name, prefix).otherwise(out)
    return out


def first_alike(rows: DataFrame, keys: list[str], among: Column, order_col: str) -> DataFrame:
    """Adds first: the least ``order_col`` of the rows ``among`` which have the same keys, null if none has."""
    least = rows.filter(among).groupBy(*keys).agg(F.min(order_col).alias("first"))
    return rows.join(least, keys, "left")


def domain_members(materials: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(domain_id, ordinal, material_id, kind, locator, raw_chars, content_hash, state, reason, canonical_ordinal) of each
    domain's items.

    ``materials``: domain_id, position, material_id, kind, locator, status, error and text. A material that a domain
    names again counts once, where it comes first. Items are numbered from 1 by position; of included ones with the same
    normalised text and kind the first stays and the others are duplicates of it. ``transcripts``: domain_id and text,
    one a domain, comes last and may be a duplicate too; blank ones are left out. Rows without a domain or material drop
    out; a null text is empty, and its item has no hash and is no duplicate.
    """
    named = materials.filter("domain_id IS NOT NULL AND material_id IS NOT NULL")
    clean = F.col("clean")
    of = item_state(F.col("kind"), F.col("status"), F.col("error"))
    items = named.withColumn("clean", normalize_text(F.col("text"))).select("domain_id", "position", "material_id", F.coalesce("kind", F.lit("unknown")).alias("kind"), "locator", F.coalesce(F.length("text"), F.lit(0)).alias("raw_chars"), F.when(clean != "", content_hash(clean)).alias("content_hash"), of["state"].alias("state"), of["reason"].alias("reason"))
    rest = [c for c in items.columns if c not in ("domain_id", "material_id")]
    once = items.groupBy("domain_id", "material_id").agg(F.min(F.struct(*rest)).alias("of")).select("domain_id", "material_id", "of.*")
    spoken = transcripts.filter(F.col("domain_id").isNotNull() & F.coalesce(F.trim("text") != "", F.lit(False)))
    last = spoken.select("domain_id", F.lit(None).cast("long").alias("position"), F.lit(None).cast(items.schema["material_id"].dataType).alias("material_id"), F.lit("transcript").alias("kind"), F.lit("transcript:inline").alias("locator"), F.length("text").alias("raw_chars"), content_hash(normalize_text(F.col("text"))).alias("content_hash"), F.lit("included").alias("state"), F.lit(None).cast("string").alias("reason"))
    every = once.unionByName(last).withColumn("inline", F.col("material_id").isNull())
    numbered = group_ordinals(every, ["domain_id"], ["inline", "position", "material_id"])
    alike = first_alike(numbered, ["domain_id", "kind", "content_hash"], (F.col("state") == "included") & F.col("content_hash").isNotNull(), "ordinal")
    again = (F.col("state") == "included") & (F.col("first") < F.col("ordinal"))
    return alike.select(
        "domain_id", "ordinal", "material_id", "kind", "locator", "raw_chars", "content_hash", F.when(again, "duplicate").otherwise(F.col("state")).alias("state"),
        F.when(again, "duplicate_content_hash").otherwise(F.col("reason")).alias("reason"), F.when(again, F.col("first")).alias("canonical_ordinal"),
    )


def placeholders(members: DataFrame, chunks: DataFrame, statuses: DataFrame) -> DataFrame:
    """Items that have no chunk, or whose state is final, as one empty span each."""
    final = F.col("state").isin("failed", "unsupported", "excluded_with_reason")
    bare = members.join(chunks.select("domain_id", "material_id").distinct(), ["domain_id", "material_id"], "left_anti").filter(~final & F.col("material_id").isNotNull())
    status = F.coalesce(F.lower("status"), F.lit(""))
    lacking = F.when(status == "failed", "failed").when(status.isin("needs_ocr", "transcribing"), "unsupported").otherwise("excluded_with_reason")
    why = F.when(status.isin("needs_ocr", "transcribing"), "unsupported_file_type").otherwise("failed_parse")
    empty = bare.join(statuses, ["domain_id", "material_id"], "left").select("domain_id", F.col("ordinal").alias("item"), "kind", "locator", lacking.alias("ended"), why.alias("why"))
    return members.filter(final).select("domain_id", F.col("ordinal").alias("item"), "kind", "locator", F.col("state").alias("ended"), span_reason(F.col("reason")).alias("why")).unionByName(empty)


def source_map(members: DataFrame, chunks: DataFrame, statuses: DataFrame, cues: DataFrame) -> DataFrame:
    """(domain_id, ordinal, source_id, item, kind, locator, page_no, chars, tokens, text_hash, state, reason,
    canonical_ordinal) of each span of the domains.

    ``chunks``: domain_id, material_id, place, locator and text; ``cues``: the same of inline transcripts, without
    material_id; ``statuses``: domain_id, material_id and the parser's status. Spans stand in the order of items and
    places. Those with a page or slide get P0017.01 and so on, others a number for each prefix, and items without content
    the next free ones. What parsers left for a failure, and noise, is marked; of other spans of one kind and text the
    first stays and the rest are its duplicates, but for transcripts, where the same words at another time are no copy.
    """
    own = members.select("domain_id", "material_id", F.col("ordinal").alias("item"), "kind", "state")
    inline = own.filter("material_id IS NULL").drop("material_id")
    live = own.filter(~F.col("state").isin("failed", "unsupported", "excluded_with_reason") & F.col("material_id").isNotNull())
    # texts are worked through once, where they are read; only what is known of them is joined, sampled and sorted
    columns = ["domain_id", "place", "locator", "text"]
    said = cues.select(*columns, F.lit(None).cast(members.schema["material_id"].dataType).alias("material_id"), F.lit(True).alias("spoken"))
    clean = chunks.select(*columns, "material_id", F.lit(False).alias("spoken")).unionByName(said).withColumn("clean", normalize_text(F.coalesce("text", F.lit(""))))
    marker = is_parse_marker(F.col("clean"))
    reason = F.when(marker, "noise_parse_marker").otherwise(F.concat(F.lit("noise_"), noise_verdict(F.col("clean"))))
    read = written(clean.select(
        "domain_id", "material_id", "spoken", F.col("place").cast("long").alias("place"), "locator", page_number(F.col("locator")).alias("page_no"), F.length("clean").alias("chars"), estimate_tokens(F.col("clean")).alias("tokens"),
        content_hash(F.col("clean")).alias("text_hash"), reason.alias("reason"), F.lit(None).cast("string").alias("ended"),
    ), "spans-read")
    parts = read.filter("NOT spoken").join(live, ["domain_id", "material_id"]).drop("material_id", "state", "spoken")
    known = parts.unionByName(read.filter("spoken").drop("material_id").join(inline, "domain_id").drop("state", "spoken"))
    none = placeholders(members, read.filter("NOT spoken"), statuses)
    ended = none.select("domain_id", "item", "kind", F.lit(0).cast("long").alias("place"), "locator", F.lit(None).cast("int").alias("page_no"), F.lit(0).alias("chars"), F.lit(0).cast("long").alias("tokens"), content_hash(F.lit("")).alias("text_hash"), F.col("why").alias("reason"), "ended")
    spans = group_ordinals(known.unionByName(ended), ["domain_id"], ["item", "place"])

    paged = F.col("page_no").isNotNull() & F.col("kind").isin(*PAGE_PREFIXES) & F.col("ended").isNull()
    prefix = F.when(paged, by_kind(F.col("kind"), PAGE_PREFIXES)).otherwise(F.coalesce(by_kind(F.col("kind"), SEQUENCE_PREFIXES), F.lit(OTHER_PREFIX)))
    series = spans.withColumns({"prefix": prefix, "page": F.when(paged, F.col("page_no")), "last": F.col("ended").isNotNull()})
    # a page's spans are a series of their own; where there is no page, ended spans go on after the live ones
    numbered = group_ordinals(series, ["domain_id", "prefix", "page"], ["last", "ordinal"], "number")
    source_id = F.when(F.col("page").isNotNull(), paged_id(F.col("prefix"), F.col("page"), F.col("number"))).otherwise(sequence_id(F.col("prefix"), F.col("number")))

    alike = first_alike(numbered, ["domain_id", "kind", "text_hash"], F.col("reason").isNull() & (F.col("kind") != "transcript"), "ordinal")
    again = F.col("reason").isNull() & (F.col("kind") != "transcript") & (F.col("first") < F.col("ordinal"))
    state = F.coalesce("ended", F.when(F.col("reason").isNotNull(), "noise").when(again, "duplicate").otherwise("included"))
    return alike.select(
        "domain_id", "ordinal", source_id.alias("source_id"), "item", "kind", "locator", "page_no", "chars", "tokens", "text_hash", state.alias("state"),
        F.when(again, "duplicate_content_hash").otherwise(F.col("reason")).alias("reason"), F.when(again, F.col("first")).alias("canonical_ordinal"),
    )


def content_hashes(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, rows, hash): a digest of all rows of each key, whatever their order. Rows are digested one by one and the
    digests added up in eight parts, so hot keys are combined before the shuffle."""
    text = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    dug = rows.select(key, F.sha2(F.concat(*text), 256).alias("d"))
    lanes = [F.sum(F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"s{i}") for i in range(8)]
    sums = dug.groupBy(key).agg(F.count("*").alias("rows"), *lanes)
    return sums.select(key, "rows", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(8)]), 256)).alias("hash"))
