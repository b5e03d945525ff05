"""File sources and sinks. All paths go through Spark's readers and writers, so they may be in any store it reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import content_hash, infer_kind, safe_file_name, sequence_id, yaml_quoted
from marginalia.operators.chunking import parse_cues

#: Kinds that parse to text, and the state of the others.
STATES = {"pdf": "parsing", "ppt": "parsing", "docx": "parsing", "text": "parsing", "transcript": "parsing", "html": "parsing", "image": "needs_ocr", "audio": "transcribing"}
#: First bytes of each kind, in hexadecimal.
MAGIC = {"pdf": "25504446", "ppt": "504B0304", "docx": "504B0304", "image": "89504E47|FFD8FF"}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, locator, text): each file as one body."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.lit("body").alias("locator"), F.col("value").alias("text"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, cue, start_ms, end_ms, text)."""
    return parse_cues(read_texts(spark, path), "path", F.col("text"))


def read_json_lists(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The rows of a list field of JSON files; files without it, and broken ones, give none."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.inline(F.from_json("value", f"{field} array<{schema}>")[field]))


def ingest(spark: SparkSession, path: str, most_bytes: int = 200_000_000) -> DataFrame:
    """(path, sha256, bytes, kind, state): uploads by content, with size, suffix and first bytes checked."""
    files = spark.read.format("binaryFile").load(path)
    kind = infer_kind(F.lit(None).cast("string"), F.col("path"))
    start, wrong = F.hex(F.substring("content", 1, 4)), F.lit(False)
    state = F.lit("unsupported")
    for name, value in STATES.items():
        state = F.when(kind == name, value).otherwise(state)
    for name, magic in MAGIC.items():
        wrong = wrong | ((kind == name) & ~start.rlike(f"^({magic})"))
    verdict = F.when(F.col("length") > most_bytes, "too_large").when(wrong, "wrong_content").otherwise(state)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), kind.alias("kind"), verdict.alias("state"))


def overwrite_parts(df: DataFrame, path: str, key: str) -> None:
    """Replaces just the partitions that ``df`` has: a re-parse deletes and inserts."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_audit(calls: DataFrame, path: str, payload: str, *keep: str) -> None:
    """Appends digests and sizes of payloads, never the payloads."""
    calls.select(*keep, F.sha2(payload, 256).alias("digest"), F.length(payload).alias("chars")).write.mode("append").parquet(path)


def vault_notes(notes: DataFrame, id_col: str, title_col: str, text_col: str) -> DataFrame:
    """(file_name, value): notes with front matter, a stable name and their content hash in the last line."""
    name = F.concat(safe_file_name(F.col(title_col)), F.lit("-"), sequence_id(F.lit("N"), F.col(id_col)), F.lit(".md"))
    head = F.concat(F.lit("---\ntitle: "), yaml_quoted(F.col(title_col)), F.lit("\nid: "), F.col(id_col).cast("string"), F.lit("\n---\n"))
    return notes.select(name.alias("file_name"), F.concat(head, F.col(text_col), F.lit("\n\n"), content_hash(F.col(text_col)), F.lit("\n")).alias("value"))


def write_vault(notes: DataFrame, path: str) -> None:
    """One folder a note, named as its file."""
    notes.write.mode("overwrite").partitionBy("file_name").text(path)


def copy_common(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of ``source`` with the columns that both have, in the target's order and types."""
    return source.select(*[F.col(f.name).cast(f.dataType) for f in target.schema if f.name in source.columns])
