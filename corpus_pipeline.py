"""Documents to packed training sequences, in stages that each work on all that the one before kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents:

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join (five words, 0.8): of each component the document with the smallest doc_id stays;
3. secret scans: secrets in the texts are replaced, and n_chars follows;
4. best-fit packing: pieces of the documents in sequences of 1024 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import jaccard_join, packing, quality, secret_scan
from marginalia.llm.common import load, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text scores at least 0.3, as a network learned from ``labels`` scores it. A null text is empty, and
    empty texts score as the network scores no words; rows without a doc_id and repeated rows are judged by their text
    like any other. Without any label of these documents all stay. Empty tables stay empty."""
    return quality.accepted_documents(docs, load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of at least 0.8 on five-word shingles join, the one with the smallest
    doc_id. Texts that are null, empty or without words link with nothing and stay, and so do rows without a doc_id.
    Rows of one doc_id are one document, linked by the texts of all of them; of a document that stays one row stays,
    that of the least text (null before all others, then the other columns)."""
    groups = jaccard_join.similarity_components(docs, width=5, percent=80)
    kept = jaccard_join.without_documents(docs, stored(groups.filter("component_id <> doc_id").select("doc_id")))
    return jaccard_join.one_row_each(kept)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in the texts replaced and n_chars counted again. Null texts stay null and empty ones
    empty; rows without a doc_id and repeated rows are treated like any other."""
    return secret_scan.redact_documents(docs, "text", "n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens. A null or empty text is its end token alone;
    repeated rows are packed each by itself. An empty table gives no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("secrets", replace_secrets), ("packing", pack_sequences)]

#: A learned score and a tokenizer's ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
