"""The supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes for each core up to which a table is dealt out again before its texts are worked through.
SMALL = 8 << 20


def load_texts(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    """A table whose texts are costly to work through. A small one may be a single row group, which one task reads
    however many cores there are, so it is dealt out by its key first; others are read as they are, without a shuffle."""
    df, cores = load(spark, sf_dir, table), spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < SMALL * cores else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds, as whole numbers compare alike everywhere."""
    return load(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as ordered spans of a domain: ordinal from 1, and estimated tokens."""
    from marginalia.functions.text import estimate_tokens

    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("domain_id"), (F.col("turn") + 1).alias("ordinal"), "role", "text", estimate_tokens(F.col("text")).alias("tokens"))
