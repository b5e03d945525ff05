"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.streaming.tables import checkpointed as checkpoint
from marginalia.streaming.tables import shared_folder as shared_dir
from marginalia.streaming.tables import written
from marginalia.tables import load, load_texts

__all__ = ["arrow_schema", "as_array", "checkpoint", "keyed_text", "load", "load_texts", "map_batches", "shared_dir", "shuffle_width", "stored"]


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: columnar, so later steps read few columns."""
    return written(df, "marginalia")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key and the text, as ``doc_id`` and ``text``; a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Runs ``make()`` once a task and what it returns once an Arrow batch; that returns columns by name."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            columns = step(batch)
            yield pa.RecordBatch.from_arrays([as_array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def as_array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
