"""Streams over event files: windows, de-duplication, a last-wins ledger and leases.

Windows in event time are an extension; the queue, ledger and change-feed forms restate batch operators as streams. All
run to the end of what is there (availableNow) and stop, so a caller can schedule them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.streaming.tables import new_folder


def event_stream(spark: SparkSession, sf_dir: str, files_a_batch: int = 64) -> DataFrame:
    """Events with a time zone, which watermarks need, out of a folder of files or a single one."""
    whole = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(whole).schema).option("maxFilesPerTrigger", files_a_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(whole)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        raw = reader.parquet(whole)
    else:
        raw = reader.option("pathGlobFilter", "*events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_updates(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs the stream and returns its rows: in update mode the last row of each key, in append mode all, in complete
    mode those of the last batch. Batches are appended with their number, then merged. Without any batch, as of an empty
    table, there are no rows."""
    spark = stream.sparkSession
    out, state = new_folder(spark, "stream-out"), new_folder(spark, "stream-state")
    none = spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(-1))
    none.write.parquet(out)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(out)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(none.schema).parquet(out)
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("_batch").alias("_batch"))), "_batch", "left_semi")  # one row
    if mode != "update" or not keys:
        return rows.drop("_batch")
    last = W.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_batch")


def awaiting(stream: DataFrame, late: str | None) -> DataFrame:
    """With a watermark where a lateness is given. Runs that catch up have none: files come in any order, and a
    watermark would drop the older events of later ones."""
    return stream.withWatermark("ts", late) if late else stream


def tumbling(stream: DataFrame, size: str, late: str | None = None) -> DataFrame:
    return awaiting(stream, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "total")


def sliding(stream: DataFrame, size: str, step: str, late: str | None = None) -> DataFrame:
    return awaiting(stream, late).groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "n")


def first_of_key(stream: DataFrame, key: str, late: str | None = None) -> DataFrame:
    """Enqueue once: later rows of a key that came before, within the watermark if there is one, are dropped."""
    return awaiting(stream, late).dropDuplicatesWithinWatermark([key]) if late else stream.dropDuplicates([key])


def _lease(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first, last, n = state.get if state.exists else (None, None, 0)
    for batch in batches:
        low, high = int(batch["event_id"].min()), int(batch["event_id"].max())
        first, last, n = low if first is None else min(first, low), high if last is None else max(last, high), n + len(batch)
    state.update((first, last, n))
    yield pd.DataFrame({"user_id": [key[0]], "first_task": [first], "last_task": [last], "tasks": [n]})


def lease_state(stream: DataFrame) -> DataFrame:
    """For each worker the first and last task it was given and how many: state carried from batch to batch."""
    out = "user_id long, first_task long, last_task long, tasks long"
    return stream.select("user_id", "event_id").groupBy("user_id").applyInPandasWithState(_lease, out, "first long, last long, n long", "update", GroupStateTimeout.NoTimeout)


def lease_spans(stream: DataFrame, lease: str = "600 seconds", late: str | None = None) -> DataFrame:
    """(user_id, leased_us, expires_us, heartbeats): every event is a heartbeat that holds the worker's lease for so
    long; one that comes after it ran out takes a new one. A session window is the timer: it ends when the watermark
    passes the lease's end, and without a watermark when the stream does."""
    spans = awaiting(stream, late).groupBy(F.session_window("ts", lease).alias("w"), "user_id").agg(F.count("*").alias("heartbeats"))
    return spans.select("user_id", F.unix_micros("w.start").alias("leased_us"), F.unix_micros("w.end").alias("expires_us"), "heartbeats")


def ledger(stream: DataFrame) -> DataFrame:
    """Rows of a ledger; ``run_updates`` with its keys keeps the last of each."""
    return stream.groupBy("user_id", "event_type").agg(F.max(F.struct("event_id", "value")).alias("m")).select("user_id", "event_type", "m.event_id", "m.value")
