"""Commits of tables by content: readers see all of a batch or nothing, and what is frozen never changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.domain import content_hashes


class FrozenConflict(ValueError):
    """A key that is frozen was given with other content."""


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    where = jvm.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path


def frozen_hashes(spark: SparkSession, base: str) -> DataFrame | None:
    """(key, rows, hash) of all that is frozen in a folder; None before the first commit."""
    files, path = _files(spark, base)
    batches = files.globStatus(path(f"{base}/batch-*/keys")) if files.exists(path(base)) else None
    return spark.read.parquet(f"{base}/batch-*/keys") if batches else None


def frozen_rows(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One of the tables, from all batches."""
    return spark.read.parquet(f"{base}/batch-*/{name}")


def freeze(tables: dict[str, DataFrame], base: str, key: str) -> dict[str, int]:
    """Freezes the keys of the first table, with their rows in all tables, by the content of that table.

    Keys that are frozen with the same content stay as they are. If any is there with other content, nothing is written
    and ``FrozenConflict`` says how many. All new keys are written to a folder that readers pass over, and then named by
    their content in one rename: a job that fails or is repeated leaves nothing half done, and a batch that another
    writer published meanwhile is left as it is. Keys' digests are compared in a join; a count goes to the driver.
    """
    main = next(iter(tables.values()))
    spark = main.sparkSession
    stage = f"{base}/_staged-{uuid.uuid4().hex}"
    files, path = _files(spark, base)
    content_hashes(main, key, main.columns).write.parquet(f"{stage}/asked")
    asked, known = spark.read.parquet(f"{stage}/asked"), frozen_hashes(spark, base)
    if known is not None:
        met = asked.join(known.select(key, F.col("hash").alias("_frozen")), key)
        conflicts = met.filter("hash <> _frozen").count()
        if conflicts:
            files.delete(path(stage), True)
            raise FrozenConflict(f"{conflicts} keys are frozen with other content")
        asked = asked.join(known, key, "left_anti")
    asked.write.parquet(f"{stage}/keys")
    fresh = spark.read.parquet(f"{stage}/keys")
    new, total = fresh.count(), spark.read.parquet(f"{stage}/asked").count()
    if new:
        for name, rows in tables.items():
            rows.join(fresh.select(key), key, "left_semi").write.parquet(f"{stage}/{name}")
        named = content_hashes(fresh.withColumn("_all", F.lit(0)), "_all", [key, "hash"]).first()["hash"]
        files.delete(path(f"{stage}/asked"), True)
        target = path(f"{base}/batch-{named.removeprefix('sha256:')}")
        if not files.exists(target) and files.rename(path(stage), target):
            return {"new": new, "kept": total - new}
    files.delete(path(stage), True)
    return {"new": 0, "kept": total}


def _versions(spark: SparkSession, base: str) -> list[int]:
    files, path = _files(spark, base)
    found = files.globStatus(path(f"{base}/version-*")) if files.exists(path(base)) else None
    return sorted(int(s.getPath().getName().removeprefix("version-")) for s in found or [])


def rewrite(tables: dict[str, DataFrame], base: str, key: str) -> int:
    """Rewrites the keys (runs) of the first table in all tables at once, and returns the version that has them. What
    the tables hold of other keys is left out, and a key that a table has no rows of has none from then on. Everything
    is written to a folder that readers pass over; one rename makes it the newest version. A job that fails leaves the
    old rows, and of two writers at once the second gets an error."""
    main = next(iter(tables.values()))
    spark = main.sparkSession
    stage = f"{base}/_staged-{uuid.uuid4().hex}"
    files, path = _files(spark, base)
    main.select(key).filter(F.col(key).isNotNull()).distinct().write.parquet(f"{stage}/keys")
    keys = spark.read.parquet(f"{stage}/keys")
    for name, rows in tables.items():
        rows.join(keys, key, "left_semi").write.parquet(f"{stage}/{name}")
    version = (_versions(spark, base) or [0])[-1] + 1
    target = path(f"{base}/version-{version:09d}")
    if files.exists(target) or not files.rename(path(stage), target):
        files.delete(path(stage), True)
        raise FileExistsError(f"version {version} was written meanwhile")
    return version


def current_rows(spark: SparkSession, base: str, name: str, key: str) -> DataFrame:
    """The rows of a table of the newest version of each key."""
    version = F.regexp_extract(F.col("_metadata.file_path"), r"/version-([0-9]+)/", 1).cast("long")
    newest = spark.read.parquet(f"{base}/version-*/keys").select(key, version.alias("_version")).groupBy(key).agg(F.max("_version").alias("_newest"))
    rows = spark.read.parquet(f"{base}/version-*/{name}").select("*", version.alias("_version"))
    return rows.join(newest, key).filter("_version = _newest").drop("_version", "_newest")


def bootstrap(rows: DataFrame, base: str, key: str) -> bool:
    """Writes the rows, one for each key (the least row), if nothing was written to the folder before; says whether it
    did. Run again, or by two at once, it leaves one set of rows: only one can name the first version."""
    if _versions(rows.sparkSession, base):
        return False
    once = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("_of")).select(key, "_of.*")
    try:
        rewrite({"rows": once}, base, key)
    except FileExistsError:
        return False
    return True


def seeded_calendar(courses: DataFrame, events: str = "events") -> DataFrame:
    """(event_id, course_id, name, date) of courses (course_id, start: a term's first Monday, events: an array of structs
    of name, week and weekday from 1): dates by week arithmetic. event_id: a digest of course, name and date, so seeding
    again makes the same keys. Weeks and weekdays out of range, and courses without a start, give no date and are left
    out."""
    each = courses.select("course_id", "start", F.inline(events)).filter((F.col("week") >= 1) & F.col("weekday").between(1, 7) & F.col("start").isNotNull())
    date = F.date_add(F.col("start").cast("date"), ((F.col("week") - 1) * 7 + F.col("weekday") - 1).cast("int"))
    return each.select("course_id", "name", date.alias("date")).select(F.sha2(F.concat_ws("|", F.col("course_id").cast("string"), "name", F.col("date").cast("string")), 256).alias("event_id"), "*")
