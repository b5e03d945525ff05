"""Tables that refer to each other: deletes that follow references, and units projected from runs with their links."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.windows import group_ordinals
from marginalia.streaming.tables import written


@dataclass(frozen=True)
class Reference:
    """``column`` of ``child`` holds keys of ``parent``. When a parent's row goes, its children go too (``cascade``), lose
    the key (``clear``), or forbid it (``restrict``)."""

    child: str
    column: str
    parent: str
    action: str = "cascade"


def _keys(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name))


def delete_cascade(tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], doomed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables without the rows whose keys ``doomed`` has for a table (one column, named as that key), and without
    what refers to those, at any distance. ``keys`` names the key of each table that others refer to, or that has doomed
    rows; other tables need none.

    Only new keys are followed in each round, so there are as many rounds as the longest way along references, also where
    tables refer to themselves or in a circle. Then each table is read once more, with one anti join a reference; rows
    never meet in pairs. Null keys refer to nothing. A ``restrict`` that rows left over break is an error before anything
    is returned.
    """
    gone = {t: written(_keys(df, keys[t], "_key").filter("_key IS NOT NULL").distinct(), "doomed") for t, df in doomed.items()}
    frontier = dict(gone)
    while frontier:
        found: dict[str, list[DataFrame]] = {}
        for r in references:
            if r.action == "cascade" and r.parent in frontier and r.child in keys:
                hit = tables[r.child].join(_keys(frontier[r.parent], "_key", r.column), r.column, "left_semi")
                found.setdefault(r.child, []).append(_keys(hit, keys[r.child], "_key"))
        frontier = {}
        for t, parts in found.items():
            new = reduce(DataFrame.unionByName, parts).distinct()
            new = written(new.join(gone[t], "_key", "left_anti") if t in gone else new, "doomed")
            if new.limit(1).count():
                frontier[t] = new
                gone[t] = gone[t].unionByName(new) if t in gone else new
    left = {}
    for t, df in tables.items():
        rest = df.join(_keys(gone[t], "_key", keys[t]), keys[t], "left_anti") if t in gone else df
        for r in (r for r in references if r.child == t and r.parent in gone):
            lost = _keys(gone[r.parent], "_key", r.column)
            if r.action == "cascade" and t not in keys:
                rest = rest.join(lost, r.column, "left_anti")
            elif r.action == "clear":
                rest = rest.join(lost.withColumn("_lost", F.lit(True)), r.column, "left").withColumn(r.column, F.when(F.col("_lost").isNull(), F.col(r.column))).drop("_lost")
            elif r.action == "restrict" and rest.join(lost, r.column, "left_semi").limit(1).count():
                raise ValueError(f"{r.child}.{r.column} still refers to deleted rows of {r.parent}")
        left[t] = rest.select(*df.columns)
    return left


def orphans(tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference]) -> DataFrame:
    """(child, column, n): how many rows of each reference hold a key that its parent hasn't."""
    def one(r: Reference) -> DataFrame:
        loose = tables[r.child].filter(F.col(r.column).isNotNull()).join(_keys(tables[r.parent], keys[r.parent], r.column), r.column, "left_anti")
        return loose.agg(F.count("*").alias("n")).select(F.lit(r.child).alias("child"), F.lit(r.column).alias("column"), "n")

    return reduce(DataFrame.unionByName, [one(r) for r in references])


def project_units(made: DataFrame, units: DataFrame, links: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, links) after the units of runs are projected onto those that are there.

    ``made``: run_id, number (in its run, from 1), domain_id, scope, key, topic, kind, summary, emphasis, refs.
    ``units``: unit_id, scope, key, topic, kind, summary, emphasis; ``links``: unit_id, span_id; ``spans``: domain_id,
    source_id, span_id. Of the units of one scope and key the last (by run and number) counts. One that is there keeps
    its id and takes the new content, others get the next ids in the order of scope and key. All links of a projected
    unit are replaced by the spans of its own domain that its references name, each once; unknown references are left
    out, and other units keep their links. A unit without a key is named by its number; a missing kind is ``concept``,
    a missing topic or summary empty, missing emphasis 0. A null scope is a scope like any other.
    """
    key = F.coalesce("key", F.format_string("KU-%04d", F.col("number")))
    text = lambda c, default: F.coalesce(c, F.lit(default)).alias(c)
    content = F.struct(text("topic", ""), F.when(F.col("kind") > "", F.col("kind")).otherwise("concept").alias("kind"), text("summary", ""), F.coalesce("emphasis", F.lit(0.0)).alias("emphasis"), "domain_id", "refs")
    last = made.groupBy("scope", key.alias("key")).agg(F.max_by(content, F.struct("run_id", "number")).alias("u")).select("scope", "key", "u.*")
    known = units.select(F.col("scope").alias("_scope"), F.col("key").alias("_key"), "unit_id")
    met = written(last.join(known, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("key") == F.col("_key")), "left").drop("_scope", "_key"), "projected")
    top = units.agg(F.coalesce(F.max("unit_id"), F.lit(0)).alias("_top"))  # one row
    fresh = group_ordinals(met.filter("unit_id IS NULL").drop("unit_id"), [], ["scope", "key"]).join(F.broadcast(top)).withColumn("unit_id", F.col("_top") + F.col("ordinal"))
    projected = written(met.filter("unit_id IS NOT NULL").unionByName(fresh.select(*met.columns)), "projected")
    columns = ["unit_id", "scope", "key", "topic", "kind", "summary", "emphasis"]
    named = projected.select("unit_id", "domain_id", F.explode(F.array_distinct("refs")).alias("source_id"))
    linked = named.join(spans.select("domain_id", "source_id", "span_id"), ["domain_id", "source_id"]).select("unit_id", "span_id").distinct()
    ids = projected.select("unit_id")
    return units.select(*columns).join(ids, "unit_id", "left_anti").unionByName(projected.select(*columns)), links.select("unit_id", "span_id").join(ids, "unit_id", "left_anti").unionByName(linked)
