"""Content-addressed blobs with counted references, folded from what was added, dropped and collected."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.folds import streamed

LIVE, PENDING, DELETED = "live", "pending_delete", "deleted"


def blob_history(actions: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """(blob, event_id, state, refs, result, open_tasks) after each action on a blob, in the order of event_id.

    ``actions``: blob (its content's digest), event_id, action:

    * ``add``: a blob that is live has one reference more (``reused``). One that is pending or deleted is live again with
      one reference, and its file is written anew (``revived``); an unknown one is written (``created``).
    * ``drop``: one reference less; a live blob without any is pending (``pending``, else ``released``).
    * ``collect``: a pending blob without references is deleted, and a failed attempt's task is closed (``deleted``).
      ``collect_failed`` is an attempt whose file couldn't be removed: the blob stays pending, with a task to retry it
      (``failed``). Others say ``already_deleted`` or ``still_referenced``.

    Drops and collections of unknown blobs are ``missing``, any other action is ``ignored``; neither changes anything. Rows without a
    blob or an event_id take no part.
    ``blobs`` (blob, state, refs, open_tasks) is what an earlier run left (``blob_states``), so that actions can be folded
    piece by piece: the result is that of all at once. Only digests and numbers move, and a task holds one blob's state.
    """
    actions = actions.filter("blob IS NOT NULL AND event_id IS NOT NULL")
    rows = actions.select("blob", F.col("event_id").cast("long"), "action", F.lit(None).cast("string").alias("was"), F.lit(None).cast("long").alias("had"), F.lit(None).cast("long").alias("owed"))
    if blobs is not None:
        start = blobs.join(actions.select("blob").distinct(), "blob", "left_semi")
        rows = rows.unionByName(start.select("blob", F.lit(None).cast("long").alias("event_id"), F.lit("was").alias("action"), F.col("state").alias("was"), F.col("refs").alias("had"), F.col("open_tasks").alias("owed")))

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        state, refs, tasks = None, 0, 0
        for event_id, action, was, had, owed in rows:
            if event_id is None and action == "was":
                state, refs, tasks = was, had, owed
                continue
            result = "ignored"
            if action == "add":
                result = "created" if state is None else "reused" if state == LIVE else "revived"
                state, refs = LIVE, refs + 1 if state == LIVE else 1
            elif action in ("drop", "collect", "collect_failed"):
                if state is None:
                    result = "missing"
                elif action == "drop":
                    refs -= 1
                    result = "pending" if refs <= 0 and state == LIVE else "released"
                    state = PENDING if result == "pending" else state
                elif state == DELETED:
                    result = "already_deleted"
                elif refs > 0:
                    result = "still_referenced"
                elif action == "collect":
                    state, tasks, result = DELETED, 0, "deleted"
                else:
                    tasks, result = tasks + 1, "failed"
            yield event_id, state, refs, result, tasks

    out = "event_id long, state string, refs long, result string, open_tasks long"
    return streamed(rows.withColumnRenamed("event_id", "_at"), ["action", "was", "had", "owed"], out, fold, key_col="blob", order_col="_at")


def blob_states(history: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """(blob, state, refs, open_tasks) after a history's last action on each blob; ``blobs`` that it didn't touch stay."""
    last = history.groupBy("blob").agg(F.max_by(F.struct("state", "refs", "open_tasks"), "event_id").alias("s")).filter("s.state IS NOT NULL").select("blob", "s.*")
    return last if blobs is None else last.unionByName(blobs.select("blob", "state", "refs", "open_tasks").join(history.select("blob").distinct(), "blob", "left_anti"))
