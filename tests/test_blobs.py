import random

from marginalia.operators.blobs import blob_history, blob_states

ACTIONS = "blob string, event_id long, action string"


def test_a_blob_comes_back_and_failed_collections_are_retried(spark):
    told = ["drop", "add", "add", "drop", "collect", "drop", "collect_failed", "collect_failed", "collect", "collect", "add", "drop", "drop", "add", "drop", "other", None]
    df = spark.createDataFrame([("b", i, a) for i, a in enumerate(told)] + [(None, 1, "add"), ("b", None, "add")], ACTIONS)
    got = [(r["state"], r["refs"], r["result"], r["open_tasks"]) for r in blob_history(df).orderBy("event_id").collect()]
    assert got == [
        (None, 0, "missing", 0), ("live", 1, "created", 0), ("live", 2, "reused", 0), ("live", 1, "released", 0), ("live", 1, "still_referenced", 0), ("pending_delete", 0, "pending", 0),
        ("pending_delete", 0, "failed", 1), ("pending_delete", 0, "failed", 2), ("deleted", 0, "deleted", 0), ("deleted", 0, "already_deleted", 0), ("live", 1, "revived", 0), ("pending_delete", 0, "pending", 0),
        ("pending_delete", -1, "released", 0), ("live", 1, "revived", 0), ("pending_delete", 0, "pending", 0), ("pending_delete", 0, "ignored", 0), ("pending_delete", 0, "ignored", 0)]


def test_pieces_give_what_one_run_gives(spark):
    drawn = random.Random(4)
    rows = [(f"b{int(drawn.random() ** 3 * 12)}", i, drawn.choice(["add", "add", "drop", "drop", "collect", "collect_failed", "?"])) for i in range(600)]
    df = spark.createDataFrame(rows, ACTIONS)
    whole = {r["event_id"]: tuple(r) for r in blob_history(df).collect()}
    assert len(whole) == 600
    states, pieces = None, {}
    for low in (0, 150, 170, 600):
        piece = blob_history(df.filter(f"event_id >= {low} AND event_id < {[150, 170, 600, 601][[0, 150, 170, 600].index(low)]}"), states)
        pieces |= {r["event_id"]: tuple(r) for r in piece.collect()}
        states = spark.createDataFrame(blob_states(piece, states).collect(), "blob string, state string, refs long, open_tasks long")
    assert pieces == whole
    assert sorted(map(tuple, states.collect())) == sorted(map(tuple, blob_states(blob_history(df)).collect()))
