import time

from marginalia.llm.chat_quotes import parsed, reply_ordered
from marginalia.llm.queries import op9_quoted_parts

SCHEMA = "conv_id long, turn long, role string, text string, thread string, path int"


def ordered(spark, rows):
    return [(r["thread"], r["turn"], r["parent"], r["reply_path"], r["text"]) for r in reply_ordered(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)).orderBy("thread", "path").collect()]


def test_nested_quotes_link_and_go(spark):
    rows = [
        (1, 0, "user", "Where is  it?\nTell me."),
        (1, 1, "assistant", "> where is it?\n> Tell me.\nOver there."),
        (1, 2, "user", "Never mind."),
        (1, 3, "assistant", "> > Where is it?\n> > Tell me.\n> Over there.\nGood."),
        (1, 4, "user", ">Never mind.\r\n> \r\nfirst\n>>Where is it?\n>>Tell me.\nlast"),
        (2, 0, "user", "> Over there.\nother thread"),
        (2, 1, None, None),
        (2, 2, "user", "> \n"),
    ]
    assert ordered(spark, rows) == [
        (1, 0, None, "0", "Where is  it?\nTell me."),
        (1, 1, 0, "0.1", "Over there."),
        (1, 3, 1, "0.1.3", "Good."),
        (1, 2, None, "2", "Never mind."),
        (1, 4, 2, "2.4", "first\nlast"),
        (2, 0, None, "0", "other thread"),
        (2, 1, None, "1", ""),
        (2, 2, None, "2", ""),
    ]


def test_long_chain_repeated_rows_and_empty_table(spark):
    rows = [(5, t, "user", (f"> number {t - 1}\n" if t else "") + f"number {t}") for t in range(40)]
    got = ordered(spark, rows + rows[:7] + [(None, 3, "user", "x"), (6, None, "user", "x")])
    assert [g[1] for g in got] == list(range(40))
    assert got[-1][3] == ".".join(map(str, range(40)))
    assert ordered(spark, []) == []


def test_quoted_parts_and_answers_between(spark):
    rows = [
        (1, 0, "user", "First point.\nSecond point.\n\nA last paragraph\nof two lines."),
        (1, 1, "assistant", "First point."),
        (1, 2, "user", "> Second  point.\nRight."),
        (1, 3, "assistant", "> First point.\nYes.\n> second point.\nNo."),
        (1, 4, "user", "> A last\n> paragraph of\n> two lines.\nWrapped."),
        (1, 5, "assistant", "> > Second point.\n> Nothing there.\n> No.\nGood."),
        (1, 6, "user", "> First point.\nWhole."),
        (1, 7, "user", "> Later.\n> > nowhere\nx"),
        (1, 8, "user", "Later."),
        (2, 0, "user", "> Second point.\nother thread"),
    ]
    got = {(g[0], g[1]): g[2] for g in ordered(spark, rows)}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 0, (1, 4): 0, (1, 5): 3, (1, 6): 1, (1, 7): None, (1, 8): None, (2, 0): None}


def test_interleaved_query_against_brute_force(spark, sf_dir):
    plain = lambda line: " ".join(line.split()).lower()
    threads = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        threads.setdefault(r["conv_id"], {})[r["turn"]] = r["text"].split("\n")
    want = {}
    for conv, said in threads.items():
        for turn in said:
            quoted = [plain(x) for x in said.get(turn - 1, [])[::2] if plain(x)]
            covers = {t: sum(q in set(map(plain, said[t])) for q in quoted) for t in said if t < turn}
            most = max(covers.values(), default=0)
            want[conv, turn] = [t for t, n in covers.items() if n == most] if most else [None]
    got = {(r["conv_id"], r["turn"]): (r["parent"], r["text"]) for r in op9_quoted_parts(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(parent in want[k] for k, (parent, _) in got.items())
    assert all(text == "\n".join(threads[k[0]][k[1]]).strip(" ") for k, (_, text) in got.items())
    assert sum(len(w) == 1 and w[0] == k[1] - 1 for k, w in want.items()) > 0


def test_long_messages_take_time_in_proportion(spark):
    def blocks(n, mark=""):
        return "\n\n".join(f"{mark}paragraph {i}\n{mark}of two lines" for i in range(n))

    rows = [
        (1, 0, "user", blocks(10_000)),
        (1, 1, "assistant", "\n".join(f"line {i}" for i in range(10_000))),
        (1, 2, "user", "> paragraph 7000\n> of two lines\nThat one."),
        (1, 3, "user", "> line 9999\nThe last."),
        (1, 4, "user", blocks(300, "> ") + "\nMany.\n\n" + "> x\n" * 5000 + " \n" * 20_000),
        (1, 5, "user", blocks(10_000, "> ") + "\nAll of it."),
    ]
    began = time.monotonic()
    got = {g[1]: g[2] for g in ordered(spark, rows)}
    assert got == {0: None, 1: None, 2: 0, 3: 1, 4: 0, 5: 0}
    assert time.monotonic() - began < 60
    frame = spark.createDataFrame([(1, 0, "user", blocks(300)), (1, 1, "user", blocks(3000))], "thread long, turn long, role string, body string")
    units = {r["turn"]: r["units"] for r in parsed(frame).collect()}
    for turn, n in ((0, 300), (1, 3000)):
        assert len(units[turn]) == 1 + n + 2 * n and sum(u["whole"] for u in units[turn]) == 1
        assert [u["at"] for u in units[turn][1 : n + 1]] == [[3 * i, 3 * i + 1] for i in range(n)]
