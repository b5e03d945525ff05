import random
import re

from marginalia.llm.secret_scan import automaton, base62_crc, redact_documents, scan_documents, scan_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_force(text):
    text = text or ""
    spans = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def good_token(prefix, body):
    return prefix + body + base62_crc(body)


def test_random_texts_match_plain_patterns():
    rng, words = random.Random(1), automaton()
    parts = ["password", "PassWd", "secret", "tokEn", "api_key", "APIKEY", "AKIA", "=", ":", " ", '"', "'", "abc", "0123456789abcdef", "XYZ0123456789", "-", "İ", "é", "ſecret", "toKen", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [s for s in scan_text(text, words) if s[2] in ("assign", "access", "hex")] == brute_force(text), text


def test_checksums_and_rows(spark):
    body = "aB3" * 10
    good, bad = good_token("ghp_", body), "ghp_" + body + "000000"
    rows = [(1, f"x {good} y"), (2, f"x {bad} y"), (3, f"npm_{body}{base62_crc(body)}"), (4, None), (5, ""), (5, ""), (6, "z" * 100_000 + " password = hunter22"), (None, "a" * 24)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, n_hex int")
    got = {r["doc_id"]: r for r in scan_documents(df).collect()}
    assert got[1]["spans"] == f"github:2:{2 + len(good)}" and got[1]["base_spans"] == ""
    assert got[2]["spans"] == "" and got[3]["n_checked"] == 1 and got[4]["spans"] == got[5]["spans"] == ""
    assert got[6]["spans"] == "assign:100001:100020" and got[None]["n_hex"] == 1
    assert scan_documents(df.filter("false")).collect() == []


def test_redaction(spark):
    df = spark.createDataFrame([(1, 'password: "hunter22" and ' + "ab12" * 6, 5, "k"), (2, None, 1, "k"), (3, "clean", 5, "k")], "doc_id long, text string, n_chars long, batch string")
    got = {r["doc_id"]: r for r in redact_documents(df, "text", "n_chars").collect()}
    assert got[1]["text"] == 'password: "[SECRET]" and [SECRET]' and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "clean" and got[3]["batch"] == "k"
