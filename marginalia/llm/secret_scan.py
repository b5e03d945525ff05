"""Secret scanning: a keyword automaton first, anchored patterns only where it hits, then checksums.

One Aho-Corasick pass over a text finds the keywords of every kind that has some; that kind's pattern is tried just
where its keyword stands. Runs of hexadecimal digits have no keyword, so one linear pattern looks for them. Kinds with a
checksum in the token (six base-62 digits of the CRC-32 of the rest) count only where it is right.

The scan is a narrow map: no shuffle, whole texts, nothing kept from row to row.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.common import keyed_text, map_batches

#: Kinds in the order that ties of the same start follow.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = ("assign", "access", "hex")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # shorter runs are dropped whole, so a match starts where a run does
CHECKED = {"github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")}
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(text: str) -> str:
    value, digits = zlib.crc32(text.encode()), []
    for _ in range(6):
        value, d = divmod(value, 62)
        digits.append(BASE62[d])
    return "".join(reversed(digits))


def automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        words.add_word(word, (len(word), kind))
    words.make_automaton()
    return words


def scan_text(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then kind."""
    spans: list[tuple[int, int, str]] = [(*m.span(), "hex") for m in HEX.finditer(text)]
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would shift what follows
        low = text.translate(LOWER)
    hits: dict[str, list[int]] = defaultdict(list)
    for end, (length, kind) in words.iter(low):
        hits[kind].append(end + 1 - length)
    for kind, starts in hits.items():
        free = 0  # matches don't overlap, and one that fails its length still takes up its text
        for start in sorted(starts):
            if start < free:
                continue
            if kind == "assign":
                m = ASSIGN.match(text, start)
                good = m and len(m[2]) >= 6
            elif kind == "access":
                m = ACCESS.match(text, start)
                good = m and m.end() - start >= 20
            else:
                m = CHECKED[kind].match(text, start)
                good = m and base62_crc(m[1]) == m[2]
            if m:
                free = m.end()
            if good:
                spans.append((start, m.end(), kind))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


def written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_checked, base_spans, spans) of every row.

    Spans read ``kind:start:end``, in code points, end exclusive, by start and then kind, joined by commas. Null and
    empty texts have no spans. Repeated rows are scanned each by itself, and spans of different kinds may overlap.
    """
    def make():
        words = automaton()

        def step(batch: pa.RecordBatch) -> dict:
            found = [scan_text(t.as_py(), words) for t in batch.column("text")]
            base = [[s for s in spans if s[2] in BASE] for spans in found]
            count = {f"n_{k}": [sum(s[2] == k for s in spans) for spans in base] for k in BASE}
            return {"doc_id": batch.column("doc_id"), **count, "n_checked": [len(a) - len(b) for a, b in zip(found, base)], "base_spans": list(map(written, base)), "spans": list(map(written, found))}

        return step

    return map_batches(keyed_text(docs, id_col, text_col), make, "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_spans string, spans string")


def redact_text(text: str, words: ahocorasick.Automaton) -> str:
    """The text with each run of overlapping spans replaced by ``[SECRET]``; an assignment loses its value only."""
    out, at = [], 0
    for start, end, kind in scan_text(text, words):
        if kind == "assign":
            start = ASSIGN.match(text, start).start(2)
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All columns of ``docs``, with secrets in ``text_col`` replaced by ``[SECRET]``; other columns stay as they are.

    ``length_col``: a column that is to hold the new length in code points. A null text stays null, with a null length.
    """
    schema = docs.schema
    arrow_names = docs.columns

    def run(batches):
        words = automaton()
        for batch in batches:
            texts = [None if t is None else redact_text(t, words) for t in batch.column(text_col).to_pylist()]
            columns = []
            for name in arrow_names:
                column = batch.column(name)
                if name == text_col:
                    column = pa.array(texts, type=column.type)
                elif name == length_col:
                    column = pa.array([None if t is None else len(t) for t in texts], type=column.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names=arrow_names)

    return docs.mapInArrow(run, schema)


