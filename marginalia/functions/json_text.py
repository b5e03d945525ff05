"""JSON out of noisy text: batches of a pandas UDF, as nested brackets are beyond regular expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"```(?:json)?\s*(.*?)(?:```|\Z)", re.S | re.I)
THINKING = re.compile(r"<thinking>.*?</thinking>", re.S)
THINKING_TAG = re.compile(r"<\s*/?\s*thinking\s*>")
MARKS = re.compile(r'["{}\[\]]')
STRING_END = re.compile(r'(?<!\\)(?:\\\\)*"')
LOOSE_COMMA = re.compile(r",(?=\s*[}\]])")
DECODER = json.JSONDecoder()


def without_thoughts(text: str) -> str:
    """The text without what stands between thinking tags, and without tags that have no other."""
    last = text.rfind("</thinking>") + 1
    return THINKING_TAG.sub("", THINKING.sub("", text[: last + 10]) + text[last + 10 :] if last else text)


def never_closed(text: str, start: int, end: int) -> set[int]:
    """Openings from ``start`` on, strings left out, that no closing before ``end`` answers."""
    open_: list[int] = []
    at = start
    while (mark := MARKS.search(text, at, end)) is not None:
        at = mark.end()
        if mark[0] == '"':
            stop = STRING_END.search(text, at, end)
            if stop is None:
                break
            at = stop.end()
        elif mark[0] in "{[":
            open_.append(mark.start())
        elif open_:
            open_.pop()
    return set(open_)


def openings(text: str, opening: str) -> Iterator[object]:
    """Values that an opening begins, from left to right. Where one can't be read on, those inside it that are still
    open there can't either, so each stretch of a text is read a bounded number of times."""
    doomed: set[int] = set()
    at = text.find(opening)
    while at >= 0:
        if at not in doomed:
            try:
                yield DECODER.raw_decode(text, at)[0]
            except json.JSONDecodeError as e:
                doomed |= never_closed(text, at, e.pos)
            except RecursionError:
                doomed |= never_closed(text, at, len(text))
        at = text.find(opening, at + 1)


def json_values(text: str) -> Iterator[object]:
    """Values that the text holds, likeliest first: the text itself or what it starts with, then its fenced blocks, then
    whatever an opening brace or, after those, an opening bracket begins. What follows a value doesn't matter, so one
    cut off or run on is read as far as it is whole. Commas before a closing bracket are forgiven."""
    plain = without_thoughts(text).strip()
    for part in (plain, *(block.strip() for block in FENCE.findall(plain))):
        for form in (part, LOOSE_COMMA.sub("", part)):
            try:
                yield DECODER.raw_decode(form)[0] if form[:1] in ("{", "[") else json.loads(form)
            except (ValueError, RecursionError):
                continue
    for opening in "{[":
        for form in (plain, LOOSE_COMMA.sub("", plain)):
            yield from openings(form, opening)


def first_json(text: str | None) -> str | None:
    """The first of ``json_values`` with sorted keys and without blanks; null without any."""
    for value in json_values(text or ""):
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return None


def extracted_json(text: Column) -> Column:
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(first_json)

    return F.pandas_udf(each, "string")(text)
