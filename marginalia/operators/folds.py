"""Order-dependent packing under budgets, as folds over a domain's ordered spans.

A fold's result depends on the order, so Spark sorts each domain's rows by ordinal and streams them, in Arrow batches,
past a state of a few numbers: a domain of any length takes a bounded memory. Only numbers go there; texts stay where
they are and are joined back by (domain, ordinal).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = 10_000


KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def streamed(rows: DataFrame, columns: list[str], out: str, fold: Callable[[Iterator[tuple]], Iterator[tuple]], key_col: str = "domain_id", order_col: str = "ordinal", then: Sequence[str] = ()) -> DataFrame:
    """(key, *out) of ``fold`` over each key's (order, *columns), in order of the first and then of ``then``."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = fold(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in (order_col, *columns))))
        while held := list(islice(folded, BATCH)):
            values = [pa.array(c, type=t) for c, t in zip(zip(*held), kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(held), key[0].type), *values], names=[key_col, *names])

    names, kinds = zip(*[(n, KINDS[k]) for n, k in (field.split() for field in out.split(", "))])
    dealt = rows.select(key_col, order_col, *columns).repartition(key_col).sortWithinPartitions(key_col, order_col, *then)
    return dealt.groupBy(key_col).applyInArrow(run, f"{key_col} {rows.schema[key_col].dataType.simpleString()}, {out}")


def budget_segments(spans: DataFrame, budget: int) -> DataFrame:
    """(domain_id, ordinal, tokens, segment): spans fill segments in order; one over the budget by itself stays without a
    segment and changes nothing. Unknown tokens count as none."""
    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        segment, left = 0, budget
        for ordinal, tokens in rows:
            weight = tokens or 0
            if weight > budget:
                yield ordinal, tokens, None
                continue
            if segment == 0 or weight > left:
                segment, left = segment + 1, budget
            left -= weight
            yield ordinal, tokens, segment

    return streamed(spans, ["tokens"], "ordinal long, tokens long, segment long", fold)


def unit_batches(spans: DataFrame, cap: int, most: int = 8) -> DataFrame:
    """(domain_id, ordinal, batch): a batch ends when it has ``most`` units or the next would pass the cap."""
    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        batch, size, used = 0, 0, 0
        for ordinal, tokens in rows:
            if batch == 0 or size >= most or used + (tokens or 0) > cap:
                batch, size, used = batch + 1, 0, 0
            size, used = size + 1, used + (tokens or 0)
            yield ordinal, batch

    return streamed(spans, ["tokens"], "ordinal long, batch long", fold)


def excerpts(spans: DataFrame, most: int = 40, budget: int = 4000, sent: int = 400) -> DataFrame:
    """(domain_id, ordinal, status): spans are taken while there are fewer than ``most`` and their whole length fits the
    budget; one that doesn't fit is skipped, and later ones may still be taken."""
    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        taken, used = 0, 0
        for ordinal, chars in rows:
            length = chars or 0
            if taken >= most:
                yield ordinal, "max_spans_exceeded"
            elif used + length > budget:
                yield ordinal, "char_budget_exceeded"
            else:
                taken, used = taken + 1, used + length
                yield ordinal, "truncated" if length > sent else "sent"

    return streamed(spans, ["chars"], "ordinal long, status string", fold)


def planned_segments(spans: DataFrame, capacity: int, least_fill: float = 0.25) -> DataFrame:
    """(domain_id, ordinal, segment): a cut comes before a span that would pass the capacity, that is a preferred break,
    or that is a natural boundary once a quarter is full. A span over the capacity is an error: nothing is cut short."""
    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        segment, used = 0, 0
        for ordinal, tokens, preferred, boundary in rows:
            weight = tokens or 0
            if weight > capacity:
                raise ValueError("a span is over the segment capacity")
            wish = preferred or (boundary and used >= least_fill * capacity)
            if segment == 0 or (used > 0 and (used + weight > capacity or wish)):
                segment, used = segment + 1, 0
            used += weight
            yield ordinal, segment

    return streamed(spans, ["tokens", "preferred", "boundary"], "ordinal long, segment long", fold)


def halves(sums: list[int], fixed: int, each: int, budget: int) -> list[tuple[int, int]]:
    """Ranges (from, to) of spans, in order, that each cost at most ``budget``: ``fixed``, ``each`` for a span, and its
    weight. ``sums`` are the running sums of the weights, from 0. What costs more is cut where half of its weight is
    reached, again and again; a single span stays as it is."""
    fit, open_ = [], [(0, len(sums) - 1)]
    while open_:
        low, high = open_.pop()
        weight = sums[high] - sums[low]
        if high - low <= 1 or fixed + each * (high - low) + weight <= budget:
            fit.append((low, high))
            continue
        cut = bisect_left(sums, sums[low] + max(weight // 2, 1), low + 1, high - 1)
        open_ += [(cut, high), (low, cut)]
    return fit


def refit_segments(planned: DataFrame, budget: int) -> DataFrame:
    """(domain_id, segment, ordinal, overlap): segments over the budget lose their overlap, then are halved by weight
    until they fit; primary spans stay, in order. ``planned``: domain_id, segment, ordinal, tokens, overlap. A single
    span over the budget is an error. Spans count at least one token when halved. The numbers of one segment are held
    at a time, however many a domain has."""
    def fit(held: list[tuple[int, int, bool]], number: int) -> Iterator[tuple]:
        if sum(t for _, t, _ in held) > budget:
            held = [r for r in held if not r[2]]
        if any(t > budget for _, t, _ in held):
            raise ValueError(f"span {next(o for o, t, _ in held if t > budget)} is over the budget")
        if sum(t for _, t, _ in held) <= budget:
            parts = [(0, len(held))]
        else:
            sums = [0]
            for _, t, _ in held:
                sums.append(sums[-1] + max(t, 1))
            parts = halves(sums, 0, 0, budget)
        for number, (low, high) in enumerate(parts, number):
            yield from ((number, o, v) for o, _, v in held[low:high])

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        number = 0
        for _, part in groupby(rows, key=itemgetter(0)):
            for row in fit([(o, t or 0, bool(v)) for _, o, t, v in part], number + 1):
                number = row[0]
                yield row

    return streamed(planned.withColumnRenamed("segment", "_segment"), ["ordinal", "tokens", "overlap"], "segment long, ordinal long, overlap boolean", fold, order_col="_segment", then=["ordinal"])


def attempt_chain(attempts: DataFrame) -> DataFrame:
    """(user_id, event_id, before, after, interval_before, interval_after) of ``attempts`` (user_id, event_id, right,
    rating): each attempt starts from the mastery and the days to the next review that the last one left (0.5 and 1.0
    at first). Two wrong ones in a row start over."""
    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        mastery, days, wrong = 0.5, 1.0, 0
        for event_id, right, rating in rows:
            wrong = 0 if right else wrong + 1
            after = round(max(0.0, min(1.0, mastery + (0.15 if right else -0.25))), 4)
            grown = 1.0 if rating <= 1 else 3.0 if rating == 2 else days * {3: 1.8, 4: 2.5}.get(rating, 3.2)
            later = 1.0 if wrong >= 2 else max(1.0, min(180.0, grown))
            yield event_id, mastery, after, days, later
            mastery, days = after, later

    return streamed(attempts, ["right", "rating"], "event_id long, before double, after double, interval_before double, interval_after double", fold, "user_id", "event_id")
