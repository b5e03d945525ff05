"""Segments with overlap under a budget for whole prompts: packed, given context, and halved where they don't fit."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.folds import halves, streamed

SINGLE, MANY, FAILED = "single_pass", "segmented_map_merge", "failed"


def tail_within(spans: list[tuple[int, int]], cap: int, most: int = 3) -> list[tuple[int, int]]:
    """The last (ordinal, tokens), at most ``most``, as far back as all from there on fit ``cap``."""
    taken, used = 0, 0
    for _, tokens in reversed(spans[-most:]):
        if used + tokens > cap:
            break
        taken, used = taken + 1, used + tokens
    return spans[len(spans) - taken:]


def segment_plan(spans: DataFrame, budget: int, fixed: int, each: int = 0, context: int | None = None, slack: int = 512, least_fill: float = 0.25, share: float = 0.15) -> DataFrame:
    """(domain_id, segment, ordinal, tokens, overlap, strategy): each span once as a primary one of a segment, and before
    a segment's own spans up to three of the segment before, as context.

    ``spans``: domain_id, ordinal, tokens, ends_unit (a preferred cut comes after it), boundary (a natural one before it).
    A prompt costs ``fixed``, its spans' tokens and ``each`` for every span; the last isn't counted while spans are packed.

    * A span too large for ``budget`` raises it for its domain to its tokens, ``fixed`` and ``slack``, if that is at most
      ``context``. A domain with a span that still doesn't fit has no segments and the strategy ``failed``; nothing is cut
      short, and other domains go on.
    * A domain that fits as a whole is one segment. Else a cut comes before a span that would pass the budget, after
      one that ends a unit, and at a natural boundary once ``least_fill`` of the capacity is full.
    * Context takes at most ``share`` of the budget and what the segment's own spans leave. A prompt over the budget
      loses its context, and then is halved by weight until it fits.

    Null flags are false. Null, negative or no tokens count as one, so a segment has at most ``budget`` spans: the fold
    holds the numbers of one segment and the last three of the one before, however long a domain is.
    """
    weight = F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(1)), F.lit(1))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    counted = spans.select("domain_id", "ordinal", weight.alias("tokens"), flag("ends_unit"), flag("boundary"))
    wholes = counted.groupBy("domain_id").agg(F.sum("tokens").alias("total"), F.max("tokens").alias("largest"))
    asked = F.col("largest") + fixed + slack
    own = F.when((asked > budget) & (asked <= (context or budget)), asked).otherwise(F.lit(budget).cast("long"))
    rows = counted.join(wholes.select(F.col("domain_id").alias("_d"), "total", "largest", own.alias("budget")), F.col("domain_id").eqNullSafe(F.col("_d"))).drop("_d")

    def close(held: list[tuple[int, int]], before: list[tuple[int, int]], number: int, own: int, whole: bool) -> Iterator[tuple]:
        sums = [0]
        for _, tokens in held:
            sums.append(sums[-1] + tokens)
        tail = tail_within(before, min(int(own * share), max(own - fixed - sums[-1], 0)))
        if fixed + each * (len(held) + len(tail)) + sums[-1] + sum(t for _, t in tail) <= own:
            yield from ((o, number, t, True, MANY) for o, t in tail)
        parts = halves(sums, fixed, each, own)
        strategy = SINGLE if whole and len(parts) == 1 else MANY
        for number, (low, high) in enumerate(parts, number):
            yield from ((o, number, t, False, strategy) for o, t in held[low:high])

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple[int, int]] = []
        before: list[tuple[int, int]] = []
        used, number, ended, own, whole = 0, 0, False, budget, False
        for ordinal, tokens, ends_unit, boundary, total, largest, own in rows:
            if largest + fixed + each > own:
                yield ordinal, None, tokens, False, FAILED
                continue
            whole, capacity = total + fixed <= own, own - fixed
            if held and not whole and (used + tokens > capacity or ended or (boundary and used >= least_fill * capacity)):
                for row in close(held, before, number + 1, own, whole):
                    number = row[1]
                    yield row
                held, before, used = [], held[-3:], 0
            held.append((ordinal, tokens))
            used, ended = used + tokens, ends_unit
        if held:
            yield from close(held, before, number + 1, own, whole)

    out = "ordinal long, segment long, tokens long, overlap boolean, strategy string"
    return streamed(rows, ["tokens", "ends_unit", "boundary", "total", "largest", "budget"], out, fold)
