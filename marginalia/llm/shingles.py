"""Hashes of word shingles of whole Arrow text columns, without a Python string for any text.

A word is a run of bytes other than space and the five ASCII controls from tab to carriage return. Its hash is a
polynomial over table values of its bytes, read off prefix sums modulo 2**64, so the work is a few passes of numpy over
the column's own buffer. Slices end at word borders, which bounds memory for texts of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _table(lower: bool) -> np.ndarray:
    byte = np.arange(256, dtype=np.uint64)
    if lower:
        byte[65:91] += np.uint64(32)
    return mixed(byte + np.uint64(1000))


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Kinds of bytes: 0 separates words; a word also ends where the kind changes.
WORDS = (~SPACE).astype(np.uint8)
WORDS_AND_SIGNS = WORDS * 2
WORDS_AND_SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
TABLES = {True: _table(True), False: _table(False)}


class Powers:
    """BASE**i and its inverse for i below a length that grows with the longest slice."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grown(self, n: int) -> Powers:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 2**64))
            for name, base in (("up", BASE), ("down", inverse)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self


POWERS = Powers()


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the row borders of a text column without nulls."""
    wide = pa.types.is_large_string(texts.type)
    _, borders, data = texts.buffers()
    borders = np.frombuffer(borders, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if borders else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), borders


def word_hashes(texts: pa.Array, lower: bool = False, kinds: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row where its words begin (one more entry than rows)."""
    data, borders = text_buffer(texts)
    at, end = int(borders[0]), int(borders[-1])
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    while at < end:
        to = min(end, at + SLICE)
        if to < end:  # on to the next border of a word or a row
            row_end = int(borders[np.searchsorted(borders, to)])
            while to < row_end:
                near = np.flatnonzero(SPACE[data[to : min(row_end, to + 4096)]])
                to = to + int(near[0]) if len(near) else min(row_end, to + 4096)
                if len(near):
                    break
        part = data[at:to]
        kind = kinds[part]
        inside = kind > 0
        turn = kind[1:] != kind[:-1]
        first = inside.copy()
        first[1:] &= turn
        last = inside.copy()
        last[:-1] &= turn
        cuts = borders[np.searchsorted(borders, at, "right") : np.searchsorted(borders, to, "left")] - at
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        powers = POWERS.grown(to - at)
        sums = np.zeros(to - at + 1, dtype=np.uint64)
        np.cumsum(TABLES[lower][part] * powers.up[: to - at], out=sums[1:])
        value = (sums[stop] - sums[begin]) * powers.down[begin]
        hashes.append(mixed(value + (stop - begin).astype(np.uint64)))
        starts.append(begin + at)
        at = to
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), borders)


def joined(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` neighbouring words."""
    out = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for i in range(width):
        out = out * BASE + words[i : i + len(out)]
    return mixed(out + np.uint64(width))


def row_shingles(words: np.ndarray, bounds: np.ndarray, width: int):
    """For each row its shingle hashes, in order and with repeats; a shorter row is one shingle, one without words has
    none."""
    whole = joined(words, width)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield whole[a : b - width + 1] if b - a >= width else joined(words[a:b], b - a) if b > a else words[:0]
