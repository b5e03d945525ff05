"""Deterministic vectors of texts, for runs without a model."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Numbers of one step, some 8 MB, however many texts an Arrow batch has.
STEP = 1 << 20


def text_vector(text: bytes, dimensions: int, key: bytes) -> np.ndarray:
    """Bytes of a keyed hash, counted up, to numbers from -1 to 1; of length one."""
    blocks = []
    for i in range(-(-dimensions * 4 // 32)):
        block = hmac.new(key, b"%d:" % i, hashlib.sha256)
        block.update(text)
        blocks.append(block.digest())
    drawn = np.frombuffer(b"".join(blocks), dtype="<u4")[:dimensions].astype(np.float64) / 2**31 - 1
    return drawn / np.linalg.norm(drawn)


def hashed_vector(text: Column, dimensions: int = 64, key: bytes = b"marginalia") -> Column:
    """Texts are hashed where Arrow has them, and numbers go to an Arrow buffer, so that a batch makes no Python strings
    and lists."""
    def some(texts: pa.Array) -> pa.Array:
        known = texts.is_valid().to_numpy(zero_copy_only=False)
        values = np.empty((int(known.sum()), dimensions))
        at = 0
        for t in texts:
            if t.is_valid:
                values[at] = text_vector(t.as_buffer(), dimensions, key)
                at += 1
        borders = np.concatenate([[0], np.cumsum(known) * dimensions]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(borders, mask=np.append(~known, False)), pa.array(values.ravel()))

    def each(texts: pa.Array) -> pa.Array:
        step = max(1, STEP // dimensions)
        return pa.concat_arrays([some(texts.slice(i, step)) for i in range(0, max(1, len(texts)), step)])

    return F.arrow_udf(each, "array<double>")(text)
