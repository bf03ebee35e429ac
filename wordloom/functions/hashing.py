"""Uniform numbers derived from keys.

``rand()`` depends on partitioning and on task retries. A draw here depends only on the
seed, the record and the position, so a lost executor recomputes the same sample.

One md5 per record gives a 31-bit state; each position then takes three rounds of a
multiplicative congruential generator with xor-shifts. All steps stay inside BIGINT.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: a Mersenne prime, a position stride and three multipliers
MODULUS = 2**31 - 1
STRIDE = 1_000_003
ROUNDS = ((48_271, 13), (69_621, 16), (39_373, 0))


def digest(seed: int | str, *parts: Column | str) -> Column:
    """Hex md5 of ``seed:part:part…``, the total order behind splits and shuffles."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def record_state(seed: int | str, *parts: Column | str) -> Column:
    """31-bit BIGINT state of one record."""
    return F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("bigint") % F.lit(MODULUS)


def uniform(state: Column, pos: Column | int) -> Column:
    """Uniform DOUBLE in [0, 1) for a position within a record."""
    pos = F.lit(pos) if isinstance(pos, int) else pos
    x = (state + pos.cast("bigint") * F.lit(STRIDE)) % F.lit(MODULUS)
    for factor, shift in ROUNDS:
        x = (x * F.lit(factor)) % F.lit(MODULUS)
        if shift:
            x = x.bitwiseXOR(F.shiftright(x, shift))
    return x / F.lit(float(MODULUS))


def uniform_np(state: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The same number for Arrow batches."""
    x = (state.astype(np.int64) + pos.astype(np.int64) * STRIDE) % MODULUS
    for factor, shift in ROUNDS:
        x = (x * factor) % MODULUS
        if shift:
            x = x ^ (x >> shift)
    return x / float(MODULUS)
