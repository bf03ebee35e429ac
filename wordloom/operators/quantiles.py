"""Exact quantiles by radix selection.

Every number has a 64-bit image that keeps the order: an integer is its own, a double the bits of its
representation, those of negative numbers turned round. The ranks that are wanted are then found digit by digit. A pass
counts, for each range that still holds a wanted rank, the rows in each of 4,096 parts of it, and the part that holds the rank is the range of the next
pass. Tasks add up before they send, the driver sees counts only, and no task sorts or holds the values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.session import materialize

BITS = 12  # of a digit
LOWEST = -(2**63)


@F.arrow_udf(T.LongType())
def _double_image(x: pa.Array) -> pa.Array:
    values = x.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # one zero
    values[np.isnan(values)] = np.nan  # one NaN, above all numbers
    bits = values.view(np.int64)
    image = np.where(bits < 0, ~bits ^ np.int64(LOWEST), bits)
    return pa.array(image, mask=np.asarray(x.is_null(nan_is_null=False)))


def _number(image: int, integer: bool) -> float | int:
    if integer:
        return image
    bits = np.int64(image) if image >= 0 else ~(np.int64(image) ^ np.int64(LOWEST))
    return float(np.array([bits], np.int64).view(np.float64)[0])


def image(value: Column, kind: T.DataType) -> Column:
    """Order-keeping BIGINT of a number; NaN above all others, both zeros equal, null for null."""
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint")
    if isinstance(kind, T.DecimalType):
        raise TypeError("quantiles are of integers and floating point numbers")
    return _double_image(value.cast("double"))


def select_ranks(df: DataFrame, value: str, ranks: Sequence[int], weight: str | None = None) -> list[float | int]:
    """The values at the given ranks, from 0, in ascending order; each row counts ``weight`` times. Null values and
    rows with weight 0 or below do not count. A rank beyond the rows is an error."""
    kind = df.schema[value].dataType
    integer = isinstance(kind, T.IntegralType)
    n = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    # the sign turned, so that the bits as they stand are in order
    rows = df.select(image(F.col(value), kind).bitwiseXOR(F.lit(LOWEST)).alias("v"), n.alias("n"))
    rows = rows.filter(F.col("v").isNotNull() & (F.col("n") > 0))
    if not integer:
        rows = materialize(rows, "images")  # the image is made in Python, once
    signed = F.col("v").bitwiseXOR(F.lit(LOWEST))
    ends = rows.agg(F.min(signed).alias("low"), F.max(signed).alias("high"), F.sum("n").alias("n")).first()
    if not ranks:
        return []
    if min(ranks) < 0 or max(ranks) >= (ends.n or 0):
        raise IndexError(f"there are {ends.n or 0} values")
    low, high = ends.low - LOWEST, ends.high - LOWEST
    width = (low ^ high).bit_length()  # of the bits that are still open; the others are the prefix
    state = {rank: (low >> width, rank) for rank in ranks}  # prefix, and the rank among the values that have it
    while width:
        shift = max(width - BITS, 0)
        prefixes = sorted({prefix for prefix, _ in state.values()})
        inside = rows
        if width < 64:
            signed_prefixes = [p if p < 2**63 else p - 2**64 for p in prefixes]
            inside = rows.filter(F.shiftrightunsigned("v", width).isin(signed_prefixes))
        counted = inside.groupBy(F.shiftrightunsigned("v", shift).alias("part")).agg(F.sum("n").alias("n")).collect()
        parts = sorted((r.part % 2**64, r.n) for r in counted)
        for rank, (prefix, within) in state.items():
            for part, many in parts:
                if part >> (width - shift) == prefix:
                    if within < many:
                        state[rank] = (part, within)
                        break
                    within -= many
        width = shift
    return [_number(state[rank][0] + LOWEST, integer) for rank in ranks]


def quantiles(df: DataFrame, value: str, shares: Sequence[float], weight: str | None = None) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbouring ranks; None without any value."""
    n = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    total = df.filter(F.col(value).isNotNull() & (n > 0)).agg(F.sum(n)).first()[0] or 0
    if not total:
        return [None] * len(shares)
    places = [share * (total - 1) for share in shares]
    wanted = sorted({f(p) for p in places for f in (math.floor, math.ceil)})
    found = dict(zip(wanted, select_ranks(df, value, wanted, weight)))
    out = []
    for p in places:
        low, high = found[math.floor(p)], found[math.ceil(p)]
        same = math.floor(p) == math.ceil(p) or low == high
        out.append(float(low) if same else (math.ceil(p) - p) * low + (p - math.floor(p)) * high)
    return out
