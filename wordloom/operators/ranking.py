"""Positions, running totals and neighbours without a window over a whole group.

A plain window sorts each group in one task. One run, source or series may hold a third
of all rows, so the operators here cut every group into ranges first: the long pass sorts
(group, range) pieces of bounded size, and a second pass over one row per piece supplies
what a piece needs from the ones before and after it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.hashing import digest

HASH_PREFIX = 4  # hex digits: 65,536 ranges, evenly filled because the key is a hash
ROWS_PER_RANGE = 500_000
MAX_RANGES = 10_000


def with_ranges(df: DataFrame, order: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``_range``, the number of the range that holds ``order``.

    The cuts are quantiles of the whole table, so a range holds about ``rows_per_range``
    rows over all groups together and no (group, range) piece holds more than its range.
    """
    total = df.count()
    ranges = max(1, min(MAX_RANGES, -(-total // rows_per_range)))
    if ranges == 1:
        return df.withColumn("_range", F.lit(0.0))
    keyed = df.withColumn("_order", F.col(order).cast("double"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = keyed.agg(F.percentile_approx("_order", shares, 10 * ranges)).first()[0]
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="_order", outputCol="_range", handleInvalid="keep")
    return bucketizer.transform(keyed).drop("_order")


def _pieces(df: DataFrame, groups: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    return df.groupBy(*groups, "_range").agg(*aggregates)


def _before(groups: Sequence[str]) -> Window:
    return (
        Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )


def _attach(df: DataFrame, pieces: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Join each row with its piece; null is a group like any other, and a range is never null."""
    keys = [*groups, "_range"]
    pieces = pieces.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    same = [F.col("_range") == F.col("_of__range"), *[F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in groups]]
    return df.join(pieces, reduce(and_, same)).drop(*[f"_of_{c}" for c in keys])


def row_numbers(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    name: str = "position",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Zero-based position of each row within its group. ``order`` is unique in a group."""
    ranged = with_ranges(df, order, rows_per_range)
    pieces = _pieces(ranged, groups, [F.count("*").alias("_n")])
    offsets = pieces.select(
        *groups, "_range", F.coalesce(F.sum("_n").over(_before(groups)), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*groups, "_range").orderBy(order)
    return (
        _attach(ranged, offsets, groups)
        .withColumn(name, F.row_number().over(within) - 1 + F.col("_offset"))
        .drop("_range", "_offset")
    )


def running_mean(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    value: str,
    name: str = "running_mean",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Mean of ``value`` over all rows of the group up to and including this one."""
    ranged = with_ranges(df, order, rows_per_range)
    pieces = _pieces(ranged, groups, [F.count(value).alias("_n"), F.sum(value).alias("_s")])
    offsets = pieces.select(
        *groups,
        "_range",
        F.coalesce(F.sum("_n").over(_before(groups)), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(_before(groups)), F.lit(0.0)).alias("_s0"),
    )
    within = (
        Window.partitionBy(*groups, "_range")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _attach(ranged, offsets, groups)
        .withColumn(
            name,
            (F.coalesce(F.sum(value).over(within), F.lit(0.0)) + F.col("_s0"))
            / (F.count(value).over(within) + F.col("_n0")),
        )
        .drop("_range", "_n0", "_s0")
    )


def neighbours(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    values: Sequence[str],
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add structs ``previous`` and ``next`` holding ``values`` of the adjacent rows of the
    group; null at the ends. ``order`` must be unique within a group."""
    ranged = with_ranges(df, order, rows_per_range)
    here = F.struct(*values)
    pieces = _pieces(
        ranged,
        groups,
        [F.min_by(here, order).alias("_first"), F.max_by(here, order).alias("_last")],
    )
    along = Window.partitionBy(*groups).orderBy("_range")
    edges = pieces.select(
        *groups, "_range", F.lag("_last").over(along).alias("_left"), F.lead("_first").over(along).alias("_right")
    )
    within = Window.partitionBy(*groups, "_range").orderBy(order)
    return (
        _attach(ranged, edges, groups)
        .withColumn("previous", F.coalesce(F.lag(here).over(within), F.col("_left")))
        .withColumn("next", F.coalesce(F.lead(here).over(within), F.col("_right")))
        .drop("_range", "_left", "_right")
    )


def shuffled_positions(df: DataFrame, key: str, seed: int | str, name: str = "position") -> DataFrame:
    """Zero-based place of every row in a random order fixed by the seed.

    The order is that of the hash of ``key``, so the 65,536 hash prefixes are even ranges.
    """
    ranged = df.withColumn("_hash", digest(seed, key)).withColumn("_range", F.substring("_hash", 1, HASH_PREFIX))
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select(
            "_range",
            F.coalesce(
                F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_offset"),
        )
    )
    within = Window.partitionBy("_range").orderBy("_hash", key)
    return (
        ranged.join(F.broadcast(offsets), "_range")  # at most 65,536 rows
        .withColumn(name, F.row_number().over(within) - 1 + F.col("_offset"))
        .drop("_range", "_hash", "_offset")
    )


def hash_cut(df: DataFrame, key: str, seed: int | str, k: int | Column) -> Column:
    """Hash of the k-th row in hash order, as a scalar subquery; null where ``k`` is zero.

    Two passes read the key column only. The first counts rows per hash prefix; the
    second ranks the rows of the one prefix that holds the k-th. Comparing a row's hash
    with the cut then needs no shuffle of the data.
    """
    k = F.lit(k) if isinstance(k, int) else k
    hashes = df.select(digest(seed, key).alias("_hash"))
    prefix = F.substring("_hash", 1, HASH_PREFIX)
    so_far = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = (
        hashes.groupBy(prefix.alias("_prefix"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_through", F.sum("_n").over(so_far))
        .filter((F.col("_through") >= k) & (F.col("_through") - F.col("_n") < k))
        .select("_prefix", (k - F.col("_through") + F.col("_n")).alias("_place"))
    )
    ranked = (
        hashes.withColumn("_prefix", prefix)
        .join(F.broadcast(counts), "_prefix")  # one row
        .withColumn("_no", F.row_number().over(Window.partitionBy("_prefix").orderBy("_hash")))
        .filter(F.col("_no") == F.col("_place"))
    )
    return ranked.agg(F.max("_hash")).scalar()
