"""Statistics of vocabularies, sequence lengths and layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.numeric import linspace
from wordloom.operators.quantiles import quantiles
from wordloom.operators.sampling import keep_probability
from wordloom.operators.vocabulary import count_frequencies, most_common
from wordloom.session import materialize


def histogram(df: DataFrame, value: str, name: str = "n") -> DataFrame:
    """Rows per value."""
    return df.groupBy(value).agg(F.count("*").alias(name))


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of an integer column.

    The rows are first counted per value, so one frequent value is one entry of the sums, and the exact
    quartiles come from counts of ranges of values: no task holds all of them.
    """
    h = materialize(histogram(df.filter(F.col(value).isNotNull()), value, "_n"), "histogram")
    n = F.sum("_n")
    whole = F.col(value).cast("decimal(19,0)")
    s1 = F.sum((whole * F.col("_n")).cast("decimal(38,0)"))
    s2 = F.sum((whole * whole).cast("decimal(38,0)").cast("double") * F.col("_n"))
    quartiles = F.lit(quantiles(h, value, (0.25, 0.5, 0.75), "_n")).cast("array<double>")
    summed = h.agg(
        n.alias("n"),
        s1.cast("double").alias("s1"),
        s2.alias("s2"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    )
    variance = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / F.when(F.col("n") > 1, F.col("n") - 1)
    return summed.select(
        F.coalesce("n", F.lit(0)).alias("count"),
        (F.col("s1") / F.when(F.col("n") > 0, F.col("n"))).alias("mean"),
        F.sqrt(F.when(variance < 0, 0.0).otherwise(variance)).alias("std"),
        "min",
        quartiles[0].alias("p25"),
        quartiles[1].alias("p50"),
        quartiles[2].alias("p75"),
        "max",
    )


def words_at_ranks(counts: DataFrame, ranks: Sequence[int]) -> DataFrame:
    """``(rank, word, cnt)`` at the given ranks, from 0."""
    return most_common(counts, max(ranks) + 1).filter(F.col("rank").isin(list(ranks)))


def cutoffs(counts: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Least frequent word kept by a vocabulary of each size, and the share of all tokens
    that the vocabulary covers."""
    total = counts.agg(F.sum("cnt")).scalar()
    running = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = most_common(counts, max(sizes)).withColumn("covered", F.sum("cnt").over(running))
    last = top.filter((F.col("rank") + 1).isin(list(sizes)))
    return last.select(
        (F.col("rank") + 1).alias("size"), "word", "cnt", (F.col("covered") / total).alias("coverage")
    )


def common_frequencies(counts: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` counts that most words share, with their share of all words."""
    frequencies = count_frequencies(counts)
    total = counts.agg(F.count("*")).scalar()
    top = frequencies.orderBy(F.desc("n_words"), F.asc("cnt")).limit(k)
    return top.withColumn("share", F.col("n_words") / total)


def lengths(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    return encoded.select("record_id", F.size(ids).alias("length"))


def length_shares(sizes: DataFrame, at: Sequence[int] | None = None) -> DataFrame:
    """Share of records of each length, or of the given lengths only."""
    total = sizes.agg(F.count("*")).scalar()
    h = histogram(sizes, "length", "n_records")
    if at is not None:
        h = h.filter(F.col("length").isin(list(at)))
    return h.withColumn("share", F.col("n_records") / total)


def retention(sizes: DataFrame, contexts: Sequence[int]) -> DataFrame:
    """Share of records that hold a window of n words per side, for each n."""
    h = histogram(sizes, "length", "_n")
    kept = [
        F.struct(
            F.lit(n).alias("n_context"),
            (F.sum(F.when(F.col("length") >= 2 * n + 1, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("share"),
        )
        for n in contexts
    ]
    return h.agg(F.array(*kept).alias("rows")).select(F.inline("rows"))


def keep_curves(
    counts: DataFrame, thresholds: Sequence[float] = (1e-2, 1e-3, 1e-4), points: int = 10_000
) -> DataFrame:
    """Keep probability along ``points`` counts from 1 to the highest one, per threshold."""
    spark = counts.sparkSession
    top = counts.agg(F.max("cnt").cast("double")).scalar()
    total = counts.agg(F.sum("cnt").cast("double")).scalar()
    grid = linspace(spark, 0.0, 1.0, points, "share").withColumn("x", 1.0 + F.col("share") * (top - 1.0))
    lines = grid.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return lines.select("t", "i", "x", keep_probability(F.col("x"), total, F.col("t")).alias("keep_prob"))


def layer_moments(df: DataFrame, layer: str, x: str) -> DataFrame:
    """Mean and population deviation per layer."""
    return df.groupBy(layer).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")
    )


def layer_histogram(
    df: DataFrame, layer: str, x: str, bins: int = 30, low: float = -1.0, high: float = 1.0
) -> DataFrame:
    """Values per bin and layer; values outside are dropped, the last bin includes its right edge."""
    v = F.col(x).cast("double")
    place = F.floor((v - low) * (bins / (high - low))).cast("int")
    inside = df.filter(v.between(low, high)).withColumn("bin", F.least(place, F.lit(bins - 1)))
    return inside.groupBy(layer, "bin").agg(F.count("*").alias("n"))
