"""Lookups of rows in a table of bounded size, safe against frequent keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_BYTES = 64  # generous size of a lookup row: a word, an id, a weight
HOT_KEYS = 1000


def broadcast_fits(df: DataFrame, rows: int, row_bytes: int = ROW_BYTES) -> bool:
    """Whether a table of at most ``rows`` rows stays below the planner's own threshold."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return rows * row_bytes <= limit


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, rows: int, how: str = "left") -> DataFrame:
    """Join ``df`` with a table of unique keys and at most ``rows`` rows; ``how`` is left, inner, left_semi or left_anti.

    The planner sees the limit behind such a table and broadcasts it while the bound is
    below its threshold. Beyond, :func:`attach` finds the frequent keys, which do not depend on what else is
    in a row: a word that is a third of all rows, and nothing but that word in them, meets a broadcast row.
    """
    on = F.col(key) == F.col(table_key)
    if broadcast_fits(df, rows):
        return df.join(table, on, how) if how != "left" else df.join(table, on, how).drop(table_key)
    found = attach(df, table.withColumn("_found", F.lit(True)), key, table_key)
    if how == "left":
        return found.drop("_found")
    if how == "inner":
        return found.filter("_found").drop("_found")
    wanted = F.col("_found") if how == "left_semi" else F.col("_found").isNull()
    return found.filter(wanted).select(*df.columns)


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """``(_hot, _n)``: rows of each key."""
    return df.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n"))


def attach(df: DataFrame, table: DataFrame, key: str, table_key: str, counts: DataFrame | None = None) -> DataFrame:
    """Left join with a table of unique keys and any size.

    Keys that make up more than one in a thousand rows of ``df`` are fewer than a thousand.
    Their few table rows are broadcast; all other rows take the ordinary join. ``counts`` are those of
    :func:`key_counts` where they are known already.
    """
    counts = key_counts(df, key) if counts is None else counts
    total = counts.agg(F.sum("_n")).scalar()
    hot = counts.filter(F.col("_hot").isNotNull() & (F.col("_n") * HOT_KEYS > total)).limit(HOT_KEYS).select("_hot")
    hot_rows = table.join(F.broadcast(hot), F.col(table_key) == F.col("_hot"), "left_semi")
    marked = df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    # a null key matches nothing; with the hot ones these rows stay where they are
    stays = F.col("_hot").isNotNull() | F.col(key).isNull()
    common, other = marked.filter(stays).drop("_hot"), marked.filter(~stays).drop("_hot")
    on = F.col(key) == F.col(table_key)
    return (
        other.join(table, on, "left")
        .unionByName(common.join(F.broadcast(hot_rows), on, "left"))
        .drop(table_key)
    )


def together(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Records placed by their keys before their items become rows, so that a lookup in at most ``rows`` rows and :func:`regroup` move
    the records once and no item. Where the lookup is a join of its own, the items move anyway and the records stay."""
    if not keys or not broadcast_fits(df, rows):
        return df
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def regroup(rows: DataFrame, keys: Sequence[str], item: Column, pos: str = "pos") -> DataFrame:
    """Back from one row per item to one per record: ``items`` in the order of ``item``'s
    first field. Rows without a position stand for empty records; null items are left out.

    A record gathers what it held before the explode. Two records under one id would mix, so
    their repeated positions are an error.
    """
    grouped = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col(pos).isNotNull(), item))).alias("items"),
        F.max(pos).alias("_last"),
        F.count(pos).alias("_n"),
    )
    failure = F.raise_error(F.lit("records need unique ids to be regrouped")).cast(grouped.schema["items"].dataType)
    whole = F.when(F.col("_last") + 1 != F.col("_n"), failure).otherwise(F.col("items"))
    return grouped.select(*keys, whole.alias("items"))
