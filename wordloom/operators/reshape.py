"""Projection, filters, flattening and one-to-many maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wordloom.functions.text import ASCII_PUNCTUATION
from wordloom.operators.blocks import BLOCK_BYTES, distinct_parts, flat_array, list_parts, ship

ROWS_OUT = 1 << 16  # rows of a batch that a task hands on


def select_key(df: DataFrame, key: str = "text", record_id: str = "record_id") -> DataFrame:
    """Keep the record id and the text column; the scan reads nothing else."""
    return df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(key).alias("text"))


def unnest(df: DataFrame, items: Column, name: str, position: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per item of an array, with the columns in ``keep``.

    A plain explode makes the optimiser filter on the size of the array first, and where
    the array is a long text expression that filter computes it a second time. The outer
    form has no such filter; the row that it makes of an empty array has no position and is
    dropped afterwards. A null item is an item.
    """
    place = position or "_position"
    while position is None and place in {*keep, name}:
        place = "_" + place
    rows = df.select(*keep, F.posexplode_outer(items).alias(place, name)).filter(F.col(place).isNotNull())
    return rows if position else rows.drop(place)


def map_records(
    df: DataFrame, fn: Callable[[Column], Column], key: str = "text", position: str | None = None
) -> DataFrame:
    """Apply a column function to the key.

    A function that yields an array turns one record into many, and a record with an
    empty array disappears. ``position`` names a column for the place within the record.
    """
    mapped = df.withColumn(key, fn(F.col(key)))
    if not isinstance(mapped.schema[key].dataType, T.ArrayType):
        return mapped
    others = [c for c in mapped.columns if c != key]
    flat = _flatten_to_depth_one(F.col(key), mapped.schema[key].dataType)
    return unnest(mapped, flat, key, position, others)


def _flatten_to_depth_one(c: Column, dtype: T.DataType) -> Column:
    while isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.ArrayType):
        # a null among the lists is an item; flatten() would make all of them null
        c, dtype = F.flatten(F.transform(c, lambda x: F.coalesce(x, F.array(F.lit(None))))), dtype.elementType
    return c


def flatten_column(df: DataFrame, name: str) -> DataFrame:
    """Flatten nested arrays to one item per row; a string, bytes or number is one item."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    items = _flatten_to_depth_one(c, dtype) if isinstance(dtype, T.ArrayType) else F.array(c)
    others = [o for o in df.columns if o != name]
    return unnest(df, items, name, "item_no", others)


def drop_rare(counts: DataFrame, above: int = 1) -> DataFrame:
    """Keep words counted more than ``above`` times."""
    return counts.filter(F.col("cnt") > above)


def infrequent(cnt: Column | str, min_freq: int) -> Column:
    return (F.col(cnt) if isinstance(cnt, str) else cnt) < min_freq


def long_enough(ids: Column | str, n: int) -> Column:
    """True where a sequence can hold one window of ``n`` items per side."""
    return F.size(ids) >= 2 * n + 1


def truncate(ids: Column | str, length: int) -> Column:
    """First ``length`` items; zero keeps all."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.slice(c, 1, length) if length > 0 else c


def mask_items(values: Column | str, mask: Column | str) -> Column:
    """Items whose entry in the parallel boolean array is true."""
    v = F.col(values) if isinstance(values, str) else values
    m = F.col(mask) if isinstance(mask, str) else mask
    kept = F.filter(F.arrays_zip(v.alias("value"), m.alias("keep")), lambda z: z["keep"])
    return F.transform(kept, lambda z: z["value"])


def member_ngrams(
    tokens: DataFrame, members: DataFrame, n: int, words: str = "tokens", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """N-grams whose every item is in ``members(word)`` and is no ASCII punctuation.

    The distinct tokens of a batch are looked up once, in the blocks of the members. That marks every
    token, n-grams are cut where ``n`` marks follow each other in a record, and nothing else is ever a row.
    """
    blocks = ship(members.select("word"), F.xxhash64("word"), lambda rows: flat_array(rows["word"], pa.string()), block_bytes)
    others = [f for f in tokens.schema.fields if f.name != words]
    schema = T.StructType([*others, T.StructField("pos", T.IntegerType()), T.StructField("word", T.StringType())])
    out_schema = to_arrow_schema(schema)
    punctuation = pa.array(list(ASCII_PUNCTUATION), pa.string())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.gather(batches):
            flat, offsets = list_parts(batch.column(words))
            distinct, codes = distinct_parts(flat)
            member = np.zeros(len(distinct) + 1, bool)  # the last stands for null
            for listed in blocks.visit():
                member[:-1] |= np.asarray(pc.is_in(distinct, value_set=listed))
            member[:-1] &= ~np.asarray(pc.is_in(distinct, value_set=punctuation))
            mark = member[codes]
            starts = np.flatnonzero(_runs(mark, n))
            record = np.searchsorted(offsets, starts, side="right") - 1
            within = starts + n <= offsets[record + 1]
            starts, record = starts[within], record[within]
            for lo in range(0, len(starts), ROWS_OUT):
                at, row = starts[lo : lo + ROWS_OUT], pa.array(record[lo : lo + ROWS_OUT])
                grams = pc.binary_join_element_wise(*[flat.take(pa.array(at + k)) for k in range(n)], " ")
                pos = pa.array((at - offsets[record[lo : lo + ROWS_OUT]]).astype(np.int32))
                arrays = [*[batch.column(f.name).take(row) for f in others], pos, grams]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out_schema)], schema=out_schema)

    return tokens.mapInArrow(cut, schema)


def _runs(mark: np.ndarray, n: int) -> np.ndarray:
    """Places from which ``n`` marks follow each other."""
    last = max(len(mark) - n + 1, 0)
    out = np.ones(last, bool)
    for k in range(n):
        out &= mark[k : k + last]
    return out
