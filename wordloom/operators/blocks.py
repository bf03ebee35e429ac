"""Tables of a vocabulary's size for Arrow tasks, shipped in blocks.

A table is cut into ranges of an integer key. Every block is a broadcast of its own, which the driver collects
and lets go before the next, and which a worker loads, uses on all rows it holds and forgets. So a
table needs no bound on its size for the memory of the driver or of a worker: both hold one
block, or two while one replaces the other. Small tables are one block, which stays loaded.
Rows of the corpus never move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import measured_bytes

BLOCK_BYTES = 64 * 1024 * 1024
HELD_BYTES = 32 * 1024 * 1024  # of batches that visit the blocks together, where there are several, and of what is made of them
PIECE_BYTES = 2 * 1024 * 1024  # of a batch that visits the blocks at one time, where there is one block
PRECISION = 1e-3  # of the ranges, as a share of all rows


class Blocks:
    """Shipped ranges of a table; ``visit`` gives one after the other."""

    def __init__(self, handles: Sequence[Broadcast]):
        self.handles = list(handles)

    def __len__(self) -> int:
        return len(self.handles)

    def visit(self) -> Iterator[Any]:
        for handle in self.handles:
            yield handle.value
            if len(self.handles) > 1:  # a handle keeps what it has loaded
                handle.__dict__.pop("_value", None)

    def gather(self, batches: Iterator[pa.RecordBatch], row_bytes: int = 0, together: bool = False) -> Iterator[pa.RecordBatch]:
        """The batches in pieces of about PIECE_BYTES for one block, else or if rows share work ``together`` put together, so that a block is loaded
        once for many rows: for as many as fit into HELD_BYTES with the ``row_bytes`` that a visit carries for each."""
        if len(self.handles) <= 1 and not together:
            for batch in batches:
                rows = max(1, -(-batch.num_rows // max(1, -(-batch.nbytes // PIECE_BYTES))))
                yield from (batch.slice(lo, rows) for lo in range(0, max(batch.num_rows, 1), rows))
            return
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.nbytes + row_bytes * batch.num_rows
            if held and (batch is None or size >= HELD_BYTES):
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0


def ship(
    table: DataFrame, key: Column | str, pack: Callable[[pa.Table], Any], block_bytes: int = BLOCK_BYTES
) -> Blocks:
    """Blocks of about ``block_bytes`` of ``table``, cut by ranges of the integer ``key``.

    ``pack`` makes of the rows of a range, ordered by the key, what the tasks shall see. The driver
    holds one block at a time.
    """
    spark = table.sparkSession
    place = F.col(key) if isinstance(key, str) else key
    keyed = table.withColumn("_key", place.cast("bigint")).persist()
    try:
        n = -(-measured_bytes(keyed) // block_bytes)
        cuts: list[int] = []
        if n > 1:
            shares = [i / n for i in range(1, n)]
            cuts = sorted({int(x) for x in keyed.approxQuantile("_key", shares, PRECISION / n)})
        handles = []
        for low, high in zip([None, *cuts], [*cuts, None]):
            part = keyed
            if low is not None:
                part = part.filter(F.col("_key") >= low)
            if high is not None:
                part = part.filter(F.col("_key") < high)
            found = part.orderBy("_key").drop("_key").toArrow()
            handles.append(spark.sparkContext.broadcast(pack(found)))
        return Blocks(handles)
    finally:
        keyed.unpersist()


def list_parts(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flat values and zero-based offsets of a list column, whatever slice it is."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return column.flatten(), np.concatenate([[0], np.cumsum(lengths)])


def list_column(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def distinct_parts(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values, and for each value its place among them; one beyond the last for null."""
    coded = flat.dictionary_encode()
    return coded.dictionary, pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)


def places(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the ids ``wanted`` those that are in the sorted ``known``, as a mask, and their places there."""
    if not len(known):
        return np.zeros(len(wanted), bool), np.zeros(0, np.int64)
    if known[-1] - known[0] + 1 == len(known):
        inside = (wanted >= known[0]) & (wanted <= known[-1])
        return inside, wanted[inside] - known[0]
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    inside = known[at] == wanted
    return inside, at[inside]


def flat_array(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    """One array of a table's column."""
    whole = column.combine_chunks()
    return (pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) and whole.num_chunks else whole).cast(kind)


def vector_rows(table: pa.Table, column: str = "vector") -> np.ndarray:
    """The lists of a column as the rows of a matrix."""
    lists = table[column].combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), np.float32)
