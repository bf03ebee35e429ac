"""Subword pieces learnt from a word-count table by merging the most frequent pairs of neighbours.

A word is a mark followed by its characters, each a symbol with a number. A merge replaces the most frequent pair of
neighbouring symbols by a new symbol; of equally frequent pairs the one whose newer symbol is older comes first,
then the smaller left, then the smaller right one. The words stay where they are. A round is one job over them: tasks
apply the merges since the words were last written, recount only words that hold one of them, and send differences of
pair counts, which are added to the counts as last written. The driver sees the most frequent pairs only.

Pairs that share no symbol do not touch each other's counts, and a pair made by a merge is no more frequent than the pair it
came from and newer than all in the list. So as long as the pairs of the list share no symbol, they are what merging one at a time
would choose next, and a round takes them all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.blocks import list_column, list_parts
from wordloom.session import materialize

MARK = "▁"
TOP = 64  # pairs that the driver sees a round
ROUNDS = 16  # after which words and pair counts are written anew
MERGES = 8000


def merge_pairs(flat: np.ndarray, offsets: np.ndarray, merges: Sequence[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Apply merges (left, right, new) to the words ``flat[offsets[i]:offsets[i + 1]]`` one after the other:
    the new symbols, their offsets, and which words have changed."""
    changed = np.zeros(len(offsets) - 1, bool)
    for left, right, new in merges:
        at = np.flatnonzero((flat[:-1] == left) & (flat[1:] == right))
        if not len(at):
            continue
        word = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 1 < offsets[word + 1]
        at, word = at[inside], word[inside]
        if left == right and len(at):  # of a run every other place, from its start
            first = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(word) > 0)])
            start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            inside = (np.arange(len(at)) - start) % 2 == 0
            at, word = at[inside], word[inside]
        if not len(at):
            continue
        changed[word] = True
        stays = np.ones(len(flat), bool)
        stays[at + 1] = False
        flat = flat.copy()
        flat[at] = new
        flat = flat[stays]
        offsets = np.concatenate([[0], np.cumsum(stays)])[offsets]
    return flat, offsets, changed


def _pair_counts(flat: np.ndarray, offsets: np.ndarray, counts: np.ndarray, chosen: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours in the chosen words, as left << 32 | right, and how often, times ``sign``."""
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero((owner[:-1] == owner[1:]) & chosen[owner[:-1]])
    return (flat[at].astype(np.int64) << 32) | flat[at + 1], sign * counts[owner[at]]


def _changes(merges: Sequence[tuple[int, int, int]], every: bool):
    """Task function: words (symbols, cnt) to pair counts, or to what ``merges`` change of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, offsets = list_parts(batch.column("symbols"))
            flat, counts = column.to_numpy(zero_copy_only=False), batch.column("cnt").to_numpy()
            if every:
                parts = [_pair_counts(flat, offsets, counts, np.ones(len(counts), bool), 1)]
            else:
                new, ends, changed = merge_pairs(flat, offsets, merges)
                parts = [_pair_counts(flat, offsets, counts, changed, -1), _pair_counts(new, ends, counts, changed, 1)]
            pairs, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, place, np.concatenate([n for _, n in parts]))
            pairs, total = pairs[total != 0], total[total != 0]
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total)], names=["pair", "cnt"])

    return run


@dataclass
class Subwords:
    pieces: list[str]  # text of every symbol; equal texts may come from different merges
    merges: list[tuple[int, int]]  # symbol len(pieces) - len(merges) + i is the i-th pair
    words: DataFrame  # word, symbols, cnt

    def counts(self) -> DataFrame:
        """``(word, cnt)`` of the pieces: what a vocabulary of pieces is made of."""
        rows = self.words.select("cnt", F.explode("symbols").alias("symbol")).groupBy("symbol").agg(F.sum("cnt").alias("cnt"))
        named = rows.select(F.element_at(F.lit(self.pieces), F.col("symbol") + 1).alias("word"), "cnt")
        return named.groupBy("word").agg(F.sum("cnt").cast("bigint").alias("cnt"))

    def split(self) -> DataFrame:
        """``(word, pieces)`` of every word that was learnt from."""
        return self.words.select("word", F.transform("symbols", lambda s: F.element_at(F.lit(self.pieces), s + 1)).alias("pieces"))


def learn_subwords(counts: DataFrame, merges: int = MERGES, at_least: int = 2) -> Subwords:
    """At most ``merges`` merges from ``counts(word, cnt)``, of pairs that occur ``at_least`` so often."""
    spelled = counts.filter(F.length("word") > 0).select("word", F.col("cnt").cast("bigint").alias("cnt"), F.split(F.concat(F.lit(MARK), F.col("word")), "").alias("chars"))
    spelled = materialize(spelled, "spelled")
    pieces = sorted(r.c for r in spelled.select(F.explode("chars").alias("c")).distinct().collect())  # no more than there are characters
    listed = pa.array(pieces, pa.string())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = list_parts(batch.column("chars"))
            ids = pc.index_in(flat, value_set=listed).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("word"), list_column(offsets, ids), batch.column("cnt")], names=["word", "symbols", "cnt"])

    schema = "word string, symbols array<int>, cnt bigint"
    words = materialize(spelled.mapInArrow(number, schema), "symbols")
    pair = "pair bigint, cnt bigint"
    known = materialize(words.select("symbols", "cnt").mapInArrow(_changes((), True), pair).groupBy("pair").agg(F.sum("cnt").alias("cnt")), "pairs")
    chosen: list[tuple[int, int]] = []
    pending: list[tuple[int, int, int]] = []
    rounds = 0
    while len(chosen) < merges:
        now = known
        if pending:
            found = words.select("symbols", "cnt").mapInArrow(_changes(tuple(pending), False), pair)
            now = known.unionByName(found).groupBy("pair").agg(F.sum("cnt").alias("cnt"))
        if rounds == ROUNDS:
            known = materialize(now.filter("cnt > 0"), "pairs")
            words = materialize(words.mapInArrow(_merged(tuple(pending)), schema), "symbols")
            now, pending, rounds = known, [], 0
        left, right = F.shiftright("pair", 32), F.col("pair").bitwiseAND(F.lit(2**32 - 1))
        order = [F.desc("cnt"), F.greatest("l", "r"), F.asc("l"), F.asc("r")]
        top = now.filter(F.col("cnt") >= at_least).withColumn("l", left).withColumn("r", right).orderBy(*order).limit(TOP).collect()
        taken: set[int] = set()
        before = len(chosen)
        for row in top:
            if {row.l, row.r} & taken or len(chosen) == merges:
                break
            taken |= {row.l, row.r}
            chosen.append((row.l, row.r))
            pending.append((row.l, row.r, len(pieces)))
            pieces.append(pieces[row.l] + pieces[row.r])
        if len(chosen) == before:
            break
        rounds += 1
    if pending:
        words = materialize(words.mapInArrow(_merged(tuple(pending)), schema), "symbols")
    return Subwords(pieces, chosen, words)


def _merged(merges: Sequence[tuple[int, int, int]]):
    """Task function: words with the merges applied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, offsets = list_parts(batch.column("symbols"))
            flat, ends, _ = merge_pairs(column.to_numpy(zero_copy_only=False), offsets, merges)
            yield pa.RecordBatch.from_arrays([batch.column("word"), list_column(ends, pa.array(flat, pa.int32())), batch.column("cnt")], names=["word", "symbols", "cnt"])

    return run
