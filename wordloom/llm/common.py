"""Helpers that several operators share: batches of bounded size, hashes of words and shingles,
connected components."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import bounded_batches as bounded_batches
from wordloom.session import materialize

SLICE = 512 * 1024  # bytes of text whose per-byte arrays exist at one time

# fixed values: the increment and the two multipliers of the splitmix64 generator, and an odd base
GAMMA = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
BASE = 0x5851F42D4C957F2D

SPACE = re.compile(rb"[\x20\x09-\x0D]")


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    """64 bits of a text, null for none."""
    return F.when(text.isNotNull(), F.xxhash64(text))


# -- hashes ----------------------------------------------------------------------------


def splitmix(x: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits of each 64 bits; one to one."""
    x = x.astype(np.uint64) + np.uint64(GAMMA)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Polynomial hashes of byte ranges modulo 2**64, from running sums.

    The sum over bytes i of value(byte) * BASE**i, cut to a range and divided by BASE**start,
    depends on the content of the range only. ``seed`` gives independent functions.
    """

    def __init__(self, seed: int = 0):
        self.value = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * seed + 1))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) > n:
            return
        base = np.full(n + 1, BASE, np.uint64)
        inverse = np.full(n + 1, pow(BASE, -1, 2**64), np.uint64)
        base[0] = inverse[0] = 1
        self.up, self.down = np.multiply.accumulate(base), np.multiply.accumulate(inverse)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums: one more than there are bytes."""
        n = len(data)
        self._powers(n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:n], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all windows of ``width`` bytes, in order."""
        n = len(sums) - width
        return (sums[width:] - sums[:n]) * self.down[:n]


def _pieces(data: bytes):
    """(start, end) of slices of about SLICE bytes that end at white space."""
    lo = 0
    while lo < len(data):
        hi = min(lo + SLICE, len(data))
        if hi < len(data):
            found = SPACE.search(data, hi)
            hi = found.end() if found else len(data)
        yield lo, hi
        lo = hi


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(data: bytes, roll: RollingHash) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word, a run of bytes other than white space."""
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, hi in _pieces(data):
        part = np.frombuffer(data, np.uint8, hi - lo, lo)
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~IS_SPACE[part]
        turn = np.diff(inside)
        start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        hashes.append(splitmix(roll.ranges(roll.sums(part), start, end) + (end - start).astype(np.uint64)))
        starts.append(start + lo)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[bytes], size: int, roll: RollingHash) -> list[np.ndarray]:
    """The sorted distinct hashes of the word shingles of each text.

    A text with fewer than ``size`` words but at least one has one shingle, all its words; a
    text without words has none.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= SLICE:
            out += _shingle_group(group, size, roll)
            group, held = [], 0
    return out + (_shingle_group(group, size, roll) if group else [])


def _shingle_group(texts: list[bytes], size: int, roll: RollingHash) -> list[np.ndarray]:
    start, word = word_hashes(b"\n".join(texts), roll)
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(start, ends)  # words before the end of each text
    first = np.concatenate([[0], last[:-1]])
    n = len(word) - size + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(BASE) + word[k : k + len(rolled)]
    rolled = splitmix(rolled)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in word[a:b]:
                whole = splitmix(whole * np.uint64(3) + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# -- connected components --------------------------------------------------------------


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): each node of ``edges`` (columns u, v) with the least node it is connected to.

    Alternates large-star and small-star steps, each an aggregation with partial sums and a join
    that Spark may split where a node is a hub; every round is a table in the shared folder, so
    a lost executor costs tasks of one round. Nodes without an edge to another are left out;
    null nodes are ignored.
    """
    a, b = F.greatest("u", "v"), F.least("u", "v")
    now = edges.dropna(subset=["u", "v"]).filter("u <> v").select(a.alias("u"), b.alias("v")).distinct()
    now, mark = materialize(now, label), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(nearest.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, label)
        total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(total) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = tuple(total)
