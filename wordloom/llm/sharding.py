"""Shards of near equal size from atomic groups, by a minimax contiguous partition.

Rows of equal group stay together. Groups are ordered by a 64-bit hash of their key; the
smallest capacity for which a greedy walk over this order needs no more than the wanted shards
is found by binary search, and the walk's cuts are the shard bounds. The sizes are never
brought to one place: the driver holds a histogram of them over the leading bits of the hash,
FAN rows per node, and looks deeper only where a cut falls.

Defined cases: a null text counts as empty; equal rows are separate rows of one group; an empty
table gives no rows; an empty shard is possible if one group outweighs a fair share. Texts
whose 64-bit hashes agree count as one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.common import free_name
from wordloom.session import materialize

SHIFTS = (52, 44, 36, 28, 20, 12, 4, 0)  # bits below the histogram's prefix, level by level
CHUNK_BITS = 16  # rows of one slot count: 2**16


class _Sizes:
    """Running sizes over the hash order, known as finely as was asked for."""

    def __init__(self, groups: DataFrame):
        self.groups, self.nodes = groups, {}
        self.refine([None])
        self.total = sum(size for _, size, _ in self.nodes[None])

    def refine(self, wanted: list[tuple[int, int] | None]) -> None:
        """Split the nodes (level, prefix) with one job per level."""
        by_level: dict[int, list[int]] = {}
        for node in wanted:
            by_level.setdefault(-1 if node is None else node[0], []).append(0 if node is None else node[1])
        for level, prefixes in by_level.items():
            rows, child = self.groups, F.shiftright("key", SHIFTS[level + 1])
            if level >= 0:
                rows = rows.filter(F.shiftright("key", SHIFTS[level]).isin(prefixes))
            found = rows.groupBy(child.alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
            for prefix in prefixes:
                self.nodes[None if level < 0 else (level, prefix)] = sorted(
                    ((level + 1, r.p), r.size, r.n)
                    for r in found
                    if level < 0 or r.p >> (SHIFTS[level] - SHIFTS[level + 1]) == prefix
                )

    def below(self, target: int) -> tuple[int, int | None, tuple[int, int] | None]:
        """The last known boundary at or below ``target``: its size, the hash it lies before
        (none: the end), and the node that hides a nearer one, if any."""
        at, node = 0, None
        while True:
            for child, size, n in self.nodes[node]:
                if at + size > target:
                    break
                at += size
            else:
                return at, None, None
            if child not in self.nodes:
                return at, child[1] << SHIFTS[child[0]], child if n > 1 else None
            node = child

    def walk(self, capacity: int, shards: int, hopeful: bool) -> tuple[bool, list[int], set]:
        """Greedy walk. Cuts are taken at known boundaries, or if ``hopeful`` wherever a hidden one might be."""
        at, cuts, hidden = 0, [], set()
        for _ in range(shards):
            start = at
            at, key, node = self.below(start + capacity)
            if node:
                hidden.add(node)
                at = start + capacity if hopeful else at
            if key is None:
                return True, cuts, hidden
            cuts.append(key)
            if at <= start:
                break
        return False, cuts, hidden


def smallest_capacity(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Capacity and the first hash of every shard but the first. ``groups``: key, size."""
    sizes = _Sizes(groups)
    low = -(-sizes.total // shards) - 1  # too small
    high = sizes.total
    while True:
        wanted: set = set()
        a, b = low, high  # the largest that fails even hopefully
        while b - a > 1:
            mid = (a + b) // 2
            ok, _, hidden = sizes.walk(mid, shards, True)
            a, b = (a, mid) if ok else (mid, b)
        low = a
        a, b = low, high  # the smallest that succeeds with what is known
        while b - a > 1:
            mid = (a + b) // 2
            ok, _, _ = sizes.walk(mid, shards, False)
            a, b = (a, mid) if ok else (mid, b)
        high = b
        if high - low <= 1:
            return high, sizes.walk(high, shards, False)[1]
        for capacity in (low + 1, (low + high) // 2, high):
            for hopeful in (True, False):
                wanted |= sizes.walk(capacity, shards, hopeful)[2]
        sizes.refine(sorted(wanted))


def _slots(rows: DataFrame, shard: Column) -> DataFrame:
    """Number the rows of each shard from 0 in the order of ``seq``: counts of chunks first, so no task sorts a shard."""
    rows = rows.withColumn("shard", shard).withColumn("chunk", F.shiftright("seq", CHUNK_BITS))
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("seq")) - 1
    return rows.withColumn("inside", inside).join(offsets, ["shard", "chunk"]).withColumn("slot", F.col("before") + F.col("inside"))


def shard_texts(docs: DataFrame, shards: int, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with size, text_crc32, law, shard, slot and grown_shard of every row."""
    names = free_name(docs.select(*keep), "key", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        *keep,
        F.xxhash64(whole).alias(names[0]),
        (F.octet_length(whole) + 1).cast("bigint").alias(names[1]),
        F.crc32(whole).alias(names[2]),
    )
    rows = materialize(rows, "shard-sizes")
    if rows.isEmpty():
        cuts: list[int] = []
    else:
        groups = rows.groupBy(F.col(names[0]).alias("key")).agg(F.sum(names[1]).alias("size"))
        _, cuts = smallest_capacity(materialize(groups, "shard-groups"), shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("key") >= F.lit(cut)).cast("int")
    flat = rows.select(
        F.struct(*keep).alias("kept"),
        F.col(names[0]).alias("key"),
        F.col(names[1]).alias("size"),
        F.col(names[2]).alias("crc"),
        F.monotonically_increasing_id().alias("seq"),
    )
    return _slots(flat, shard).select(
        *[F.col("kept")[c].alias(c) for c in keep],
        F.col("size").alias(names[1]),
        F.col("crc").alias(names[2]),
        F.lit("bytes").alias(names[3]),
        F.col("shard").alias(names[4]),
        F.col("slot").alias(names[5]),
        F.lit(None).cast("int").alias(names[6]),
    )
