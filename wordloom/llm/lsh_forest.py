"""N-gram Jaccard join with a MinHash LSH forest.

A text is the set of its word shingles. Texts with equal sets are one class and compared
once. Each class has a signature per tree, and a tree holds it in the sorted order of prefixes.
Classes that share a prefix are candidates. The prefixes are shortened from the full depth, one
hash at a time, until a pair at the threshold shares one in some tree with the target recall;
exact Jaccard similarity of the shingle sets then decides. Candidates are connected into clusters
first, and the sets of a cluster, or of two blocks of a large one, are compared within one task,
so each set travels once per block and no pair is ever a row, unless all links are asked for.

Defined cases: texts that are null or without words are in no pair and are classes of their own;
equal rows are members of one class; null ids are members as well, and a class's id is its
least id that is not null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import BASE, RollingHash, bounded_batches, components, free_name, shingle_sets, splitmix
from wordloom.session import materialize

TREES = 24
DEPTH = 8
RECALL = 0.9999
BLOCK_ROWS = 2048  # classes of a block, about
BLOCK_SHINGLES = 4 << 20  # and their shingles
OUT = 1 << 14  # rows of a batch that a task hands on
PIECE = 1 << 11  # shingles whose hashes of all seeds exist at one time


def depth_for(threshold: float, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree as often as asked."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def identity(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(splitmix(shingles).sum().view(np.int64)), int(splitmix(shingles ^ np.uint64(BASE)).sum().view(np.int64))


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least of each seed's hashes over a set, set by set in bounded pieces."""
    out = np.full(len(seeds), np.uint64(2**64 - 1))
    for lo in range(0, len(shingles), PIECE):
        out = np.minimum(out, splitmix(shingles[lo : lo + PIECE, None] ^ seeds).min(axis=0))
    return out


def classes(docs: DataFrame, size: int, depth: int, key: list[str], text: str) -> DataFrame:
    """Rows of ``key`` with a set's identity (s1, s2; null without words), its size n and its prefixes' hashes, one per tree."""
    bounded_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*key).schema)
    with np.errstate(over="ignore"):
        seeds = splitmix(np.arange(1, TREES * depth + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash()
        for batch in batches:
            sets = shingle_sets([(t.as_py() or "").encode() for t in batch.column(len(key))], size, roll)
            s1, s2, trees = [], [], []
            for one in sets:
                if not len(one):
                    s1.append(None), s2.append(None), trees.append(None)
                    continue
                for into, x in zip((s1, s2), identity(one)):
                    into.append(x)
                marks = signature(one, seeds).reshape(TREES, depth)
                prefix = np.arange(TREES, dtype=np.uint64)
                for i in range(depth):
                    prefix = splitmix(prefix * np.uint64(BASE) + marks[:, i])
                trees.append(prefix.view(np.int64))
            columns = [batch.column(i) for i in range(len(key))]
            columns += [pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(trees, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*key, "s1", "s2", "n", "trees"])

    return docs.select(*key, text).mapInArrow(run, f"{schema}, s1 bigint, s2 bigint, n bigint, trees array<bigint>")


def _meet(nodes: np.ndarray, block: np.ndarray, trees: np.ndarray, sets: list[np.ndarray], threshold: float, across: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Links among the sets: a place, the later places it is linked to and their similarities;
    ``across``: only those between different blocks."""
    sizes = np.array([len(s) for s in sets])
    names, where = np.unique(np.concatenate(sets), return_inverse=True)
    items = np.split(where, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(names), bool)
    for a in range(len(nodes) - 1):
        rest = slice(a + 1, None)
        fits = np.minimum(sizes[rest], sizes[a]) >= threshold * np.maximum(sizes[rest], sizes[a])
        if across:
            fits &= block[rest] != block[a]
        at = a + 1 + np.flatnonzero(fits)
        at = at[(trees[at] == trees[a]).any(axis=1)]
        if len(at):
            mark[items[a]] = True
            common = np.array([np.count_nonzero(mark[items[b]]) for b in at])
            mark[items[a]] = False
            jaccard = common / (sizes[at] + sizes[a] - common)
            near = jaccard >= threshold
            if near.any():
                yield a, at[near], jaccard[near]


def _connected(nodes: np.ndarray, met: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple]:
    """Each linked node, the least node that links here connect it to, and its number of links here."""
    label, degree = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
    for a, at, _ in met:
        degree[a] += len(at)
        degree[at] += 1
        for old in np.unique(label[at]):
            if old != label[a]:
                label[label == old] = label[a]
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    for a in np.flatnonzero(degree):
        yield nodes[a], least[label[a]], None, degree[a]


def _links(placed: DataFrame, threshold: float, every: bool) -> DataFrame:
    """Verify what meets in the groups (root, i, j) of ``placed``, one group in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def settle() -> None:
            one = {row[0]: row for row in held}  # a node once
            if len(one) > 1:
                nodes, block, trees, sets, cuts = zip(*one.values())
                cut = cuts[0] > 1
                nodes = np.array(nodes)
                met = _meet(nodes, np.array(block), np.stack(trees), list(sets), threshold, now[1] < now[2])
                if every:
                    out.extend((nodes[a], nodes[b], x, None, cut) for a, at, jaccard in met for b, x in zip(at, jaccard))
                else:
                    out.extend((*row, cut) for row in _connected(nodes, met))
            held.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[], [], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["u", "v", "jaccard", "links", "cut"])
            out.clear()
            return batch

        now = None
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
            nodes, block, blocks = (batch.column(c).to_pylist() for c in (3, 4, 7))
            for i, key in enumerate(keys):
                if key != now:
                    settle()
                    now = key
                    if len(out) >= OUT:
                        yield flush()
                # copies, lest a row keep its whole batch
                trees, items = (batch.column(c)[i].values.to_numpy().copy() for c in (5, 6))
                held.append((nodes[i], block[i], trees, items, blocks[i]))
        settle()
        yield flush()

    groups = placed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return groups.select("root", "i", "j", "node", "block", "trees", "set", "blocks").mapInArrow(run, "u bigint, v bigint, jaccard double, links bigint, cut boolean")


def _clusters(leaves: DataFrame, threshold: float) -> DataFrame:
    """(node, root): nodes that share a leaf and might be similar by their sizes have one root.

    Sizes fall into classes so wide that those of a similar pair lie in one or in two neighbouring
    ones; a node is tied to the least of its leaf and class, and this to the least of the next class.
    """
    wide = 1.0001 * -np.log(threshold)
    rows = leaves.withColumn("size", F.floor(F.log("n") / wide))
    least = rows.groupBy("leaf", "size").agg(F.min("node").alias("m"))
    own = rows.join(least, ["leaf", "size"]).select(F.col("node").alias("u"), F.col("m").alias("v"))
    above = least.select("leaf", (F.col("size") - 1).alias("size"), F.col("m").alias("u"))
    return components(own.union(least.join(above, ["leaf", "size"]).select("u", F.col("m").alias("v"))), "clusters")


def similar(docs: DataFrame, threshold: float = 0.8, size: int = 5, doc_id: str = "doc_id", text: str = "text", every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, s1, s2, node) and, for classes' nodes, rows (u, v, jaccard, links, cut).

    With ``every`` these are all links u, v. Otherwise v is the least node that u is connected to
    and ``links`` its number of links; of a cluster that was ``cut`` into blocks each row tells
    of two blocks, and they are still to be added up and connected. A group of many near copies
    then costs comparisons, but no row for each of its pairs.
    """
    spark = docs.sparkSession
    depth = depth_for(threshold)
    rows = materialize(classes(docs, size, depth, [doc_id], text), "signatures")
    # equal sets have equal signatures, so any row of a class will do
    ids = F.coalesce(F.col(doc_id), F.lit(2**63 - 1))
    reps = rows.filter("s1 is not null").groupBy("s1", "s2").agg(F.first("n").alias("n"), F.first("trees").alias("trees"), F.min(ids).alias("d"))
    reps = materialize(reps.select(F.xxhash64("s1", "s2").alias("node"), "s1", "s2", "n", "trees", "d"), "classes")
    leaves = reps.select("node", "n", F.explode("trees").alias("leaf"))
    shared = leaves.groupBy("leaf").agg(F.count("*").alias("many")).filter("many > 1").select("leaf")
    leaves = materialize(leaves.join(shared, "leaf"), "leaves")
    roots = materialize(_clusters(leaves, threshold).join(reps, "node"), "clustered")
    # a large cluster is cut into blocks, of which every two meet in a task of their own
    need = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    chosen = roots.join(roots.groupBy("root").agg(need.alias("blocks")), "root")
    bounded_batches(spark)

    @F.pandas_udf("s1 bigint, s2 bigint, set array<bigint>")
    def shingles(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        roll = RollingHash()
        for texts in parts:
            sets = shingle_sets([(t or "").encode() for t in texts], size, roll)
            yield pd.DataFrame({"s1": [identity(s)[0] for s in sets], "s2": [identity(s)[1] for s in sets], "set": [s.view(np.int64) for s in sets]})

    # else the filter on what it finds goes below the join, where every text would be cut into shingles for it and those that stay again
    shingles = shingles.asNondeterministic()
    whole = docs.select(ids.alias("d"), F.col(text).alias("text"))
    sets = whole.join(chosen, "d").withColumn("found", shingles("text"))
    # an id may belong to several texts
    sets = sets.filter((F.col("found")["s1"] == F.col("s1")) & (F.col("found")["s2"] == F.col("s2"))).dropDuplicates(["node"])
    block = F.pmod(F.xxhash64("node", "root"), F.col("blocks")).cast("int")
    placed = sets.select("root", "node", "blocks", block.alias("block"), "trees", F.col("found")["set"].alias("set"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = materialize(_links(placed, threshold, every), "links")
    members = rows.select(doc_id, "s1", "s2", F.when(F.col("s1").isNotNull(), F.xxhash64("s1", "s2")).alias("node"))
    return members, found


def similar_pairs(docs: DataFrame, threshold: float = 0.8, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, s1, s2, node) and all links (u, v, jaccard) between classes' nodes, u < v."""
    members, found = similar(docs, threshold, size, doc_id, text, every=True)
    return members, found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "jaccard")


def groups(docs: DataFrame, threshold: float = 0.8, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (least id of the texts with the same shingles), group_id (least id of those
    connected by links), n_links (links of its class to other classes), one row per document."""
    members, found = similar(docs, threshold, size, doc_id, text)
    degree = found.groupBy(F.col("u").alias("x")).agg(F.sum("links").alias("n_links")).filter("n_links > 0")
    roots = found.filter(~F.col("cut")).select(F.col("u").alias("x"), F.col("v").alias("root"))
    cut = found.filter("cut").select("u", "v")
    if not cut.isEmpty():
        roots = roots.union(components(cut, "near-groups"))
    per = members.filter("node is not null").groupBy("node").agg(F.min(doc_id).alias("class_id"))
    per = per.join(degree, per["node"] == degree["x"], "left").drop("x")
    per = per.join(roots, per["node"] == roots["x"], "left").drop("x").withColumn("root", F.coalesce("root", "node"))
    least = per.groupBy("root").agg(F.min("class_id").alias("group_id"))
    per = per.join(least, "root").drop("root")
    per = materialize(per, "classes-linked")
    own = F.coalesce("class_id", F.col(doc_id))
    return members.select(doc_id, "node").join(per, "node", "left").select(
        doc_id, own.alias("class_id"), F.coalesce("group_id", own).alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )


def one_per_group(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; rows without words all stay."""
    (row,) = free_name(docs, "row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    kept = groups(rows, threshold, size, doc_id=row).filter(F.col(row) == F.col("group_id")).select(row)
    return rows.join(kept, row, "left_semi").select(*docs.columns)
