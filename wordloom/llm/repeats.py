"""Remove repeated byte strings across documents, by sorting what may repeat.

Only positions that can start a repeated string of ``length`` bytes are ever sorted. Of every such string the least hash of its
short pieces is its anchor. Equal strings have equal anchors, so an anchor found once in the corpus rules its strings out; a sort of the
anchors tells. Neighbouring strings with one anchor form a run. A second sort brings equal runs together: of those the
first stays and the others are later starts as a whole. What is left are different runs with one anchor, which may share
some of their strings. Their bytes meet by anchor and are compared string by string within a task; where an anchor has
more than ``BLOCK`` different runs, the pairs of hashes of each string's halves are sorted instead, over all tasks.

Sorts are by range and include the place, so a frequent anchor or string spreads over tasks. Where a group may go on in the next
task, it is taken for a repeated one, which costs a comparison and no error, or settled from the one row at each edge.

Equal texts take part once: every string of a later copy also starts in the first one. Suspected texts are written once, in buckets by
their keys, and are joined there with what is found about them without being moved again.

Defined cases: a null text counts as empty; texts shorter than ``length`` stay whole; null ids
come after all others; rows with equal ids follow the hash of their texts; equal rows are
copies of each other, of which one is the first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import RollingHash, bounded_batches, splitmix
from wordloom.operators.joins import attach
from wordloom.session import discard, local_table, materialize, shared_dir

LAST = 2**63 - 1  # stands for a null id
PIECE = 1 << 20  # positions whose hashes exist at one time
OUT = 1 << 17  # rows of a batch that a task hands on
OUT_BYTES = 1 << 23  # or bytes
BLOCK = 4096  # different runs of one anchor that are compared within a task
KEYS = ["k", "k2", "d"]


def piece_of(length: int) -> int:
    """Bytes of the pieces whose hashes are anchors."""
    return max(1, length * 32 // 100)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over all runs of ``width`` values, by doubling."""
    n, have, out = len(values) - width + 1, 1, values
    while 2 * have <= width:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    return pick(out[:n], out[width - have : width - have + n])


def _hashed(data: bytes, length: int, roll: RollingHash) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of the pieces, in parts that share what a string of full length needs: (first position, hashes)."""
    for lo in range(0, max(len(data) - length + 1, 0), PIECE):
        part = np.frombuffer(data, np.uint8, min(PIECE + length - 1, len(data) - lo), lo)
        yield lo, splitmix(roll.windows(roll.sums(part), piece_of(length)))


def anchors(data: bytes, length: int, roll: RollingHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a text's anchors, and at how many places each lies (2 for more)."""
    where, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    span = length - piece_of(length) + 1
    for lo, hashes in _hashed(data, length, roll):
        least = _slide(hashes, span, np.minimum)
        wide = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
        at = np.flatnonzero(_slide(wide, span, np.maximum) == hashes)
        where.append(at + lo)
        found.append(hashes[at])
    where, first = np.unique(np.concatenate(where), return_index=True)  # parts overlap
    values, counts = np.unique(np.concatenate(found)[first], return_counts=True)
    return values, np.minimum(counts, 2)


def _write(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(columns[0]), OUT):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + OUT]) for c in columns], names=names)


def _removed(pos: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by strings that start at ``many`` places in a row from each ``pos``."""
    order = np.argsort(pos, kind="stable")
    begin, end = pos[order].astype(np.int64), np.maximum.accumulate((pos.astype(np.int64) + many + length - 1)[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.concatenate([new[1:], [True]])]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, k, n) sorted by h and k, each (h, k) once where h has another k or an n above 1, or is at an edge of the task."""
    carry: list[np.ndarray] | None = None  # the group that the last batch ended in: its first row, and whether it is wanted and told
    wanted = True  # the first group of the task
    told = False
    for batch in batches:
        h, k, n = (batch.column(i).to_numpy() for i in range(3))
        if not len(h):
            continue
        before = carry if carry is not None else [np.array([h[0]]), np.array([k[0] ^ 1])]
        new_h = np.concatenate([before[0], h])[1:] != np.concatenate([before[0], h])[:-1]
        other = new_h | (np.concatenate([before[1], k])[1:] != np.concatenate([before[1], k])[:-1])
        group = np.cumsum(new_h)
        many = np.bincount(group[other], minlength=group[-1] + 1)
        again = np.bincount(group, weights=n > 1, minlength=group[-1] + 1) > 0
        if carry is not None:
            many[0] += 1  # the row before
        good = (many > 1) | again
        good[0] |= wanted
        keep = other & good[group]
        out_h, out_k = h[keep], k[keep]
        if carry is not None and not told and good[0]:  # the held row
            out_h, out_k = np.concatenate([before[0], out_h]), np.concatenate([before[1], out_k])
        # the last group goes on: its one row is held if nothing is known yet
        if group[-1]:
            wanted = told = bool(good[-1])
        else:
            wanted, told = bool(good[0]), bool(good[0])
        carry = [h[-1:], k[-1:]]
        yield from _write([out_h, out_k], ["h", "k"])
    if carry is not None and not told:
        yield from _write(carry, ["h", "k"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs (h, r, many, t, pos, twice) sorted so: later copies, and the first of each kind where their anchor has
    several kinds or lies twice in a run, or is at an edge of the task. Rows (t, pos, many, h, copy)."""
    last: tuple | None = None  # h, r, many of the row before
    shared, told, held = True, True, None  # of the group that goes on; the first group of the task is shared
    names = ["t", "pos", "many", "h", "copy"]
    for batch in batches:
        h, r, many, t, pos, twice = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        m = len(h)
        if not m:
            continue
        new_h, kind = np.ones(m, bool), np.ones(m, bool)
        new_h[1:] = h[1:] != h[:-1]
        kind[1:] = new_h[1:] | (r[1:] != r[:-1]) | (many[1:] != many[:-1])
        if last is not None:
            new_h[0] = h[0] != last[0]
            kind[0] = (h[0], r[0], many[0]) != last
        else:
            new_h[0] = False
        group = np.cumsum(new_h)
        kinds = np.bincount(group[kind], minlength=group[-1] + 1)
        if last is not None:
            kinds[0] += 1
        good = (kinds > 1) | (np.bincount(group, weights=twice, minlength=group[-1] + 1) > 0)
        good[0] |= shared
        part = kind & good[group]
        keep = part | ~kind
        columns = [t[keep], pos[keep], many[keep], h[keep], ~kind[keep]]
        if held is not None and (good[0] or not group[-1]):
            if good[0]:
                columns = [np.concatenate([[x], c]) for x, c in zip(held, columns)]
                held = None
        elif held is not None:
            held = None  # its group has ended with one kind
        if group[-1]:
            shared = bool(good[-1])
            if not shared:
                at = int(np.flatnonzero(new_h)[-1])
                held = (t[at], pos[at], many[at], h[at], False)
        else:
            shared = bool(good[0])
        last = (h[-1], r[-1], many[-1])
        yield from _write([np.asarray(c, x.dtype) for c, x in zip(columns, (t, pos, many, h, kind))], names)
    if held is not None:  # the last group may go on in the next task
        yield from _write([np.array([x], kind) for x, kind in zip(held, (np.int64, np.int32, np.int32, np.int64, bool))], names)


def _strings(data: bytes, length: int, roll: RollingHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the two halves of every string of ``length`` bytes."""
    half = (length + 1) // 2
    hashes = splitmix(roll.windows(roll.sums(np.frombuffer(data, np.uint8)), half)).view(np.int64)
    n = len(data) - length + 1
    return hashes[:n], hashes[length - half : length - half + n]


def _together(later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring later strings: first places and how many."""
    turn = np.diff(np.concatenate([[0], later.astype(np.int8), [0]]))
    begin = np.flatnonzero(turn == 1)
    return begin, np.flatnonzero(turn == -1) - begin


def _compare(length: int):
    """Task function: runs (h, t, pos, bytes) sorted by h, t and pos to their later strings (t, pos, many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash()
        held: list[tuple] = []
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle() -> None:
            a, b = zip(*[_strings(data, length, roll) for _, _, data in held])
            ends = np.cumsum([0, *[len(x) for x in a]])
            a, b = np.concatenate(a), np.concatenate(b)
            order = np.lexsort((np.arange(len(a)), b, a))
            same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
            later = np.zeros(len(a), bool)
            later[order[1:][same]] = True
            for (t, pos, _), lo, hi in zip(held, ends[:-1], ends[1:]):
                begin, many = _together(later[lo:hi])
                if len(begin):
                    out.append((np.full(len(begin), t), begin + pos, many))

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                t, pos, many = (np.concatenate(x) for x in zip(*out))
                out.clear()
                yield from _write([t.astype(np.int64), pos.astype(np.int32), many.astype(np.int32)], ["t", "pos", "many"])

        now = None
        for batch in batches:
            for h, t, pos, data in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if h != now:
                    if len(held):
                        settle()
                    held.clear()
                    now = h
                held.append((t, pos, data))
            if len(out) > OUT // 64:
                yield from flush()
        if held:
            settle()
        yield from flush()

    return run


def _not_first(ranked: DataFrame) -> DataFrame:
    """Of the strings (a, b, t, pos) those that are not the first of their pair (a, b): (t, pos, many)."""
    names = ["t", "pos", "part", "edge", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, part = None, None, None
        for batch in batches:
            a, b, t, pos, parts = (batch.column(i).to_numpy() for i in range(5))
            if not len(a):
                continue
            same = np.zeros(len(a), bool)
            same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            if last is None:
                first, part = (int(t[0]), int(pos[0]), int(a[0]), int(b[0])), int(parts[0])
            else:
                same[0] = (int(a[0]), int(b[0])) == last
            last = (int(a[-1]), int(b[-1]))
            n = int(same.sum())
            if n:
                zero = np.zeros(n, np.int64)
                yield from _write([t[same], pos[same], np.full(n, part, np.int32), np.zeros(n, np.int32), zero, zero], names)
        if last is not None:  # the first row, and the last row's pair
            edges = [[first[0], 0], [first[1], 0], [part, part], [1, 2], [first[2], last[0]], [first[3], last[1]]]
            kinds = (np.int64, np.int32, np.int32, np.int32, np.int64, np.int64)
            yield from _write([np.array(c, k) for c, k in zip(edges, kinds)], names)

    ordered = ranked.repartitionByRange("a", "b", "t", "pos").sortWithinPartitions("a", "b", "t", "pos")
    ordered = ordered.select("a", "b", "t", "pos", F.spark_partition_id().alias("part"))
    found = materialize(ordered.mapInArrow(run, "t bigint, pos int, part int, edge int, a bigint, b bigint"), "later-strings")
    edges = found.filter("edge > 0").orderBy("part", "edge").collect()  # two rows per task
    more, end = [], None
    for row in edges:
        if row.edge == 1 and (row.a, row.b) == end:
            more.append((row.t, row.pos))
        if row.edge == 2:
            end = (row.a, row.b)
    rest = local_table(ranked.sparkSession, more, "t bigint, pos int")
    return found.filter("edge = 0").select("t", "pos").union(rest).withColumn("many", F.lit(1))


# -- over the documents ----------------------------------------------------------------


def _keys(doc_id: str, text: str) -> tuple[Column, Column, Column, Column]:
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST)), F.xxhash64(whole), F.xxhash64(F.lit(100), whole), whole


def _numbered(long: DataFrame) -> DataFrame:
    """(t, d, k, k2): distinct texts at their first documents, numbered in the order of these."""
    first = long.groupBy("k", "k2").agg(F.min("d").alias("d"))
    ordered = first.repartitionByRange("d", "k", "k2").sortWithinPartitions("d", "k", "k2")
    return materialize(ordered.select(F.monotonically_increasing_id().alias("t"), *KEYS), "first-texts")


def _bucketed(texts: DataFrame) -> tuple[DataFrame, str]:
    """``texts`` as a table in buckets by KEYS; joins on them then move the other side only."""
    spark = texts.sparkSession
    name = f"wordloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_dir(spark, "suspects")
    texts.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, *KEYS).saveAsTable(name)
    found = spark.table(name)
    found.materialized_at = path
    return found, name


def cut_texts(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What is left of each distinct text at its first document: d, k, k2, n_bytes, n_removed, n_spans, kept (binary).

    Only texts that lose bytes have a row.
    """
    bounded_batches(docs.sparkSession)
    d, k, k2, whole = _keys(doc_id, text)
    span = length - piece_of(length) + 1
    long = docs.filter(F.octet_length(text) >= length).select(d.alias("d"), k.alias("k"), k2.alias("k2"), whole.alias("text"))
    first = _numbered(long.select(*KEYS))

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            held: list[list[np.ndarray]] = [[], [], []]
            for i, value in enumerate(batch.column(1)):
                values, counts = anchors(value.as_py().encode(), length, roll)
                for into, x in zip(held, (values.view(np.int64), np.full(len(values), keys[i]), counts.astype(np.int8))):
                    into.append(x)
            if held[0]:
                yield from _write([np.concatenate(x) for x in held], ["h", "k", "n"])

    found = materialize(long.select("k", "text").mapInArrow(list_anchors, "h bigint, k bigint, n tinyint"), "anchors")
    again = found.repartitionByRange("h", "k").sortWithinPartitions("h", "k").mapInArrow(_repeated, "h bigint, k bigint")
    wanted = materialize(again.groupBy("k").agg(F.collect_set("h").alias("hashes")), "wanted")  # a text's own anchors: no more than its length
    discard(found)

    # copies of the first row of a text, and equal rows, are one
    named = first.join(wanted, "k")
    texts, table = _bucketed(long.join(named, KEYS).dropDuplicates(KEYS).select(*KEYS, "t", "text", "hashes"))

    def list_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, other = RollingHash(), RollingHash(1)
        for batch in batches:
            for t, value, wanted in zip(*[batch.column(i) for i in range(3)]):
                keys, data = np.sort(wanted.values.to_numpy().view(np.uint64)), value.as_py().encode()
                for lo, hashes in _hashed(data, length, roll):
                    least = _slide(hashes, span, np.minimum)
                    begin = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
                    many = np.diff(np.concatenate([begin, [len(least)]]))
                    at = keys[np.minimum(np.searchsorted(keys, least[begin]), len(keys) - 1)] == least[begin]
                    begin, many = begin[at], many[at]
                    # a run that holds its anchor twice may repeat a string of its own
                    near = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    held = np.flatnonzero(keys[near] == hashes)
                    held = np.sort((near[held] << 32) + held)
                    own = np.searchsorted(keys, least[begin]) << 32
                    twice = np.searchsorted(held, own + begin + many - 1 + span) - np.searchsorted(held, own + begin) > 1
                    sums = other.sums(np.frombuffer(data, np.uint8, len(hashes) + piece_of(length) - 1, lo))
                    run = splitmix(other.ranges(sums, begin, begin + many - 1 + length))
                    columns = [least[begin].view(np.int64), run.view(np.int64), many.astype(np.int32)]
                    columns += [np.full(len(begin), t.as_py(), np.int64), (begin + lo).astype(np.int32), twice]
                    yield from _write(columns, ["h", "r", "many", "t", "pos", "twice"])

    order = ["h", "r", "many", "t", "pos"]
    runs = materialize(texts.select("t", "text", "hashes").mapInArrow(list_runs, "h bigint, r bigint, many int, t bigint, pos int, twice boolean"), "runs")
    settled = runs.repartitionByRange(*order).sortWithinPartitions(*order)
    settled = materialize(settled.mapInArrow(_settled, "t bigint, pos int, many int, h bigint, copy boolean"), "settled-runs")
    discard(runs)

    parts = settled.filter("not copy").select("t", "pos", "many", "h")
    large = materialize(parts.groupBy("h").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > BLOCK).select(F.col("h").alias("large")), "large-anchors")
    parts = attach(parts.withColumn("hh", F.col("h")), large.withColumn("wide", F.lit(True)), "hh", "large").drop("hh")
    run = F.struct("pos", "many", "h", F.coalesce("wide", F.lit(False)).alias("wide"))
    listed = parts.groupBy("t").agg(F.collect_list(run).alias("parts"))  # no more than the text's length

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash()
        names, types = ["h", "t", "pos", "data", "a", "b"], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            rows, size = [], 0
            for t, value, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = value.as_py().encode()
                for one in listed:
                    pos, bytes_ = one["pos"], data[one["pos"] : one["pos"] + one["many"] + length - 1]
                    if not one["wide"]:
                        rows.append((one["h"], t, pos, bytes_, None, None))
                        size += len(bytes_)
                        if len(rows) >= OUT or size >= OUT_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)
                            rows, size = [], 0
                        continue
                    a, b = _strings(bytes_, length, roll)
                    n = len(a)
                    columns = [pa.nulls(n, pa.int64()), pa.array(np.full(n, t, np.int64)), pa.array((pos + np.arange(n)).astype(np.int32)), pa.nulls(n, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(a), pa.array(b)], names=names)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)

    def with_text(per_text: DataFrame) -> DataFrame:
        return texts.select(*KEYS, "text").join(per_text.join(first, "t"), KEYS)

    rest = with_text(listed).select("t", "text", "parts").mapInArrow(pieces, "h bigint, t bigint, pos int, data binary, a bigint, b bigint")
    rest = materialize(rest, "different-runs")
    near = rest.filter("data is not null").select("h", "t", "pos", "data").repartition("h").sortWithinPartitions("h", "t", "pos")
    later = near.mapInArrow(_compare(length), "t bigint, pos int, many int")
    later = later.union(settled.filter("copy").select("t", "pos", "many"))
    if not large.isEmpty():
        later = later.union(_not_first(rest.filter("data is null").select("a", "b", "t", "pos")))
    starts = later.groupBy("t").agg(F.collect_list(F.struct("pos", "many")).alias("starts"))  # no more than the text's length
    names = [*KEYS, "n_bytes", "n_removed", "n_spans", "kept"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, places in zip(batch.column(3), batch.column(4)):
                data = value.as_py().encode()
                begin, end = _removed(places.values.field(0).to_numpy(), places.values.field(1).to_numpy(), length)
                edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(data)]
                out.append((len(data), int((end - begin).sum()), len(begin), b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))))
            cols = list(zip(*out)) if out else [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=names)

    schema = "k bigint, k2 bigint, d bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    found = with_text(starts).select(*KEYS, "text", "starts").mapInArrow(cut, schema)
    found = materialize(found, "cut-texts")
    docs.sparkSession.sql(f"DROP TABLE {table}")
    discard(rest, settled, wanted, large, texts)
    return found


def digest(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the sha256 of the remaining bytes, for every row."""
    cut = cut_texts(docs, length).withColumn("kept", F.sha2("kept", 256))
    d, k, k2, whole = _keys("doc_id", "text")
    n = F.octet_length(whole).cast("bigint")
    rows = docs.select("doc_id", d.alias("d"), k.alias("k"), k2.alias("k2"), n.alias("n"), F.sha2(whole.cast("binary"), 256).alias("sha"))
    rows = materialize(rows.groupBy("doc_id", "d", "k", "k2", "n", "sha").agg(F.count("*").alias("copies")), "text-digests")
    first = rows.groupBy("k", "k2").agg(F.min("d").alias("first"), F.count("*").alias("members")).filter("members > 1")
    # a text may have many copies: those of a frequent one stay where they are
    rows = attach(rows.withColumn("own", F.struct("k", "k2")), first.select(F.struct("k", "k2").alias("of"), "first"), "own", "of")
    rows = rows.drop("own").withColumn("first", F.coalesce("first", "d") == F.col("d"))
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    leads = F.col("first") & (F.col("turn") == 1)
    gone = (F.col("n") >= length) & ~leads
    out = rows.withColumn("leads", leads).withColumn("gone", gone).join(cut.drop("n_bytes").withColumn("leads", F.lit(True)), [*KEYS, "leads"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(F.col("gone"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("gone"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(F.col("gone"), F.lit(empty)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def cut_documents(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with ``text`` shortened to its remaining bytes and ``n_chars`` adjusted. Bytes of a character
    that was cut in two go as well. A null text stays null; rows equal in id and text keep the same text."""
    d, k, k2, whole = _keys("doc_id", "text")
    cut = cut_texts(docs, length).select(F.col("d").alias("_d"), F.col("k").alias("_k"), F.col("k2").alias("_k2"), "kept")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), d.alias("d"), k.alias("k"), k2.alias("k2"), (F.octet_length(whole) >= length).alias("long"))
    first = keyed.select("d", "k", "k2").groupBy("k", "k2").agg(F.min("d").alias("first"), F.max("d").alias("last")).filter("first < last").drop("last")

    @F.pandas_udf("string")
    def valid(parts: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else p.decode(errors="ignore") for p in parts], dtype=object)

    rows = attach(keyed.withColumn("own", F.struct("k", "k2")), first.select(F.struct("k", "k2").alias("of"), "first"), "own", "of")
    rows = rows.join(cut, (F.col("d") == F.col("_d")) & (F.col("k") == F.col("_k")) & (F.col("k2") == F.col("_k2")), "left")
    copy = F.col("long") & (F.col("d") > F.col("first"))
    text = F.when(copy, F.lit("")).otherwise(F.coalesce(valid("kept"), F.col("row")["text"]))
    rows = rows.select("row", text.alias("left_over"))
    return rows.select(
        *[{"text": F.col("left_over"), "n_chars": F.length("left_over").cast("bigint")}.get(c, F.col("row")[c]).alias(c) for c in docs.columns]
    )
