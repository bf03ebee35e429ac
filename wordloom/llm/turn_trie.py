"""Prefix trie of conversations, built as a burst trie.

A turn is 16 bytes, 12 of the digest of its role and text and 4 of its length, and a conversation is the
string of its turns' bytes, its path. Equal paths are merged first. A container holds the paths below one head, a node
of the trie. One container, below the root, starts with all paths; a container of more than ``limit``
paths bursts: its head moves down to the end of what all its paths share, and the paths
go to containers of their next turns. The containers that remain are sorted and swept, each in
one pass over its paths, into nodes. What the burst heads need of their subtrees is added up
from the last round to the first, by aggregation.

Data that repeats costs nothing extra: copies of a conversation are one path, and a long common beginning is passed in
one round. A round reads only what is in containers that still burst. The list of ids whose digest
a node carries is cut into chunks by range before it is hashed in order, so copies do not meet as rows.

Defined cases: a null role or text counts as empty; turns are ordered by number, null first, equal numbers by role and the
digest of the text; repeated turns stay; rows without a conversation id belong to no conversation;
other columns are ignored; an empty table gives no nodes. A conversation is one row, of 16 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import bounded_batches
from wordloom.operators.joins import attach
from wordloom.session import materialize

STEP = 16  # bytes of a turn
DIGEST = 12  # of them, of its digest; the others are its length in code points
LIMIT = 256  # paths of a container that is swept whole
CHUNK = 1 << 15  # ids joined to one piece of a list
OUT = 1 << 14  # rows of a batch that a task hands on
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, turn_key string"
NODE_TYPES = [pa.int64()] * 7 + [pa.string()] * 2
NAMES = [field.split()[0] for field in NODE.split(", ")]


def turn_key(role: Column, text: Column) -> Column:
    """A turn as hexadecimal text: its digest, then its length in code points."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)))
    return F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.lower(F.hex(F.char_length(text))), 2 * (STEP - DIGEST), "0"))


def turn_texts(turns: DataFrame) -> DataFrame:
    """turn_key, role, text: what the keys of nodes stand for."""
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    return turns.groupBy(turn_key(F.col("role"), F.col("text")).alias("turn_key")).agg(F.first(role).alias("role"), F.first(text).alias("text"))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: the keys of each conversation's turns, in order."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), turn_key(F.col("role"), F.col("text")).alias("key"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), said.alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["key"]).alias("turns"))


def graft(convs: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """Each conversation with its first ``taken`` turns replaced by those of conversation ``base``
    (both columns of conv_id); ``most`` bounds ``taken``."""
    convs = materialize(convs, "conversations")
    first = convs.join(convs.select(base.alias("base")).distinct(), F.col("conv_id") == F.col("base"), "left_semi")
    first = first.select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, most).alias("first"))
    joined = convs.withColumn("h", taken).join(first, base == F.col("base_id"), "left")
    start = F.when(F.col("h") > 0, F.slice(F.coalesce("first", F.array().cast("array<string>")), F.lit(1), F.col("h"))).otherwise(F.array().cast("array<string>"))
    return joined.select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """conv_id, path."""
    return convs.select("conv_id", F.unhex(F.concat_ws("", "turns")).alias("path"))


# -- equal paths -----------------------------------------------------------------------


def _batch(columns: list[list], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (path, conv_id) to pieces of the list of ids of each path."""
    names, types = ["path", "first", "n", "ids"], [pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    now, ids, out, held = None, [], [], 0

    def settle() -> int:
        joined = ",".join(map(str, ids)).encode()
        out.append((now, ids[0], len(ids), joined))
        ids.clear()
        return len(joined) + len(now)

    for batch in batches:
        for path, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (path != now or len(ids) == CHUNK):
                held += settle()
                if held > 1 << 22 or len(out) >= OUT:
                    yield _batch(list(zip(*out)), types, names)
                    out, held = [], 0
            now = path
            ids.append(conv)
    if ids:
        settle()
    if out:
        yield _batch(list(zip(*out)), types, names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one row a path, its ids hashed as they pass."""
    names, types = ["path", "n", "conv_id", "ends"], [pa.binary(), pa.int64(), pa.int64(), pa.string()]
    now, n, conv, digest, out = None, 0, 0, hashlib.sha256(), []
    for batch in batches:
        for path, first, many, ids in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if path != now:
                if now is not None:
                    out.append((now, n, conv, digest.hexdigest()))
                now, n, conv, digest = path, 0, first, hashlib.sha256()
            digest.update((b"," if n else b"") + ids)
            n += many
        if len(out) >= OUT:
            yield _batch(list(zip(*out)), types, names)
            out = []
    if now is not None:
        out.append((now, n, conv, digest.hexdigest()))
    if out:
        yield _batch(list(zip(*out)), types, names)


def merged(convs: DataFrame) -> DataFrame:
    """path, n, conv_id, ends: one row per distinct path with the number, the least and the digest of its conversations' ids."""
    rows = materialize(paths(convs), "paths")
    pieces = rows.select("path", "conv_id").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    pieces = pieces.mapInArrow(_pieces, "path binary, first bigint, n bigint, ids binary")
    whole = pieces.repartition("path").sortWithinPartitions("path", "first")
    return materialize(whole.mapInArrow(_joined, "path binary, n bigint, conv_id bigint, ends string"), "distinct-paths")


# -- bursting --------------------------------------------------------------------------


def _shared(a: bytes, b: bytes) -> int:
    """How many turns two paths share from the start."""
    n = min(len(a), len(b)) // STEP
    x, y = (np.frombuffer(p, np.uint64, 2 * n).reshape(n, 2) for p in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n


def _lengths(path: bytes) -> np.ndarray:
    return np.frombuffer(path, ">u4")[STEP // 4 - 1 :: STEP // 4].astype(np.int64)


def _bursting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers (head, top, parent, parent_conv, n, conv_id, lo, hi) to their heads after the common beginning,
    with what the nodes from ``top`` to ``depth`` need."""
    for batch in batches:
        lo, hi, top = (batch.column(c).to_pylist() for c in ("lo", "hi", "top"))
        depth = [_shared(a, b) for a, b in zip(lo, hi)]
        steps = [path[max(t - 1, 0) * STEP : d * STEP] for path, t, d in zip(lo, top, depth)]
        kept = [batch.column(c) for c in ("head", "top", "parent", "parent_conv", "n", "conv_id")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(depth, pa.int32()), pa.array(steps, pa.binary())],
            names=["head", "top", "parent", "parent_conv", "n", "conv_id", "depth", "steps"],
        )


def _burst(now: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """One round: (rows whose container stays, heads that burst, rows of new containers or, with null head, ends at a head)."""
    held = now.groupBy("head").agg(
        F.count("*").alias("rows"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.min("path").alias("lo"), F.max("path").alias("hi"),
        F.first("top").alias("top"), F.first("parent").alias("parent"), F.first("parent_conv").alias("parent_conv"),
    )
    schema = "head string, top int, parent string, parent_conv bigint, n bigint, conv_id bigint, depth int, steps binary"
    heads = materialize(held.filter(F.col("rows") > limit).mapInArrow(_bursting, schema), "burst-heads")
    if heads.isEmpty():
        return None
    to = heads.select(F.col("head").alias("at"), F.col("depth").alias("at_depth"), F.col("conv_id").alias("at_conv"))
    found = attach(now, to, "head", "at")
    stay = found.filter("at_depth is null").select(*now.columns)
    deeper = F.octet_length("path") > STEP * F.col("at_depth")
    prefix = F.substring(F.col("path"), F.lit(1), STEP * (F.col("at_depth") + 1))
    moved = found.filter("at_depth is not null").select(
        F.when(deeper, F.md5(prefix)).alias("head"), (F.col("at_depth") + 1).alias("top"), F.col("head").alias("parent"),
        F.col("at_conv").alias("parent_conv"), "path", "n", "conv_id", "ends",
    )
    return stay, heads, materialize(moved, "burst")


# -- sweeping --------------------------------------------------------------------------


def _swept(rows: list[tuple], top: int, parent_conv: int | None) -> list[list]:
    """The nodes of a container from its sorted rows (path, n, conv_id, ends); its head's is the last."""
    out: list[list] = []
    open_: list[list] = []  # nodes from the head down: n, conv_id, children, leaves, saved, ends, key, places of the children in out

    def close() -> None:
        n, conv, children, leaves, saved, ends, key, below = open_.pop()
        leaves, saved = leaves or 1, saved + ((n - 1) * int.from_bytes(key[DIGEST:], "big") if key else 0)
        for child in below:
            out[child][2] = conv
        if open_:
            up = open_[-1]
            up[0] += n
            up[1] = conv if up[1] is None else min(up[1], conv)
            up[2] += 1
            up[3] += leaves
            up[4] += saved
            up[7].append(len(out))
        out.append([conv, top + len(open_), parent_conv, n, children, leaves, saved, ends, key.hex() if key else None])

    before = b""
    for path, n, conv, ends in rows:
        depth = len(path) // STEP
        common = _shared(before, path) if open_ else top - 1
        while top + len(open_) - 1 > common and open_:
            close()
        for at in range(top + len(open_), depth + 1):
            open_.append([0, None, 0, 0, 0, EMPTY, path[(at - 1) * STEP : at * STEP] if at else b"", []])
        node = open_[-1]
        node[0] += n
        node[1] = conv if node[1] is None else min(node[1], conv)
        node[5] = ends
        before = path
    while open_:
        close()
    return out


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (head, path) to nodes; ``up`` names the parent of a container's head, ``round`` the round that made it."""
    names, types = [*NAMES, "up", "round"], [*NODE_TYPES, pa.string(), pa.int32()]
    out: list[list] = []
    held: list[tuple] = []
    now: tuple = ()

    def settle() -> None:
        if held:
            nodes = _swept(held, now[1], now[3])
            out.extend([*node, None, None] for node in nodes)
            out[-1][-2:] = [now[2], now[4]]
            held.clear()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("head", "top", "parent", "parent_conv", "round", "path", "n", "conv_id", "ends")]
        for row in zip(*columns):
            if not now or row[0] != now[0]:
                settle()
                now = row[:5]
                if len(out) >= OUT:
                    yield _batch(list(zip(*out)), types, names)
                    out.clear()
            held.append(row[5:])
    settle()
    if out:
        yield _batch(list(zip(*out)), types, names)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Burst heads with the sums of their children to nodes, from the container's top down to where it burst."""
    names, types = [*NAMES, "up", "round"], [*NODE_TYPES, pa.string(), pa.int32()]
    wanted = ("top", "depth", "steps", "conv_id", "parent_conv", "n", "children", "leaves", "saved", "ends", "parent", "round")
    for batch in batches:
        for top, depth, steps, conv, above, n, children, leaves, saved, ends, parent, made in zip(*[batch.column(c).to_pylist() for c in wanted]):
            tokens = _lengths(steps) if top else np.concatenate([np.zeros(1, np.int64), _lengths(steps)])
            total = saved + (n - 1) * np.cumsum(tokens[::-1])[::-1]
            keys = [steps[i : i + STEP].hex() for i in range(0, len(steps), STEP)]
            keys = keys if top else [None, *keys]
            for lo in range(0, len(keys), OUT):
                m = len(keys[lo : lo + OUT])
                last = lo + m == len(keys)
                rows = [
                    [conv] * m, list(range(top + lo, top + lo + m)), [above if lo == 0 else conv, *[conv] * (m - 1)], [n] * m,
                    [*[1] * (m - 1), children if last else 1], [leaves] * m, total[lo : lo + m].tolist(),
                    [*[EMPTY] * (m - 1), (ends or EMPTY) if last else EMPTY], keys[lo : lo + m],
                    [parent if lo == 0 else None, *[None] * (m - 1)], [made if lo == 0 else None, *[None] * (m - 1)],
                ]
                yield _batch(rows, types, names)


def trie(convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id, turns: array of keys, which may be empty).

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (code points that
    storing each node's turn once saves in its subtree), ends_sha256 (of the ids that end here), turn_key.
    """
    bounded_batches(convs.sparkSession)
    rows = merged(convs)
    now = rows.select(
        F.md5(F.lit(b"")).alias("head"), F.lit(0).alias("top"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("bigint").alias("parent_conv"),
        "path", "n", "conv_id", "ends",
    )
    left, rounds = [], []
    while True:
        made = len(rounds)
        burst = _burst(now, limit)
        if burst is None:
            left.append(now.withColumn("round", F.lit(made)))
            break
        stay, heads, moved = burst
        left.append(stay.withColumn("round", F.lit(made)))
        ended = moved.filter("head is null").select(F.col("parent").alias("ended"), "ends")
        rounds.append((heads, ended))
        now = moved.filter("head is not null")
    whole = left[0]
    for part in left[1:]:
        whole = whole.unionByName(part)
    schema = f"{NODE}, up string, round int"
    swept = materialize(whole.repartition("head").sortWithinPartitions("head", "path").mapInArrow(_sweep, schema), "swept")
    nodes, tops = swept, swept
    for made in reversed(range(len(rounds))):
        heads, ended = rounds[made]
        below = tops.filter(F.col("round") == made + 1)
        if tops is not swept:
            below = below.unionByName(swept.filter(F.col("round") == made + 1))
        sums = below.groupBy("up").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        known = heads.join(sums, heads["head"] == sums["up"]).join(ended, heads["head"] == ended["ended"], "left").withColumn("round", F.lit(made))
        tops = materialize(known.mapInArrow(_chains, schema), "burst-nodes")
        nodes = nodes.unionByName(tops)
    return nodes.drop("up", "round")


def shared_beginnings(turns: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """The trie of ``turns`` whose conversations begin as the first of their ``block`` does: with its first h turns, h being the
    unsigned crc32 of the decimal id modulo ``most``, then their own after as many."""
    base = F.col("conv_id") - F.col("conv_id") % block
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    return trie(graft(conversations(turns), base, taken, most))
