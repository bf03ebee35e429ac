"""Splits, mixes, shuffles, and the sampling of words. All draws derive from keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wordloom.functions.hashing import digest, record_state, uniform, uniform_np
from wordloom.operators.blocks import list_column, list_parts, places, ship
from wordloom.operators.joins import lookup, regroup
from wordloom.operators.ranking import hash_cut, shuffled_positions
from wordloom.operators.reshape import infrequent
from wordloom.operators.vocabulary import Vocabulary, most_common
from wordloom.schemas import NEG_SAMPLE_COUNT, NEG_SAMPLE_POWER, SEED, SPLIT_SHARES, SUBSAMPLE_THRESHOLD
from wordloom.session import MAX_BROADCAST_BYTES, bounded_batches, local_table, measured_bytes

COPIES_PER_BLOCK = 10_000

# -- records ---------------------------------------------------------------------------


def split_records(
    df: DataFrame,
    key: str = "record_id",
    shares: Mapping[str, float] = SPLIT_SHARES,
    seed: int = SEED,
    exact: bool = True,
) -> DataFrame:
    """Add ``split``: train, val or test.

    Exact parts hold ⌊share·n⌋ records of train and of test, and val takes the rest. The
    order is that of a hash of the key, which must be unique; two light passes over the
    key find the hashes at which to cut, and the data itself is only compared, never
    shuffled. The other form compares the hash with the shares, with sizes that are right
    on average and no pass in advance.
    """
    place = digest(seed, key)
    if exact:
        n = df.count()
        n_train, n_test = int(n * shares["train"]), int(n * shares["test"])
        train = place <= hash_cut(df, key, seed, n_train)
        val = place <= hash_cut(df, key, seed, n - n_test)
    else:
        u = record_state(seed, key) / F.lit(float(2**31 - 1))
        train, val = u < shares["train"], u < 1.0 - shares["test"]
    name = F.when(train, "train").when(val, "val").otherwise("test")
    return df.withColumn("split", name)


def proportional_weights(sizes: DataFrame) -> DataFrame:
    """``weight`` of each row of ``(source, n)``: its share of the sum."""
    return sizes.withColumn("weight", F.col("n") / sizes.agg(F.sum("n")).scalar())


def interleave(
    sources: Mapping[str, DataFrame],
    weights: Mapping[str, float] | None = None,
    key: str = "record_id",
    seed: int = SEED,
    ordered: bool = True,
) -> DataFrame:
    """Mix sources by weight until every source is used up at least once.

    With ``T = max(n / weight)`` a source gives ``round(T · weight)`` rows: whole copies of
    itself, and the part of one more copy that comes first in hash order. ``copy_no`` tells
    copies apart. Weights default to the sizes, which uses each row exactly once. The rows come
    in mixed order, that of a hash; without ``ordered`` they come source after source and nothing is sorted.
    """
    sizes = {name: df.count() for name, df in sources.items()}
    sizes = {name: n for name, n in sizes.items() if n} or {name: 0 for name in list(sizes)[:1]}
    weights = weights or {name: n / max(sum(sizes.values()), 1) for name, n in sizes.items()}
    total = max(n / weights[name] if n else 0 for name, n in sizes.items())
    parts = []
    for name, n in sizes.items():
        copies, rest = divmod(int(total * weights[name] + 0.5), max(n, 1))
        df = sources[name].withColumn("source", F.lit(name))
        hashed = f"{seed}:{name}"
        upto = F.lit(copies)
        if rest:
            cut = hash_cut(sources[name], key, hashed, rest)
            upto = upto + (digest(hashed, key) <= cut).cast("int")
        parts.append(_copies(df, upto, copies + 1))
    mixed = reduce(DataFrame.unionByName, parts)
    if ordered:
        mixed = mixed.orderBy(digest(seed, "source", "copy_no", key))
    return mixed


def mixed_positions(mixed: DataFrame, key: str = "record_id", seed: int = SEED) -> DataFrame:
    """Add ``position``, the place of each row in the order of an interleaved mix."""
    keyed = mixed.withColumn("_mixed", F.concat_ws(":", "source", F.col("copy_no").cast("string"), F.col(key).cast("string")))
    return shuffled_positions(keyed, "_mixed", seed).drop("_mixed")


def _copies(df: DataFrame, times: Column, at_most: int) -> DataFrame:
    """Each row ``times`` times, with ``copy_no``. Many copies are made block by block, and
    the blocks of one row go to different tasks."""
    numbered = df.withColumn("_times", times)
    if at_most <= COPIES_PER_BLOCK:
        rows = numbered.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("_times"))))
    else:
        last = (F.col("_times") / COPIES_PER_BLOCK).cast("int")
        blocks = numbered.withColumn("_block", F.explode(F.sequence(F.lit(0), last)))
        first = F.col("_block") * COPIES_PER_BLOCK
        rows = (
            blocks.repartition(F.xxhash64(*blocks.columns))
            .withColumn("copy_no", F.explode(F.sequence(first, first + (COPIES_PER_BLOCK - 1))))
            .drop("_block")
        )
    return rows.filter(F.col("copy_no") < F.col("_times")).drop("_times")


def shuffle_records(df: DataFrame, epoch: int, key: str = "record_id", seed: int = SEED) -> DataFrame:
    """Rows in a random order of their own for every epoch."""
    return df.orderBy(digest(f"{seed}:{epoch}", key), key)


def batches(df: DataFrame, size: int, key: str = "record_id", seed: int = SEED) -> DataFrame:
    """Add ``batch_no``: shuffled groups of ``size`` records, the last one maybe smaller."""
    placed = shuffled_positions(df, key, seed)
    return placed.withColumn("batch_no", F.floor(F.col("position") / size).cast("bigint")).drop("position")


def collate(df: DataFrame, size: int, columns: Sequence[str], key: str = "record_id", seed: int = SEED) -> DataFrame:
    """One row per batch with an array of its records; a batch holds ``size`` at most."""
    numbered = batches(df, size, key, seed)
    return numbered.groupBy("batch_no").agg(
        F.array_sort(F.collect_list(F.struct(key, *columns))).alias("records")
    )


def map_batches(
    df: DataFrame,
    size: int,
    fn: Callable[[pa.Table], pa.Table],
    schema: str | T.StructType,
    key: str = "record_id",
    seed: int = SEED,
) -> DataFrame:
    """Run a user's collate function on each batch of ``size`` records as an Arrow table."""
    return batches(df, size, key, seed).groupBy("batch_no").applyInArrow(fn, schema)


# -- words -----------------------------------------------------------------------------


def keep_probability(count: Column, total: Column, t: float | Column = SUBSAMPLE_THRESHOLD) -> Column:
    """Chance to keep a word of relative frequency f: ``(sqrt(f/t) + 1) · t/f``, above 1 for rare words."""
    f = count.cast("double") / total
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    return (F.sqrt(f / t) + 1) * t / f


def keep_weights(vocabulary: Vocabulary, t: float = SUBSAMPLE_THRESHOLD) -> DataFrame:
    """``(word, cnt, keep_prob)`` of the ``size`` most frequent words. The total that
    frequencies refer to is the sum over these words."""
    return _weighted(vocabulary, t).select("word", "cnt", "keep_prob")


def _weighted(vocabulary: Vocabulary, t: float) -> DataFrame:
    """The ``size`` most frequent words with their rank and ``keep_prob``."""
    top = most_common(vocabulary.counts, vocabulary.size)
    # an aggregate over the same bounded rows; every row gets the sum beside it
    total = F.sum("cnt").over(Window.partitionBy(F.lit(0)))
    return top.withColumn("keep_prob", keep_probability(F.col("cnt"), total, t))


def weighted_table(vocabulary: Vocabulary, t: float = SUBSAMPLE_THRESHOLD) -> DataFrame:
    """The id table with ``keep_prob``; one lookup then serves encoding and subsampling.

    Both come from one ranking: the ids number its words that are not special, in order.
    """
    specials = vocabulary.specials
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    special = F.col("word").isin(specials) if specials else F.lit(False)
    ranked = _weighted(vocabulary, t).withColumn("_special", special)
    place = F.col("rank") - F.sum(F.col("_special").cast("int")).over(before) + len(specials)
    ranked = ranked.withColumn("id", place.cast("int"))
    words = ranked.filter(~F.col("_special") & (F.col("id") < vocabulary.size)).select(
        "id", "word", "cnt", F.lit(False).alias("is_special"), infrequent("cnt", vocabulary.min_freq).alias("is_infrequent"), "keep_prob"
    )
    heads = local_table(vocabulary.counts.sparkSession, [(i, word, True, False) for i, word in enumerate(specials)], "id int, word string, is_special boolean, is_infrequent boolean")
    counted = heads.join(ranked.filter("_special").select("word", "keep_prob"), "word", "left")
    return words.unionByName(counted.withColumn("cnt", F.lit(None).cast("bigint")))


def subsample_tokens(
    rows: DataFrame,
    weights: DataFrame,
    size: int,
    seed: int = SEED,
    key: str = "record_id",
    pos: str = "pos",
    token: str = "token",
) -> DataFrame:
    """Thin out frequent words of a long table ``(record, pos, token)``; words without a
    weight stay. There are weights for at most ``size`` words."""
    listed = weights.select(F.col("word").alias("_word"), "keep_prob")
    joined = lookup(rows, listed, token, "_word", size)
    u = uniform(record_state(seed, key), F.col(pos))
    kept = F.coalesce("keep_prob", F.lit(1.0)) > u
    return joined.filter(kept).drop("keep_prob")


def subsample_ids(
    encoded: DataFrame,
    vocabulary: Vocabulary,
    t: float = SUBSAMPLE_THRESHOLD,
    seed: int = SEED,
    key: str = "record_id",
    way: str = "arrow",
) -> DataFrame:
    """Thin out frequent words of the array ``ids``.

    Position i of a record meets the i-th uniform number of that record. The weights travel in blocks of
    ids and records stay in place; the join way, for records with unique ids, gives the same rows.
    """
    table = weighted_table(vocabulary, t).select("id", F.coalesce("keep_prob", F.lit(1.0)).alias("keep_prob"))
    if way == "join":
        return _subsample_join(encoded, table, vocabulary.size, seed, key)
    return _subsample_arrow(encoded, table, seed, key)


def _subsample_arrow(encoded: DataFrame, table: DataFrame, seed: int, key: str) -> DataFrame:
    bounded_batches(encoded.sparkSession)
    blocks = ship(table, "id", lambda rows: (rows["id"].to_numpy(), rows["keep_prob"].to_numpy()))
    others = [f for f in encoded.schema.fields if f.name not in ("ids", "tokens", "attention_mask")]
    schema = T.StructType([*others, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out_schema = to_arrow_schema(schema)
    names = [f.name for f in others]

    def thin(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.gather(record_batches):
            flat, offsets = list_parts(batch.column("ids"))
            ids = flat.to_numpy(zero_copy_only=False)
            weights = np.ones(len(ids))
            for known, keep_prob in blocks.visit():
                inside, place = places(known, ids)
                weights[inside] = keep_prob[place]
            lengths = np.diff(offsets)
            states = np.repeat(batch.column("_state").to_numpy(), lengths)
            pos = np.arange(len(ids)) - np.repeat(offsets[:-1], lengths)
            keep = weights > uniform_np(states, pos)
            kept_before = np.concatenate([[0], np.cumsum(keep)])
            thinned = list_column(kept_before[offsets], pa.array(ids[keep], pa.int32()))
            arrays = [batch.column(name) for name in names] + [thinned]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out_schema)], schema=out_schema)

    return encoded.select(*names, "ids", record_state(seed, key).alias("_state")).mapInArrow(thin, schema)


def _subsample_join(encoded: DataFrame, table: DataFrame, size: int, seed: int, key: str) -> DataFrame:
    others = [c for c in encoded.columns if c not in ("ids", "tokens", "attention_mask")]
    rows = encoded.select(*others, F.posexplode_outer("ids").alias("pos", "_token"))
    joined = lookup(rows, table, "_token", "id", size)
    u = uniform(record_state(seed, key), F.col("pos"))
    kept = F.when(F.coalesce("keep_prob", F.lit(1.0)) > u, F.struct("pos", F.col("_token").alias("id")))
    return regroup(joined, others, kept).select(*others, F.transform("items", lambda x: x["id"]).alias("ids"))


# -- negative samples ------------------------------------------------------------------


def negative_distribution(vocabulary: Vocabulary, power: float = NEG_SAMPLE_POWER) -> DataFrame:
    """``(id, word, cnt, prob, low, high)``: counts to the given power, normalised, and the
    interval of [0, 1) that draws each word. At most ``size`` rows."""
    words = vocabulary.table.filter(~F.col("is_special"))
    strength = F.pow(F.col("cnt").cast("double"), F.lit(power))
    everything = Window.partitionBy(F.lit(0))
    running = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weighed = words.select("id", "word", "cnt", strength.alias("_w")).withColumn("_total", F.sum("_w").over(everything))
    return weighed.select(
        "id",
        "word",
        "cnt",
        (F.col("_w") / F.col("_total")).alias("prob"),
        ((F.sum("_w").over(running) - F.col("_w")) / F.col("_total")).alias("low"),
        (F.sum("_w").over(running) / F.col("_total")).alias("high"),
    )


def _cuts(ids: np.ndarray, avoid: np.ndarray) -> np.ndarray:
    """For each row the places in ``ids`` of the ids in ``avoid``, sorted, each once; then ``len(ids)``."""
    n = len(ids)
    if not n:
        return np.zeros(avoid.shape, np.int64)
    cut = np.searchsorted(ids, avoid)
    cut = np.sort(np.where(ids[np.minimum(cut, n - 1)] == avoid, cut, n), axis=1)  # n: not in the table
    cut[:, 1:][cut[:, 1:] == cut[:, :-1]] = n
    cut.sort(axis=1)
    return cut


def _allowed_draws(high: np.ndarray, low: np.ndarray, width: np.ndarray, cut: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each row the place that its uniform number draws when the places in ``cut`` are
    cut out of the distribution; ``len(high)`` if none is left."""
    n = len(high)
    if not n:
        return np.zeros(len(u), dtype=np.int64)
    point = u * (high[-1] - width.take(cut).sum(axis=1))
    columns = np.ascontiguousarray(cut.T)
    for column in columns:  # in order: step over each interval at or below the point
        point += width.take(column) * (low.take(column) <= point)
    drawn = np.minimum(np.searchsorted(high, point, side="right"), n - 1)
    for row in np.flatnonzero((columns == drawn).any(axis=0)):  # rounding at an edge, or none is left
        left = np.setdiff1d(np.arange(n), cut[row])
        drawn[row] = left[np.argmin(np.abs(left - drawn[row]))] if len(left) else n
    return drawn


def draw_negatives(
    examples: DataFrame,
    distribution: DataFrame,
    k: int = NEG_SAMPLE_COUNT,
    seed: int = SEED,
    keys: Sequence[str] = ("record_id", "start"),
) -> DataFrame:
    """Add ``negatives``: ``k`` distinct ids per example, none of them its centre or context.

    A draw is a uniform number over the mass of the words that are still allowed, looked up in the
    cumulative distribution without the intervals of the others: the distribution itself, given
    that none of these comes up, and one number a draw. The table is bounded by the vocabulary
    size and measured before it is broadcast. With fewer than ``k`` words left, all are drawn.
    """
    bounded_batches(examples.sparkSession)
    table = distribution.select("id", "high").persist()
    try:
        if measured_bytes(table) > MAX_BROADCAST_BYTES:
            raise ValueError("the distribution is too large to broadcast; lower the vocabulary size")
        found = table.orderBy("id").toArrow()
    finally:
        table.unpersist()
    shipped = examples.sparkSession.sparkContext.broadcast(
        (found["id"].to_numpy().astype(np.int32), found["high"].to_numpy())
    )
    names = list(examples.columns)
    schema = T.StructType([*examples.schema.fields, T.StructField("negatives", T.ArrayType(T.IntegerType()))])
    out_schema = to_arrow_schema(schema)

    def draw(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, high = shipped.value
        size = len(ids)
        low = np.concatenate([[0.0], high, [np.inf]])[[*range(size), size + 1]]
        interval = np.concatenate([high - low[:size], [0.0]])
        for batch in record_batches:
            n = batch.num_rows
            states = batch.column("_state").to_numpy()
            # what a row must not draw: its centre, its context (padded to one width), its draws so far
            flat, offsets = list_parts(batch.column("context"))
            lengths = np.diff(offsets)
            width = int(lengths.max()) if n else 0
            avoid = np.full((n, 1 + width + k), -1, dtype=np.int64)
            avoid[:, 0] = batch.column("center").to_numpy()
            rows = np.repeat(np.arange(n), lengths)
            avoid[rows, 1 + np.arange(len(rows)) - np.repeat(offsets[:-1], lengths)] = flat.to_numpy(
                zero_copy_only=False
            )
            done = np.zeros(n, dtype=np.int64)
            cut = _cuts(ids, avoid)
            for turn in range(k):
                at = _allowed_draws(high, low, interval, cut, uniform_np(states, np.full(n, turn)))
                hit = at < size
                avoid[hit, 1 + width + turn] = ids[at[hit]]
                done += hit
                cut[:, -1] = at  # the last place is free before the last draw
                cut.sort(axis=1)
            drawn_ids = avoid[:, 1 + width :]
            filled = np.arange(k) < done[:, None]
            chosen = list_column(np.concatenate([[0], np.cumsum(done)]), pa.array(drawn_ids[filled], pa.int32()))
            arrays = [batch.column(name) for name in names] + [chosen]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out_schema)], schema=out_schema)

    return examples.withColumn("_state", record_state(seed, *keys)).mapInArrow(draw, schema)
