"""Word vectors: training, norms, context means, scores, analogies and axes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel, Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.operators.blocks import BLOCK_BYTES, Blocks, list_column, list_parts, places, ship, vector_rows
from wordloom.operators.joins import attach, key_counts
from wordloom.operators.softmax import find_windows, furthest, window_loss
from wordloom.schemas import (
    CHECKPOINT_EVERY,
    EMBED_DIMENSION,
    EMBED_MAX_NORM,
    EPOCHS,
    LEARNING_RATE,
    MAX_SEQUENCE_LENGTH,
    N_CONTEXT,
    SEED,
)
from wordloom.session import MAX_BROADCAST_BYTES, bounded_batches, materialize, measured_bytes

CRITERIA = ("softmax", "negative", "sampled")
WORDS_PER_TASK = 4_000_000
TILE = 256, 1024  # examples and rows whose logits exist at one time
EXAMPLES = 2048  # whose context vectors exist at one time
ROWS = 1 << 14  # candidates whose vectors exist at one time
EXAMPLE_BYTES = 256  # that a softmax takes for an example besides its columns
OTHERS = 1 << 14  # examples of a softmax whose means exist at one time

# -- training --------------------------------------------------------------------------


def train_vectors(
    encoded: DataFrame,
    tokens: str = "tokens",
    dimension: int = EMBED_DIMENSION,
    n_context: int = N_CONTEXT,
    max_sequence_len: int = MAX_SEQUENCE_LENGTH,
    learning_rate: float = LEARNING_RATE,
    epochs: int = 1,
    partitions: int | None = None,
    seed: int = SEED,
) -> Word2VecModel:
    """Fit word vectors on encoded tokens, in one task per four million of them unless ``partitions`` says otherwise.

    Tasks start an epoch from the same vectors, and what they made of them is averaged.

    The trainer keeps one vector per distinct token on the driver. Encoding has replaced
    words outside the vocabulary by the unknown token, so that is at most ``size`` vectors.
    """
    if partitions is None:
        partitions = 1 + encoded.agg(F.coalesce(F.sum(F.greatest(F.size(tokens), F.lit(0))), F.lit(0))).first()[0] // WORDS_PER_TASK
    trainer = Word2Vec(
        inputCol=tokens,
        outputCol="document_vector",
        vectorSize=dimension,
        windowSize=n_context,
        maxSentenceLength=max_sequence_len or 2**31 - 1,
        minCount=1,
        stepSize=learning_rate,
        maxIter=epochs,
        numPartitions=partitions,
        seed=seed,
    )
    return trainer.fit(encoded.select(tokens))


def vectors_of(model: Word2VecModel, vocabulary_table: DataFrame | None = None) -> DataFrame:
    """``(word, vector)`` of a fitted model, with ``id`` where a vocabulary table is given."""
    found = model.getVectors().select("word", vector_to_array("vector", "float32").alias("vector"))
    if vocabulary_table is None:
        return found
    return vocabulary_table.select("id", "word").join(found, "word")


def checkpoint_name(epoch: int, epochs: int = EPOCHS) -> str:
    """Folder of the checkpoint after an epoch, numbered from 1, padded so that names sort."""
    return f"checkpoint_{str(epoch).zfill(len(str(epochs)))}"


def train_with_checkpoints(
    encoded: DataFrame, path: str, epochs: int = EPOCHS, every: int = CHECKPOINT_EVERY, **options
) -> Word2VecModel:
    """Fit, saving a model after each ``every`` epochs and the last one as ``model``.

    The trainer offers no hook between epochs, so a checkpoint is a fit of its own with that
    many epochs and the same seed.
    """
    if every:
        for epoch in range(every, epochs, every):
            train_vectors(encoded, epochs=epoch, **options).save(f"{path}/{checkpoint_name(epoch, epochs)}")
    model = train_vectors(encoded, epochs=epochs, **options)
    if every and epochs % every == 0:
        model.save(f"{path}/{checkpoint_name(epochs, epochs)}")
    model.save(f"{path}/model")
    return model


# -- arithmetic on vectors -------------------------------------------------------------


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def clip_norm(v: Column | str, max_norm: float = EMBED_MAX_NORM) -> Column:
    """Shorten a vector to ``max_norm`` where it is longer."""
    v = F.col(v) if isinstance(v, str) else v
    length = norm(v)
    scale = F.when(length > max_norm, max_norm / length).otherwise(F.lit(1.0))
    return F.transform(v, lambda x: x.cast("double") * scale)


def cosine(a: Column | str, b: Column | str) -> Column:
    lengths = norm(a) * norm(b)
    return dot(a, b) / F.when(lengths > 0, lengths)


def context_means(
    examples: DataFrame,
    vectors: DataFrame,
    keys: Sequence[str] = ("record_id", "start"),
    way: str = "arrow",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Mean of the vectors of each example's context ids. An id without a vector counts for
    nothing, and an example without any vector disappears.

    The vectors travel in blocks of ids, whatever their number, and examples stay in place. The join
    way gives the same rows: ids are joined with the vectors, and each example gathers its ``2n`` vectors at most.
    """
    table = vectors.select("id", "vector")
    found = examples.select(*keys, "context")
    return _means_join(found, table, keys) if way == "join" else _means_arrow(found, table, keys, block_bytes)


def _dimension(vectors: DataFrame) -> int:
    """Length of the first vector."""
    return len((vectors.filter(F.col("vector").isNotNull()).select("vector").first() or [[]])[0])


def _vector_block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return rows["id"].to_numpy(), vector_rows(rows)


def _sums(blocks: Blocks, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the vectors of each example's ids and how many ids have one."""
    n = np.zeros(len(offsets) - 1, np.int64)
    total = np.zeros((len(n), 0))
    for known, matrix in blocks.visit():
        if not len(known):
            continue
        if not total.size:
            total = np.zeros((len(n), matrix.shape[1]))
        for lo in range(0, len(n), EXAMPLES):
            ends = offsets[lo : lo + EXAMPLES + 1]
            inside, place = places(known, flat[ends[0] : ends[-1]])
            owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[inside]
            if len(owner):
                first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
                total[lo + owner[first]] += np.add.reduceat(matrix[place], first, axis=0, dtype=np.float64)
                n[lo : lo + EXAMPLES] += np.bincount(owner, minlength=len(ends) - 1)
    return total, n


def _means_arrow(
    examples: DataFrame, table: DataFrame, keys: Sequence[str], block_bytes: int, rows_at_once: int = EXAMPLES
) -> DataFrame:
    bounded_batches(examples.sparkSession)
    d = _dimension(table)
    blocks = ship(table, "id", _vector_block, block_bytes)
    schema = T.StructType(
        [*[examples.schema[k] for k in keys], T.StructField("mean", T.ArrayType(T.DoubleType()))]
    )

    def average(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in blocks.gather(record_batches, 8 * d):
            flat, offsets = list_parts(whole.column("context"))
            total, n = _sums(blocks, flat.to_numpy(zero_copy_only=False), offsets)
            for at in range(0, whole.num_rows, rows_at_once):
                part = slice(at, at + rows_at_once)
                keep = n[part] > 0
                if not keep.any():
                    continue
                means = total[part][keep] / n[part][keep][:, None]
                ends = np.arange(len(means) + 1) * means.shape[1]
                kept = whole.slice(at, rows_at_once).filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [*[kept.column(k) for k in keys], list_column(ends, pa.array(means.ravel()))],
                    names=[*keys, "mean"],
                )

    return examples.mapInArrow(average, schema)


def look_up_vectors(
    rows: DataFrame, vectors: DataFrame, id: str = "id", way: str = "auto", keep_missing: bool = True
) -> DataFrame:
    """Add ``vector`` to rows with an id; rows whose id has none keep a null vector, or are dropped
    without ``keep_missing``.

    Vectors that were measured to fit are broadcast. If not, the ids of the rows are counted in a pass of their own, and the vectors
    that these use are measured. If those do not fit either, the vectors of frequent ids are broadcast, and the other rows are joined.
    """
    table, counts = vectors.select(F.col("id").alias("_vid"), "vector"), None
    on, how = F.col(id) == F.col("_vid"), "left" if keep_missing else "inner"
    if way == "auto":
        fits = measured_bytes(table) <= MAX_BROADCAST_BYTES
        if not fits:
            counts = materialize(key_counts(rows, id), "used-ids")
            table = materialize(table.join(counts.select("_hot"), F.col("_vid") == F.col("_hot"), "left_semi"), "used-vectors")
            fits = measured_bytes(table) <= MAX_BROADCAST_BYTES
        way = "broadcast" if fits else "join"
    if way == "broadcast":
        return rows.join(F.broadcast(table), on, how).drop("_vid")
    found = attach(rows, table.withColumn("_found", F.lit(True)), id, "_vid", counts)
    return (found if keep_missing else found.filter("_found")).drop("_found")


def _means_join(examples: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = examples.select(*keys, F.posexplode("context").alias("place", "_id"))
    gathered = (
        look_up_vectors(rows, table, "_id", "join", keep_missing=False)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("place", "vector"))).alias("_found"))
    )
    first = F.transform(F.col("_found")[0]["vector"], lambda x: x.cast("double"))
    rest = F.slice("_found", 2, F.greatest(F.size("_found") - 1, F.lit(0)))
    total = F.aggregate(
        rest, first, lambda acc, item: F.zip_with(acc, item["vector"], lambda x, y: x + y.cast("double"))
    )
    return gathered.select(*keys, F.transform(total, lambda x: x / F.size("_found")).alias("mean"))


def analogy(vectors: DataFrame, a: int, b: int, c: int, k: int = 10) -> DataFrame:
    """The ``k`` ids nearest by cosine to ``a − b + c``, without these three; an id without a vector is an error."""

    def one(id: int) -> Column:
        return vectors.filter(F.col("id") == id).select("vector").limit(1).scalar()

    three = vectors.sparkSession.range(1).select(one(a).alias("a"), one(b).alias("b"), one(c).alias("c"))
    difference = F.zip_with("a", "b", lambda x, y: x.cast("double") - y.cast("double"))
    query = three.select(F.zip_with(difference, F.col("c"), lambda x, y: x + y.cast("double")))
    known = F.coalesce(query.scalar(), F.raise_error(F.lit(f"one of the ids {a}, {b}, {c} has no vector")))
    others = vectors.filter(~F.col("id").isin([a, b, c])).withColumn("query", known)
    scored = others.select("id", cosine("vector", "query").alias("similarity"))
    return scored.orderBy(F.desc("similarity"), F.asc("id")).limit(k)


def principal_axes(vectors: DataFrame, k: int = 2, column: str = "vector") -> PCAModel:
    """Principal axes of the vectors."""
    dense = vectors.select(array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="projected").fit(dense)


def project(vectors: DataFrame, model: PCAModel, column: str = "vector") -> DataFrame:
    dense = vectors.withColumn("features", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    return model.transform(dense).withColumn("projected", vector_to_array("projected")).drop("features")


@dataclass
class Discriminant:
    """Axes (columns) along which labels differ most, relative to how rows of a label differ."""

    n: int
    mean: np.ndarray
    within: np.ndarray  # scatter of rows around their label's mean
    between: np.ndarray  # scatter of the labels' means, by their rows
    values: np.ndarray  # between over within along each axis, falling
    axes: np.ndarray


def _scatter(rows: DataFrame, d: int) -> np.ndarray:
    """Sum of ``weight * vector vector'`` over the rows, added up in the tasks and then row by row of the matrix."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = vector_rows(pa.Table.from_batches([batch]))
            if len(x):
                total += (x * batch.column("weight").to_numpy()[:, None]).T @ x
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total.tolist())], names=["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # rows of the matrix that fell to this task
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[i] = total.get(i, 0.0) + row.values.to_numpy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([r.tolist() for r in total.values()])], names=["i", "row"])

    schema = "i int, row array<double>"
    found = rows.select("vector", "weight").mapInArrow(partial, schema).repartition("i").mapInArrow(add, schema).collect()
    out = np.zeros((d, d))
    for r in found:
        out[r.i] = r.row
    return out


def discriminant_axes(vectors: DataFrame, label: str = "label", k: int = 2, column: str = "vector") -> Discriminant:
    """At most ``k`` axes a with between a = value · within a, of unit scatter within labels.

    Rows without a vector or a label take no part. Labels may be many: their means are one aggregation, and only what has the
    size of the dimension comes to the driver. Directions in which no label has any spread are left out.
    """
    rows = vectors.filter(F.col(column).isNotNull() & F.col(label).isNotNull())
    rows = rows.select(F.col(label).alias("label"), F.transform(column, lambda x: x.cast("double")).alias("vector"))
    means = rows.groupBy("label").agg(F.count("*").alias("n"), Summarizer.mean(array_to_vector("vector")).alias("mean"))
    means = materialize(means.select("label", "n", vector_to_array("mean").alias("mean")), "label-means")
    parts = means.select(F.col("n").cast("double").alias("weight"), F.posexplode("mean").alias("pos", "x"))
    sums = parts.groupBy("pos").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("n"))
    sums = sorted(sums.collect(), key=lambda r: r.pos)
    n, d = int(sums[0].n) if sums else 0, len(sums)
    mean = np.array([r.mean for r in sums])
    empty = Discriminant(n, mean, np.zeros((d, d)), np.zeros((d, d)), np.zeros(0), np.zeros((d, 0)))
    if not d:
        return empty
    centre = F.lit(mean.tolist())
    apart = means.select(F.zip_with("mean", centre, lambda x, m: x - m).alias("vector"), F.col("n").cast("double").alias("weight"))
    joined = attach(rows, means.select(F.col("label").alias("_label"), "mean"), "label", "_label")
    around = joined.select(F.zip_with("vector", "mean", lambda x, m: x - m).alias("vector"), F.lit(1.0).alias("weight"))
    between, within = _scatter(apart, d), _scatter(around, d)
    spread, turn = np.linalg.eigh(within)
    usable = spread > d * np.finfo(float).eps * max(spread.max(), 0.0) if spread.max() > 0 else np.zeros(d, bool)
    if not usable.any():
        return replace(empty, within=within, between=between)
    scaled = turn[:, usable] / np.sqrt(spread[usable])
    values, axes = np.linalg.eigh(scaled.T @ between @ scaled)
    k = min(k, means.count() - 1, len(values))
    values, axes = values[::-1][:k], (scaled @ axes[:, ::-1])[:, :k]
    largest = axes[np.abs(axes).argmax(axis=0), np.arange(k)]
    return Discriminant(n, mean, within, between, values, axes * np.where(largest < 0, -1.0, 1.0))


def place(vectors: DataFrame, mean: np.ndarray, axes: np.ndarray, column: str = "vector") -> DataFrame:
    """Add ``placed``: the coordinates of each vector, less the mean, along the axes (columns)."""
    less = F.zip_with(column, F.lit(mean.tolist()), lambda x, m: x.cast("double") - m)
    return vectors.withColumn("placed", F.when(F.col(column).isNotNull(), F.array(*[dot(less, F.lit(a.tolist())) for a in axes.T])))


def eigen_residuals(vectors: DataFrame, label: str, axes: np.ndarray, values: np.ndarray, column: str = "vector") -> DataFrame:
    """``(axis, value, residual)``: how far each axis a is from between a = value · within a, relative to the
    greatest entry of between a. From the rows alone: scatter times a is a sum over rows of vector times coordinate."""
    rows = vectors.filter(F.col(column).isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).alias("label"), F.transform(column, lambda x: x.cast("double")).alias("vector")
    )
    rows = place(rows, np.zeros(len(axes)), axes)
    long = rows.select("label", "placed", F.posexplode("vector").alias("pos", "x")).select(
        "label", "pos", "x", F.posexplode("placed").alias("axis", "p")
    )
    # sums of products per label; around the means they are sums of products less n times the product of means
    per = long.groupBy("axis", "pos", "label").agg(
        F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("p").alias("sp"), F.sum(F.col("x") * F.col("p")).alias("sxp")
    )
    total = per.groupBy("axis", "pos").agg(
        F.sum(F.col("sxp") - F.col("sx") * F.col("sp") / F.col("n")).alias("within"),
        (F.sum(F.col("sx") * F.col("sp") / F.col("n")) - F.sum("sx") * F.sum("sp") / F.sum("n")).alias("between"),
    )
    value = F.lit(values.tolist())[F.col("axis")]
    return total.groupBy("axis").agg(
        F.first(value).alias("value"),
        (F.max(F.abs(F.col("between") - value * F.col("within"))) / F.max(F.abs("between"))).alias("residual"),
    )


# -- scoring ---------------------------------------------------------------------------


def score_examples(
    examples: DataFrame,
    embeddings: DataFrame,
    output: DataFrame | None = None,
    criterion: str = "softmax",
    distribution: DataFrame | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``loss``: embed the context, average, apply the output layer, compare with the centre.

    ``embeddings(id, vector)`` and ``output(id, vector, bias)`` may have any number of rows; without an output
    layer the embeddings serve with bias 0. Both are visited block by block, and an example carries
    from block to block what its loss needs, so the result does not depend on the blocks. Examples never move.

    - ``softmax``: cross-entropy over all rows of ``output``. Carried: the greatest logit so far, the sum of
      exponentials below it, the logit of the centre.
    - ``negative``: logistic loss of the centre as positive and the ids in ``negatives`` as negatives.
    - ``sampled``: cross-entropy over the centre and its ``negatives``, each logit less the logarithm of how often
      ``distribution(id, prob)`` is expected to draw it.

    Context ids without a vector count for nothing; without any, or with a centre that ``output`` does not hold, the loss is null.
    Negatives without output weights are left out.
    """
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion {criterion}; there are {', '.join(CRITERIA)}")
    output = embeddings.withColumn("bias", F.lit(0.0)) if output is None else output
    output = output.select("id", "vector", F.col("bias").cast("double").alias("bias"))
    if criterion == "sampled":
        if distribution is None:
            raise ValueError("the sampled criterion needs the distribution of the negatives")
        output = output.join(distribution.select("id", F.col("prob").cast("double").alias("prob")), "id", "left")
    else:
        output = output.withColumn("prob", F.lit(1.0))
    bounded_batches(examples.sparkSession)
    d = _dimension(embeddings)
    embedded = ship(embeddings.select("id", "vector"), "id", _vector_block, block_bytes)
    weights = ship(output, "id", _output_block, block_bytes)
    dropped = ("context", "negatives")
    schema = T.StructType(
        [*[f for f in examples.schema.fields if f.name not in dropped], T.StructField("loss", T.DoubleType())]
    )
    names = [f.name for f in schema.fields[:-1]]
    visited = embedded if len(embedded) > 1 else weights

    def score(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in visited.gather(record_batches, 16 * d):
            flat, offsets = list_parts(batch.column("context"))
            means, n = _means(embedded, flat.to_numpy(zero_copy_only=False), offsets)
            center = batch.column("center").to_numpy(zero_copy_only=False)
            drawn, bounds = list_parts(batch.column("negatives"))
            loss, known = _candidate_loss(weights, means, center, drawn.to_numpy(zero_copy_only=False), bounds, criterion)
            yield scored(batch, loss, known & (n > 0))

    def score_all(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = None
        for batch in visited.gather(record_batches, EXAMPLE_BYTES, together=True):
            far = far or furthest(weights)
            flat, offsets = list_parts(batch.column("context"))
            center = batch.column("center").to_numpy(zero_copy_only=False)
            yield scored(batch, *_whole_softmax(embedded, weights, flat.to_numpy(zero_copy_only=False), offsets, center, far))

    def scored(batch: pa.RecordBatch, loss: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[batch.column(name) for name in names], pa.array(loss, mask=~known)], names=[*names, "loss"])

    return examples.mapInArrow(score_all if criterion == "softmax" else score, schema)


def _means(embedded: Blocks, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the vectors of each example's ids and how many ids have one."""
    means, n = _sums(embedded, flat, offsets)
    means /= np.maximum(n, 1)[:, None]
    return means, n


def _whole_softmax(
    embedded: Blocks, weights: Blocks, flat: np.ndarray, offsets: np.ndarray, center: np.ndarray, far: tuple[float, float]
) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each example and whether it has one: of windows by products, of the others through their logits."""
    m = len(center)
    loss, known, left = np.zeros(m), np.zeros(m, bool), np.ones(m, bool)
    for windows, vectors, at in find_windows(flat, offsets, center, embedded, far):
        loss[at], known[at] = window_loss(weights, windows, vectors)
        left[at] = False
    at, lengths = np.flatnonzero(left), np.diff(offsets)
    for lo in range(0, len(at), OTHERS):
        some = at[lo : lo + OTHERS]
        size = lengths[some]
        ends = np.concatenate([[0], np.cumsum(size)])
        means, n = _means(embedded, flat[np.repeat(offsets[some] - ends[:-1], size) + np.arange(ends[-1])], ends)
        loss[some], known[some] = _softmax_loss(weights, means, center[some])
        known[some] &= n > 0
    return loss, known


def _output_block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return rows["id"].to_numpy(), vector_rows(rows), rows["bias"].to_numpy(), rows["prob"].to_numpy()


def _softmax_loss(weights: Blocks, means: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each example and whether its centre has weights.

    Logits exist in tiles that stay in a core's cache. What is taken off them before they are raised is a bound of theirs by
    lengths of vectors, which the product brings along; only where that is far from the logits, their own maximum.
    """
    m = len(means)
    peak, total, own = np.full(m, -np.inf), np.zeros(m), np.zeros(m)
    known = np.zeros(m, bool)
    lengths = np.linalg.norm(means, axis=1)
    for ids, matrix, bias, _ in weights.visit():
        if not len(ids) or not means.shape[1]:
            continue
        for left in range(0, len(ids), TILE[1]):
            part = matrix[left : left + TILE[1]].astype(np.float64)
            some = bias[left : left + TILE[1]]
            reach = lengths * np.linalg.norm(part, axis=1).max()
            bound = reach + some.max()
            near = bound - some.min() + reach < 500  # else, or where it is no number, the slower way
            wide = np.concatenate([part, some[:, None], np.ones((len(part), 1))], axis=1).T
            for lo in range(0, m, TILE[0]):
                rows = slice(lo, lo + TILE[0])
                quick = near[rows].all()
                taken = bound[rows] if quick else np.zeros(len(means[rows]))
                logits = np.concatenate([means[rows], np.ones((len(taken), 1)), -taken[:, None]], axis=1) @ wide
                top = np.maximum(peak[rows], taken if quick else logits.max(axis=1))
                logits += (taken - top)[:, None]
                total[rows] = total[rows] * np.exp(peak[rows] - top) + np.exp(logits, out=logits).sum(axis=1)
                peak[rows] = top
        here, place = places(ids, center)
        at = np.flatnonzero(here)
        for lo in range(0, len(at), EXAMPLES):
            some, rows = at[lo : lo + EXAMPLES], place[lo : lo + EXAMPLES]
            own[some] = np.einsum("ij,ij->i", means[some], matrix[rows].astype(np.float64)) + bias[rows]
        known |= here
    with np.errstate(divide="ignore", invalid="ignore"):
        return peak + np.log(total) - own, known


def _candidate_loss(
    weights: Blocks, means: np.ndarray, center: np.ndarray, drawn: np.ndarray, bounds: np.ndarray, criterion: str
) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each example over its centre and its negatives, and whether the centre has weights."""
    m, lengths = len(means), np.diff(bounds)
    owner = np.concatenate([np.arange(m), np.repeat(np.arange(m), lengths)])
    wanted = np.concatenate([center, drawn])
    logits, prob, known = np.zeros(len(wanted)), np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    for ids, matrix, bias, share in weights.visit():
        here, place = places(ids, wanted)
        at = np.flatnonzero(here)
        for lo in range(0, len(at), ROWS):
            part, rows = at[lo : lo + ROWS], place[lo : lo + ROWS]
            logits[part] = np.einsum("ij,ij->i", means[owner[part]], matrix[rows].astype(np.float64)) + bias[rows]
            prob[part] = share[rows]
        known |= here
    own, others, user = logits[:m], logits[m:], owner[m:]
    if criterion == "negative":
        # log(1 + exp(-x)) for the centre, log(1 + exp(x)) for a negative
        loss = np.logaddexp(0.0, -own)
        np.add.at(loss, user, np.where(known[m:], np.logaddexp(0.0, others), 0.0))
        return loss, known[:m]
    with np.errstate(divide="ignore"):
        corrected = logits - np.log(np.concatenate([np.maximum(lengths, 1), np.repeat(lengths, lengths)]) * prob)
    corrected = np.where(known & (prob > 0), corrected, -np.inf)
    peak = corrected[:m].copy()
    np.maximum.at(peak, user, corrected[m:])
    with np.errstate(invalid="ignore"):
        total = np.exp(corrected[:m] - peak)
        np.add.at(total, user, np.exp(corrected[m:] - peak[user]))
        return peak + np.log(total) - corrected[:m], known[:m] & (prob[:m] > 0)


def mean_loss(scored: DataFrame, batch: str | None = None) -> DataFrame:
    """Mean cross-entropy; with a batch column the mean of the batch means."""
    if batch is None:
        return scored.agg(F.avg("loss").alias("loss"))
    return scored.groupBy(batch).agg(F.avg("loss").alias("loss")).agg(F.avg("loss").alias("loss"))
