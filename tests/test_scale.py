"""What keeps memory, tasks and shuffles bounded, on small tables."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom import streaming
from wordloom.operators import blocks as bl
from wordloom.operators import examples as ex
from wordloom.operators import training as tn
from wordloom.operators import vectors as vc
from wordloom.operators import vocabulary as vb
from wordloom.operators.encoding import Encoder, decode
from wordloom.plans.catalog import DOCUMENTS
from wordloom.session import BATCH_BYTES, BATCH_ROWS, SHUFFLE_CLEANUP, materialize
from wordloom.sources.corpora import Corpus, read_corpus


class Shipped:
    """Blocks without a broadcast."""

    def __init__(self, *parts):
        self.parts = parts

    def visit(self):
        return iter(self.parts)


@pytest.mark.parametrize("files", [1, 3])
def test_a_stream_reads_a_table_of_one_or_many_files(spark, sf, tmp_path, files):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = f"{sf}/documents.parquet"
    if files > 1:
        path = str(tmp_path / "documents.parquet")
        docs.repartition(files).write.parquet(path)
    stream = streaming.table_stream(spark, path, DOCUMENTS, "text", "doc_id")
    streaming.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == docs.count() and found.select("record_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_word_vectors_are_fitted_in_tasks_by_words(spark, monkeypatch):
    class Told(Exception):
        pass

    def trainer(**options):
        raise Told(options["numPartitions"])

    monkeypatch.setattr(vc, "Word2Vec", trainer)
    monkeypatch.setattr(vc, "WORDS_PER_TASK", 10)
    few_but_long = spark.createDataFrame([(["a"] * 25,), ([],), (None,)], "tokens array<string>")
    with pytest.raises(Told, match="3"):
        vc.train_vectors(few_but_long)


def test_rows_that_visit_blocks_together_count_what_is_made_of_them():
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1000))], names=["x"])
    blocks = bl.Blocks([None, None])
    sizes = [b.num_rows for b in blocks.gather(iter([batch] * 100), 8 * bl.HELD_BYTES // 8000)]
    assert sum(sizes) == 100_000 and max(sizes) <= 9000


def test_losses_hold_a_tile_of_logits():
    draw = np.random.default_rng(5)
    matrix, bias = draw.normal(size=(5000, 16)).astype(np.float32), draw.normal(size=5000)
    means, center = draw.normal(size=(2000, 16)), draw.integers(0, 6000, 2000)
    means[7] *= 1000  # where a bound of the logits is far from them
    block = np.arange(5000), matrix, bias, np.ones(5000)
    tracemalloc.start()
    loss, known = vc._softmax_loss(Shipped(block), means, center)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6
    logits = means @ matrix.T.astype(float) + bias
    top = logits.max(axis=1)
    expected = top + np.log(np.exp(logits - top[:, None]).sum(axis=1)) - logits[np.arange(2000), np.minimum(center, 4999)]
    assert (known == (center < 5000)).all() and loss[known] == pytest.approx(expected[known], rel=1e-12, abs=1e-9)


def test_sums_of_contexts_hold_a_few_examples():
    draw = np.random.default_rng(6)
    matrix = draw.normal(size=(500, 64)).astype(np.float32)
    lengths = draw.integers(0, 17, 40_000)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = draw.integers(0, 700, offsets[-1])
    parts = [(np.arange(lo, lo + 250), matrix[lo : lo + 250]) for lo in (0, 250)]
    tracemalloc.start()
    total, n = vc._sums(Shipped(*parts), flat, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < total.nbytes + 30e6
    for i in range(0, 40_000, 997):
        ids = flat[offsets[i] : offsets[i + 1]]
        ids = ids[ids < 500]
        assert n[i] == len(ids) and total[i] == pytest.approx(matrix[ids].sum(axis=0, dtype=float), abs=1e-9)


def test_batches_are_bounded_whatever_the_session_says(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "record_id int, text string")
    v = vb.Vocabulary(vb.word_counts(vb.tokenize_corpus(docs)), min_freq=1, special_tokens=["<S>", "</S>"])
    for use in (lambda: Encoder(v).encode(docs), lambda: decode(docs.withColumn("ids", F.array(F.lit(1))), v)):
        spark.conf.set(key, str(64 * BATCH_BYTES))
        use()
        assert int(spark.conf.get(key)) == BATCH_BYTES


def test_changes_are_added_up_before_they_meet(spark):
    weights = spark.createDataFrame([(i, [1.0 * i, 2.0], [0.0, 3.0], 0.5) for i in range(4)], tn.WEIGHTS)
    rows = [(1, [1.0, 1.0], None, None), (1, [3.0, 5.0], [1.0, 1.0], 2.0), (2, None, [4.0, 6.0], 1.0), (2, None, [0.0, 0.0], 0.0), (None, None, None, None)]
    found = spark.createDataFrame(rows, tn.WEIGHTS).repartition(3)
    moved = tn._moved(weights, found, 2)
    assert "Generate" not in moved._jdf.queryExecution().executedPlan().toString()  # no row per number
    got = {r.id: (r.vector, r.output, r.bias) for r in moved.collect()}
    assert got == {0: ([0, 2], [0, 3], 0.5), 1: ([3, 5], [1, 4], 2.5), 2: ([2, 2], [2, 6], 1.0), 3: ([3, 2], [0, 3], 0.5)}
    assert [r.x for r in _sums_of(found, 2)] == [[4, 6, 1, 1, 2], [0, 0, 4, 6, 1]]


def _sums_of(found, d):
    """The changes added up in pieces of one id at most."""
    none = F.array_repeat(F.lit(0.0), d)
    whole = F.concat(F.coalesce(F.col("vector").cast("array<double>"), none), F.coalesce(F.col("output").cast("array<double>"), none), F.array(F.coalesce(F.col("bias").cast("double"), F.lit(0.0))))
    rows = found.filter("id IS NOT NULL").select("id", whole.alias("x"), F.lit(1).cast("bigint").alias("n_in"), F.lit(1).cast("bigint").alias("n_out"))
    schema = "id int, x array<double>, n_in bigint, n_out bigint"
    return rows.mapInArrow(tn._added(d, 1), schema).repartition(1).mapInArrow(tn._added(d), schema).orderBy("id").collect()


def test_words_of_simple_texts_are_the_same_either_way(spark):
    draw = np.random.default_rng(7)
    texts = ["".join(draw.choice(list("ab9_.'~`-!@[  \t\né\x07"[: 13 + 6 * (i % 2)]), 12)) for i in range(500)]
    from wordloom.functions.text import PUNCTUATION, WORD_CHARS, split_words

    pattern = f"[{PUNCTUATION}]|[{WORD_CHARS}]+|[^\\s\\p{{Z}}{PUNCTUATION}{WORD_CHARS}]+"
    found = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string").select(
        split_words("t").alias("quick"), F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("plain")
    )
    assert found.filter(~F.col("quick").eqNullSafe(F.col("plain"))).count() == 0


def test_a_batch_visits_one_block_in_pieces():
    texts = ["x" * 1000] * 8000
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(np.arange(8000))], names=["text", "i"])
    pieces = list(bl.Blocks([None]).gather(iter([batch, batch.slice(0, 0)])))
    assert max(p.nbytes for p in pieces) <= bl.PIECE_BYTES and len(pieces) < 8
    assert pa.Table.from_batches(pieces).column("i").to_pylist() == list(range(8000))


def test_the_shuffles_behind_a_written_table_go_with_it(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    shuffles = lambda: {f for f in files().split() if "shuffle_" in f}
    before, setting = shuffles(), spark.conf.get(SHUFFLE_CLEANUP, "false")
    found = materialize(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("g")).count(), "shuffled")
    for _ in range(50):
        left = shuffles() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(SHUFFLE_CLEANUP, "false") == setting
    assert sum(r["count"] for r in found.collect()) == 1000


def test_short_records_go_without_a_second_look_at_their_texts(spark):
    docs = spark.createDataFrame([(1, "café au lait"), (2, "é"), (3, "a b c d"), (4, None)], "record_id long, text string")
    v = vb.Vocabulary(vb.word_counts(vb.tokenize_corpus(docs)), special_tokens=["<S>", "</S>"])
    thin = ex.thinned_sequences(docs, Encoder(v), n=2, t=1.0)
    assert {r.record_id: len(r.ids) for r in thin.collect()} == {1: 5, 3: 6}
    plan = thin._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_texts_of_a_corpus_reach_python_in_bounded_batches(spark, sf):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "10000")  # as in a session of a user's own
    try:
        read_corpus(spark, sf, Corpus(path="documents.parquet", record_id="doc_id"))
        assert int(spark.conf.get(size)) == BATCH_ROWS
    finally:
        spark.conf.set(size, before)
