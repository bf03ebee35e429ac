"""Arriving documents: cleaning, encoding and a growing vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wordloom.operators.encoding import Encoder
from wordloom.operators.reshape import select_key
from wordloom.operators.vocabulary import merge_counts, tokenize_corpus, word_counts
from wordloom.schemas import COUNTS
from wordloom.sources.corpora import apply_steps

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, key: str, record_id: str, glob: str = "*.parquet"
) -> DataFrame:
    """Documents from Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 1000)
    return select_key(reader.parquet(folder), key, record_id)


def table_stream(spark: SparkSession, path: str, schema: T.StructType, key: str, record_id: str) -> DataFrame:
    """Documents of a Parquet table as they arrive: a folder of files, or one file, whose folder may hold other tables."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return read_stream(spark, path, schema, key, record_id)
    return read_stream(spark, at.getParent().toString(), schema, key, record_id, at.getName())


def clean_stream(stream: DataFrame, steps: Sequence[Callable]) -> DataFrame:
    """The cleaning chain of a recipe; it keeps no state."""
    return apply_steps(stream, steps)


def encode_stream(stream: DataFrame, encoder: Encoder) -> DataFrame:
    """Encode arriving documents against a fixed vocabulary of any size, batch by batch, without state. The
    vocabulary travels in blocks, so a large one needs no other way."""
    return encoder.encode(stream)


def running_counts(stream: DataFrame) -> DataFrame:
    """Counts of all words so far, as a stateful aggregation in update or complete mode.

    The state holds every distinct word; :func:`use_disk_state` puts it on disk. Where
    the lexicon grows without end use :func:`collect_counts`, which keeps no state.
    """
    return word_counts(tokenize_corpus(stream))


def use_disk_state(spark: SparkSession) -> None:
    """Keep the state of queries that start from now on in RocksDB, with changelogs: memory does not grow with the state, and
    a micro-batch uploads what it changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def keep_running_counts(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the running counts of the words that each micro-batch changes to a folder of its own below ``path``.

    The counts themselves are state below ``checkpoint``, from which a stopped query goes on. A batch that
    runs again overwrites its folder with the same rows.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = running_counts(stream).writeStream.outputMode("update").foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_total(spark: SparkSession, path: str) -> DataFrame:
    """``(word, cnt)`` after the last batch: counts only grow, so the greatest of a word is its last."""
    return spark.read.schema(COUNTS).parquet(path).groupBy("word").agg(F.max("cnt").alias("cnt"))


def compact_running(spark: SparkSession, path: str, out: str, upto: int) -> int:
    """Fold the folders of the batches up to ``upto`` into one at a new place, and copy the later ones there as they are,
    so that ``out`` reads like ``path``. Returns the number of folders that were folded."""
    batches = spark.read.schema("word string, cnt bigint, batch_id bigint").parquet(path)
    old = batches.filter(F.col("batch_id") <= upto)
    n = old.select("batch_id").distinct().count()
    old.groupBy("word").agg(F.max("cnt").alias("cnt")).write.mode("errorifexists").parquet(f"{out}/batch_id={upto}")
    batches.filter(F.col("batch_id") > upto).write.mode("append").partitionBy("batch_id").parquet(out)
    return n


def collect_counts(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the word counts of each micro-batch as a table of its own below ``path``.

    A batch that runs again after a failure overwrites its own folder, so each document
    counts once. Nothing accumulates in the query; totals form on reading.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        counted = word_counts(tokenize_corpus(batch))
        counted.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def collected_counts(spark: SparkSession, path: str) -> DataFrame:
    """Total counts over all batches so far."""
    return merge_counts([spark.read.schema(COUNTS).parquet(path)])


def compact_counts(spark: SparkSession, path: str, out: str) -> None:
    """Fold the batches so far into one table at a new place."""
    collected_counts(spark, path).write.mode("errorifexists").parquet(f"{out}/batch_id=0")


def append_stream(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the rows of a stateless stream to a Parquet table."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
