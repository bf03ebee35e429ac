"""Named corpora and prepared tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.text import parse_sentences
from wordloom.operators.joins import attach
from wordloom.operators.ranking import row_numbers
from wordloom.operators.reshape import map_records, select_key
from wordloom.schemas import N_SHARDS
from wordloom.session import bounded_batches, discard, materialize, spread


@dataclass(frozen=True)
class Corpus:
    """Where a corpus lies below a data root, and how to read it.

    ``where`` selects rows of a table that holds several corpora; the scan gets it as a
    pushed filter. Without ``record_id`` rows are named by their content.
    """

    path: str
    subset: str | None = None
    format: str = "parquet"
    key: str = "text"
    record_id: str | None = None
    where: str | None = None
    recipe: str = "commoncrawl"
    options: Mapping[str, str] = field(default_factory=dict)

    @property
    def prefix(self) -> str:
        return f"{self.path}/{self.subset}" if self.subset else self.path


# fixed values: the managed corpora
MANAGED = {
    "bookcorpus": Corpus(path="bookcorpus", recipe="bookcorpus"),
    "commoncrawl": Corpus(path="c4", subset="realnewslike", recipe="commoncrawl"),
    "wikipedia": Corpus(path="wikimedia/wikipedia", subset="20231101.en", recipe="wikipedia"),
}


def read_corpus(
    spark: SparkSession, root: str, corpus: Corpus | str, split: str | None = None, key: str | None = None,
    ids: str = "content",
) -> DataFrame:
    """``(record_id, text)`` of one corpus. Files carry the text column, and the id column
    if one is named; nothing else is read and nothing is inferred.

    Without an id column records are named by their content, see :func:`content_ids`: the same texts get the
    same ids from another file layout, at the price of a shuffle. ``ids="storage"`` names them by
    file and row instead, which costs nothing and holds as long as the files do."""
    corpus = MANAGED[corpus] if isinstance(corpus, str) else corpus
    key = key or corpus.key
    bounded_batches(spark)  # text functions hand texts to Python long before an operator does
    path = "/".join(p for p in (root, corpus.prefix, split) if p)
    reader = spark.read.options(**corpus.options)
    if corpus.format == "text":
        df = reader.text(path).withColumnRenamed("value", key)
    elif corpus.format in ("parquet", "orc"):
        df = reader.format(corpus.format).load(path)
    else:
        schema = T.StructType([T.StructField(key, T.StringType())])
        if corpus.record_id:
            schema = schema.add(corpus.record_id, T.LongType())
        df = reader.format(corpus.format).schema(schema).load(path)
    if corpus.where:
        df = df.filter(corpus.where)
    if corpus.record_id is None:
        if ids not in ("content", "storage"):
            raise ValueError(f"ids come from content or storage, not {ids}")
        df = storage_ids(df) if ids == "storage" else content_ids(df, key)
    return select_key(df, key, corpus.record_id or "record_id")


def storage_ids(df: DataFrame) -> DataFrame:
    """Add ``record_id``, 64 bits of a row's file and its place in the file. Formats that tell no place of a row have content ids only."""
    return df.withColumn("record_id", F.xxhash64("_metadata.file_path", "_metadata.row_index"))


def content_ids(df: DataFrame, key: str) -> DataFrame:
    """Add ``record_id``, 64 bits of a row's text and of how many equal texts come before it. Which of equal texts is the first
    has no meaning, so retries may number them differently: they are numbered by a table that is written first.

    Only the hashes are counted and numbered, a text that is a third of the corpus in pieces.
    """
    (hashed, copy) = ("_text_hash", "_copy")
    rows = df.withColumn(hashed, F.xxhash64(key))
    again = rows.groupBy(F.col(hashed).alias("_again")).agg(F.count("*").alias("_times")).filter("_times > 1")
    again = materialize(again, "repeated-texts")
    if again.isEmpty():
        return rows.withColumn("record_id", F.xxhash64(hashed, F.lit(0).cast("bigint"))).drop(hashed)
    rows = materialize(rows.withColumn(copy, F.monotonically_increasing_id()), "hashed-texts")
    marked = attach(rows.select(hashed, copy), again, hashed, "_again").filter("_times IS NOT NULL").select(hashed, copy)
    numbers = row_numbers(materialize(marked, "copies"), [hashed], copy, "_no").select(F.col(copy).alias("_of"), "_no")
    found = rows.join(numbers, F.col(copy) == F.col("_of"), "left")
    return found.withColumn("record_id", F.xxhash64(hashed, F.coalesce("_no", F.lit(0)).cast("bigint"))).drop(hashed, copy, "_of", "_no")


def apply_steps(df: DataFrame, steps: Sequence[Callable]) -> DataFrame:
    """Run a chain of steps over the text column.

    A step takes the text column, or the whole DataFrame if it is marked by
    :func:`table_step`. A column step that yields an array turns a record into many, with
    ``sent_no`` for the place.
    """
    for step in steps:
        if getattr(step, "takes_table", False):
            df = step(df)
        else:
            position = None if "sent_no" in df.columns else "sent_no"
            df = map_records(df, step, "text", position)
    return df


def table_step(step: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    step.takes_table = True
    return step


def default_steps() -> list[Callable[[Column], Column]]:
    return [parse_sentences]


def prepare(
    corpus: DataFrame,
    save_dir: str,
    steps: Sequence[Callable] | None = None,
    shards: int | None = None,
) -> dict[str, int]:
    """Clean a corpus and save it. Returns the record counts before and after, which the
    writing job observes on its way; no pass is spent on counting.

    The output has the partitions of the input, and at least 32; ``shards`` asks for an exact
    number of files. Rows are spread before the steps either way, so steps, counts and files
    are one stage, in which a repeated task counts once; the exact number of files is dealt out
    afterwards, from what that stage wrote. Saved work is not overwritten.
    """
    before, after = Observation("before"), Observation("after")
    wide = spread(corpus, "record_id", at_least=N_SHARDS)
    seen = wide.observe(before, F.count(F.lit(1)).alias("n"))
    done = apply_steps(seen, default_steps() if steps is None else steps)
    done = done.observe(after, F.count(F.lit(1)).alias("n"))
    stored = materialize(done, "cleaned") if shards else None
    try:
        (stored.repartition(shards) if shards else done).write.mode("errorifexists").parquet(save_dir)
    except AnalysisException as error:
        if error.getCondition() == "PATH_ALREADY_EXISTS":
            raise FileExistsError(f"{save_dir} holds saved work; read it with load_prepared or delete it") from error
        raise
    finally:
        if stored is not None:
            discard(stored)
    return {"before": before.get["n"], "after": after.get["n"]}


def load_prepared(spark: SparkSession, root: str, corpus: Corpus | str | None = None) -> DataFrame:
    """A prepared corpus, by folder or by its registered name below the root."""
    if corpus is not None:
        corpus = MANAGED[corpus] if isinstance(corpus, str) else corpus
        root = f"{root}/{corpus.prefix}"
    missing = f"no prepared data in {root}; run prepare first"
    try:
        df = spark.read.parquet(root)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(missing) from error
        raise
    return df


def n_records(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_records"))
