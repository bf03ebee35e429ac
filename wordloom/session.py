"""Session settings, shared scratch folders and the two size checks used everywhere."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

# A table travels to every executor only when it was measured below this many bytes.
MAX_BROADCAST_BYTES = 256 * 1024 * 1024

# What a Python worker is handed at a time; its arrays take several times as much.
BATCH_ROWS = 2048
BATCH_BYTES = 8 * 1024 * 1024

# Shuffle files of a query that has ended go at once, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # long documents: bound an Arrow batch by bytes as well as by rows
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
}


def spark_session(app: str = "wordloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume; ``spark-submit`` supplies the rest."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the storage all executors can see.

    Only a local session may go without that setting; it then gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="wordloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from files,
    so a lost executor costs one task, not the whole lineage, and the shuffles behind the files go at once."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.materialized_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from :func:`materialize`. Only when all that was made of them is
    written itself: a lost executor's share is computed anew from its inputs."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.materialized_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str, at_least: int = 0) -> DataFrame:
    """Give text-heavy work at least one partition per core, or ``at_least`` so many.

    A small input may arrive as one split. A big one has far more splits than cores and
    passes through untouched, so this adds no shuffle at scale. Call it on a scan.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > max(cores, at_least - 1):
        return df
    return df.repartition(max(2 * cores, at_least), *keys)


def local_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A small table of literals. Going through Arrow makes it a local relation, whose size
    the planner knows."""
    if isinstance(schema, str):
        schema = _parse_datatype_string(schema)
    names = [f.name for f in schema.fields]
    table = pa.Table.from_pylist([dict(zip(names, row)) for row in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def measured_bytes(df: DataFrame) -> int:
    """Text bytes plus eight per row and column: the size that a broadcast would ship."""
    width = F.lit(8 * len(df.columns))
    for field in df.schema.fields:
        if field.dataType.typeName() == "string":
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif field.dataType.typeName() == "array":
            width = width + 8 * F.greatest(F.coalesce(F.size(field.name), F.lit(0)), F.lit(0))
    return df.agg(F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()[0]
