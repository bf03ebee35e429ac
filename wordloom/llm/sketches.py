"""Document fingerprints: the k smallest shingle hashes of a text.

A fingerprint is a text of 16 hex digits per hash, in rising order. It depends on the set of
shingles only; fingerprints of parts merge into that of the whole. Two of them estimate the
resemblance and containment of their texts, one the number of distinct shingles.

Defined cases: a null text counts as empty; a text without words has an empty fingerprint; two
empty fingerprints resemble each other fully, an empty and another not at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wordloom.llm.common import RollingHash, bounded_batches, shingle_sets
from wordloom.session import local_table

K = 128
SHINGLE = 5
NULL_BUCKETS = 256


def bottom(texts: list[bytes], k: int = K, shingle: int = SHINGLE, roll: RollingHash | None = None) -> list[np.ndarray]:
    return [s[:k] for s in shingle_sets(texts, shingle, roll or RollingHash())]


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / max(float(a[k - 1]), 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    union = np.union1d(a, b)
    if len(a) >= k or len(b) >= k:
        union = union[:k]
    if not len(union):
        return 1.0
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(common <= union[-1])) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    union, r = distinct(merged(a, b, k), k), resemblance(a, b, k)
    return min(1.0, r * union / distinct(a, k)) if len(a) else 1.0


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Add the fingerprint of ``text``."""
    bounded_batches(df.sparkSession)

    @pandas_udf("string")
    def sketch(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        roll = RollingHash()
        for texts in parts:
            yield pd.Series([as_text(s) for s in bottom([(t or "").encode() for t in texts], k, shingle, roll)], dtype=object)

    return df.withColumn(name, sketch(F.col(text)))


def merge(df: DataFrame, by: list[str], fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint per group: partial merges of at most ``k`` hashes on each side of the shuffle, salted twice."""

    @pandas_udf("string")
    def union(parts: pd.Series) -> str:
        out = np.zeros(0, np.uint64)
        for part in parts:
            out = merged(out, from_text(part or ""), k)
        return as_text(out)

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(fingerprint), F.lit(1024)).cast("int"))
    unique = salted.select(*by, "_salt", fingerprint).distinct()
    once = unique.groupBy(*by, "_salt").agg(union(F.col(fingerprint)).alias(fingerprint))
    return once.groupBy(*by).agg(union(F.col(fingerprint)).alias(fingerprint))


def _with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, carrier, sorted in every partition by bucket and then descending
    doc_id, null ids last; each bucket ends with a carrier row, the first row of the bucket after it
    (after the last: of the first). Equal ids follow the hash of their texts."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    cuts = rows.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = np.unique(np.array(cuts, np.float64)).astype(np.int64)

    @pandas_udf("int")
    def bucket(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        known = ids.fillna(0).astype(np.int64).to_numpy()
        falling = len(cuts) - np.searchsorted(cuts, known, side="right")
        null = len(cuts) + 1 + (hashes.to_numpy() >> 56) + NULL_BUCKETS // 2
        return pd.Series(np.where(ids.isna().to_numpy(), null, falling).astype(np.int32))

    rows = rows.withColumn("bucket", bucket("doc_id", "h"))
    heads = rows.groupBy("bucket").agg(F.min(F.struct((-F.col("doc_id")).alias("d"), "h")).alias("x")).orderBy("bucket").collect()
    before = {heads[i].bucket: heads[i - 1].bucket for i in range(len(heads))}
    table = local_table(
        spark,
        [(r.bucket, None if r.x.d is None else -r.x.d, r.x.h, before[r.bucket]) for r in heads],
        "b int, d bigint, hh bigint, before int",
    )
    # one row per bucket, and there are no more buckets than partitions and NULL_BUCKETS
    same = (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh"))
    carriers = rows.join(F.broadcast(table), same).dropDuplicates(["b"])
    carriers = carriers.select("doc_id", "text", "h", F.col("before").alias("bucket"), F.lit(True).alias("carrier"))
    both = rows.withColumn("carrier", F.lit(False)).unionByName(carriers)
    return (
        both.repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "carrier", F.desc_nulls_last("doc_id"), "h")
        .select("doc_id", "text", "carrier")
    )


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edit(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint every text and its edited form, the last third replaced by the start of the next text."""
    bounded_batches(docs.sparkSession)
    sha = hashlib.sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash()
        held: list[tuple] = []
        for batch in batches:
            fresh = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            sketches = bottom([t.encode() for _, t, _ in fresh], k, shingle, roll)
            rows = held + [(*row, s) for row, s in zip(fresh, sketches)]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[2]]
            held = rows[-1:]
            edits = [a[1][: len(a[1]) - len(a[1]) // 3] + b[1][: len(a[1]) // 3] for a, b in pairs]
            data = [e.encode() for e in edits]
            edited = bottom(data, k, shingle, roll)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                    pa.array([sha(e).hexdigest() for e in data], pa.string()),
                    pa.array([as_text(a[3]) for a, _ in pairs], pa.string()),
                    pa.array([as_text(e) for e in edited], pa.string()),
                    pa.array([resemblance(a[3], e, k) for (a, _), e in zip(pairs, edited)], pa.float64()),
                    pa.array([resemblance(a[3], b[3], k) for a, b in pairs], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return _with_next(docs).mapInArrow(run, SCHEMA)
