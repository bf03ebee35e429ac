"""The corpus pipeline: identify languages, drop near duplicates, cut repeated passages, mix sources, tokenize.

Each stage takes the documents that its predecessor wrote and returns what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import bpe, language, lsh_forest, mixing, repeats
from wordloom.llm.common import free_name
from wordloom.session import materialize, spread

# Share of a text's n-grams that its language knows, below which it is no text in any of them. Held-out documents of scales
# 0.001 to 0.1 had 0.52 and more, passages in six other languages up to 0.29, random letters up to 0.04.
MIN_SCORE = 0.4
SHORT = 8  # letters, below which a text has too few n-grams to be rejected for them


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that the labelled documents of the other half teach, and those too
    short to tell; null texts and those without letters go."""
    predicted, share = free_name(docs, "predicted", "share")
    found = language.predict_held_out(spread(docs), names=(predicted, share))
    short = F.length(F.regexp_replace("text", r"\P{L}+", "")) < SHORT
    return found.filter((F.col(predicted) != language.UNKNOWN) & ((F.col(share) >= MIN_SCORE) | short)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarities of at least 0.8; those without words all stay."""
    return lsh_forest.one_per_group(spread(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the strings of 100 bytes that also start earlier; a null text stays null, a copy becomes empty."""
    return repeats.cut_documents(spread(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole; those it does not take go, and so do those without words."""
    mixed = mixing.mix(docs, docs.columns)
    times = mixed.columns[-1]
    taken = mixed.filter(F.col(times) > 0)
    (copy,) = free_name(docs, "copy")
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their tokens (``ids``, or a free name like it) and the text that these decode to; a null
    text has no ids and becomes empty."""
    import public_tokenizers as vocabularies

    path = vocabularies.path("byte_bpe_50k.tiktoken")
    ids, decoded = free_name(docs, "ids", "decoded")
    encoded = bpe.encode(spread(docs), path, vocabularies.PATTERN, ids=ids)
    return bpe.decode(encoded.drop("text"), path, ids, decoded).withColumn("text", F.col(decoded).cast("string")).drop(decoded)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mix", mix_sources),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
