"""Registered queries of this subpackage, each over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import bpe, fagin, host_rules, language, licenses, lsh_forest, mixing, preferences, repeats, sharding, sketches, turn_trie, whitening
from wordloom.llm.twins import ORACLES  # noqa: F401
from wordloom.session import spread


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_texts(_table(spark, sf, "documents"), 8, ["doc_id"])


def op2_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents"), ["doc_id"]).drop("times")


def op3_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return fagin.top_k(_table(spark, sf, "embeddings"), 5)


def op4_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.compare_with_edit(_table(spark, sf, "documents"))


def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = language.fold(F.col("doc_id")) == 0
    model = language.train(docs.filter(~held_out))
    found = language.predict(spread(docs.drop("lang")), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.digest(spread(_table(spark, sf, "documents").select("doc_id", "text")))


def op7_preferences(spark: SparkSession, sf: str) -> DataFrame:
    return preferences.answer_pairs(_table(spark, sf, "conversations"))


def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers as vocabularies

    path = vocabularies.path("byte_bpe_50k.tiktoken")
    docs = spread(_table(spark, sf, "documents").select("doc_id", "text"))
    ids = bpe.encode(docs, path, vocabularies.PATTERN).drop("text")
    return bpe.decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return lsh_forest.groups(spread(_table(spark, sf, "documents").select("doc_id", "text")))


def op10_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(spread(_table(spark, sf, "documents").select("doc_id", "text")), ["doc_id"])


def op11_turn_trie(spark: SparkSession, sf: str) -> DataFrame:
    return turn_trie.shared_beginnings(_table(spark, sf, "conversations")).drop("turn_key")


def op12_host_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The documents name no page; their source stands for the host."""
    return host_rules.judge(spread(_table(spark, sf, "documents").select("doc_id", "source", "text")), ["doc_id"], "source")


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten_embeddings(_table(spark, sf, "embeddings"), ["vec_id"])


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mix_sources": op2_mix_sources,
    "op3_top_k": op3_top_k,
    "op4_fingerprints": op4_fingerprints,
    "op5_language": op5_language,
    "op6_repeats": op6_repeats,
    "op7_preferences": op7_preferences,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_licenses": op10_licenses,
    "op11_turn_trie": op11_turn_trie,
    "op12_host_rules": op12_host_rules,
    "op13_whitening": op13_whitening,
}
