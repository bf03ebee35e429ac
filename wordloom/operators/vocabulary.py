"""Word counts and vocabularies with stable ids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.text import parse_words
from wordloom.operators.joins import attach, lookup
from wordloom.operators.reshape import drop_rare, infrequent, member_ngrams, unnest
from wordloom.session import local_table, materialize
from wordloom.schemas import COUNTS, UNK_TOKEN, VOCAB_MIN_FREQ, VOCAB_SIZE, VOCABULARY

# Ids of up to this many words are numbered in one task, on rows already cut to the size.
ONE_TASK_WORDS = 1_000_000

OPTIONS = "size int, min_freq int, unk_token string, special_tokens array<string>"


# -- counting --------------------------------------------------------------------------


def tokenize_corpus(corpus: DataFrame, key: str = "text") -> DataFrame:
    """``(record_id, tokens)`` of a corpus: normalise, then split into words."""
    return corpus.select("record_id", parse_words(key).alias("tokens"))


def word_counts(tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count every token. Partial aggregation runs before the shuffle, so a word that is a
    third of the corpus costs one row per map task."""
    rows = unnest(tokens, F.col("tokens"), "word", keep=by).filter(F.col("word").isNotNull())
    return rows.groupBy(*by, "word").agg(F.count("*").alias("cnt"))


def word_counts_rollup(tokens: DataFrame, by: str) -> DataFrame:
    """Counts per value of ``by`` and, where ``by`` is null, in total."""
    counts = word_counts(tokens, [by])
    total = counts.groupBy("word").agg(F.sum("cnt").alias("cnt"))
    return counts.unionByName(total.withColumn(by, F.lit(None).cast(counts.schema[by].dataType)))


def ngram_counts(tokens: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """Count n-grams built only from ``members`` words."""
    return member_ngrams(tokens, members, n).groupBy("word").agg(F.count("*").alias("cnt"))


def merge_counts(parts: Sequence[DataFrame]) -> DataFrame:
    """Add the counts of several tables in one aggregation."""
    union = reduce(DataFrame.unionByName, [p.select("word", "cnt") for p in parts])
    return union.groupBy("word").agg(F.sum("cnt").cast("bigint").alias("cnt"))


def total_count(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("total"))


def count_frequencies(counts: DataFrame) -> DataFrame:
    """How many words have each count."""
    return counts.groupBy("cnt").agg(F.count("*").alias("n_words"))


# -- ranking ---------------------------------------------------------------------------


def most_common(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent words, ties in alphabetical order, with their rank from 0.

    The histogram of counts gives the lowest count that can make the cut. Filtering by it
    first leaves about ``k`` rows in all, where a plain top-k would send ``k`` rows from
    every partition to one task.
    """
    if k <= 0:
        return counts.limit(0).withColumn("rank", F.lit(0))
    above = Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    lowest = (
        count_frequencies(counts)
        .withColumn("above", F.coalesce(F.sum("n_words").over(above), F.lit(0)))
        .filter(F.col("above") < k)
        .agg(F.coalesce(F.min("cnt"), F.lit(0)))
        .scalar()
    )
    kept = counts.filter(F.col("cnt") >= lowest)
    order = [F.desc("cnt"), F.asc("word")]
    if k <= ONE_TASK_WORDS:
        top = kept.orderBy(*order).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
    return _number_sorted(kept, order).filter(F.col("rank") < k)


def _number_sorted(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rank of every row in the given order, numbered range by range; the table of ranges has a row per task."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranges")  # the numbers must not change between the two uses
    task, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit(2**33 - 1))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(task.alias("_task")).agg((F.max(within) + 1).alias("_n"))
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = ranged.withColumn("_own", task).join(F.broadcast(starts), F.col("_own") == F.col("_task"))
    return placed.withColumn("rank", (F.col("_start") + within).cast("int")).select(*df.columns, "rank")


class Vocabulary:
    """Words with ids: special tokens first, then the most frequent words.

    ``counts`` keeps every word ever seen; the table of ids depends on ``size`` and
    ``min_freq`` and shifts whenever counts change, so an encoded corpus belongs to the
    vocabulary that encoded it. Words below ``min_freq`` hold an id but encode as unknown.
    """

    def __init__(
        self,
        counts: DataFrame,
        size: int = VOCAB_SIZE,
        min_freq: int = VOCAB_MIN_FREQ,
        unk_token: str | None = UNK_TOKEN,
        special_tokens: Sequence[str] | None = None,
    ):
        self.counts = counts.select("word", F.col("cnt").cast("bigint").alias("cnt"))
        self.size = size
        self.min_freq = min_freq
        self.unk_token = unk_token or None
        self.special_tokens = list(special_tokens or [])
        listed = ([self.unk_token] if self.unk_token else []) + self.special_tokens
        self.specials = list(dict.fromkeys(listed))
        self._stored: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession, **options) -> Vocabulary:
        return cls(local_table(spark, [], COUNTS), **options)

    def _with_counts(self, counts: DataFrame) -> Vocabulary:
        return Vocabulary(counts, self.size, self.min_freq, self.unk_token, self.special_tokens)

    # changes give a new vocabulary

    def update(self, *counts: DataFrame) -> Vocabulary:
        """Add counts of any number of tables and renumber."""
        return self._with_counts(merge_counts([self.counts, *counts]))

    def delete(self, *words: str, check: bool = True) -> Vocabulary:
        """Remove words and renumber. Unknown words are an error unless ``check`` is off."""
        wanted = local_table(self.counts.sparkSession, [(w,) for w in words], "word string")
        if check:
            missing = wanted.join(self.counts, "word", "left_anti").limit(1).collect()
            if missing:
                raise KeyError(missing[0].word)
        return self._with_counts(self.counts.join(F.broadcast(wanted), "word", "left_anti"))

    # tables

    @property
    def table(self) -> DataFrame:
        """``(id, word, cnt, is_special, is_infrequent)``, at most ``size`` rows."""
        if self._stored is not None:
            return self._stored
        spark = self.counts.sparkSession
        first = len(self.specials)
        words = self.counts.filter(~F.col("word").isin(self.specials)) if self.specials else self.counts
        ranked = most_common(words, self.size - first).select(
            (F.col("rank") + first).cast("int").alias("id"),
            "word",
            "cnt",
            F.lit(False).alias("is_special"),
            infrequent("cnt", self.min_freq).alias("is_infrequent"),
        )
        heads = local_table(spark, [(i, word, None, True, False) for i, word in enumerate(self.specials)], VOCABULARY)
        return heads.unionByName(ranked)

    @property
    def infrequent(self) -> DataFrame:
        """Words below the minimum frequency, over all counts rather than the table."""
        return self.counts.filter(infrequent("cnt", self.min_freq)).select("word", "cnt")

    @property
    def encodable(self) -> DataFrame:
        """``(word, id)`` of the words that encode as themselves."""
        return self.table.filter(~F.col("is_infrequent")).select("word", "id")

    @property
    def special_table(self) -> DataFrame:
        return self.table.filter("is_special").select("id", "word")

    def length(self) -> DataFrame:
        """Number of ids, with special and infrequent words."""
        return self.table.agg(F.count("*").alias("length"))

    # lookups over a column of words or ids

    @property
    def unk_id(self) -> int | None:
        return self.specials.index(self.unk_token) if self.unk_token else None

    def _lookup(self, df: DataFrame, word: str, columns: Sequence[str], table: DataFrame) -> DataFrame:
        """Left join of words with columns of the id table."""
        return lookup(df, table.select(F.col("word").alias("_word"), *columns), word, "_word", self.size)

    def word_to_id(self, df: DataFrame, word: str = "word", strict: bool = False) -> DataFrame:
        """Add ``id``; a miss gives the unknown id, or fails if there is none or if strict."""
        joined = self._lookup(df, word, ["id"], self.encodable)
        return joined.withColumn("id", self._or_unknown(F.col("id"), F.col(word), strict))

    def _or_unknown(self, found: Column, word: Column, strict: bool) -> Column:
        if self.unk_id is not None and not strict:
            return F.coalesce(found, F.lit(self.unk_id))
        failure = F.raise_error(F.concat(F.lit("unknown word: "), F.coalesce(word, F.lit("null")))).cast("int")
        return F.when(found.isNotNull(), found).otherwise(failure)

    def missing(self, df: DataFrame, word: str = "word") -> DataFrame:
        """Rows whose word does not encode as itself."""
        right = self.encodable.select(F.col("word").alias("_word"))
        return lookup(df, right, word, "_word", self.size, "left_anti")

    def contains(self, df: DataFrame, word: str = "word") -> DataFrame:
        joined = self._lookup(df, word, ["_id"], self.encodable.withColumnRenamed("id", "_id"))
        return joined.withColumn("in_vocab", F.col("_id").isNotNull()).drop("_id")

    def word_frequency(self, df: DataFrame, word: str = "word") -> DataFrame:
        """Add ``cnt``, zero for unseen words."""
        joined = attach(df, self.counts.select(F.col("word").alias("_word"), "cnt"), word, "_word")
        return joined.withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("bigint")))

    def id_to_word(self, df: DataFrame, id: str = "id") -> DataFrame:
        """Add ``word``. Negative ids count from the end; ids out of range give the unknown
        token, or fail if there is none."""
        numbered = self.table.select(F.col("id").alias("_id"), "word")
        length = self.table.agg(F.count("*").cast("int")).scalar()
        wanted = F.when(F.col(id) < 0, F.col(id) + length).otherwise(F.col(id))
        joined = lookup(df.withColumn("_wanted", wanted), numbered, "_wanted", "_id", self.size)
        if self.unk_token:
            word = F.coalesce("word", F.lit(self.unk_token))
        else:
            failure = F.raise_error(F.concat(F.lit("no word has the id "), F.coalesce(F.col(id).cast("string"), F.lit("null"))))
            word = F.when(F.col("word").isNotNull(), F.col("word")).otherwise(failure.cast("string"))
        return joined.withColumn("word", word).drop("_wanted")

    def __getitem__(self, item: int | str) -> int | str:
        """Id of one word or word of one id."""
        spark = self.counts.sparkSession
        if isinstance(item, str):
            return self.word_to_id(local_table(spark, [(item,)], "word string")).first().id
        return self.id_to_word(local_table(spark, [(item,)], "id int")).first().word

    def __contains__(self, word: str) -> bool:
        return self.encodable.filter(F.col("word") == word).limit(1).count() > 0

    def __len__(self) -> int:
        return self.table.count()

    # storage

    def _options(self) -> dict:
        return {
            "size": self.size,
            "min_freq": self.min_freq,
            "unk_token": self.unk_token,
            "special_tokens": self.special_tokens,
        }

    def save(self, path: str) -> None:
        """Write counts, id table and options. An existing vocabulary is not overwritten."""
        spark = self.counts.sparkSession
        self.counts.write.mode("errorifexists").parquet(f"{path}/counts")
        table = self._with_counts(spark.read.schema(COUNTS).parquet(f"{path}/counts")).table
        if self.size <= ONE_TASK_WORDS:
            table = table.coalesce(1)
        table.write.mode("errorifexists").parquet(f"{path}/table")
        options = local_table(spark, [tuple(self._options().values())], OPTIONS)
        options.coalesce(1).write.mode("errorifexists").parquet(f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> Vocabulary:
        """Read a saved vocabulary. With its own options the saved id table serves; other
        options number the counts anew."""
        saved = spark.read.schema(OPTIONS).parquet(f"{path}/options").first().asDict()
        vocabulary = cls(load_counts(spark, path), **{**saved, **options})
        if vocabulary._options() == saved:
            vocabulary._stored = spark.read.schema(VOCABULARY).parquet(f"{path}/table")
        return vocabulary


def load_counts(spark: SparkSession, *paths: str) -> DataFrame:
    """Counts of saved vocabularies; a path may hold wildcards."""
    return spark.read.schema(COUNTS).parquet(*[f"{p}/counts" for p in paths])


def merge_saved(spark: SparkSession, pattern: str, above: int = 0, **options) -> Vocabulary:
    """One vocabulary from every saved one that matches, in one aggregation."""
    parts = load_counts(spark, pattern)
    if above:
        parts = drop_rare(parts, above)
    return Vocabulary(merge_counts([parts]), **options)
