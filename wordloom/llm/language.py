"""Language identification by filters of n-grams whose cells are masks of languages.

Training counts, per language, the documents that hold each n-gram. An n-gram belongs to all
languages where it is about as common as where it is most common, however many they are, and sets their bits in the cells that its
hashes name. One look at those cells gives all languages that may contain an n-gram. For a text
the set bits are counted per language, corrected for the rate at which a language's bits are set
by chance, and the language with the most wins. A text of one letter has no n-gram and is judged by
the letter, whose languages training counts in the same way.

Training reads at most about ``per_language`` documents of each language, drawn by hash; the
filter has eight cells for each distinct n-gram of that sample, at most 2**MAX_BITS; if these fill up, training stops with an error. Predictions use the whole text.

Defined cases: a null text, or one without letters, is ``und`` with score 0; with no labelled
text every prediction is ``und``; ties go to the first language by code point; rows without a
language or without text teach nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import BASE, bounded_batches, free_name, splitmix

GRAM = 4
HASHES = 3
MAX_BITS = 24
MAX_FILL = 0.5  # of the cells, above which a language's chance hits would outweigh its own
PER_LANGUAGE = 10_000
SHARE = 0.3  # of an n-gram's greatest rate in any language, what another needs to contain it too
PIECE = 1 << 20  # code points whose n-grams exist at one time
MASK = 62  # languages per word of a cell
NOT_LETTERS = re.compile(r"[\W\d_]+")  # of numerals that are no decimal digits it leaves some; a text of these alone has no letters
UNKNOWN = "und"


def gram_hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of all runs of GRAM characters, in pieces; a run of other characters than letters is one space."""
    clean = NOT_LETTERS.sub(" ", f" {text.lower()} ")
    if not any(map(str.isalpha, clean)):
        return
    for lo in range(0, max(len(clean) - GRAM + 1, 1), PIECE):
        points = np.frombuffer(clean[lo : lo + PIECE + GRAM - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        rolled = np.zeros(max(len(points) - GRAM + 1, 0), np.uint64)
        for i in range(GRAM):
            rolled = rolled * np.uint64(BASE) + points[i : i + len(rolled)]
        yield splitmix(rolled)


def letter_hashes(text: str) -> np.ndarray:
    """Hashes of the distinct letters: what a text of one letter is judged by, which has no run of GRAM characters."""
    letters = {c for c in set(text.lower()) if c.isalpha()}
    points = np.frombuffer("".join(sorted(letters)).encode("utf-32-le", "surrogatepass"), np.uint32)
    return splitmix(points.astype(np.uint64))


def _cells(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(splitmix(grams + np.uint64(i)) >> np.uint64(64 - bits)).astype(np.int64) for i in range(HASHES)]


def _evidence(text: str) -> Iterator[np.ndarray]:
    """Hashes of a text's n-grams, or of its letters if it has none."""
    n = 0
    for grams in gram_hashes(text):
        n += len(grams)
        yield grams
    if not n:
        yield letter_hashes(text)


class Model:
    """Languages, the filter's cells (cell, word) and each language's chance of a false hit."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table, self.bits = languages, table, max(len(table) - 1, 1).bit_length()
        self.chance = [float(np.mean(self._bit(table, i))) ** HASHES for i in range(len(languages))]

    @staticmethod
    def _bit(masks: np.ndarray, language: int) -> np.ndarray:
        word = masks.dtype.type
        return (masks[:, language // MASK] >> word(language % MASK)) & word(1)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts, total = np.zeros(len(self.languages)), 0
        for grams in _evidence(text or ""):
            first, *others = _cells(grams, self.bits)
            masks = self.table[first]
            for cells in others:
                masks = masks & self.table[cells]
            counts += [np.count_nonzero(self._bit(masks, i)) for i in range(len(self.languages))]
            total += len(grams)
        if not total or not self.languages:
            return UNKNOWN, 0.0
        real = [max(0.0, (c - total * p) / (1 - p)) if p < 1 else 0.0 for c, p in zip(counts, self.chance)]
        best = int(np.argmax(real))
        return self.languages[best], float(min(1.0, real[best] / total))


def train(df: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    bounded_batches(df.sparkSession)
    draw: Column = F.pmod(F.xxhash64(*df.columns), F.lit(1_000_000)) / 1_000_000
    rows = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), draw.alias("draw"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((2, 1), np.uint64))
    wanted = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))])
    sample = rows.filter(F.col("draw") < wanted[F.col("lang")]).select("text", "lang")
    numbers = {k: i for i, k in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for grams in chain(gram_hashes(text), [letter_hashes(text)]):
                    grams = np.unique(grams).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.full(len(grams), numbers[name], np.int32))], names=["gram", "l"])

    counts = sample.mapInArrow(run, "gram bigint, l int").groupBy("gram", "l").agg(F.count("*").alias("n"))
    taken = {k: max(1.0, min(sizes[k], per_language)) for k in languages}
    per = F.create_map(*[x for k in languages for x in (F.lit(numbers[k]), F.lit(float(taken[k])))])
    rates = counts.withColumn("rate", F.col("n") / per[F.col("l")])
    most = rates.groupBy("gram").agg(F.max("rate").alias("most"))
    kept = rates.join(most, "gram").filter(F.col("rate") >= SHARE * F.col("most")).select("gram", "l")
    distinct = most.count()
    bits = min(MAX_BITS, max(10, (8 * max(distinct, 1)).bit_length()))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, l = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            where = np.concatenate(_cells(grams, bits))
            word, mask = np.tile(l // MASK, HASHES), np.tile(np.int64(1) << (l % MASK).astype(np.int64), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(word.astype(np.int32)), pa.array(mask)], names=["cell", "word", "mask"])

    filled = kept.mapInArrow(cells, "cell bigint, word int, mask bigint").groupBy("cell", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    # a cell has as many bits as there are languages, rounded up to a word
    width = next((k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= n), np.uint64)
    table = np.zeros((1 << bits, (len(languages) - 1) // MASK + 1), width)
    table[filled["cell"], filled["word"]] = filled["mask"].to_numpy().astype(width)
    model = Model(languages, table)
    if max(model.chance) > MAX_FILL**HASHES:
        raise ValueError("the filter is too full to tell languages apart; lower per_language")
    return model


def predict(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and its share of the text's n-grams, under ``names`` as far as they are free.
    The model is broadcast; it has a bounded size."""
    names = tuple(free_name(df, *names))
    spark = df.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast((model.languages, model.table))

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = Model(*shipped.value)
        for texts in parts:
            yield pd.DataFrame([held.predict(t) for t in texts], columns=["lang", "score"])

    (found,) = free_name(df, "_guess")
    out = df.withColumn(found, guess(F.col(text)))
    return out.withColumn(names[0], F.col(found)["lang"]).withColumn(names[1], F.col(found)["score"]).drop(found)


def predict_held_out(df: DataFrame, text: str = "text", lang: str = "lang", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``predict`` by models that have not seen the text: halves by a hash of the text, each judged by the model of the
    other. Equal texts share a half. If a half has no labelled text, the other's own model judges the other."""
    side = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")) % 2
    halves = [df.filter(side == i) for i in range(2)]
    models = [train(half, text, lang) for half in halves]
    judges = [other if other.languages else own for own, other in zip(models, reversed(models))]
    first, second = (predict(half, judge, text, names) for half, judge in zip(halves, judges))
    return first.unionByName(second)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5
