"""Token ids for a corpus, and back.

Words are looked up in Arrow batches: the distinct words of a batch against the blocks of the
vocabulary, which takes any size of it and moves no data. The same pass wraps records, and thins out
frequent words where that is asked for. The join way explodes, joins and regroups by record; it gives the same rows and needs unique record ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wordloom.functions.hashing import record_state, uniform_np
from wordloom.functions.text import TextFunction, normalize, parse_words, split_words
from wordloom.operators.blocks import BLOCK_BYTES, Blocks, distinct_parts, flat_array, list_column, list_parts, places, ship
from wordloom.operators.joins import regroup, together
from wordloom.operators.sampling import weighted_table
from wordloom.operators.vocabulary import Vocabulary
from wordloom.schemas import END_TOKEN, SEED, START_TOKEN, SUBSAMPLE_THRESHOLD
from wordloom.session import bounded_batches


@dataclass(frozen=True)
class Thinning:
    """Thin out frequent words while encoding: position i of a record, the wrapping tokens included, meets the
    i-th uniform number of that record. Records with fewer than ``shortest`` ids go first; ``longest`` cuts
    ids before they are thinned, 0 keeps all."""

    t: float = SUBSAMPLE_THRESHOLD
    seed: int | str = SEED
    key: tuple[str, ...] = ("record_id",)
    shortest: int = 0
    longest: int = 0


class Encoder:
    """Text to ``ids``, ``tokens`` and ``attention_mask``.

    Every record is wrapped in the start and end tokens; both must be special tokens of
    the vocabulary, and it needs an unknown token. The text of an unknown word becomes the
    unknown token too. An empty text encodes as the two wrapping tokens.
    """

    def __init__(
        self,
        vocabulary: Vocabulary,
        start: str = START_TOKEN,
        end: str = END_TOKEN,
        normalizer: TextFunction = normalize,
        splitter: TextFunction = split_words,
        block_bytes: int = BLOCK_BYTES,
    ):
        for token in (start, end):
            if token not in vocabulary.specials:
                raise ValueError(f"{token} must be a special token of the vocabulary")
        if vocabulary.unk_id is None:
            raise ValueError("the vocabulary needs an unknown token")
        self.vocabulary = vocabulary
        self.start, self.end = start, end
        self.start_id = vocabulary.specials.index(start)
        self.end_id = vocabulary.specials.index(end)
        self.normalizer, self.splitter = normalizer, splitter
        self.block_bytes = block_bytes
        self._shipped: dict[float | None, tuple[Blocks, list[float]]] = {}

    def encode(
        self, corpus: DataFrame, key: str = "text", way: str = "arrow", with_tokens: bool = True,
        keep_text: bool = False, thinning: Thinning | None = None,
    ) -> DataFrame:
        """Add the three arrays to a corpus, in place of the text unless ``keep_text``. Training needs only
        the ids; without tokens no text travels back from the lookup."""
        words = parse_words(key, self.normalizer, self.splitter)
        others = [c for c in corpus.columns if c != key or keep_text]
        split = corpus.select(*others, F.coalesce(words, F.array().cast("array<string>")).alias("words"))
        return self.encode_words(split, way, with_tokens, thinning)

    def encode_words(
        self, split: DataFrame, way: str = "arrow", with_tokens: bool = True, thinning: Thinning | None = None
    ) -> DataFrame:
        """Encode an array column ``words`` that is split already."""
        if thinning is not None:
            return self._encode_arrow(split, False, thinning)
        encoded = self._encode_join(split, with_tokens) if way == "join" else self._encode_arrow(split, with_tokens)
        return encoded.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("ids")))

    def encode_pair(self, pairs: DataFrame, first: str, second: str, way: str = "arrow") -> DataFrame:
        """Two texts in one sequence, each wrapped, with ``type_ids`` 0 and 1."""
        others = [c for c in pairs.columns if c not in (first, second)]

        def one(df: DataFrame, text: str, tag: str) -> DataFrame:
            done = self.encode(df, text, way).drop("attention_mask")
            return done.withColumnsRenamed({"ids": f"_ids{tag}", "tokens": f"_tokens{tag}"})

        both = one(one(pairs, first, "0"), second, "1")
        return both.select(
            *others,
            F.concat("_ids0", "_ids1").alias("ids"),
            F.concat("_tokens0", "_tokens1").alias("tokens"),
            F.concat(
                F.array_repeat(F.lit(0), F.size("_ids0")), F.array_repeat(F.lit(1), F.size("_ids1"))
            ).alias("type_ids"),
            F.array_repeat(F.lit(1), F.size("_ids0") + F.size("_ids1")).alias("attention_mask"),
        )

    # the Arrow way

    def _ship(self, t: float | None = None) -> tuple[Blocks, list[float]]:
        """Blocks of (words, ids, keep weights) by the words' hash, and the weights of the unknown, start
        and end tokens; all weights 1 without ``t``. Shipped once."""
        if t not in self._shipped:
            weight = F.lit(1.0).alias("keep_prob")
            table = self.vocabulary.table.withColumn("keep_prob", weight) if t is None else weighted_table(self.vocabulary, t)
            table = table.select("word", "id", F.coalesce("keep_prob", F.lit(1.0)).alias("keep_prob"), "is_special", "is_infrequent").persist()
            try:
                heads = {r.word: r.keep_prob for r in table.filter("is_special").select("word", "keep_prob").collect()}
                words = table.filter(~F.col("is_infrequent")).select("word", "id", "keep_prob")
                blocks = ship(words, F.xxhash64("word"), _word_block, self.block_bytes)
            finally:
                table.unpersist()
            self._shipped[t] = blocks, [heads[x] for x in (self.vocabulary.unk_token, self.start, self.end)]
        return self._shipped[t]

    def _encode_arrow(self, split: DataFrame, with_tokens: bool, thinning: Thinning | None = None) -> DataFrame:
        bounded_batches(split.sparkSession)
        blocks, weights = self._ship(thinning.t if thinning else None)
        others = [f for f in split.schema.fields if f.name != "words"]
        added = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
        if with_tokens:
            added.append(T.StructField("tokens", T.ArrayType(T.StringType())))
        schema = T.StructType([*others, *added])
        out_schema = to_arrow_schema(schema)
        names = [f.name for f in others]
        heads = [self.vocabulary.unk_id, self.start_id, self.end_id]
        head_texts = [self.vocabulary.unk_token, self.start, self.end]

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks.gather(batches):
                if thinning is not None and thinning.shortest:
                    # here and not by a filter, which the planner moves down to split every text a second time for it
                    lengths = pc.fill_null(pc.list_value_length(batch.column("words")), 0)
                    batch = batch.filter(pc.greater_equal(pc.add(lengths, 2), thinning.shortest))
                flat, offsets = list_parts(batch.column("words"))
                distinct, codes = distinct_parts(flat)
                n = len(distinct)
                # of the distinct words, then unknown, start and end
                ids = np.concatenate([np.full(n, heads[0]), heads]).astype(np.int32)
                keep = np.concatenate([np.full(n, weights[0]), weights])
                known = np.zeros(n, bool)
                for words, word_ids, word_keep in blocks.visit():
                    found = pc.index_in(distinct, value_set=words)
                    here = np.asarray(found.is_valid())
                    at = found.drop_null().to_numpy()
                    ids[:n][here], keep[:n][here] = word_ids[at], word_keep[at]
                    known |= here
                wrapped = offsets + 2 * np.arange(len(offsets))
                place = np.full(wrapped[-1], -1, dtype=np.int64)
                place[wrapped[:-1]] = n + 1
                place[wrapped[1:] - 1] = n + 2
                place[place < 0] = codes  # a null word is at n, the unknown token
                if thinning is not None:
                    state = batch.column("_state").to_numpy()
                    place, wrapped = _thinned(place, wrapped, keep, state, thinning.longest)
                arrays = [batch.column(name) for name in names]
                arrays.append(list_column(wrapped, pa.array(ids[place])))
                if with_tokens:
                    texts = pa.concat_arrays([distinct.cast(pa.string()), pa.array(head_texts, pa.string())])
                    shown = np.where(np.concatenate([known, [True, True, True]])[place], place, n)
                    arrays.append(list_column(wrapped, texts.take(pa.array(shown))))
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out_schema)], schema=out_schema)

        if thinning is not None:
            split = split.withColumn("_state", record_state(thinning.seed, *thinning.key))
        return split.mapInArrow(look_up, schema)

    # the join way

    def _encode_join(self, split: DataFrame, with_tokens: bool) -> DataFrame:
        others = [c for c in split.columns if c != "words"]
        # the outer form keeps records without words; their one row has no position
        placed = together(split, others, self.vocabulary.size)
        rows = placed.select(*others, F.posexplode_outer("words").alias("pos", "word"))
        found = self.vocabulary._lookup(rows, "word", ["id"], self.vocabulary.encodable)
        unk, unk_id = self.vocabulary.unk_token, self.vocabulary.unk_id
        item = F.struct(
            "pos",
            F.coalesce("id", F.lit(unk_id)).alias("id"),
            F.when(F.col("id").isNull(), F.lit(unk)).otherwise(F.col("word")).alias("token"),
        )
        grouped = regroup(found, others, item)

        def wrapped(start: int | str, field: str, end: int | str) -> Column:
            inner = F.transform("items", lambda x: x[field])
            return F.concat(F.array(F.lit(start)), inner, F.array(F.lit(end)))

        arrays = [wrapped(self.start_id, "id", self.end_id).alias("ids")]
        if with_tokens:
            arrays.append(wrapped(self.start, "token", self.end).alias("tokens"))
        return grouped.select(*others, *arrays)


def _word_block(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    return flat_array(rows["word"], pa.string()), rows["id"].to_numpy().astype(np.int32), rows["keep_prob"].to_numpy()


def _thinned(place: np.ndarray, offsets: np.ndarray, keep: np.ndarray, states: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that stay, and their offsets. ``keep``: weight of each place; ``states``: one per record."""
    lengths = np.diff(offsets)
    pos = np.arange(len(place)) - np.repeat(offsets[:-1], lengths)
    stays = keep[place] > uniform_np(np.repeat(states, lengths), pos)
    if longest:
        stays &= pos < longest
    return place[stays], np.concatenate([[0], np.cumsum(stays)])[offsets]


def decode(
    encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", tokens: str = "tokens", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Add ``tokens``, the words of ``ids``; all other columns stay. Negative ids count from the end; null ids and ids out of
    range give the unknown token, or fail if there is none; a null list decodes as an empty one."""
    bounded_batches(encoded.sparkSession)
    table = vocabulary.table.select("id", "word")
    length = table.agg(F.count("*").cast("int")).first()[0]
    blocks = ship(table, "id", lambda rows: (rows["id"].to_numpy(), flat_array(rows["word"], pa.string())), block_bytes)
    unk = vocabulary.unk_token
    others = [f for f in encoded.schema.fields if f.name != tokens]
    schema = T.StructType([*others, T.StructField(tokens, T.ArrayType(T.StringType()))])
    out_schema = to_arrow_schema(schema)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.gather(batches):
            flat, offsets = list_parts(batch.column(ids))
            wanted = pc.fill_null(flat.cast(pa.int64()), length).to_numpy(zero_copy_only=False)
            wanted = np.where(wanted < 0, wanted + length, wanted)
            at, texts = np.zeros(len(wanted), np.int64), [pa.array([unk], pa.string())]
            for known, words in blocks.visit():
                inside, place = places(known, wanted)
                # only the words in use outlive their block
                used, where = np.unique(place, return_inverse=True)
                at[inside] = sum(map(len, texts)) + where
                texts.append(words.take(pa.array(used)))
            if unk is None and not at.all():
                raise ValueError(f"no word has the id {wanted[at == 0][0]}")
            arrays = [batch.column(f.name) for f in others] + [list_column(offsets, pa.concat_arrays(texts).take(pa.array(at)))]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out_schema)], schema=out_schema)

    return encoded.mapInArrow(look_up, schema)


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """Each turn of a conversation with the one after it."""
    following = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("second")
    )
    first = turns.select("conv_id", "turn", F.col("text").alias("first"))
    return first.join(following, ["conv_id", "turn"])
