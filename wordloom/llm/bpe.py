"""Byte-level BPE: encode texts to the ids of a public vocabulary and decode them.

The vocabulary is a file of ranks: one base64 token and its rank a line. A sentencepiece BPE
model is written from it directly: every byte is mapped to one character, a token's piece is
the string of its bytes' characters, its score the negative rank, and normalisation does
nothing. The model then merges as the ranks say. Texts are cut by the vocabulary's pattern
first and each cut is encoded alone.

The model is about a megabyte, whatever the corpus, and travels to the workers by broadcast.
No step moves a row. Defined cases: a null or empty text has no ids and decodes to no bytes;
a null list of ids decodes to null, a null id to nothing; an id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wordloom.llm.common import bounded_batches

FIRST_CHARACTER = 0x100  # byte b is written as this character plus b
CACHED = 500_000  # distinct cuts that a worker remembers; it forgets all and starts anew beyond

# fixed values: field numbers and codes of the sentencepiece model format
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND, NORMAL, UNKNOWN = 1, 2, 3, 1, 2
MODEL_TYPE, BPE, VOCAB_SIZE = 3, 2, 4
NAME, ADD_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def as_characters(data: bytes) -> str:
    return data.decode("latin-1").translate({b: FIRST_CHARACTER + b for b in range(256)})


# of each byte, its character in UTF-8; no byte of a text in UTF-8 is 255
CHARACTERS = np.frombuffer("".join(chr(FIRST_CHARACTER + b) for b in range(256)).encode(), np.uint8).reshape(256, 2)


def all_characters(data: list[bytes]) -> list[str]:
    """``as_characters`` of many texts in UTF-8 at once."""
    joined = CHARACTERS[np.frombuffer(b"\xff".join(data), np.uint8)].tobytes().decode()
    return joined.split(chr(FIRST_CHARACTER + 255))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _string(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Its id 0 is the unknown piece; the token at place r of the order by
    rank has id r + 1."""
    pieces = [_string(PIECE, b"<unk>") + _number(KIND, UNKNOWN)]
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        score = _varint(SCORE << 3 | 5) + struct.pack("<f", -float(rank))
        pieces.append(_string(PIECE, as_characters(token).encode()) + score + _number(KIND, NORMAL))
    trainer = _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, len(pieces))
    plain = _string(NAME, b"identity") + _number(ADD_PREFIX, 0) + _number(REMOVE_SPACES, 0) + _number(ESCAPE_SPACES, 0)
    return b"".join(_string(PIECES, p) for p in pieces) + _string(TRAINER, trainer) + _string(NORMALIZER, plain)


class Tokenizer:
    """Encodes the cuts of texts; lives in a worker. The ids of every cut that it remembers lie in one array."""

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str):
        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.by_place = np.array([-1, *sorted(ranks.values())], np.int32)  # of the model's ids
        self.cut = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # cut to its place in ``ends``
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def learn(self, cuts: list[str]) -> None:
        """Encode cuts that were not seen yet."""
        data = [cut.encode() for cut in cuts]
        whole = [self.ranks.get(d) for d in data]  # a token as a whole, also where no merge reaches it
        long = [d for d, rank in zip(data, whole) if rank is None]
        found = iter(self.model.encode(all_characters(long), out_type=int) if long else [])
        ids, ends = [], []
        n = len(self.ids)
        for rank in whole:
            part = (rank,) if rank is not None else self.by_place[next(found)]
            ids.append(part)
            n += len(part)
            ends.append(n)
        self.known.update(zip(cuts, range(len(self.ends), len(self.ends) + len(cuts))))
        self.ids = np.concatenate([self.ids, *ids]).astype(np.int32)
        self.ends = np.concatenate([self.ends, ends])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and end."""
        cuts = [self.cut(text) for text in texts]
        flat = list(chain.from_iterable(cuts))
        new = set(flat).difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.forget()
            new = set(flat)
        if new:
            self.learn(list(new))
        place = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        start, sizes = self.ends[place - 1], self.ends[place] - self.ends[place - 1]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(start - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.concatenate([[0], np.cumsum([len(c) for c in cuts])]).astype(np.int64)]


def _append(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table already has a column {name}")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the column ``ids``, the array of token ids of ``text``."""
    spark: SparkSession = df.sparkSession
    bounded_batches(spark)
    ranks = read_ranks(ranks_path)
    shipped = spark.sparkContext.broadcast((ranks, sentencepiece_model(ranks)))
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(*shipped.value, pattern)
        for batch in batches:
            found, offsets = tokenizer.encode([value.as_py() or "" for value in batch.column(place)])
            yield _append(batch, ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found)))

    return df.mapInArrow(run, _with(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the column ``decoded``, the bytes that the ids in ``ids`` stand for."""
    spark = df.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(read_ranks(ranks_path))
    place = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[bytes | None] = [None] * (max(shipped.value.values()) + 1)
        for token, rank in shipped.value.items():
            table[rank] = token
        tokens = pa.array([*table, b""], pa.binary())  # the last stands for a null id
        for batch in batches:
            lists = batch.column(place)
            flat = lists.flatten().fill_null(len(table))
            found = tokens.take(flat)
            if found.null_count:
                raise ValueError("an id is not in the vocabulary")
            # the bytes of all tokens lie in a row: a text is what lies between its first and last
            bounds = np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1] if len(found) else np.zeros(1, np.int32)
            sizes = [len(x) if x.is_valid else 0 for x in lists]
            ends = bounds[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].astype(np.int32)
            data = found.buffers()[2] if len(found) else None
            texts = pa.Array.from_buffers(
                pa.binary(), len(lists), [None, pa.py_buffer(ends), data if data is not None else pa.py_buffer(b"")]
            )
            if lists.null_count:
                texts = pa.array([t if x.is_valid else None for t, x in zip(texts.to_pylist(), lists)], pa.binary())
            yield _append(batch, decoded, texts)

    return df.mapInArrow(run, _with(df, decoded, T.BinaryType()))
