"""Byte-level BPE encoding and decoding with a sentencepiece model serialised from a rank file."""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.llm.chunks import ChunkIds

#: A byte stands in the model as the character this far above it: no blank, no control character, never normalised.
SHIFT = 0x100
_UP = {b: b + SHIFT for b in range(256)}
NORMAL, UNKNOWN, BPE = 1, 2, 2
#: Texts encoded before their ids leave the task.
SLICE = 256


def mapped(piece: bytes) -> str:
    return piece.decode("latin-1").translate(_UP)


def unmapped(piece: str) -> bytes:
    return bytes(ord(c) - SHIFT for c in piece)


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model of the ranks: piece i has id i and score -i; the last id is the unknown piece.

    The normaliser is the identity: no prefix, no trimming, no escaping of spaces. Ranks must be 0 to n - 1.
    """
    pieces = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must run from 0 without gaps")
    out = [_field(1, _field(1, mapped(p).encode()) + _field(2, -float(i)) + _field(3, NORMAL)) for i, p in enumerate(pieces)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN)))
    trainer = _field(3, BPE) + _field(4, len(pieces) + 1) + _field(40, len(pieces))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*out, _field(2, trainer), _field(3, normalizer)])


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern)
        self.bytes_of = [unmapped(self.model.id_to_piece(i)) for i in range(self.model.vocab_size() - 1)]
        self.id_of = {p: i for i, p in enumerate(self.bytes_of)}
        self.pieces: dict[str, bytes] = {}
        self.ids = ChunkIds(self._chunks)

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk: a piece that is a token is that token; others are merged by the model."""
        known = self.pieces
        if len(known) > self.ids.most:
            known.clear()
        split = list(map(self.split.findall, chunks))
        new = list(set().union(*split).difference(known))
        raw = [p.encode() for p in new]
        tokens = list(map(self.id_of.get, raw))
        merged = iter(self.model.encode([mapped(p) for p, t in zip(raw, tokens) if t is None], num_threads=1))
        known.update(zip(new, (array("i", next(merged) if t is None else (t,)).tobytes() for t in tokens)))
        return [b"".join([known[p] for p in pieces]) for pieces in split]

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])


@lru_cache(maxsize=2)
def _codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


class Tokenizer:
    """Columns of token ids and of decoded bytes. The model, at most a few MB for any vocabulary, is sent to each executor once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        model = spark.sparkContext.broadcast(serialise(read_ranks(path)))

        @F.pandas_udf("array<int>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = _codec(model.value, pattern)
            for texts in batches:
                yield pd.Series(codec.ids.all(texts.tolist()), dtype=object)

        @F.pandas_udf("binary")
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = _codec(model.value, pattern)
            for lists in batches:
                yield pd.Series([codec.decode(x.tolist()) for x in lists], dtype=object)

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        return self._encode(F.coalesce(text, F.lit("")))

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)


def encode_decode(docs: DataFrame, path: str, pattern: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, `ids` (array of int) and `decoded` (bytes) of every row.

    Equal to splitting the text by `pattern` and merging the bytes of each match by the ranks in `path`; no special
    tokens. Null and empty texts have no ids and decode to no bytes; rows with the same or no doc_id stay as they are.
    Columns other than text and those kept are not read. A task holds the ids of `SLICE` texts at a time.
    """
    model = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(path)))
    kept = docs.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                *columns, texts = batch.slice(i, SLICE).columns
                ids = codec.ids.all(texts.to_pylist())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                decoded = pa.array([codec.decode(x.tolist()) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, lists, decoded], names=[*keep, "ids", "decoded"])

    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(run, schema)


def digest_of_ids(ids: Column) -> Column:
    """Hex SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.concat_ws(" ", ids.cast("array<string>")), 256)
