"""Token-ID files: whole corpora in ascending document order, written and read back section by section."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from demandloom.llm import rans
from demandloom.llm.chunks import ID, WordIds
from demandloom.llm.common import before

#: Ids of a section, the unit that shares a frequency table: 8 MB in memory.
SECTION_IDS = 1 << 21
LAST = (1 << 63) - 1
#: Bytes of text encoded at a time; a longer text is encoded on its own.
SLICE_BYTES = 12 << 20
# Fixed values of byte-level BPE: the pattern that splits a text, and the letter that stands for each byte: printable
# ones for themselves, the others for the letters from U+0100 on, in order.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
LETTERS = {b: chr(256 + i) for i, b in enumerate(_OTHERS)}
#: Texts whose characters every version of Unicode classes alike.
LATIN = re.compile("[\\t\\n -~\u00a1-\u024f]+")

SECTIONS = "first_key long, n_ids long, doc_ids array<bigint>, lengths array<int>, frequencies binary, blocks array<binary>"
SUMMED = "first_key long, doc_id long, inside long, n_ids long, ids_crc32 long"
DECODED = f"{SUMMED}, ids array<int>"


class _Encoder:
    """The library's model over pieces, with the ids of pieces seen before kept in a bounded table.

    Words of plain Latin text are split by the byte-level pattern here; the library splits all others, as the version of
    its character classes is its own.
    """

    def __init__(self, text: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.whole = Tokenizer.from_str(text)
        self.split, self.model = self.whole.pre_tokenizer.pre_tokenize_str, self.whole.model
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        made = json.loads(text)["pre_tokenizer"]
        known = made["type"] == "ByteLevel" and made.get("use_regex", True) and not made["add_prefix_space"]
        self.latin = LATIN.fullmatch if known else lambda word: None
        self.most, self.pieces, self.letters = most, {}, {}
        self.ids = WordIds(self._after_space, self._alone, self.added)

    def _known(self, pieces: list[str], table: dict[str, bytes], spell: Callable[[str], str]) -> list[bytes]:
        """Ids of each piece; `spell` writes a piece in the letters of the byte-level alphabet."""
        if len(table) > self.most:
            table.clear()
        for piece in set(pieces).difference(table):
            table[piece] = array("i", [t.id for t in self.model.tokenize(spell(piece))]).tobytes()
        return [table[p] for p in pieces]

    def _split_here(self, words: list[str]) -> list[bytes]:
        pieces = PATTERN.findall("".join([" " + w for w in words]))
        return _joined(pieces, self._known(pieces, self.pieces, _spelt), " ")

    def _split_there(self, words: list[str]) -> list[bytes]:
        pieces = [p for p, _ in self.split("".join([" " + w for w in words]))]
        return _joined(pieces, self._known(pieces, self.letters, str), LETTERS[32])

    def _after_space(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it. Strings of added tokens are taken as plain text."""
        if self.latin(" ".join(words)):
            return self._split_here(words)
        here = [w for w in words if self.latin(w)]
        found = dict(zip(here, self._split_here(here)))
        there = [w for w in words if w not in found]
        found.update(zip(there, self._split_there(there)))
        return [found[w] for w in words]

    def _alone(self, text: str) -> bytes:
        """Ids of a text as the library has them."""
        if any(a in text for a in self.added):
            return array("i", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if self.latin(text):
            return b"".join(self._known(PATTERN.findall(text), self.pieces, _spelt))
        return b"".join(self._known([p for p, _ in self.split(text)], self.letters, str))


def _spelt(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(LETTERS)


def _joined(pieces: list[str], ids: list[bytes], space: str) -> list[bytes]:
    """Ids of words from those of their pieces; a word's first piece starts with the space."""
    out = []
    for piece, found in zip(pieces, ids):
        if piece[0] == space:
            out.append(found)
        else:
            out[-1] += found
    return out


@lru_cache(maxsize=2)
def _encoder(text: str) -> _Encoder:
    return _Encoder(text)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `SLICE_BYTES` of text."""
    bytes_ = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(bytes_) // SLICE_BYTES)) + 1
    for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
        if j > i:
            yield batch.slice(i, j - i)


def _section(docs: list[tuple[int | None, np.ndarray]]) -> dict:
    ids = np.concatenate([x for _, x in docs])
    freq = rans.frequencies(ids)
    return {
        "first_key": LAST if docs[0][0] is None else docs[0][0],
        "n_ids": len(ids),
        "doc_ids": [d for d, _ in docs],
        "lengths": [len(x) for _, x in docs],
        "frequencies": rans.pack_table(freq),
        "blocks": rans.encode(ids, freq),
    }


def write(docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int = 0, section_ids: int = SECTION_IDS) -> None:
    """Encode every text, append `end_id` and write the ids to `path` in ascending doc_id order.

    Each file is a Parquet table of sections in order, and files are in order of their names. A section ends once it
    has `section_ids` ids and the doc_id changes, so a task holds one section and one document. Null texts are empty:
    their only id is the end id. Rows without doc_id come last; rows that share a doc_id are ordered by text. Strings
    of special tokens in a text become their ids, as the library has it. An empty table gives no sections. Other columns are not read.
    """
    longs, ints, bytes_ = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary())
    fields = [("first_key", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", longs), ("lengths", ints), ("frequencies", pa.binary()), ("blocks", bytes_)]
    arrow = pa.schema(fields)
    with open(tokenizer_path, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, n, end = _encoder(model.value), [], 0, np.array([end_id], ID)
        for batch in batches:
            for part in _slices(batch):
                ids_, sizes = encoder.ids.of(part.column(1))
                keys, ends = part.column(0).to_pylist(), np.cumsum(sizes)
                for key, found in zip(keys, np.split(ids_, ends[:-1])):
                    doc_id = None if key == LAST else key
                    if n >= section_ids and held[-1][0] != doc_id:
                        yield pa.RecordBatch.from_pylist([_section(held)], arrow)
                        held, n = [], 0
                    ids = np.concatenate([found, end])
                    held.append((doc_id, ids))
                    n += len(ids)
        if held:
            yield pa.RecordBatch.from_pylist([_section(held)], arrow)

    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("_key").sortWithinPartitions("_key", "text")
    ordered.mapInArrow(sections, SECTIONS).write.parquet(path)


def _documents(sections: DataFrame, with_ids: bool) -> DataFrame:
    """Documents of each section, from its decoded ids: place in the section, number of ids, their CRC-32, the ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = rans.decode(list(row.blocks), rans.unpack_table(row.frequencies))
                ends = np.cumsum(row.lengths)
                for i in range(0, len(ends), 4096):
                    spans = list(zip((ends - row.lengths)[i : i + 4096], ends[i : i + 4096]))
                    out = {
                        "first_key": row.first_key,
                        "doc_id": pd.array(list(row.doc_ids[i : i + 4096]), "Int64"),
                        "inside": [a for a, _ in spans],
                        "n_ids": [b - a for a, b in spans],
                        # of the ids as little-endian unsigned 32-bit integers
                        "ids_crc32": [zlib.crc32(ids[a:b].astype("<u4", copy=False).tobytes()) for a, b in spans],
                    }
                    yield pd.DataFrame(out | ({"ids": [ids[a:b] for a, b in spans]} if with_ids else {}))

    return sections.mapInPandas(run, DECODED if with_ids else SUMMED)


def read(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """Read the files back: doc_id, start, n_ids, ids_crc32 and, if wanted, `ids`, all with the end id.

    `start` is the number of ids in all documents before it in the files. Every checksum of the files is verified.
    """
    sections = spark.read.schema(SECTIONS).parquet(path)
    starts = before(sections, "first_key", "n_ids", "_base")
    docs = _documents(sections, with_ids).join(starts, "first_key")
    start = F.col("_base") + F.col("inside")
    return docs.select("doc_id", start.alias("start"), "n_ids", "ids_crc32", *(["ids"] if with_ids else []))
