"""A training-corpus pipeline: quality filter, line dedup, near dedup, source mixing, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm import bpe, line_dedup, mixing, near_dedup, quality
from demandloom.llm.common import table
from demandloom.session import materialize

#: A learnt classifier and token ids have no SQL form; each stage is tested against a brute-force version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the table's labels, scores at 0.7 or more.

    A null text counts as empty; rows alike in text share their score, so repeated rows stay or go together; rows without
    doc_id are scored but never learnt. An empty table gives an empty one. Other columns come back unread.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated lines, however short; emptied ones go.

    Null and empty texts stay as they are, and so do rows without doc_id; a row that repeats another keeps the same
    lines. An empty table gives an empty one. Columns named like the operator's own come back with their values.
    """
    others = {c: f"_column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    found = line_dedup.line_dedup(docs.withColumnsRenamed(others))
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    values = {c: F.col(name) for c, name in others.items()} | {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in others:
        values["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(values["n_chars"])
    return left.select(*[values[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each class of near copies.

    Documents without words (null, empty, blank) are copies of nothing and stay, as do rows without doc_id; repeated rows
    of one id are one document and stay or go together. An empty table gives an empty one. Other columns are not read.
    """
    gone = near_dedup.near_dedup(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, once, or repeated.

    Documents without words are left out; a null source is one of its own; among rows of one id the largest number of
    copies holds for all; a null id counts as one id. An empty table gives an empty one. Other columns are not read.
    """
    return mixing.write_out(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the digest of the text they decode to.

    Null and empty texts have no ids; repeated rows are encoded alike. An empty table gives no rows. Columns other than
    doc_id, source and text are not read.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_decode(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "source"))
    return coded.select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_level_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
