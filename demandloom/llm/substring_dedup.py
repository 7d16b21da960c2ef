"""Substring deduplication: seeds from winnowed anchors, extended both ways to repeats over the length threshold.

An anchor is a run of K words that has the smallest hash among the anchors of some window of `length` words. Equal
windows choose the same anchor at the same offset, so a repeat of at least `length` words is always seeded. The windows
that chose one occurrence of an anchor are consecutive; together with their words they are its extent. Extents are
compared between documents by anchor, first whole, then window by window where whole extents differ, so that work grows
with the words near shared anchors and not with pairs of documents. Overlapping repeated windows make up the maximal
repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.words import Runs, WordHashes, split
from demandloom.session import materialize

LENGTH = 50
K = 10
#: `place` packs the first start of the windows that chose the anchor, the anchor's distance and the last start's.
BITS = 12
ANCHORS = "doc_id long, anchor long, extent long, place long"
WINDOWS = "doc_id long, anchor long, window long, start int"


def smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum in each run of `width` hashes."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, width)
    return np.concatenate([i + np.arange(len(v)) + v.argmin(axis=1) for i, v in ((i, views[i : i + 4096]) for i in range(0, len(views), 4096))])


def anchors_of(words: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchors of a document: hash, hash of the extent, and place."""
    runs = Runs(words)
    starts = np.arange(max(0, len(words) - k + 1))
    hashes = runs.hash(starts, starts + k)
    chosen = smallest(hashes, length - k + 1)
    if not len(chosen):
        return (np.empty(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(chosen) - 1]])
    at = chosen[first]
    with np.errstate(over="ignore"):
        # The place of the anchor in its extent is part of the extent.
        extent = runs.hash(first, last + length) + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return hashes[at].view(np.int64), extent.view(np.int64), first << 2 * BITS | at - first << BITS | last - first


def find_anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for part in range(0, len(batch), 512):
                keys, columns = [], []
                for key, text in zip(batch["doc_id"][part : part + 512], batch["text"][part : part + 512]):
                    found = anchors_of(hashes.of(split(text)), length, k)
                    keys.append(np.full(len(found[0]), key, np.int64))
                    columns.append(found)
                names = ["anchor", "extent", "place"]
                yield pd.DataFrame({"doc_id": np.concatenate(keys)} | {n: np.concatenate(c) for n, c in zip(names, zip(*columns))})

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(run, ANCHORS)


def windows_of(seeds: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """All windows of the seeds (doc_id, list of anchors) with hashes of their words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for key, text, seeds in zip(batch["doc_id"], batch["text"], batch["seeds"]):
                words = hashes.of(split(text))
                runs = Runs(words)
                place = np.array([s["place"] for s in seeds], np.int64)
                lo, low = place >> 2 * BITS, (1 << BITS) - 1
                at, hi = lo + (place >> BITS & low), lo + (place & low)
                fits = hi + length <= len(words)
                lo, hi, at = lo[fits], hi[fits], at[fits]
                counts = hi - lo + 1
                anchor = np.repeat(np.array([s["anchor"] for s in seeds], np.int64)[fits], counts)
                starts = np.repeat(lo, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                with np.errstate(over="ignore"):
                    offset = (np.repeat(at, counts) - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    window = (runs.hash(starts, starts + length) + offset).view(np.int64)
                yield pd.DataFrame({"doc_id": np.full(len(starts), key, np.int64), "anchor": anchor, "window": window, "start": starts})

    return docs.join(seeds, "doc_id").select("doc_id", "text", "seeds").mapInPandas(run, WINDOWS)


def repeats(docs: DataFrame, *, length: int = LENGTH, k: int = K) -> DataFrame:
    """Starts `lo` to `hi` of the windows of each document that also start in a document with a smaller id."""
    if length - k >= 1 << BITS:
        raise ValueError(f"length may exceed k by less than {1 << BITS}")
    anchors = materialize(find_anchors(docs, length, k), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_z")).where("_a < _z")
    seeds = materialize(anchors.join(shared.select("anchor"), "anchor"), "seeds")
    extents = seeds.groupBy("anchor", "extent").agg(F.min("doc_id").alias("first"))
    several = extents.groupBy("anchor").agg(F.count("*").alias("n"))
    extents = materialize(extents.join(several, "anchor"), "extents")
    # Whole extents that a smaller document has as well.
    whole = seeds.join(extents, ["anchor", "extent"]).where("first < doc_id")
    lo = F.shiftright("place", 2 * BITS)
    hi = lo + F.col("place").bitwiseAND(F.lit((1 << BITS) - 1))
    whole = whole.select("doc_id", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    # Of anchors with several extents, the first document of each extent stands for the extent.
    stand = extents.where("n > 1").select("anchor", "extent", F.col("first").alias("doc_id"))
    compared = seeds.join(stand, ["anchor", "extent", "doc_id"])
    lists = compared.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place")).alias("seeds"))
    windows = materialize(windows_of(lists, docs.select("doc_id", "text"), length), "windows")
    least = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_z")).where("first < _z")
    single = windows.join(least, ["anchor", "window"]).where("first < doc_id")
    return whole.unionByName(single.select("doc_id", F.col("start").alias("lo"), F.col("start").alias("hi")))


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def substring_dedup(docs: DataFrame, *, length: int = LENGTH, k: int = K) -> DataFrame:
    """Remove every word covered by a run of `length` words that also starts in a document with a smaller doc_id.

    Returns one row per row of `docs`: doc_id, n_words, n_removed and `kept`, the words that stay, joined by one space.
    Words are what lies between ASCII white space, unchanged; runs are judged on the input. Repeats inside one document
    stay. Null and empty texts have no words; documents of fewer than `length` words lose none. A row without doc_id
    neither loses words nor takes any from others. Rows that share a doc_id are one document's and need the same text.
    Columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"]):
                words = split(text)
                edges = np.zeros(len(words) + 1, np.int64)
                for s in spans if spans is not None else ():
                    edges[s["lo"]] += 1
                    edges[min(len(words), s["hi"] + length)] -= 1
                keep = np.cumsum(edges[:-1]) == 0
                stay = words if keep.all() else [w for w, x in zip(words, keep) if x]
                rows.append((key, len(words), len(words) - len(stay), b" ".join(stay).decode()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"]).astype({"doc_id": "Int64"})

    docs = docs.select("doc_id", "text")
    spans = repeats(docs, length=length, k=k).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return docs.join(spans, "doc_id", "left").mapInPandas(run, KEPT)
