"""Benchmark decontamination by winnowing: seeds where fingerprints meet, extended to the shared windows around them.

A window of L words chooses one of its k-grams, the rightmost of least hash. Equal windows choose at the same offset, so
a document that holds a window of an item also holds its fingerprint: every shared span of L words is found. Fingerprints
of documents meet those of the items; seeds are extended word by word to the windows that may contain them, and the
windows that the item has as well mark the hit words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.words import WordHashes, mix
from demandloom.session import materialize

LENGTH = 10
#: Documents' fingerprints are first looked up in a bit table of this fixed size (4 MB), whatever the number of items.
BITS = 25
#: Items of one document that are extended together.
SLICE = 256
#: Words of one round of hashing, and items whose windows a task keeps.
WORDS, KEPT = 1 << 18, 2048

_SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _SIGNS, bytes(range(97, 123)) + b" " * len(_SIGNS))


def split(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text: runs of a-z, digits and all beyond ASCII, A-Z lower-cased."""
    return (text or b"").translate(_PLAIN).split()


def fingerprints(words: np.ndarray, document: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of the k-gram that each window of `length` words chooses, windows of several documents left out.

    `words` are word hashes of documents laid end to end, `document` the number of each word's document. The k-grams have
    half a window's words, rounded up; each window chooses among the others' starts.
    """
    n, k = len(words) - length + 1, (length + 1) // 2
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = np.full(len(words) - k + 1, length, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(grams)]
    grams = mix(grams)
    least, at = grams[:n], np.zeros(n, np.int64)
    for i in range(1, length - k + 1):
        here = grams[i : i + n]
        at = np.where(here <= least, i, at)
        least = np.minimum(here, least)
    whole = np.flatnonzero(document[:n] == document[length - 1 :])
    return least[whole].view(np.int64), whole + at[whole]


def item_classes(items: DataFrame, length: int) -> DataFrame:
    """Items of equal words as one class: number, words joined by spaces, words of a window, item ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [split(t.as_py()) for t in batch["text"]]
            joined = [b" ".join(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch["item_id"], pa.array(joined, pa.binary()), pa.array([min(length, len(w)) for w in words], pa.int32())],
                ["item_id", "words", "window"],
            )

    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    split_up = rows.mapInArrow(run, "item_id string, words binary, window int").where("window > 0")
    return split_up.groupBy("words", "window").agg(F.collect_set("item_id").alias("items")).withColumn("class", F.monotonically_increasing_id())


def item_fingerprints(classes: DataFrame) -> DataFrame:
    """Distinct (h, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = []
            for text, window in zip(batch["words"], batch["window"]):
                words = hashes.of(text.as_py().split())
                found.append(np.unique(fingerprints(words, np.zeros(len(words), np.int8), window.as_py())[0]))
            named = np.repeat(batch["class"].to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found])), pa.array(named)], ["h", "class"])

    return classes.select("class", "words", "window").mapInArrow(run, "h long, class long")


def bit_table(prints: DataFrame) -> np.ndarray:
    """Bits of all fingerprints by their top bits: 2^25 bits, however many fingerprints there are."""
    place = F.shiftrightunsigned("h", 64 - BITS)
    rows = prints.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(h, {64 - BITS}) & 63))")).alias("bits"))
    table = np.zeros(1 << BITS - 6, np.int64)
    found = rows.toArrow()
    table[found["at"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint64)


SEEDED = "key long, doc_id long, n_words long, text binary, seeds array<struct<h: long, at: int>>"


def seed(docs: DataFrame, table: np.ndarray, windows: list[int]) -> DataFrame:
    """One row per document: key, doc_id, n_words and, where fingerprints are in the bit table, those and the text."""
    seeds_type = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))

    def found(words: list[list[bytes]], hashes: WordHashes) -> list[list | None]:
        sizes = np.array([len(w) for w in words])
        document = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        flat = hashes.of([w for ws in words for w in ws])
        out: list[list | None] = [None] * len(words)
        starts = np.cumsum(sizes) - sizes
        for window in windows:
            h, at = fingerprints(flat, document, window)
            place = h.view(np.uint64) >> np.uint64(64 - BITS)
            hit = table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1
            at, first = np.unique(at[hit], return_index=True)
            for x, a in zip(h[hit][first].tolist(), at.tolist()):
                d = document[a]
                if out[d] is None:
                    out[d] = []
                out[d].append({"h": x, "at": a - int(starts[d])})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch["text"]
            counts, seeds, kept = [], [], []
            some, size, first = [], 0, 0
            for i in range(len(batch)):
                some.append(split(texts[i].as_py()))
                size += len(some[-1])
                if size >= WORDS or i == len(batch) - 1:
                    these = found(some, hashes)
                    counts += [len(w) for w in some]
                    seeds += these
                    kept += [texts[first + j].as_py() if s else None for j, s in enumerate(these)]
                    some, size, first = [], 0, i + 1
            columns = [batch["key"], batch["doc_id"], pa.array(counts, pa.int64()), pa.array(kept, pa.binary()), pa.array(seeds, seeds_type)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "n_words", "text", "seeds"])

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, SEEDED)


def spans_of(hits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word + 1 of the runs that overlapping windows make up; `hits` are their starts in order."""
    new = np.concatenate([[True], hits[1:] > hits[:-1] + width])
    return hits[new], np.concatenate([hits[:-1][new[1:]], hits[-1:]]) + width


EXTENDED = "key long, class long, lo array<int>, hi array<int>"


def extend(seeded: DataFrame, length: int) -> DataFrame:
    """Hit spans of each document and class; rows carry text and `seen`, classes with their words and seed positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = {}
        windows: dict[int, tuple[int, set[bytes]]] = {}

        def learn(name: int, words: list[bytes]) -> None:
            row = np.array([ids.setdefault(w, len(ids)) for w in words], np.int32)
            width = min(length, len(row))
            windows[name] = width, {row[i : i + width].tobytes() for i in range(len(row) - width + 1)}

        for batch in batches:
            out = []
            for key, text, seen in zip(batch["key"], batch["text"], batch["seen"]):
                if len(windows) > KEPT:
                    ids.clear()
                    windows.clear()
                seen = seen.as_py()
                for s in seen:
                    if s["class"] not in windows:
                        learn(s["class"], s["words"].split())
                words = split(text.as_py())
                row = np.fromiter((ids.get(w, -1) for w in words), np.int32, len(words))
                for s in seen:
                    width, known = windows[s["class"]]
                    # A seed is a k-gram of half a window; the windows around it start up to the other half earlier.
                    at = np.array(s["at"], np.int64)
                    starts = np.unique(at[:, None] - np.arange(width - (width + 1) // 2 + 1))
                    starts = starts[(starts >= 0) & (starts + width <= len(row))]
                    hits = starts[[row[i : i + width].tobytes() in known for i in starts]] if len(starts) else starts
                    if len(hits):
                        out.append((key.as_py(), s["class"], *spans_of(hits, width)))
            columns = list(zip(*out)) or [(), (), (), ()]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([c.tolist() for c in columns[2]], ints), pa.array([c.tolist() for c in columns[3]], ints)],
                ["key", "class", "lo", "hi"],
            )

    return seeded.select("key", "text", "seen").mapInArrow(run, EXTENDED)


def decontaminate(docs: DataFrame, items: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, `spans` (array of lo, hi: hit words lo to hi - 1, overlapping
    ones of several items not merged) and `items` (sorted ids as strings, of which some window occurs).

    Words are runs of a-z, digits and characters beyond ASCII, A-Z lower-cased. An item's windows are all runs of
    `length` of its words, or all its words if it has fewer; items without words or without id take no part. Item ids
    are distinct: an id whose rows have different texts counts once. Null texts have no words. Rows that share a doc_id,
    or have none, are documents of their own. Empty tables of items give documents without hits. Columns other than
    doc_id, text, item_id are not read.

    Classes of equal items are joined, not broadcast; only a bit table of 4 MB goes to every task. It keeps documents
    without a fingerprint of any item from being written again, and lets all pass where there are very many items.
    """
    classes = materialize(item_classes(items, length), "leak-classes")
    prints = materialize(item_fingerprints(classes), "leak-prints")
    windows = sorted(r["window"] for r in classes.select("window").distinct().collect())
    seeded = materialize(seed(docs, bit_table(prints), windows), "leak-seeds")
    seeds = seeded.where("seeds IS NOT NULL").select("key", F.explode("seeds").alias("s")).select("key", "s.*")
    pairs = seeds.join(prints, "h").groupBy("key", "class").agg(F.collect_set("at").alias("at"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("class"))
    sliced = pairs.withColumn("slice", F.floor((turn - 1) / SLICE)).join(classes.select("class", "words"), "class")
    seen = sliced.groupBy("key", "slice").agg(F.collect_list(F.struct("class", "words", "at")).alias("seen"))
    texts = seeded.where("seeds IS NOT NULL").select("key", "text")
    found = materialize(extend(texts.join(seen, "key"), length), "leak-spans")
    spans = found.select("key", F.explode(F.arrays_zip("lo", "hi")).alias("s")).select("key", "s.*").distinct()
    past = F.max("hi").over(Window.partitionBy("key").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(past, F.lit(0))))
    hit = spans.withColumn("fresh", fresh).groupBy("key").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    named = found.select("key", "class").join(classes.select("class", F.explode("items").alias("item")), "class")
    named = named.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    whole = seeded.select("key", "doc_id", "n_words").join(hit, "key", "left").join(named, "key", "left")
    none = F.array().cast("array<struct<lo: int, hi: int>>")
    return whole.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
