"""Filter interaction audit: what each order of five text filters removes, from one survival word per document.

A document that fails the filters F survives a set of filters S if F and S are disjoint. Its survival word has bit S set
for each of the 32 sets it survives. Adding the words up position by position gives the survivors of every set, and
every order and every step is a difference of two of them; no order is applied to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.session import materialize

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
SYMBOLS = "#$%&*|"
#: Parts whose sums a task holds before it hands them on.
PARTS = 4096
#: Rows of one text are dealt to so many tasks when they look up its smallest id.
SALTS = 16

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))


def truth_word(fails: int) -> int:
    """Bit S is set if a document that fails `fails` survives the set of filters S."""
    return sum(1 << s for s in range(SETS) if not s & fails)


TRUTH = np.array([truth_word(f) for f in range(SETS)], np.uint32)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits set, by carry-save addition.

    Three words of one weight become their sum bits of that weight and their carries of twice the weight, 32 counters at
    a time; what is left of each weight, two words at most, is added to the counts.
    """
    counts, weight = np.zeros(32, np.int64), 1
    places = np.arange(32, dtype=np.uint32)
    while len(words):
        carries = []
        while len(words) > 2:
            n = len(words) // 3
            a, b, c = words[:n], words[n : 2 * n], words[2 * n : 3 * n]
            half = a ^ b
            carries.append(a & b | half & c)
            words = np.concatenate([half ^ c, words[3 * n :]])
        counts += weight * (words[:, None] >> places & np.uint32(1)).sum(axis=0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def failed_filters(
    docs: DataFrame, *, min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3, symbols: str = SYMBOLS
) -> DataFrame:
    """One row per row of `docs`: doc_id, `part` (lang, empty for null) and `fails`, filter A as bit 0 to E as bit 4.

    A: under `min_words` words; B: distinct words below `distinct_percent` of the words; C: capitals A-Z above
    `capital_percent` of the code points; D: holds one of `symbols`; E: the text equals that of a row with a smaller
    doc_id (by SHA-256 of the whole text). Words are what lies between ASCII white space, case-sensitive.

    Null texts count as empty: they fail A, and E if a smaller doc_id is empty too. A row without doc_id neither fails E
    nor makes others fail. Rows of one doc_id are rows of their own and equal to none of the same id. Columns other than
    doc_id, lang and text are not read.
    """
    signs = symbols.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fails, digests = np.zeros(len(batch), np.int32), []
            for i, value in enumerate(batch["text"]):
                text = value.as_py() or b""
                words = text.split()
                points = len(text.translate(None, _CONTINUATION))
                fails[i] = (
                    (len(words) < min_words)
                    | (100 * len(set(words)) < distinct_percent * len(words)) << 1
                    | (100 * (len(text) - len(text.translate(None, _CAPITALS))) > capital_percent * points) << 2
                    | (len(text.translate(None, signs)) < len(text)) << 3
                )
                digests.append(hashlib.sha256(text).digest())
            columns = [batch["doc_id"], batch["part"], pa.array(fails), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "fails", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    seen = materialize(rows.mapInArrow(run, "doc_id long, part string, fails int, digest binary"), "audit-rows")
    several = seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    fails = F.when(copy, F.col("fails") + 16).otherwise(F.col("fails"))
    dealt = seen.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(several, ["digest", "salt"], "left").select("doc_id", "part", fails.alias("fails"))


SURVIVORS = "part string, filters int, kept long, good long, toxic long"


def survivors(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and set of filters: documents that survive it, those of label quality = 1 and those of toxic = 1.

    A document is good (toxic) if any label row of its doc_id says so; one without label rows is neither. Survival words
    are added up in the tasks that read them; 32 rows per part and task are summed by Spark.
    """
    marks = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    marked = failed.join(marks, "doc_id", "left").select(
        "part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )

    def rows(sums: dict) -> pd.DataFrame:
        return pd.concat(
            pd.DataFrame({"part": part, "filters": np.arange(SETS, dtype=np.int32), "kept": n[0], "good": n[1], "toxic": n[2]})
            for part, n in sums.items()
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, group in batch.groupby("part", sort=False):
                words = TRUTH[group["fails"].to_numpy()]
                total = sums.setdefault(part, np.zeros((3, SETS), np.int64))
                total[0] += positional_counts(words)
                total[1] += positional_counts(words[group["good"].to_numpy()])
                total[2] += positional_counts(words[group["toxic"].to_numpy()])
                if len(sums) >= PARTS:
                    yield rows(sums)
                    sums = {}
        if sums:
            yield rows(sums)

    return marked.mapInPandas(run, SURVIVORS).groupBy("part", "filters").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])


REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def report(counts: DataFrame) -> DataFrame:
    """All orders and steps of each part from its 32 survivor counts."""
    bit = {name: 1 << i for i, name in enumerate(FILTERS)}
    steps = []
    for order in permutations(FILTERS):
        passed = 0
        for step, name in enumerate(order, 1):
            steps.append(("".join(order), step, bit[name], passed, passed | bit[name]))
            passed |= bit[name]
    named = pd.DataFrame(steps, columns=["filter_order", "step", "bit", "before", "after"])
    mine, before, after = (named[c].to_numpy() for c in ("bit", "before", "after"))
    everything = SETS - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                kept, good, toxic = (np.array([s[c] for s in row.sets], np.int64) for c in ("kept", "good", "toxic"))
                removed = kept[before] - kept[after]
                shapley = np.zeros(SETS, np.int64)
                for b in bit.values():
                    for s in range(SETS):
                        if not s & b:
                            size = s.bit_count()
                            shapley[b] += factorial(size) * factorial(len(FILTERS) - 1 - size) * (kept[s] - kept[s | b])
                yield named[["filter_order", "step"]].assign(
                    part=row.part,
                    step=named["step"].astype("int32"),
                    kept=kept[after],
                    removed=removed,
                    redundant=kept[0] - kept[mine] - removed,
                    unique_fails=kept[everything ^ mine] - kept[everything],
                    good_lost=good[before] - good[after],
                    toxic_lost=toxic[before] - toxic[after],
                    shapley=shapley[mine],
                )[[f.split()[0] for f in REPORT.split(", ")]]

    sets = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("filters", "kept", "good", "toxic"))).alias("sets"))
    return sets.mapInPandas(run, REPORT)


def audit(docs: DataFrame, labels: DataFrame, **thresholds) -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley (the removed documents of the step's filter summed over all orders).

    `thresholds` go to `failed_filters`, which also says what nulls, ties and repeated rows do. A part is a value of
    lang, null counting as empty; an empty table has no parts and gives no rows.
    """
    return report(survivors(failed_filters(docs, **thresholds), labels))
