"""Line deduplication: a suffix array over line ids by distributed prefix doubling, and deletion of repeated runs.

Every line is an id and every document a sequence of ids. Only lines that occur more than once take part, as no other
can lie in a repeated run. A suffix's rank by its first 2^j lines follows from two ranks by 2^(j-1) lines; ranks are
refined inside their group until no group splits, when they order all suffixes. A group of equal rank at level j is an
interval of the suffix array whose longest common prefix is at least 2^j, and two ranks name a run of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.common import word_count
from demandloom.session import materialize

#: A repeated run counts from so many words on, over any number of lines: any that is not blank, single short lines too.
MIN_WORDS = 1
#: Ranks and hashes are cut into blocks of so many bits for prefix sums, so that no window holds a whole group.
BLOCK_BITS = 12
#: Tasks that share the copies of one run.
SALTS = 16
RUNS = "doc_id long, row long, lo int, n int, head long, tail long"


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """Lines with their hashes and words; where one word is enough, 1 stands for any number."""
    text = F.coalesce("text", F.lit(""))
    words = word_count(F.col("_line")) if min_words > 1 else (F.btrim("_line", F.lit(" \t\n\x0b\x0c\r")) != "").cast("long")
    cut = docs.where("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("at", "_line")
    )
    return cut.select("doc_id", "row", "at", F.xxhash64("_line").alias("h"), F.hash("_line").alias("g"), words.alias("words"))


def _first_ranks(lines: DataFrame) -> DataFrame:
    """Lines that occur more than once, ranked by their hashes: 1 plus the number of smaller such lines."""
    counts = materialize(lines.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1"), "line-counts")
    block = F.shiftright("h", 64 - BLOCK_BITS).alias("block")
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over 4,096 blocks at most
    bases = counts.groupBy(block).agg(F.sum("n").alias("s")).select("block", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("h", "g").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.select("h", "g", "n", block).join(bases, "block")
    ranked = ranked.select("h", "g", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + 1).alias("rank"))
    return lines.join(ranked, ["h", "g"]).select("doc_id", "row", "at", "words", "rank").dropDuplicates(["doc_id", "row", "at"])


def _refined(active: DataFrame, reach: int) -> DataFrame:
    """Ranks by twice as many lines: each group is ordered by the rank `reach` lines further on, 0 past a run's end."""
    document = Window.partitionBy("doc_id", "row").orderBy("at").rangeBetween(reach, reach)
    ahead = active.withColumn("next", F.coalesce(F.max("rank").over(document), F.lit(0)))
    block = F.shiftright("next", BLOCK_BITS).alias("block")
    pairs = ahead.groupBy("rank", "next").agg(F.count("*").alias("n")).withColumn("block", block)
    earlier = Window.partitionBy("rank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = pairs.groupBy("rank", "block").agg(F.sum("n").alias("s"))
    bases = bases.select("rank", "block", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "block").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    moved = pairs.join(bases, ["rank", "block"]).select("rank", "next", (F.col("rank") + smaller).alias("_new"))
    return (
        ahead.join(moved, ["rank", "next"])
        .withColumn("ranks", F.concat("ranks", F.array("_new")))
        .select("doc_id", "row", "at", "words", F.col("_new").alias("rank"), "ranks")
    )


def suffix_ranks(docs: DataFrame, min_words: int = MIN_WORDS, *, whole: bool = False) -> DataFrame:
    """doc_id, row (hash of the text), at (line), words, and `ranks` by 1, 2, 4, … lines.

    Two ranks by 2^j lines name a run of up to 2^(j+1), so doubling stops at the longest of the runs that are to be
    named; with `whole` it goes on until no group splits, when ranks order all suffixes.
    """
    active = _first_ranks(materialize(_lines(docs, min_words), "lines")).withColumn("ranks", F.array("rank"))
    active = materialize(active, "line-ranks")
    longest = None if whole else _longest(active, min_words)
    groups = active.select("rank").distinct().count() if whole else 1
    reach = 1
    while groups and (whole or 2 * reach <= longest):
        refined = materialize(_refined(active, reach), "line-ranks")
        if whole:
            now = refined.select("rank").distinct().count()
            if now == groups:
                return active
            groups = now
        active, reach = refined, 2 * reach
    return active


def _pieces(lines: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stretches of repeated lines that follow each other: offset in the list, line numbers, words."""
    at = np.array([x["at"] for x in lines])
    words = np.array([x["words"] for x in lines])
    breaks = [0, *(np.flatnonzero(np.diff(at) != 1) + 1), len(at)]
    for a, b in zip(breaks, breaks[1:]):
        yield a, at[a:b], words[a:b]


def _longest(suffixes: DataFrame, least: int) -> int:
    """Lines of the longest of the shortest runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = [j - i + 1 for lines in batch["lines"] for _, _, words in _pieces(lines) for i, j in shortest_runs(words, least)]
            yield pd.DataFrame({"n": [max(lengths, default=0)]})

    lines = F.sort_array(F.collect_list(F.struct("at", "words"))).alias("lines")
    return suffixes.groupBy("doc_id", "row").agg(lines).select("lines").mapInPandas(run, "n int").agg(F.max("n")).first()[0] or 0


def shortest_runs(words: np.ndarray, least: int) -> set[tuple[int, int]]:
    """First and last line of the shortest runs of at least `least` words from each line on and up to each line.

    They cover exactly the lines of all runs of that many words.
    """
    ends = np.cumsum(words)
    starts = ends - words
    last = np.searchsorted(ends, starts + least)
    runs = {(i, int(j)) for i, j in enumerate(last) if j < len(words)}
    first = np.searchsorted(starts, ends - least, "right") - 1
    return runs | {(int(i), j) for j, i in enumerate(first) if i >= 0}


def _runs(suffixes: DataFrame, least: int) -> DataFrame:
    """Shortest runs of repeated lines, each named by its number of lines and two ranks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, row, lines in zip(batch["doc_id"], batch["row"], batch["lines"]):
                for a, at, words in _pieces(lines):
                    for i, j in shortest_runs(words, least):
                        n = j - i + 1
                        level = min(n.bit_length(), len(lines[a + i]["ranks"])) - 1
                        tail = a + j + 1 - (1 << level)
                        out.append((doc_id, row, at[i], n, lines[a + i]["ranks"][level], lines[tail]["ranks"][level]))
            yield pd.DataFrame(out, columns=["doc_id", "row", "lo", "n", "head", "tail"])

    lines = F.sort_array(F.collect_list(F.struct("at", "words", "ranks"))).alias("lines")
    return suffixes.groupBy("doc_id", "row").agg(lines).mapInPandas(run, RUNS)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs of lines, `lo` and `n`, that have a copy earlier in the corpus, by doc_id and line."""
    runs = materialize(_runs(suffix_ranks(docs, min_words), min_words), "line-runs")
    place = F.struct("doc_id", "row", "lo")
    first = runs.groupBy("n", "head", "tail").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    # Copies of one run are dealt to SALTS tasks when they look up the first of them.
    first = first.select("n", "head", "tail", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = runs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(first, ["n", "head", "tail", "salt"]).where(place > F.col("first")).select("doc_id", "row", "lo", "n")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Delete the later copies of every repeated run of lines that has at least `min_words` words.

    Returns the rows of `docs` with all their columns and `n_lines`, `n_removed` and `kept`, the lines that stay. Runs
    may be one long line or many short ones; lines are compared whole and unchanged. The first copy, by doc_id and line,
    stays, and copies that overlap it lose the lines that they add. Null and empty texts have no lines, and what is kept
    of them is empty. Rows without doc_id are neither changed nor compared. Rows alike in doc_id and text are one
    document and keep the same lines; rows that share only the doc_id are ordered by a hash of their texts. Columns
    named n_lines, n_removed or kept are replaced.
    """
    spans = repeated_runs(docs, min_words).groupBy(F.col("doc_id").alias("_d"), F.col("row").alias("_r"))
    spans = spans.agg(F.collect_set(F.struct("lo", (F.col("lo") + F.col("n") - 1).alias("hi"))).alias("_spans"))
    docs = docs.drop("n_lines", "n_removed", "kept")
    rows = docs.withColumn("_x", F.xxhash64("text"))
    joined = rows.join(spans, (rows["doc_id"] == spans["_d"]) & (rows["_x"] == spans["_r"]), "left")
    lines = F.split("text", "\n", -1)
    stay = F.filter(lines, lambda x, i: ~F.exists("_spans", lambda s: (i >= s["lo"]) & (i <= s["hi"])))
    text = F.coalesce("text", F.lit(""))
    n_lines = F.when(text == "", F.lit(0)).otherwise(F.size(lines)).cast("long")
    with_lines = joined.withColumn("_stay", F.when(F.col("_spans").isNotNull(), stay)).withColumn("n_lines", n_lines)
    return with_lines.select(
        *[F.col(c) for c in docs.columns],
        "n_lines",
        F.when(F.col("_stay").isNotNull(), F.col("n_lines") - F.size("_stay")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("_stay").isNotNull(), F.array_join("_stay", "\n")).otherwise(text).alias("kept"),
    )
