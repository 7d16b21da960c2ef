"""Quality classifier: a generalised additive model with pairwise interactions, boosted in turn per feature."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.session import materialize

FEATURES = (
    "log_chars",
    "log_words",
    "word_length",
    "alphabetic_words",
    "upper_words",
    "short_words",
    "long_words",
    "distinct_words",
    "top_word",
    "adjacent_repeats",
    "distinct_pairs",
    "capital_words",
    "digits",
    "stops",
    "commas",
    "marks",
    "bangs",
    "bars",
    "other_bytes",
    "log_lines",
    "repeated_lines",
    "line_words",
    "stop_ends",
)
#: ASCII signs other than stops, commas, quotes, hyphens and brackets.
_MARKS = np.array([b in b"#$%&*+/<=>@\\^_`{|}~" for b in range(256)])
#: Labelled rows that a fit reads at most, chosen by a hash of their id.
FIT_ROWS = 20_000
THRESHOLD = 0.7


def features(text: str) -> list[float]:
    """What the model sees of a text; all zero for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = raw.sum()
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x]
    return [
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        float(lengths.mean()),
        sum(map(str.isalpha, words)) / n,
        sum(map(str.isupper, words)) / n,
        float((lengths <= 3).mean()),
        float((lengths >= 9).mean()),
        len(set(words)) / n,
        Counter(words).most_common(1)[0][1] / n,
        sum(map(eq, words, words[1:])) / n,
        (len(set(zip(words, words[1:]))) + 1) / n,
        sum(map(str.istitle, words)) / n,
        float(raw[48:58].sum() / size),
        float(raw[46] / n),
        float(raw[44] / n),
        float(raw[_MARKS].sum() / size),
        float(raw[33] / n),
        float(raw[124] / n),
        float(raw[128:].sum() / size),
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        sum(x[-1] in ".!?:" for x in lines) / len(lines),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return texts.map(features)


def feature_column(text: Column) -> Column:
    return _features(F.coalesce(text, F.lit("")))


def _leaves(gain: Callable, cells: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """Boxes of cells after up to `depth` greedy cuts along any axis. `cells` is a mask over a table."""
    best = None
    if depth:
        whole = gain(cells)
        for axis in range(cells.ndim):
            for cut in range(1, cells.shape[axis]):
                low = cells & (np.arange(cells.shape[axis]) < cut).reshape([-1 if a == axis else 1 for a in range(cells.ndim)])
                high = cells & ~low
                got = gain(low) + gain(high) - whole
                if low.any() and high.any() and (best is None or got > best[0] + 1e-9):
                    best = got, low, high
    if best is None or best[0] <= 1e-9:
        yield cells
        return
    yield from _leaves(gain, best[1], depth - 1)
    yield from _leaves(gain, best[2], depth - 1)


def _runs(g: np.ndarray, h: np.ndarray, depth: int, smooth: float) -> np.ndarray:
    """Leaf values of a shallow tree over the bins of one feature, by cumulative sums."""
    out = np.empty(len(g))

    def grow(a: int, b: int, left: int) -> None:
        G, H = g[a:b].sum(), h[a:b].sum()
        if left and b - a > 1:
            cg, ch = g[a:b].cumsum()[:-1], h[a:b].cumsum()[:-1]
            gain = cg**2 / (ch + smooth) + (G - cg) ** 2 / (H - ch + smooth)
            cut = int(gain.argmax())
            if gain[cut] > G**2 / (H + smooth) + 1e-9:
                grow(a, a + cut + 1, left - 1)
                grow(a + cut + 1, b, left - 1)
                return
        out[a:b] = G / (H + smooth)

    grow(0, len(g), depth)
    return out


@dataclass
class Additive:
    """Cut points and lookup tables; a score is the intercept plus one entry per table."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.single):
            total += table[np.searchsorted(self.cuts[f], x[:, f], "right")]
        bins = {f: np.searchsorted(self.coarse[f], x[:, f], "right") for f in {f for p in self.pairs for f in p}}
        for (f, g), table in self.pairs.items():
            total += table[bins[f], bins[g]]
        return 1 / (1 + np.exp(-total))


def _cuts(x: np.ndarray, n: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1]))


def fit(
    x: np.ndarray, y: np.ndarray, *, rounds: int = 150, rate: float = 0.1, depth: int = 2, bins: int = 48, most_pairs: int = 8, smooth: float = 5.0
) -> Additive:
    """Boost tables in turn: every round gives each feature one shallow tree on the gradients, then the pairs likewise.

    Pairs are the ones whose coarse tables explain most of what the single features leave over. One label only, or no
    rows, gives the intercept alone.
    """
    if not len(y):
        x = np.zeros((1, x.shape[1]))
    model = Additive([_cuts(c, bins) for c in x.T], [_cuts(c, 8) for c in x.T])
    share = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(share / (1 - share)))
    model.single = [np.zeros(len(c) + 1) for c in model.cuts]
    if len(np.unique(y)) < 2:
        return model
    fine = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.cuts)]
    rough = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.coarse)]
    total = np.full(len(y), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, at in enumerate(fine):
            g, h = (np.bincount(at, v, len(model.single[f])) for v in gradients())
            step = rate * _runs(g, h, depth, smooth)
            model.single[f] += step
            total += step[at]

    def sums(f: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.coarse[f]) + 1, len(model.coarse[k]) + 1
        at = rough[f] * shape[1] + rough[k]
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in grads)

    grads, ranked = gradients(), []
    for f, k in combinations(range(len(fine)), 2):
        g, h = sums(f, k)
        ranked.append(((g**2 / (h + smooth)).sum(), f, k))
    chosen = [(f, k) for _, f, k in sorted(ranked, reverse=True)[:most_pairs]]
    model.pairs = {p: np.zeros([len(model.coarse[f]) + 1 for f in p]) for p in chosen}
    for _ in range(rounds // 5):
        for f, k in chosen:
            grads = gradients()
            g, h = sums(f, k)
            step = np.zeros(g.shape)
            for leaf in _leaves(lambda m: g[m].sum() ** 2 / (h[m].sum() + smooth), np.ones(g.shape, bool), depth):
                step[leaf] = rate * g[leaf].sum() / (h[leaf].sum() + smooth)
            model.pairs[f, k] += step
            total += step[rough[f], rough[k]]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> Additive:
    """Fit on rows (doc_id, features) that have a label and are not held out.

    Of more than `most` of them a hash of the id chooses a share that comes close to `most`, so that what reaches the
    driver is bounded and no task sorts all labelled rows.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("_label"))
    joined = rows.join(known, "doc_id").select("features", "_label", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("_slot"))
    share = 0.95 * most / max(1, joined.count())
    chosen = joined if share >= 0.95 else joined.where(F.col("_slot") < int(share * (1 << 20)))
    sample = sorted(chosen.orderBy("_slot").limit(most).select("features", "_label").collect())
    x = np.array([r[0] for r in sample], float).reshape(len(sample), len(FEATURES))
    return fit(x, np.array([float(r[1]) for r in sample]))


def scorer(model: Additive) -> Callable[[Column], Column]:
    """Score column of a feature column; the tables are a few KB."""

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(rows.to_list()))) if len(rows) else pd.Series([], dtype=float)

    return score


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from `threshold` on) of every row.

    Features come from the whole text alone. Null texts count as empty, and every text without words has the same
    score. A row without doc_id is held out; rows that share an id are scored each by its own text. With no labels, or
    one label only, every score is the smoothed share of label 1. Other columns of either table are not read.
    """
    rows = materialize(docs.select("doc_id", feature_column(F.col("text")).alias("features")), "quality-features")
    score = scorer(train(rows, labels, most=most))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("features")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, most: int = FIT_ROWS) -> DataFrame:
    """The rows that `classify` predicts to be good, with the columns they came with.

    The labelled rows to fit on are chosen by their ids before any features are computed: at most about `most` ids, which
    every task may hold. Nulls, ties and repeated rows are as in `classify`.
    """
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    share = 0.95 * most / max(1, known.count())
    chosen = known if share >= 0.95 else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    few = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    rows = materialize(few.select("doc_id", feature_column(F.col("text")).alias("features")), "quality-features")
    score = scorer(train(rows, labels, most=most))
    return docs.where(score(feature_column(F.col("text"))) >= threshold)
