"""Hard-negative mining: a forest of cover trees over norm-augmented candidates, searched best-first.

Rows are dealt into blocks of bounded size, and each block becomes a cover tree. A coordinate that brings every vector of
the block to the same norm is added, so that the inner product with an anchor falls with the distance, and the covering
radius of a node bounds the inner products of all its rows from both sides. A search takes the open node of the largest
bound, leaves nodes whose bounds lie outside all windows (or below what has been found), and scores the rows of a leaf
exactly. Anchors meet every block in chunks of bounded size.
"""

from __future__ import annotations

from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.session import materialize

#: Rows of a block, anchors of a chunk, and anchors that descend together.
BLOCK, CHUNK, TOGETHER = 8192, 32768, 512
#: A leaf's rows, a node's children, and how much smaller the next level's covering radius should be.
LEAF, FAN, BASE = 128, 64, 1.3
#: Sums below this are exact in double precision.
EXACT = float(1 << 53)
#: Largest score; its negative is the least, and NONE stands for no row.
MOST = (1 << 63) - 1
NONE = -MOST - 1


def cover(points: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, float]]]:
    """Order of the points and nodes (first, end, parent, covering radius) of a cover tree; parents come first.

    A node is a slice of the order whose first point is its centre. Its children's centres are picked farthest first, so
    that they are separated by the radius that covers the rest, and its own centre is the first of them. Slices of up to
    LEAF points, or of equal ones, are leaves.
    """
    order = np.arange(len(points))
    nodes: list[tuple[int, int, int, float]] = []
    open_nodes = [(0, len(points), -1, np.linalg.norm(points - points[0], axis=1))] if len(points) else []
    while open_nodes:
        first, end, parent, near = open_nodes.pop()
        node, radius = len(nodes), float(near.max())
        nodes.append((first, end, parent, radius))
        if end - first <= LEAF or radius == 0:
            continue
        mine = order[first:end].copy()
        owner, near, centres = np.zeros(len(mine), np.int64), near.copy(), [0]
        while len(centres) < FAN and near.max() > radius / BASE:
            centres.append(int(near.argmax()))
            away = np.linalg.norm(points[mine] - points[mine[centres[-1]]], axis=1)
            closer = away < near
            owner[closer], near[closer] = len(centres) - 1, away[closer]
        at = first
        for child, centre in enumerate(centres):
            members = np.flatnonzero(owner == child)
            members = np.concatenate([[centre], members[members != centre]])
            order[at : at + len(members)] = mine[members]
            open_nodes.append((at, at + len(members), node, near[members]))
            at += len(members)
    return order, nodes


INDEX = "block int, place int, vec_id long, label int, vector array<double>, norm double, nodes array<struct<node: int, end: int, parent: int, radius: double>>"


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.combine_chunks().flatten() if len(column) else pa.array([], pa.float64())
    return flat.to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, 0))


def index(rows: DataFrame, blocks: int) -> DataFrame:
    """Cover trees as a table: rows in the order of their block's tree, with the nodes that start at each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec_id")
        vectors = matrix(table["vector"])
        squares = (vectors * vectors).sum(axis=1)
        top = squares.max()
        order, nodes = cover(np.column_stack([vectors, np.sqrt(top - squares)]))
        starting: list[list[dict]] = [[] for _ in order]
        for i, (first, end, parent, radius) in enumerate(nodes):
            starting[first].append({"node": i, "end": end, "parent": parent, "radius": radius})
        kept = table.take(pa.array(order)).select(["block", "vec_id", "label", "vector"])
        kind = pa.list_(pa.struct([("node", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("radius", pa.float64())]))
        columns = {c: kept[c] for c in kept.column_names} | {
            "place": pa.array(np.arange(len(order), dtype=np.int32)),
            "norm": pa.array(np.full(len(order), np.sqrt(top))),
            "nodes": pa.array(starting, kind),
        }
        return pa.table({c.split()[0]: columns[c.split()[0]] for c in ("block", "place", "vec_id", "label", "vector", "norm", "nodes")})

    dealt = rows.withColumn("block", F.expr(f"int(pmod(xxhash64(vec_id), {blocks}))"))
    return dealt.select("block", "vec_id", "label", "vector").groupBy("block").applyInArrow(run, INDEX)


class Tree:
    """A block's cover tree as it is read back."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by("place")
        self.vectors, self.ids, self.labels = matrix(table["vector"]), table["vec_id"].to_numpy(), table["label"].to_numpy()
        self.norm = table["norm"][0].as_py()
        found = [(n["node"], first, n["end"], n["parent"], n["radius"]) for first, ns in enumerate(table["nodes"].to_pylist()) for n in ns]
        _, self.first, self.end, self.parent, self.radius = (np.array(c) for c in zip(*sorted(found)))
        self.children: list[list[int]] = [[] for _ in found]
        for node, parent in enumerate(self.parent[1:], 1):
            self.children[parent].append(node)
        self.largest = np.abs(self.vectors).max(initial=0)

    def products(self, anchors: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        """Exact inner products; whole numbers beyond double precision are multiplied as such and kept within 64 bits."""
        vectors = self.vectors[rows]
        if self.largest * np.abs(anchors).max(initial=0) * max(1, vectors.shape[1]) < EXACT:
            return anchors @ vectors.T
        whole = [[int(x) for x in r] for r in vectors.tolist()], [[int(x) for x in r] for r in anchors.tolist()]
        exact = [[min(max(sum(x * y for x, y in zip(a, v)), -MOST), MOST) for v in whole[0]] for a in whole[1]]
        return np.array(exact, np.int64).reshape(len(anchors), len(vectors))

    def bounds(self, anchors: np.ndarray, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each anchor with the rows of each node."""
        middle = anchors @ self.vectors[self.first[nodes]].T
        radius, length = self.radius[nodes], np.linalg.norm(anchors, axis=1)[:, None]
        # An anchor's added coordinate is 0: distance to the centre, then to the rows of its ball.
        away = np.sqrt(np.maximum(length**2 + self.norm**2 - 2 * middle, 0))
        reach = length * radius
        above = np.minimum(reach, np.where(away > radius, away * radius - radius**2 / 2, np.inf))
        below = np.minimum(reach, away * radius + radius**2 / 2)
        slack = 1e-9 * (length * self.norm + reach) + 1e-9
        return np.minimum(middle - below - slack, MOST), np.maximum(middle + above + slack, -MOST)

    def search(self, anchors: np.ndarray, wanted: Wanted) -> None:
        """Best-first: the node of the largest bound first, with the anchors that still need it."""
        turn = count()
        everyone = np.arange(len(anchors))
        heap: list[tuple] = []

        def put(nodes: list[int], who: np.ndarray) -> None:
            low, high = self.bounds(anchors[who], nodes)
            for i, node in enumerate(nodes):
                best = wanted.best(who, low[:, i], high[:, i])
                need = best > -np.inf
                if need.any():
                    heappush(heap, (-best.max(), next(turn), node, who[need], low[need, i], high[need, i]))

        put([0], everyone)
        while heap:
            _, _, node, who, low, high = heappop(heap)
            who = who[wanted.best(who, low, high) > -np.inf]
            if not len(who):
                continue
            if self.children[node]:
                put(self.children[node], who)
            else:
                rows = slice(self.first[node], self.end[node])
                wanted.take(who, self.products(anchors[who], rows), self.ids[rows], self.labels[rows])


class Wanted:
    """The best rows of each anchor and window so far: scores and ids, highest first, smaller ids first among ties.

    `low` and `high` bound the windows (anchors × windows); `alike` says whether rows of the anchor's label count or the
    others. An anchor's own id never counts.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, alike: bool):
        self.anchor_ids, self.anchor_labels, self.low, self.high, self.most, self.alike = ids, labels, low, high, most, alike
        self.scores = np.full((*low.shape, most), NONE)
        self.ids = np.full((*low.shape, most), np.iinfo(np.int64).max)

    def floor(self, who: np.ndarray) -> np.ndarray:
        return np.maximum(self.low[who], self.scores[who, :, -1])

    def best(self, who: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Largest score that rows within the bounds can add to some window; minus infinity if none."""
        most = np.minimum(high[:, None], self.high[who])
        use = (high[:, None] >= self.floor(who)) & (low[:, None] <= self.high[who])
        return np.where(use, most, -np.inf).max(axis=1, initial=-np.inf)

    def take(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        counts = (labels == self.anchor_labels[who, None]) == self.alike
        counts &= ids != self.anchor_ids[who, None]
        floor = self.floor(who)
        for window in range(self.low.shape[1]):
            # Ties with the last one found count, as a smaller id goes before it.
            row, column = np.nonzero(counts & (scores >= floor[:, window, None]) & (scores <= self.high[who, window, None]))
            if len(row):
                self.merge(window, who[row], scores[row, column], ids[column])

    def merge(self, window: int, anchor: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(anchor)
        anchor = np.concatenate([anchor, np.repeat(touched, self.most)])
        scores = np.concatenate([scores.astype(np.int64), self.scores[touched, window].ravel()])
        ids = np.concatenate([ids, self.ids[touched, window].ravel()])
        order = np.lexsort((ids, ~scores, anchor))  # ~ falls as the score rises, without overflow
        anchor, scores, ids = anchor[order], scores[order], ids[order]
        starts = np.searchsorted(anchor, touched)
        rank = np.arange(len(anchor)) - np.repeat(starts, np.diff([*starts, len(anchor)]))
        keep = rank < self.most
        self.scores[anchor[keep], window, rank[keep]] = scores[keep]
        self.ids[anchor[keep], window, rank[keep]] = ids[keep]

    def found(self) -> tuple[np.ndarray, ...]:
        anchor, window, rank = np.nonzero(self.scores > NONE)
        return self.anchor_ids[anchor], window, self.ids[anchor, window, rank], self.scores[anchor, window, rank]


HITS = "anchor_id long, slot int, vec_id long, score long"


def descend(trees: DataFrame, anchors: DataFrame, blocks: int, chunks: int, most: int, *, alike: bool) -> DataFrame:
    """The first `most` rows of each anchor and window in each block, and of these the first of all blocks.

    `anchors` has vec_id, label, vector and arrays low and high with a window's bounds at each place.
    """
    kind = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(block: pa.Table, asking: pa.Table) -> pa.Table:
        parts = []
        if block.num_rows and asking.num_rows:
            tree = Tree(block)
            for start in range(0, asking.num_rows, TOGETHER):
                some = asking.slice(start, TOGETHER)
                low, high = ([w or [] for w in some[c].to_pylist()] for c in ("low", "high"))
                width = max(map(len, low))
                bounds = [np.array([w + [empty] * (width - len(w)) for w in ws], np.int64).reshape(len(low), width) for ws, empty in ((low, MOST), (high, NONE))]
                wanted = Wanted(some["vec_id"].to_numpy(), some["label"].to_numpy(), *bounds, most, alike)
                tree.search(matrix(some["vector"]), wanted)
                parts.append(pa.table(dict(zip(kind.names, wanted.found()))).cast(kind))
        return pa.concat_tables(parts) if parts else kind.empty_table()

    # A given number of partitions: small blocks are much work and must not be put together by size.
    pairs = min(blocks * chunks, 20_000)
    left = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = anchors.withColumn("chunk", F.expr(f"int(pmod(xxhash64(vec_id, 1), {chunks}))")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    left, right = (df.repartition(pairs, "block", "chunk") for df in (left, right))
    hits = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(run, HITS)
    first = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)


def whole_numbers(rows: DataFrame, scale: float = 256) -> DataFrame:
    """Rows that take part: vec_id, label, and vector with floor(scale * x) for each component x, as double.

    Rows without vec_id, label or vector, and rows with a null or non-finite component, take no part.
    """
    times = F.transform("embedding", lambda x: x.cast("double") * scale)
    # Doubles from 2^53 on are whole already and may exceed what floor can return.
    floors = F.transform(times, lambda x: F.when(F.abs(x) >= EXACT, x).otherwise(F.floor(x).cast("double")))
    odd = F.exists(times, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~odd)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), floors.alias("vector"))


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """For each anchor and each of its first `positives` other rows of the same label, the first `negatives` rows of
    another label whose score is at least `low` and at most `high` percent of the positive's.

    `rows` has vec_id, label and vector (whole numbers as double); a score is the inner product with the anchor, higher
    ones come first and smaller ids first among ties. Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Anchors without another row of their label, and positives with no row in the window (all those of a
    negative score), give no rows. Of rows with one vec_id the least (label, vector) counts; vectors that are shorter
    than the longest are filled up with zeros. An empty table gives no rows.
    """
    spark = rows.sparkSession
    single = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")
    single = materialize(single, "mining-rows")
    size, dims, asking = single.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0)), F.count_if(is_anchor)).first()
    if not size or not dims:
        return spark.createDataFrame([], MINED)
    filled = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("vector")))
    single = single.withColumn("vector", filled)
    blocks, chunks = -(-size // BLOCK), max(1, -(-asking // CHUNK))
    trees = materialize(index(single, blocks), "mining-trees")
    anchors = single.where(is_anchor)
    whole = F.array(F.lit(-MOST)), F.array(F.lit(MOST))
    nearest = descend(trees, anchors.select("vec_id", "label", "vector", whole[0].alias("low"), whole[1].alias("high")), blocks, chunks, positives, alike=True)
    # 100 * score >= low * positive and 100 * score <= high * positive, in whole numbers.
    score = F.col("score").cast("decimal(19,0)")
    windows = F.struct(
        "rank", F.col("vec_id").alias("id"), "score", F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high")
    )
    listed = nearest.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(windows)).alias("windows"))
    asked = materialize(anchors.join(listed, "vec_id"), "mining-windows")
    bounds = asked.select("vec_id", "label", "vector", F.col("windows.low").alias("low"), F.col("windows.high").alias("high"))
    found = descend(trees, bounds, blocks, chunks, negatives, alike=False)
    positive = asked.select(F.col("vec_id").alias("anchor_id"), F.posexplode("windows").alias("slot", "positive"))
    return found.join(positive, ["anchor_id", "slot"]).select(
        "anchor_id",
        F.col("positive.id").alias("positive_id"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
