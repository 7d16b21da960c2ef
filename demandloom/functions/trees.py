"""Regression trees as bit sets of open leaves, so that mixtures of two rows are predicted by array operations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Bits of a leaf set, and the multiplier and shift that turn its lowest set bit into a slot.
_WORDS = ((32, np.uint32, 0x077CB531, 27), (64, np.uint64, 0x03F79D71B4CB0A89, 58))
MOST_LEAVES = 64


class LeafSets:
    """Numeric trees of at most 64 leaves, leaves counted from the left.

    A split that sends a row to the right closes the leaves on its left; the row ends in the lowest leaf still open. What
    a feature's value closes does not depend on the other features, so a mixture's open leaves are those that each of its
    values leaves open.
    """

    def __init__(self, trees: Sequence[dict[int, tuple]], weights: Sequence[float], features: int):
        """A tree maps node ids to (prediction, left, right, feature, threshold), the root is 0 and a leaf's left < 0."""
        marks: list[list[tuple]] = [[] for _ in range(features)]
        leaves = []
        for t, nodes in enumerate(trees):
            found: list[float] = []

            def walk(i: int) -> None:
                prediction, left, right, feature, threshold = nodes[i]
                if left < 0:
                    found.append(prediction)
                    return
                first = len(found)
                walk(left)
                marks[feature].append((threshold, t, first, len(found)))
                walk(right)

            walk(0)
            leaves.append(found)
        most = max(map(len, leaves))
        if most > MOST_LEAVES:
            raise ValueError(f"a tree of more than {MOST_LEAVES} leaves")
        bits, self._word, multiplier, shift = next(w for w in _WORDS if most <= w[0])
        self._multiplier, self._shift = self._word(multiplier), self._word(shift)
        whole = (1 << bits) - 1
        slot = [((multiplier << i) & whole) >> shift for i in range(bits)]
        values = np.zeros((len(trees), bits))
        for t, (found, weight) in enumerate(zip(leaves, weights)):
            for i, prediction in enumerate(found):
                values[t, slot[i]] = weight * prediction
        self._values, self._first = values.ravel(), np.arange(len(trees), dtype=self._word) * self._word(bits)
        self._cuts, self._open = [], []
        for listed in marks:
            cuts = sorted({m[0] for m in listed})
            table = np.full((len(cuts) + 1, len(trees)), whole, self._word)
            for threshold, t, first, end in listed:
                closed = ((1 << end) - 1) ^ ((1 << first) - 1)
                table[cuts.index(threshold) + 1 :, t] &= self._word(whole ^ closed)
            self._cuts.append(np.array(cuts))
            self._open.append(table)

    def open(self, rows: np.ndarray) -> np.ndarray:
        """Leaves left open by each value of `rows` (rows × features): rows × features × trees."""
        sides = [table[np.searchsorted(cuts, rows[:, f])] for f, (cuts, table) in enumerate(zip(self._cuts, self._open))]
        return np.stack(sides, axis=1)

    def predict(self, opened: np.ndarray) -> np.ndarray:
        """Prediction by the leaves open in each tree, the trees along the last axis."""
        lowest = opened & (~opened + self._word(1))
        lowest *= self._multiplier
        lowest >>= self._shift
        return self._values.take(lowest + self._first).sum(axis=-1)

    def switched(self, row: np.ndarray, base: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Mean change of the prediction by feature while `base` rows turn into `row`, one feature after another.

        `row` is features × trees and `base` pairs × features × trees, both as of `open`; `order` is pairs × features.
        """
        pairs, features = order.shape
        at = np.arange(pairs)
        left = [base[at, order[:, -1]]]
        for s in range(features - 2, -1, -1):
            left.append(left[-1] & base[at, order[:, s]])
        total, taken, before = np.zeros(features), row[order[:, 0]], self.predict(left[-1])
        for s in range(features):
            after = self.predict(taken & left[features - 2 - s] if s < features - 1 else taken)
            total += np.bincount(order[:, s], after - before, features)
            before = after
            if s < features - 1:
                taken = taken & row[order[:, s + 1]]
        return total / pairs
