"""A small classification tree (Gini impurity, binary splits), for models trained here on small labelled tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Node:
    label: str
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def predict(self, row: Sequence[float]) -> str:
        node = self
        while node.low is not None:
            node = node.low if row[node.feature] <= node.threshold else node.high
        return node.label


def _gini(counts: Counter, n: int) -> float:
    return 1.0 - sum((c / n) ** 2 for c in counts.values())


def train(rows: Sequence[Sequence[float]], labels: Sequence[str], depth: int = 12, least: int = 1) -> Node:
    """The tree over all rows; ties go to the first feature and the lowest threshold, so training is deterministic."""
    counts = Counter(labels)
    label = min(counts, key=lambda k: (-counts[k], k))
    if depth == 0 or len(counts) == 1:
        return Node(label)
    best = (_gini(counts, len(labels)) - 1e-9, -1, 0.0)
    for f in range(len(rows[0])):
        order = sorted(range(len(rows)), key=lambda i: rows[i][f])
        low, high = Counter(), Counter(labels)
        for k in range(len(order) - 1):
            low[labels[order[k]]] += 1
            high[labels[order[k]]] -= 1
            a, b = rows[order[k]][f], rows[order[k + 1]][f]
            if a == b or k + 1 < least or len(order) - k - 1 < least:
                continue
            impurity = ((k + 1) * _gini(low, k + 1) + (len(order) - k - 1) * _gini(high, len(order) - k - 1)) / len(order)
            if impurity < best[0] - 1e-12:
                best = (impurity, f, (a + b) / 2)
    if best[1] < 0:
        return Node(label)
    f, cut = best[1], best[2]
    pick = [[i for i in range(len(rows)) if (rows[i][f] <= cut) == side] for side in (True, False)]
    low, high = (train([rows[i] for i in p], [labels[i] for i in p], depth - 1, least) for p in pick)
    return Node(label, f, cut, low, high)
