"""The exact nearest candidate without comparing all pairs.

Distances are weighted L1 over numbers plus weights of categories that differ: a metric.
So candidates are grouped around pivots, and a group is looked into only where the
triangle inequality leaves room for something nearer: the distance to its pivot less its
radius, and within the group only members whose own distance to the pivot is near enough.
What is skipped cannot be nearest; the result is that of all pairs, ties to the smaller
id included. Where nothing is clustered little is skipped, and little is lost.
"""

from __future__ import annotations

import numpy as np

#: Pivots at most, rows that they are chosen from, candidates compared at a time.
PIVOTS, SAMPLE, BLOCK = 256, 4096, 2048
#: Distances are compared to so many digits; bounds are loosened by more than that.
DIGITS, SLACK = 9, 1e-8


class Metric:
    """Weights of the numbers (None: 1 each) and of the categories."""

    def __init__(self, weight: np.ndarray | None = None, cat_weight: np.ndarray | None = None):
        self.weight, self.cat_weight = weight, cat_weight

    def distances(self, x: np.ndarray, k: np.ndarray | None, y: np.ndarray, l: np.ndarray | None) -> np.ndarray:  # noqa: E741
        """Every row of x, k to every row of y, l."""
        out = np.zeros((len(x), len(y)))
        for c in range(x.shape[1]):
            out += np.abs(x[:, c : c + 1] - y[None, :, c]) * (1.0 if self.weight is None else self.weight[c])
        if self.cat_weight is not None:
            for c in range(k.shape[1]):
                out += (k[:, c : c + 1] != l[None, :, c]) * self.cat_weight[c]
        return np.round(out, DIGITS)


def choose_pivots(x: np.ndarray, k: np.ndarray | None, metric: Metric, most: int) -> np.ndarray:
    """Rows far from each other, of a sample spread over all: each next one the farthest from those before."""
    rows = np.unique(np.linspace(0, len(x) - 1, min(len(x), SAMPLE)).astype(np.int64))
    of = lambda i: (x[rows[i : i + 1]], None if k is None else k[rows[i : i + 1]])
    every = (x[rows], None if k is None else k[rows])
    chosen, near = [0], metric.distances(*every, *of(0))[:, 0]
    while len(chosen) < min(most, len(rows)) and near.max() > 0:
        at = int(near.argmax())
        chosen.append(at)
        near = np.minimum(near, metric.distances(*every, *of(at))[:, 0])
    return rows[chosen]


class Index:
    """Candidates around pivots; what one task, or one group of rows, holds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: np.ndarray | None, metric: Metric):
        self.metric, self.compared = metric, 0
        self.names = None if k is None else [{v: i for i, v in enumerate(np.unique(k[:, c]).tolist())} for c in range(k.shape[1])]
        k = self._coded(k)
        pivots = choose_pivots(x, k, metric, min(PIVOTS, int(np.ceil(np.sqrt(len(x))))))
        self.px, self.pk = x[pivots], None if k is None else k[pivots]
        group, far = np.zeros(len(x), np.int64), np.zeros(len(x))
        for at in range(0, len(x), BLOCK):
            d = metric.distances(x[at : at + BLOCK], None if k is None else k[at : at + BLOCK], self.px, self.pk)
            group[at : at + BLOCK] = d.argmin(1)
            far[at : at + BLOCK] = d.min(1)
        order = np.lexsort((ids, far, group))
        self.ids, self.x, self.k, self.far = ids[order], x[order], None if k is None else k[order], far[order]
        self.begin = np.searchsorted(group[order], np.arange(len(pivots) + 1))
        self.radius = np.array([self.far[e - 1] if e > b else -np.inf for b, e in zip(self.begin[:-1], self.begin[1:], strict=True)])

    def _coded(self, k: np.ndarray | None) -> np.ndarray | None:
        if k is None:
            return None
        return np.column_stack([np.array([names.get(v, -1) for v in k[:, c].tolist()], np.int64) for c, names in enumerate(self.names)]) if k.shape[1] else np.zeros((len(k), 0), np.int64)

    def search(self, x: np.ndarray, k: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest candidate's id (the smallest among equals) and its distance, for each row."""
        k = self._coded(k)
        best, at = np.full(len(x), np.inf), np.full(len(x), np.iinfo(np.int64).max)
        to = self.metric.distances(x, k, self.px, self.pk)
        self.compared += to.size
        first = to.argmin(1)
        for p in np.unique(first).tolist():
            self._look(p, np.flatnonzero(first == p), x, k, to, best, at)
        # groups that may hold something nearer for many rows come first
        least = (to - self.radius[None, :]).min(0)
        for p in np.argsort(least, kind="stable").tolist():
            rows = np.flatnonzero((to[:, p] - self.radius[p] <= best + SLACK) & (first != p))
            if len(rows):
                self._look(p, rows, x, k, to, best, at)
        return at, best

    def _look(self, p: int, rows: np.ndarray, x: np.ndarray, k: np.ndarray | None, to: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        b, e = self.begin[p], self.begin[p + 1]
        far = self.far[b:e]
        # members whose distance to the pivot is within reach of any of the rows
        lo = np.searchsorted(far, (to[rows, p] - best[rows]).min() - SLACK, "left")
        hi = np.searchsorted(far, (to[rows, p] + best[rows]).max() + SLACK, "right")
        for s in range(b + lo, b + hi, BLOCK):
            m = slice(s, min(s + BLOCK, b + hi))
            d = self.metric.distances(x[rows], None if k is None else k[rows], self.x[m], None if self.k is None else self.k[m])
            self.compared += d.size
            near = d.min(1)
            ids = np.where(d == near[:, None], self.ids[m][None, :], np.iinfo(np.int64).max).min(1)
            better = (near < best[rows]) | ((near == best[rows]) & (ids < at[rows]))
            best[rows[better]], at[rows[better]] = near[better], ids[better]
