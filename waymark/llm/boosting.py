"""Gradient-boosted decision trees on binned features, with calibrated probabilities."""

from __future__ import annotations

import numpy as np

BINS, DEPTH, TREES, RATE = 32, 3, 40, 0.3
#: Deviations of the one-sided limits (nine in ten) between which a share of right rows lies.
SURE = 1.2816


def limits(right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wilson's lower and upper limit of a share that showed ``right`` times in ``n``; 0 and 1 of none."""
    right, n = np.asarray(right, float), np.maximum(np.asarray(n, float), 1e-12)
    p, z = right / n, SURE**2
    middle, reach = p + z / (2 * n), SURE * np.sqrt(np.maximum(p * (1 - p) / n + z / (4 * n * n), 0))
    return np.maximum((middle - reach) / (1 + z / n), 0.0), np.minimum((middle + reach) / (1 + z / n), 1.0)


class Boosted:
    """Logistic boosting of weighted rows; a tree is DEPTH levels of one (feature, bin) test per node."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        mean = min(max(float(np.average(y, weights=weight)), 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        binned, raw = self._binned(x), np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            self.trees.append(self._tree(binned, weight * (y - p), weight * p * (1 - p)))
            raw += RATE * self._leaf_values(binned, self.trees[-1])

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes = 2**DEPTH - 1
        feature, cut = np.zeros(nodes, int), np.full(nodes, BINS + 1)
        node = np.zeros(len(b), int)
        for level in range(DEPTH):
            first = 2**level - 1
            width = 2**level
            best = np.full(width, 1e-9)
            for f in range(b.shape[1]):
                at = (node - first) * (BINS + 1) + b[:, f]
                sg = np.bincount(at, g, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                sh = np.bincount(at, h, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                feature[first : first + width][better] = f
                cut[first : first + width][better] = top[better]
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        leaf = node - nodes
        value = np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + 1)
        return feature, cut, value

    def _leaf_values(self, b: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), int)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        return value[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds before calibration."""
        b = self._binned(x)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += RATE * self._leaf_values(b, tree)
        return out


class Calibrated:
    """Boosted trees of which each row is judged by those that have not seen it, a logistic calibration, and a threshold per group.

    Every fold has trees fitted on the other folds; their scores of the fold's own rows are
    what calibration and thresholds are chosen on, so every row is held out once.  A
    new row's score is the mean over all folds' trees.

    A group (an integer of 0 to ``GROUPS - 1``) takes the least probability above
    which the lower limit of its own share of right rows reaches ``precision``.  One
    whose rows are too few to show it takes the threshold of all rows together, if
    what it has above that doesn't speak against it; else its threshold is beyond 1.
    A row counts as many times as its weight says.
    """

    GROUPS = 8

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, precision: float, weight: np.ndarray | None = None, group: np.ndarray | None = None):
        weight = np.ones(len(y)) if weight is None else weight
        group = np.zeros(len(y), int) if group is None else group
        self.models, raw, judged = [], np.zeros(len(y)), np.zeros(len(y), bool)
        for f in np.unique(fold):
            own = fold == f
            if len(np.unique(y[~own])) == 2:
                self.models.append(Boosted(x[~own], y[~own], weight[~own]))
                raw[own], judged[own] = self.models[-1].raw(x[own]), True
        if not self.models:
            self.models = [Boosted(x, y, weight)]
        raw, y, weight, group = raw[judged], y[judged], weight[judged], group[judged]
        self.a, self.b = _logistic(raw, y, weight)
        p = self._squashed(raw)
        pooled = _threshold(p, y, weight, precision)
        self.thresholds = np.full(self.GROUPS, 2.0)
        for k in np.unique(group):
            own = group == k
            self.thresholds[k] = _threshold(p[own], y[own], weight[own], precision)
            above = own & (p >= pooled)
            if self.thresholds[k] > 1 and above.any() and limits((weight * y)[above].sum(), weight[above].sum())[1] >= precision:
                self.thresholds[k] = pooled

    def _squashed(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * raw + self.b, -60, 60)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self._squashed(np.mean([m.raw(x) for m in self.models], axis=0))


def _logistic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibration: Newton steps with a little shrinkage, halved until they gain."""
    a, b = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        z = a * raw + b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.005 * ((a - 1) ** 2 + b**2))

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -60, 60)))
        w = weight * (p * (1 - p) + 1e-6)
        ga, gb = (weight * (p - y) * raw).sum() + 0.01 * (a - 1), (weight * (p - y)).sum() + 0.01 * b
        haa, hab, hbb = (w * raw * raw).sum() + 0.01, (w * raw).sum(), w.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = 1.0
        while step > 1e-6 and loss(a - step * da, b - step * db) > loss(a, b):
            step /= 2
        if step <= 1e-6:
            break
        a, b = a - step * da, b - step * db
    return float(np.clip(a, 0.05, 5)), float(np.clip(b, -10, 10))


def _threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray, precision: float) -> float:
    """The least probability above which the lower limit of the share of right rows reaches ``precision``; 2 if none."""
    at = np.argsort(-p, kind="stable")
    low, _ = limits(np.cumsum((weight * y)[at]), np.cumsum(weight[at]))
    last = np.append(p[at][1:] != p[at][:-1], True)  # rows of one probability are taken together
    good = np.flatnonzero((low >= precision) & last)
    if not len(good):
        return 2.0
    least, below = float(p[at[good[-1]]]), float(p[at[min(good[-1] + 1, len(at) - 1)]])
    return max(0.5, (least + below) / 2, least / (2 - least))  # halfway to the next row, or to half the odds
