"""Small classifiers fitted on the driver from a bounded feature table: boosted trees, logistic regression, isotonic calibration."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Gradient-boosted trees of one depth for log loss, on features cut into at most 64 bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: float = 5.0, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.l2 = rounds, depth, rate, least, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 64)[1:-1], method="higher")) for c in x.T]
        binned = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T, strict=True)], 1)
        f, width = np.full(len(y), self.start), 64
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, threshold = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                best = np.full(n, 1e-9)
                own = node - first
                total_g, total_h = np.bincount(own, g, n), np.bincount(own, h, n)
                parent = total_g**2 / (total_h + self.l2)
                at = np.full((2, n), -1)
                for j in range(x.shape[1]):
                    if not len(cuts[j]):
                        continue
                    key = own * width + binned[:, j]
                    lg, lh = (np.bincount(key, v, n * width).reshape(n, width).cumsum(1) for v in (g, h))
                    rg, rh = total_g[:, None] - lg, total_h[:, None] - lh
                    gain = lg**2 / (lh + self.l2) + rg**2 / (rh + self.l2) - parent[:, None]
                    gain[(lh < self.least / 100) | (rh < self.least / 100)] = -1
                    gain = gain[:, : len(cuts[j])]
                    b = gain.argmax(1)
                    better = gain[np.arange(n), b] > best
                    best[better] = gain[np.arange(n), b][better]
                    at[0, better] = j
                    at[1, better] = b[better]
                for k in np.flatnonzero(at[0] >= 0):
                    feature[first + k], threshold[first + k] = at[0, k], cuts[at[0, k]][at[1, k]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            self.trees.append((feature, threshold, value))
            f = f + value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            f += value[node - (2**self.depth - 1)]
        return f


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    def __init__(self, l2: float = 1.0, steps: int = 25, least: float = 1e-9):
        self.l2, self.steps, self.least = l2, steps, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        weight = np.ones(len(y)) if weight is None else weight
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale = np.where(self.scale < 1e-9, 1, np.maximum(self.scale, self.least))
        self.w = np.zeros(x.shape[1] + 1)
        for _ in range(self.steps):
            if self.step(*self.slopes(x, y, weight)) < 1e-6:
                break
        return self

    def slopes(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' gradient and curvature at the present weights; both add up over sets of rows."""
        z = self._with_one(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        return z.T @ (weight * (p - y)), (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z

    def step(self, gradient: np.ndarray, curvature: np.ndarray) -> float:
        """A Newton step, damped, with the ridge penalty; returns its largest component before damping."""
        penalty = np.full(len(self.w), self.l2)
        penalty[-1] = 1e-6
        step = np.linalg.solve(curvature + np.diag(penalty), gradient + penalty * self.w)
        most = float(np.abs(step).max())
        self.w = self.w - step * min(1.0, 5 / max(1e-9, most))
        return most

    def copy(self) -> Logistic:
        out = Logistic(self.l2, self.steps, self.least)
        out.mean, out.scale, out.w = self.mean, self.scale, self.w.copy()
        return out

    def _with_one(self, x):
        return np.concatenate([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._with_one(x) @ self.w


class Isotonic:
    """Scores to probabilities by pooling adjacent violators; a pseudo-count on each side keeps them off 0 and 1."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []
        for s, v in zip(score[order], y[order], strict=True):
            blocks.append([v, 1.0, s, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                v2, n2, _, hi = blocks.pop()
                blocks[-1][0] += v2
                blocks[-1][1] += n2
                blocks[-1][3] = hi
        self.x = np.array([e for b in blocks for e in b[2:]])
        self.y = np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks for _ in range(2)])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
