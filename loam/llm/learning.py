"""Small models fitted on the driver from a bounded sample of labelled rows: logistic regression and calibration."""

from __future__ import annotations

import numpy as np


class Logistic:
    """L2-regularised logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 30):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        weight = np.ones(len(x)) if weight is None else weight
        self.beta = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(rounds):
            p = sigmoid(z @ self.beta)
            gradient = z.T @ (weight * (p - y)) + penalty * self.beta
            curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curve, gradient)
            self.beta -= step / max(1.0, np.abs(step).max() / 2)
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.beta[:-1] + self.beta[-1]


class SparseLogistic:
    """The model of ``Logistic`` for rows of present features (lists of numbers), by Newton steps whose systems are solved with
    conjugate gradients: no matrix of rows by features or of features is made."""

    def __init__(self, rows: list[list[int]], y: np.ndarray, width: int, ridge: float = 1.0, rounds: int = 30):
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        of = np.fromiter((f for r in rows for f in r), np.int64, len(at))
        n = len(rows)
        self.mean = np.bincount(of, minlength=width) / n
        self.scale = np.sqrt(self.mean * (1 - self.mean)) + 1e-9
        penalty = np.append(np.full(width, ridge), 1e-6)

        def forth(beta: np.ndarray) -> np.ndarray:
            scaled = beta[:-1] / self.scale
            return np.bincount(at, scaled[of], n) - self.mean @ scaled + beta[-1]

        def back(u: np.ndarray) -> np.ndarray:
            return np.append((np.bincount(of, u[at], width) - self.mean * u.sum()) / self.scale, u.sum())

        self.beta = np.zeros(width + 1)
        for _ in range(rounds):
            p = sigmoid(forth(self.beta))
            curve = np.maximum(p * (1 - p), 1e-6)
            rest = back(p - y) + penalty * self.beta
            step, way, size = np.zeros(width + 1), rest.copy(), rest @ rest
            goal = size * 1e-16
            for _ in range(2 * width + 2):
                if size <= goal or size < 1e-24:
                    break
                bent = back(curve * forth(way)) + penalty * way
                far = size / (way @ bent)
                step += far * way
                rest = rest - far * bent
                size, before = rest @ rest, size
                way = rest + size / before * way
            self.beta -= step / max(1.0, np.abs(step).max() / 2)
            if np.abs(step).max() < 1e-6:
                break


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def folds(n: int, k: int = 3) -> np.ndarray:
    """A fold for each of n rows, the same at every run."""
    return np.random.default_rng(11).permutation(n) % k


def ranked_well(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, ties counting half; 0.5 if only one class is there."""
    ones, zeros = score[y == 1], np.sort(score[y == 0])
    if not len(ones) or not len(zeros):
        return 0.5
    below = (np.searchsorted(zeros, ones, "left") + np.searchsorted(zeros, ones, "right")) / 2
    return float(below.mean() / len(zeros))
