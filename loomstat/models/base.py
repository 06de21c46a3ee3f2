"""Estimators as plain objects: fit(x, y) gives a state, predict(state, x) applies it. Both run inside tasks."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np


class Estimator(Protocol):
    def fit(self, x: np.ndarray, y: np.ndarray) -> Any: ...

    def predict(self, state: Any, x: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class Ridge:
    """Least squares with an intercept; ridge on the slopes."""

    ridge: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        mx, my = x.mean(0), y.mean()
        a = x - mx
        slope = np.linalg.lstsq(a.T @ a + self.ridge * np.eye(x.shape[1]), a.T @ (y - my), rcond=None)[0]
        return slope, float(my - mx @ slope)

    def predict(self, state: tuple[np.ndarray, float], x: np.ndarray) -> np.ndarray:
        return x @ state[0] + state[1]


@dataclass(frozen=True)
class PLS:
    """Partial least squares for one target, by deflation, weights optional."""

    components: int = 2

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        w = np.ones(len(x)) if weight is None else weight
        mx, my = w @ x / w.sum(), w @ y / w.sum()
        a, b = x - mx, y - my
        slope, rotate, loads, heads = np.zeros(x.shape[1]), [], [], []
        for _ in range(min(self.components, x.shape[1])):
            v = a.T @ (w * b)
            if not np.linalg.norm(v) > 1e-12:
                break
            v /= np.linalg.norm(v)
            t = a @ v
            tt = t @ (w * t)
            if not tt > 1e-12:
                break
            p, q = a.T @ (w * t) / tt, b @ (w * t) / tt
            a, b = a - np.outer(t, p), b - q * t
            rotate.append(v)
            loads.append(p)
            heads.append(q)
        if rotate:
            v, p = np.stack(rotate, 1), np.stack(loads, 1)
            slope = v @ np.linalg.solve(p.T @ v, np.array(heads))
        return slope, float(my - mx @ slope)

    def predict(self, state: tuple[np.ndarray, float], x: np.ndarray) -> np.ndarray:
        return x @ state[0] + state[1]


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


#: Distinct points up to which a fit holds their kernel matrix (128 MB); beyond, columns are computed as they are met.
HELD = 4096


@dataclass(frozen=True)
class SVR:
    """Epsilon support vector regression with a Gaussian kernel, by coordinate steps on the dual (bias in the kernel).

    Rows at one point share their column of the kernel, so they move together: what they carry falls by c wherever the estimate
    passes y - epsilon or y + epsilon of a row, and a step finds the exact place on that staircase. Memory grows with the rows, not
    with their pairs.
    """

    c: float = 3.0
    epsilon: float = 0.1
    gamma: float = 0.1
    rounds: int = 200

    def fit(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        my = y.mean()
        points, at = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((y, at.ravel()))
        ends = np.cumsum(np.bincount(at.ravel(), minlength=len(points)))
        k = rbf(points, points, self.gamma) + 1.0 if len(points) <= HELD else None
        stairs = []
        for t in np.split(y[order] - my, ends[:-1]):
            edges = np.sort(np.concatenate([t - self.epsilon, t + self.epsilon]))
            level = self.c * (len(t) - np.arange(len(edges) + 1.0))  # before the first edge, after each
            stairs.append((edges, level, edges - 2.0 * level[1:]))
        beta, f = np.zeros(len(points)), np.zeros(len(points))
        for _ in range(self.rounds):
            moved = 0.0
            for i, (edges, level, reach) in enumerate(stairs):
                rest = f[i] - 2.0 * beta[i]  # the kernel of a point with itself is 2
                m = reach.searchsorted(rest)
                new = level[-1] if m == len(edges) else min(level[m], max(level[m + 1], (edges[m] - rest) / 2.0))
                if new != beta[i]:
                    f += (new - beta[i]) * (k[i] if k is not None else rbf(points, points[i : i + 1], self.gamma)[:, 0] + 1.0)
                    moved = max(moved, abs(new - beta[i]))
                    beta[i] = new
            if moved < 1e-5:
                break
        on = beta != 0
        return points[on], beta[on], float(my)

    def predict(self, state: tuple[np.ndarray, np.ndarray, float], x: np.ndarray) -> np.ndarray:
        step = max(1, (1 << 21) // max(1, len(state[0])))
        return np.concatenate([(rbf(x[a : a + step], state[0], self.gamma) + 1.0) @ state[1] for a in range(0, len(x), step)] or [np.zeros(0)]) + state[2]


@dataclass(frozen=True)
class OneClassSVM:
    """Support of a distribution: sum of alpha is 1, 0 <= alpha <= 1 / (nu m); the decision is sum alpha k(x) - rho."""

    nu: float = 0.5
    gamma: float = 0.1
    rounds: int = 2000

    def fit(self, x: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        m = len(x)
        k, top = rbf(x, x, self.gamma), 1 / (self.nu * m)
        alpha = np.full(m, 1 / m)
        g = k @ alpha
        for _ in range(self.rounds):  # the pair that violates the conditions most
            up, down = np.where(alpha < top - 1e-15, g, np.inf).argmin(), np.where(alpha > 1e-15, g, -np.inf).argmax()
            if g[down] - g[up] < 1e-8:
                break
            step = min((g[down] - g[up]) / max(1e-12, k[up, up] + k[down, down] - 2 * k[up, down]), top - alpha[up], alpha[down])
            alpha[up] += step
            alpha[down] -= step
            g += step * (k[:, up] - k[:, down])
        inner = (alpha > 1e-12) & (alpha < top - 1e-12)
        rho = float(g[inner].mean() if inner.any() else (g[alpha > 1e-12].max()))
        on = alpha > 1e-12
        return x[on], alpha[on], rho

    def predict(self, state: tuple[np.ndarray, np.ndarray, float], x: np.ndarray) -> np.ndarray:
        return rbf(x, state[0], self.gamma) @ state[1] - state[2]


@dataclass(frozen=True)
class GaussianProcess:
    """Constant times Gaussian kernel plus white noise; the three are chosen on a grid by the marginal likelihood."""

    scales: tuple[float, ...] = (0.1, 0.3, 1.0, 3.0, 10.0)
    noises: tuple[float, ...] = (1e-6, 1e-3, 1e-2, 1e-1, 0.5)

    def fit(self, x: np.ndarray, y: np.ndarray) -> dict:
        mx, sx, my, sy = x.mean(0), np.where(x.std(0, ddof=1) > 0, x.std(0, ddof=1), 1.0), y.mean(), y.std(ddof=1) or 1.0
        z, t = (x - mx) / sx, (y - my) / sy
        best = None
        for s in self.scales:
            for noise in self.noises:
                k = rbf(z, z, 1 / (2 * s * s * x.shape[1])) + noise * np.eye(len(z))
                low = np.linalg.cholesky(k + 1e-10 * np.eye(len(z)))
                v = np.linalg.solve(low, t)
                size = v @ v / len(t)  # the best constant in closed form
                loss = 0.5 * len(t) * np.log(size + 1e-300) + np.log(np.diag(low)).sum()
                if best is None or loss < best["loss"]:
                    best = {"loss": loss, "x": z, "low": low, "a": np.linalg.solve(low.T, v), "size": size, "gamma": 1 / (2 * s * s * x.shape[1]), "noise": noise}
        return best | {"mx": mx, "sx": sx, "my": my, "sy": sy}

    def predict_both(self, state: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = rbf((x - state["mx"]) / state["sx"], state["x"], state["gamma"])
        v = np.linalg.solve(state["low"], k.T)
        var = np.maximum(1e-12, state["size"] * (1 + state["noise"] - (v * v).sum(0)))
        return k @ state["a"] * state["sy"] + state["my"], np.sqrt(var) * state["sy"]

    def predict(self, state: dict, x: np.ndarray) -> np.ndarray:
        return self.predict_both(state, x)[0]
