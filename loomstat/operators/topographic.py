"""Generative topographic maps: a grid of latent points, carried into data space by Gaussian bumps, fitted by EM on Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixtures import Mixture, log_sum


def grid(nx: int, ny: int) -> np.ndarray:
    """nx * ny points in [-1, 1] x [-1, 1], x fastest, y from the top."""
    x = np.linspace(-1, 1, nx) if nx > 1 else np.zeros(1)
    y = np.linspace(1, -1, ny) if ny > 1 else np.zeros(1)
    return np.stack([np.tile(x, ny), np.repeat(y, nx)], 1)


@dataclass
class TopographicMap:
    points: np.ndarray
    phi: np.ndarray
    w: np.ndarray
    beta: float
    mixing: np.ndarray
    success: bool = True

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        c = self.phi @ self.w
        d2 = np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T)
        with np.errstate(divide="ignore"):
            return np.log(self.mixing) + 0.5 * x.shape[1] * np.log(self.beta / (2 * np.pi)) - 0.5 * self.beta * d2

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        parts = self.log_parts(x)
        return np.exp(parts - log_sum(parts)[:, None])

    def as_mixture(self) -> Mixture:
        """The same density as a mixture of equal round components: forward and inverse prediction follow from it."""
        c = self.phi @ self.w
        keep = self.mixing > 1e-12
        return Mixture(self.mixing[keep] / self.mixing[keep].sum(), c[keep], np.repeat(np.eye(c.shape[1])[None] / self.beta, keep.sum(), 0), "spherical")


def fit_map(df: DataFrame, vector: str, shape: tuple[int, int] = (10, 10), bumps: tuple[int, int] = (4, 4), variance: float = 1.0, ridge: float = 0.001, rounds: int = 20, sparse: bool = False) -> tuple[TopographicMap, list[float]]:
    """(map, log-likelihood of each round). Start: the plane of the two leading principal axes."""
    z, centres = grid(*shape), grid(*bumps)
    phi = np.hstack([np.exp(-((z[:, None] - centres[None]) ** 2).sum(2) / (2 * variance)), np.ones((len(z), 1))])
    sums = df.select(F.col(vector).alias("v"))

    def moments(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                out = np.concatenate([x.sum(0), (x.T @ x).ravel(), [len(x)]])
                yield pd.DataFrame({"p": np.arange(len(out)), "s": out})

    got = sums.mapInPandas(moments, "p int, s double").groupBy("p").agg(F.sum("s").alias("s")).orderBy("p").toPandas()["s"].to_numpy()
    n = int((np.sqrt(4 * len(got) - 3) - 1) / 2)
    m = got[-1]
    mean, cov = got[:n] / m, got[n:-1].reshape(n, n) / m - np.outer(got[:n] / m, got[:n] / m)
    value, axis = np.linalg.eigh(cov)
    value, axis = value[::-1], axis[:, ::-1]
    plane = mean + (z / np.maximum(z.std(0), 1e-12)) @ (axis[:, :2] * np.sqrt(np.maximum(value[:2], 0))).T
    w = np.linalg.lstsq(phi, plane, rcond=None)[0]
    nearest = ((plane[:, None] - plane[None]) ** 2).sum(2)
    gap = np.sort(nearest, 1)[:, 1].mean() / 2 if len(z) > 1 else 1.0
    beta = 1 / max(value[2] if n > 2 else 0.0, gap, 1e-12)
    model, history = TopographicMap(z, phi, w, beta, np.full(len(z), 1 / len(z))), []
    for _ in range(rounds):

        def step(batches, model=model):
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["v"].to_numpy()).astype(float)
                    r = model.responsibilities(x)
                    out = np.concatenate([r.sum(0), (r.T @ x).ravel(), [(x * x).sum(), log_sum(model.log_parts(x)).sum()]])
                    yield pd.DataFrame({"p": np.arange(len(out)), "s": out})

        s = sums.mapInPandas(step, "p int, s double").groupBy("p").agg(F.sum("s").alias("s")).orderBy("p").toPandas()["s"].to_numpy()
        k = len(z)
        g, rx = s[:k], s[k:-2].reshape(k, n)
        history.append(float(s[-1]))
        a = phi.T @ (g[:, None] * phi) + ridge / model.beta * np.eye(phi.shape[1])
        if np.linalg.cond(a) > 1e15:
            return TopographicMap(z, phi, model.w, model.beta, model.mixing, False), history
        w = np.linalg.solve(a, phi.T @ rx)
        c = phi @ w
        spread = s[-2] - 2 * (rx * c).sum() + (g[:, None] * c * c).sum()
        model = TopographicMap(z, phi, w, m * n / max(spread, 1e-12), g / m if sparse else model.mixing)
    return model, history


def project(df: DataFrame, model: TopographicMap, key: str, vector: str) -> DataFrame:
    """(key, mean, mode) of each row on the map."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            r = model.responsibilities(np.stack(pdf["v"].to_numpy()).astype(float)) if len(pdf) else np.zeros((0, len(model.points)))
            yield pd.DataFrame({"key": pdf["key"], "mean": list(r @ model.points), "mode": list(model.points[r.argmax(1)]) if len(r) else []})

    return df.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInPandas(run, f"key {kind}, mean array<double>, mode array<double>").withColumnRenamed("key", key)
