"""What is read from a fitted topographic map: a line on its variables with its inverse, and fewer clusters by information.

Merging drops the smallest share again and again and deals it out equally among the rest. Which shares remain at each step
follows from the shares alone, so one scan adds up the likelihood of all steps at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.base import Ridge
from .em import gathered, vectors
from .linear import fold_products, solve, squared_error
from .mixtures import log_sum
from .topographic import TopographicMap


@dataclass(frozen=True)
class Line:
    """Least squares of autoscaled y on autoscaled variables; variance is that of the residuals of autoscaled y."""

    slopes: np.ndarray
    variance: float
    mean: np.ndarray
    scale: np.ndarray  # of the variables, then of y
    raw: np.ndarray  # intercept and slopes on the values as they are


def fit_line(df: DataFrame, cols: list[str], y: str) -> Line:
    products = fold_products(df, cols, y, F.lit(0)).get(0)
    if products is None:
        raise ValueError("no row without nulls to fit to")
    n, mean = products[0, 0], products[0, 1:] / products[0, 0]
    scale = np.sqrt(np.maximum(np.diag(products)[1:] / n - mean**2, 0) * n / max(n - 1, 1))
    scale = np.where(scale > 1e-12, scale, 1.0)
    raw = solve(Ridge(0.0), products)
    return Line(raw[1:] * scale[:-1] / scale[-1], squared_error(raw, products) / n / scale[-1] ** 2, mean, scale, raw)


def invert_line(model: TopographicMap, line: Line, target: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, mode, responsibilities): the variables that a target of autoscaled y asks for, where the map's points, in autoscaled
    variables, are the prior. Each point is pulled towards the target within its own spread; points share by the density of the target."""
    centres, spread = model.phi @ model.w, max(line.variance, 1e-12)
    inverse = np.linalg.inv(model.beta * np.eye(len(line.slopes)) + np.outer(line.slopes, line.slopes) / spread)
    pulled = (line.slopes / spread * target + model.beta * centres) @ inverse.T
    var = spread + line.slopes @ line.slopes / model.beta
    e = -0.5 * (target - centres @ line.slopes) ** 2 / var
    share = np.exp(e - e.max())
    share /= share.sum()
    return share @ pulled, pulled[share.argmax()], share


def merge_steps(shares: np.ndarray) -> np.ndarray:
    """(steps, components): the shares as they are, then after each merge, down to one component."""
    now, out = shares.astype(float).copy(), []
    while (now > 0).any():
        out.append(now.copy())
        live = np.flatnonzero(now > 0)
        if len(live) == 1:
            break
        least = live[now[live].argmin()]
        rest = live[live != least]
        now[rest] += now[least] / len(rest)
        now[least] = 0
    return np.array(out)


@dataclass(frozen=True)
class _Merges:
    model: TopographicMap
    steps: np.ndarray
    fold: int | None = None

    def sums(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            base = self.model.log_parts(x) - np.log(self.model.mixing)
            like, hit = [], []
            for s in self.steps:
                parts = np.where(s > 0, np.where(np.isfinite(base), base, 0) + np.log(s), -np.inf)
                like.append(log_sum(parts).sum())
                hit.append(np.bincount(parts.argmax(1), minlength=len(s)))
        return np.concatenate([[len(x)], like, np.concatenate(hit)])


def merge_by_information(df: DataFrame, model: TopographicMap, cols: list[str]) -> tuple[DataFrame, np.ndarray]:
    """((components, bic, clusters) of each step, the shares of the step of least bic): clusters are the components that are the likeliest of some row."""
    if not (model.mixing > 0).all():
        keep = model.mixing > 0
        model = TopographicMap(model.points[keep], model.phi[keep], model.w, model.beta, model.mixing[keep], model.success)
    steps = merge_steps(model.mixing)
    s = gathered(vectors(df, cols), {0: _Merges(model, steps)}).get(0)
    if s is None:
        raise ValueError("no row without nulls")
    n, like, hit = s[0], s[1 : len(steps) + 1], s[len(steps) + 1 :].reshape(len(steps), -1)
    live = (steps > 0).sum(1)
    bic = -2 * like + live * np.log(n)
    table = pd.DataFrame({"components": live, "bic": bic, "clusters": (hit > 0).sum(1)})
    return df.sparkSession.createDataFrame(table), steps[bic.argmin()]
