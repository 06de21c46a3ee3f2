"""Regression on a reduced space that labelled and unlabelled rows share: principal components of all rows, a line on the labelled.

One scan gives the moments of each side. Components are those of both sides scaled together; the labelled products are carried
into the space of scores by a matrix, so that neither scores nor a second scan are needed to fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..models.base import Ridge
from .em import Moments, gathered, mean_and_covariance, vectors
from .linear import Linear, fold_products, solve


@dataclass(frozen=True)
class Reduction:
    """Scores of rows: autoscaled by all rows, then projected; a variable without variance is divided by 1."""

    cols: list[str]
    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray  # (variables, components)
    variance: np.ndarray

    def scores(self) -> list[Column]:
        z = [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.cols, self.mean, self.scale)]
        return [sum((F.lit(float(w)) * v for w, v in zip(axis[1:], z[1:])), F.lit(float(axis[0])) * z[0]) for axis in self.axes.T]

    def back(self, scores: np.ndarray) -> np.ndarray:
        return scores @ self.axes.T * self.scale + self.mean


@dataclass(frozen=True)
class ReducedLine:
    reduction: Reduction
    line: np.ndarray  # intercept, slopes of the scores

    def predicted(self) -> Column:
        return sum((F.lit(float(b)) * s for b, s in zip(self.line[1:], self.reduction.scores())), F.lit(float(self.line[0])))


def principal_axes(rows: DataFrame, cols: list[str], components: int, scaled: bool = True) -> Reduction:
    """The leading axes of rows(v, fold) of cols, from one scan; the greatest loading of each axis is positive."""
    totals = gathered(rows, {0: Moments()})
    if not totals:
        raise ValueError("no row without nulls to reduce")
    n, mean, cov = mean_and_covariance(totals[0], len(cols))
    scale = np.sqrt(np.maximum(np.diag(cov), 0) * n / max(n - 1, 1)) if scaled else np.ones(len(cols))
    scale = np.where(scale > 1e-12, scale, 1.0)
    value, axes = np.linalg.eigh(cov / np.outer(scale, scale))
    value, axes = value[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)
    return Reduction(cols, mean, scale, axes, value)


def fit_reduced(labelled: DataFrame, unlabelled: DataFrame, cols: list[str], y: str, components: int = 2, model: Linear = Ridge(0.0), within: tuple[DataFrame, str] | None = None) -> ReducedLine:  # noqa: B008
    """Components from both tables, the line from the labelled one. within = (table of (key, ...), key) keeps only those unlabelled rows
    that it holds, such as the ones inside an applicability domain."""
    if not 1 <= components <= len(cols):
        raise ValueError(f"{components} components of {len(cols)} variables")
    if within:
        unlabelled = unlabelled.join(within[0].select(within[1]).distinct(), within[1], "left_semi")
    both = labelled.select(*cols).unionByName(unlabelled.select(*cols))
    reduction = principal_axes(vectors(both, cols), cols, components)
    products = fold_products(labelled, cols, y, F.lit(0)).get(0)
    if products is None:
        raise ValueError("no labelled row without nulls")
    # (1, scores, y) is a linear map of (1, cols, y)
    carry = np.zeros((components + 2, len(cols) + 2))
    carry[0, 0] = carry[-1, -1] = 1
    carry[1:-1, 1:-1] = (reduction.axes / reduction.scale[:, None]).T
    carry[1:-1, 0] = -carry[1:-1, 1:-1] @ reduction.mean
    return ReducedLine(reduction, solve(model, carry @ products @ carry.T))
