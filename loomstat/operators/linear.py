"""Linear models from moments: one scan of the rows serves every candidate, fold and scaling.

The sums of 1, v and v v' of [x, y], kept by fold, give the fit of any part of the folds by addition and the squared error of
any line on any fold as a quadratic form. Nothing is fitted in a task and no row is copied.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..models.base import PLS, Ridge
from .em import gathered, vectors

Linear = PLS | Ridge


@dataclass(frozen=True)
class _Cross:
    """The sum of outer products of (1, v) of one fold."""

    fold: int
    inside: bool = True

    def sums(self, x: np.ndarray) -> np.ndarray:
        v = np.column_stack([np.ones(len(x)), x])
        return (v.T @ v).ravel()


def fold_products(df: DataFrame, cols: list[str], y: str, fold: Column) -> dict[int, np.ndarray]:
    """For each fold the (p + 2, p + 2) sums of products of (1, cols, y) of its rows without nulls. The number of folds is small."""
    return products_of(vectors(df, [*cols, y], fold))


def products_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """The same from a written table (v, fold) of vectors that end with the target."""
    every = [r["fold"] for r in rows.select("fold").distinct().collect()]  # folds
    return {f: s.reshape(int(len(s) ** 0.5), -1) for f, s in gathered(rows, {f: _Cross(f) for f in every}).items()}


def solve(model: Linear, products: np.ndarray, factors: np.ndarray | None = None) -> np.ndarray:
    """(intercept, slopes) on the variables as they are, of a model of autoscaled variables, times factors where given."""
    n = products[0, 0]
    mean = products[0] / n
    c = products / n - np.outer(mean, mean)
    p = len(c) - 2
    scale = np.sqrt(np.maximum(np.diag(c), 0) * n / max(n - 1, 1))
    scale = np.where(scale > 1e-12, scale, 1.0)
    k = np.ones(p) if factors is None else factors
    by = k / scale[1:-1]
    xx, xy = c[1:-1, 1:-1] * np.outer(by, by) * n, c[1:-1, -1] * by * n / scale[-1]
    if isinstance(model, Ridge):
        slope = np.linalg.lstsq(xx + model.ridge * np.eye(p), xy, rcond=None)[0]
    else:
        slope = _pls(xx, xy, model.components)
    slope = slope * by * scale[-1]
    return np.concatenate([[mean[-1] - slope @ mean[1:-1]], slope])


def unscaled(model: Linear, products: np.ndarray) -> np.ndarray:
    """(intercept, slopes) of the model as its own fit gives them, on variables that are only centred."""
    n = products[0, 0]
    mean = products[0] / n
    c = products - n * np.outer(mean, mean)
    xx, xy = c[1:-1, 1:-1], c[1:-1, -1]
    slope = np.linalg.lstsq(xx + model.ridge * np.eye(len(xy)), xy, rcond=None)[0] if isinstance(model, Ridge) else _pls(xx, xy, model.components)
    return np.concatenate([[mean[-1] - slope @ mean[1:-1]], slope])


def _pls(xx: np.ndarray, xy: np.ndarray, components: int) -> np.ndarray:
    """Slopes of PLS for one target from cross products: deflating them is deflating the rows."""
    rotate, loads, heads = [], [], []
    for _ in range(min(components, len(xy))):
        size = np.linalg.norm(xy)
        if not size > 1e-12:
            break
        w = xy / size
        t = xx @ w
        tt = w @ t
        if not tt > 1e-12:
            break
        p, q = t / tt, (xy @ w) / tt
        xx, xy = xx - tt * np.outer(p, p), xy - q * tt * p
        rotate.append(w)
        loads.append(p)
        heads.append(q)
    if not rotate:
        return np.zeros(len(xy))
    w, p = np.stack(rotate, 1), np.stack(loads, 1)
    return w @ np.linalg.solve(p.T @ w, np.array(heads))


def squared_error(line: np.ndarray, products: np.ndarray) -> float:
    """Of the line (intercept, slopes) on the rows behind the products."""
    a = np.append(line, -1.0)
    return max(0.0, float(a @ products @ a))


def pooled_r2(lines: dict[int, np.ndarray], products: dict[int, np.ndarray]) -> float:
    """Of the folds' rows, each fold by its own line."""
    whole = sum(products.values())
    spread = whole[-1, -1] - whole[0, -1] ** 2 / whole[0, 0]
    return float(1 - sum(squared_error(lines[f], products[f]) for f in products) / spread) if spread > 0 else float("nan")


def fold_lines(model: Linear, products: dict[int, np.ndarray], factors: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """For each fold, the line fitted to the others."""
    whole = sum(products.values())
    return {f: solve(model, whole - own, factors) for f, own in products.items()}


def predicted(lines: dict[int, np.ndarray], fold: Column, cols: list[str]) -> Column:
    """The column expression of each row's prediction by its fold's line."""
    out = F.lit(None).cast("double")
    for f, line in lines.items():
        out = F.when(fold == f, sum((F.lit(float(b)) * F.col(c) for b, c in zip(line[1:], cols)), F.lit(float(line[0])))).otherwise(out)
    return out


def best_power(df: DataFrame, cols: list[str], y: str, fold: Column, importance: dict[str, float], model: Linear, powers: list[float]) -> tuple[float, dict[float, float]]:
    """(p, r2 of every power): variables times importance^p, p by pooled r2 over folds; the first of equals wins."""
    products = fold_products(df, cols, y, fold)
    share = np.array([importance[c] for c in cols])
    r2 = {p: pooled_r2(fold_lines(model, products, share**p), products) for p in powers}
    return max(r2, key=lambda p: np.nan_to_num(r2[p], nan=-1e10)), r2
