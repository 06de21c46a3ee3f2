"""Searches over parameter grids and preferences: D-optimal starts, Bayesian optimization of a grid, preference processes, GA selection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.base import PLS, Estimator, GaussianProcess, OneClassSVM, rbf
from .learning import grid_search, inner_search
from .optimization import evolve


def d_optimal(x: np.ndarray, n: int = 15, tries: int = 100, seed: int = 11) -> np.ndarray:
    """The row numbers of the subset, of `tries` drawn, with the largest determinant of x'x (autoscaled)."""
    z = (x - x.mean(0)) / np.where(x.std(0, ddof=1) > 0, x.std(0, ddof=1), 1)
    rng = np.random.default_rng(seed)
    draws = [rng.choice(len(x), min(n, len(x)), replace=False) for _ in range(tries)]
    return np.sort(max(draws, key=lambda d: np.linalg.det(z[d].T @ z[d])))


def d_optimal_rows(df: DataFrame, key: str, cols: list[str], n: int = 15, tries: int = 100, seed: int = 11, most: int = 5000) -> DataFrame:
    """(key) of the subset drawn with the largest determinant; subsets are drawn from at most `most` rows, those of least hash."""
    rows = df.select(F.col(key), *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    few = rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(most).orderBy(key).toPandas()
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame([(few[key][i].item(),) for i in d_optimal(few[cols].to_numpy(), n, tries, seed)], f"{key} {kind}")


def bayes_grid(cells: np.ndarray, score: Callable[[list[int]], list[float]], rounds: int = 10, start: int = 15, target: tuple[float, float] | None = None, seed: int = 11) -> tuple[int, dict[int, float]]:
    """(best cell, scores of those tried): a D-optimal start, then each round the cell with the best chance of improving.

    cells is the grid as numbers (dummies for names, logarithms of positive scales); score evaluates a list of cells at once,
    so a round of the start is one Spark job. A grid of at most start + rounds cells is evaluated whole.
    """
    if len(cells) <= start + rounds:
        every = list(range(len(cells)))
        done = dict(zip(every, score(every)))
        return max(done, key=lambda i: (done[i], -i)), done
    first = d_optimal(cells, start, seed=seed).tolist()
    done = dict(zip(first, score(first)))
    from math import erf, sqrt

    for _ in range(rounds - 1):
        known = sorted(done)
        gp = GaussianProcess()
        state = gp.fit(cells[known], np.array([done[i] for i in known]))
        rest = [i for i in range(len(cells)) if i not in done]
        mu, sd = gp.predict_both(state, cells[rest])
        low, high = target or (max(done.values()) + 0.01 * np.std(list(done.values())), np.inf)
        phi = np.vectorize(lambda v: 0.5 * (1 + erf(v / sqrt(2))) if np.isfinite(v) else 1.0)
        pick = rest[int(np.argmax(phi((high - mu) / sd) - phi((low - mu) / sd)))]
        done[pick] = score([pick])[0]
    return max(done, key=lambda i: (done[i], -i)), done


def choose_model(df: DataFrame, candidates: list[Estimator], numbers: np.ndarray, fold: str, cols: list[str], y: str, rounds: int = 5, start: int = 6) -> Estimator:
    """The candidate with the best pooled r2 over folds, searched by bayes_grid."""

    def score(which: list[int]) -> list[float]:
        got = {r["candidate"]: r["r2"] for r in grid_search(df, [candidates[i] for i in which], fold, cols, y)[0].collect()}
        return [got[k] for k in range(len(which))]

    return candidates[bayes_grid(numbers, score, rounds, start)[0]]


def fold_moments(df: DataFrame, cols: list[str], y: str, folds: int) -> np.ndarray:
    """For each fold, dealt by the hash of a row, the sum of products of (1, cols, y), standardized over all rows: (folds, p + 2, p + 2)."""
    names = [*cols, y]
    s = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    mean = np.array([s[f"m{i}"] or 0.0 for i in range(len(names))])
    spread = np.array([s[f"s{i}"] or 1.0 for i in range(len(names))])
    side = len(names) + 1

    def run(batches):
        total = np.zeros((folds, side, side))
        for pdf in batches:
            v = np.column_stack([np.ones(len(pdf)), (pdf[[f"v{i}" for i in range(side - 1)]].to_numpy(float) - mean) / spread])
            fold = pdf["fold"].to_numpy()
            for f in range(folds):
                total[f] += v[fold == f].T @ v[fold == f]
        yield pd.DataFrame({"place": np.arange(total.size), "s": total.ravel()})

    rows = df.select(F.pmod(F.xxhash64(*names), F.lit(folds)).cast("int").alias("fold"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    out = np.zeros(folds * side * side)
    for r in rows.mapInPandas(run, "place long, s double").groupBy("place").agg(F.sum("s").alias("s")).collect():  # a number a fold and pair of columns
        out[r["place"]] = r["s"]
    return out.reshape(folds, side, side)


def one_component_r2(moments: np.ndarray, use: np.ndarray) -> float:
    """Pooled r2 over folds of autoscaled one-component PLS on the columns `use`, from fold_moments."""
    total, x, t, error = moments.sum(0), np.asarray(use) + 1, moments.shape[1] - 1, 0.0
    for own in moments:
        rest, n = total - own, (total - own)[0, 0]
        if own[0, 0] < 0.5:
            continue
        if n < 0.5:
            return -999.0
        mean = rest[0] / n
        c = rest - n * np.outer(mean, mean)
        var = np.where(np.diag(c) > 1e-12 * n, np.diag(c), np.inf)  # constant there: no part in the slope
        r = c / np.sqrt(np.outer(var, var))
        v, slope = r[x, t], np.zeros(len(x))
        spread = v @ r[np.ix_(x, x)] @ v
        if v @ v > 1e-24 and spread > 1e-24:
            slope = v * (v @ v) / spread * np.sqrt(var[t] / var[x])
        line = np.concatenate([slope, [-1.0]])
        at = np.append(x, t)
        d = own - np.outer(own[0], mean) - np.outer(mean, own[0]) + own[0, 0] * np.outer(mean, mean)
        error += line @ d[np.ix_(at, at)] @ line
    spread = total[t, t] - total[0, t] ** 2 / total[0, 0]
    return float(1 - error / spread) if spread > 0 else -999.0


def select_by_genes(df: DataFrame, cols: list[str], y: str, population: int = 30, generations: int = 8, seed: int = 0, folds: int = 5) -> list[str]:
    """The variables (genes above 0.5) with which one-component PLS has the best pooled r2; fitness over all rows, from their moments."""
    moments = fold_moments(df, cols, y, folds)

    def fitness(genes: np.ndarray) -> float:
        use = np.flatnonzero(genes > 0.5)
        return one_component_r2(moments, use) if len(use) else -999.0

    best, _ = evolve(fitness, np.array([[0.0, 1.0]] * len(cols)), df.sparkSession, population, generations, seed)
    return [c for c, g in zip(cols, best) if g > 0.5]


def scaled_by_importance(x: np.ndarray, y: np.ndarray, importance: np.ndarray, make: Callable[[], Estimator], powers: list[float], folds: int = 5, seed: int = 0) -> float:
    """The power p for which variables times importance^p predict best; 0 leaves them as they are."""
    share = importance / importance.max()

    class Powered:
        def __init__(self, p: float) -> None:
            self.p, self.m = p, make()

        def fit(self, a: np.ndarray, b: np.ndarray):
            return self.m.fit(a * share**self.p, b)

        def predict(self, s, a: np.ndarray) -> np.ndarray:
            return self.m.predict(s, a * share**self.p)

    return inner_search([Powered(p) for p in powers], x, y, folds, seed).p


def support_domain(x: np.ndarray, gammas: list[float], nu: float = 0.5, rate_of_outliers: float = 0.01):
    """(estimator, state, threshold) of a one-class domain: gamma by the variance of the Gram matrix over standardized distances."""
    z = x / np.where(x.std(0, ddof=1) > 0, x.std(0, ddof=1), 1)
    d = np.sqrt(np.maximum(0, ((z[:, None] - z[None]) ** 2).sum(2)))
    gamma = gammas[int(np.argmax([np.exp(-g * d).var(ddof=1) for g in gammas]))]
    m = OneClassSVM(nu, gamma)
    state = m.fit(x)
    return m, state, float(np.quantile(m.predict(state, x), rate_of_outliers))


class PreferenceProcess:
    """Gaussian process of a latent score from pairs (winner, loser): probit likelihood, Laplace approximation, Newton steps."""

    def __init__(self, x: np.ndarray, pairs: np.ndarray, gamma: float = 1.0, noise: float = 1.0, jitter: float = 1e-6) -> None:
        from math import erf, sqrt

        self.x, self.gamma = x, gamma
        k = rbf(x, x, gamma) + jitter * np.eye(len(x))
        cdf = np.vectorize(lambda v: 0.5 * (1 + erf(v / sqrt(2))))
        f = np.zeros(len(x))
        a, b = pairs[:, 0], pairs[:, 1]
        scale = noise * np.sqrt(2)
        for _ in range(40):
            z = (f[a] - f[b]) / scale
            p = np.maximum(cdf(z), 1e-12)
            r = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) / p
            grad, w = np.zeros(len(x)), np.zeros((len(x), len(x)))
            np.add.at(grad, a, r / scale)
            np.add.at(grad, b, -r / scale)
            h = r * (z + r) / scale**2
            for i, j, s in ((a, a, 1), (b, b, 1), (a, b, -1), (b, a, -1)):
                np.add.at(w, (i, j), s * h)
            new = np.linalg.solve(np.eye(len(x)) + k @ w, k @ (w @ f + grad))
            moved = np.abs(new - f).max()
            f = new
            if moved < 1e-6:
                break
        self.f, self.a = f, np.linalg.solve(k, f)
        self.back = np.linalg.inv(k + np.linalg.inv(w + 1e-8 * np.eye(len(x))))

    def predict_both(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = rbf(x, self.x, self.gamma)
        return k @ self.a, np.sqrt(np.maximum(1e-12, 1 - np.einsum("ij,jk,ik->i", k, self.back, k)))
