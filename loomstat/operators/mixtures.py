"""Gaussian mixtures by expectation-maximization on Spark, and what is read from them in both directions.

The E step is one pass: each partition returns, for every component, the sums of responsibilities, of r x and of r x x'; the
sums of partitions are added by Spark and the M step is algebra on a few small matrices on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import keep

KINDS = ("full", "tied", "diag", "spherical")


def safe_covariance(c: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """Symmetric, with eigenvalues of at least floor."""
    w, v = np.linalg.eigh((c + c.T) / 2)
    return (v * np.maximum(w, floor)) @ v.T


def log_normal(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    low = np.linalg.cholesky(cov)
    z = np.linalg.solve(low, (x - mean).T)
    return -0.5 * ((z * z).sum(0) + len(mean) * np.log(2 * np.pi)) - np.log(np.diag(low)).sum()


def log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(1, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return (top + np.log(np.exp(a - top).sum(1, keepdims=True)))[:, 0]


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    kind: str = "full"

    def log_parts(self, x: np.ndarray, cols: list[int] | None = None) -> np.ndarray:
        c = list(range(self.means.shape[1])) if cols is None else cols
        with np.errstate(divide="ignore"):
            return np.stack([np.log(w) + log_normal(x, m[c], s[np.ix_(c, c)]) for w, m, s in zip(self.weights, self.means, self.covariances)], 1)

    def responsibilities(self, x: np.ndarray, cols: list[int] | None = None) -> np.ndarray:
        """Uniform where every component underflows."""
        parts = self.log_parts(x, cols)
        total = log_sum(parts)
        r = np.exp(parts - total[:, None])
        return np.where(np.isfinite(total)[:, None], r, 1 / len(self.weights))

    def conditional(self, x: np.ndarray, given: list[int], wanted: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(means (rows, components, wanted), covariances (components, wanted, wanted), weights (rows, components))."""
        n = self.means.shape[1]
        if set(given) & set(wanted) or any(not 0 <= c < n for c in [*given, *wanted]) or len(given) + len(wanted) != n:
            raise ValueError(f"given and wanted columns must cover 0..{n - 1} once each")
        means, covs = [], []
        for m, s in zip(self.means, self.covariances):
            back = np.linalg.solve(s[np.ix_(given, given)], s[np.ix_(given, wanted)])
            means.append(m[wanted] + (x - m[given]) @ back)
            covs.append(s[np.ix_(wanted, wanted)] - s[np.ix_(wanted, given)] @ back)
        return np.stack(means, 1), np.stack(covs), self.responsibilities(x, given)

    def parameters(self) -> int:
        k, n = self.means.shape
        return k - 1 + k * n + {"full": k * n * (n + 1) // 2, "tied": n * (n + 1) // 2, "diag": k * n, "spherical": k}[self.kind]


def shaped(cov: np.ndarray, weights: np.ndarray, kind: str, floor: float = 1e-6) -> np.ndarray:
    n = cov.shape[1]
    if kind == "tied":
        cov = np.repeat(np.einsum("k,kij->ij", weights, cov)[None], len(weights), 0)
    elif kind == "diag":
        cov = np.stack([np.diag(np.diag(c)) for c in cov])
    elif kind == "spherical":
        cov = np.stack([np.eye(n) * np.trace(c) / n for c in cov])
    return np.stack([safe_covariance(c, floor) for c in cov])


def statistics(df: DataFrame, vector: str, model: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Sums of r, r x and r x x' a component, the log-likelihood and the number of rows."""
    k, n = model.means.shape

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            r = model.responsibilities(x)
            out = np.concatenate([r.sum(0), (r.T @ x).ravel(), np.einsum("mk,mi,mj->kij", r, x, x).ravel(), [log_sum(model.log_parts(x)).sum(), len(x)]])
            yield pd.DataFrame({"p": np.arange(len(out)), "s": out})

    rows = df.select(F.col(vector).alias("v")).mapInPandas(run, "p int, s double").groupBy("p").agg(F.sum("s").alias("s")).collect()
    s = np.zeros(k + k * n + k * n * n + 2)
    for r in rows:  # as many as the model has numbers
        s[r["p"]] = r["s"]
    return s[:k], s[k : k + k * n].reshape(k, n), s[k + k * n : -2].reshape(k, n, n), float(s[-2]), int(s[-1])


def fit_mixture(df: DataFrame, vector: str, components: int, kind: str = "full", rounds: int = 50, tolerance: float = 1e-6, seed: int = 0, start: Mixture | None = None, prior: float = 0.0, adjust: Callable[[Mixture], Mixture] | None = None) -> tuple[Mixture, list[float]]:
    """(model, log-likelihood of each round). prior > 0 shrinks small components (a Dirichlet prior on weights).

    Starts from rows of least hash; `adjust` may change the model after each M step (anchored means).
    """
    if start is None:
        total = df.select(F.transform(vector, lambda x: x.cast("double")).alias("v"))
        first = np.array([r["v"] for r in total.orderBy(F.xxhash64(F.lit(seed), "v")).limit(components).collect()])
        one = Mixture(np.ones(1), first[:1], np.eye(first.shape[1])[None])
        n, s1, s2, _, m = statistics(df, vector, one)
        mean = s1[0] / m
        cov = s2[0] / m - np.outer(mean, mean)
        start = Mixture(np.full(components, 1 / components), first if components > 1 else mean[None], shaped(np.repeat(cov[None], components, 0), np.full(components, 1 / components), kind), kind)
    model, history = start, []
    for _ in range(rounds):
        n, s1, s2, like, m = statistics(df, vector, model)
        history.append(like)
        if len(history) > 1 and abs(history[-1] - history[-2]) < tolerance * max(1, abs(like)):
            break
        n = np.maximum(n, 1e-10)
        weights = (n + prior) / (n + prior).sum()
        means = s1 / n[:, None]
        cov = s2 / n[:, None, None] - means[:, :, None] * means[:, None, :]
        model = Mixture(weights, means, shaped(cov, weights, kind), kind)
        if adjust:
            model = adjust(model)
    return model, history


def information(model: Mixture, like: float, rows: int) -> tuple[float, float]:
    """(BIC, AIC)."""
    return model.parameters() * np.log(rows) - 2 * like, 2 * model.parameters() - 2 * like


def fit_semi_supervised(labelled: DataFrame, unlabelled: DataFrame, xs: list[str], ys: list[str], components: int, rounds: int = 30, anchored: bool = False, seed: int = 0) -> tuple[Mixture, list[float]]:
    """A mixture of x from all rows starts the joint mixture of [x, y] on the labelled ones; anchored keeps the x means."""
    base = unlabelled.select(F.array(*xs).alias("v")).unionByName(labelled.select(F.array(*xs).alias("v")))
    px, _ = fit_mixture(base, "v", components, rounds=rounds, seed=seed)
    joint = labelled.select(F.array(*xs, *ys).alias("v"))
    one, _ = fit_mixture(joint, "v", 1, rounds=2)
    a, b = len(xs), len(xs) + len(ys)
    means = np.repeat(one.means, components, 0)
    back = np.linalg.solve(one.covariances[0][:a, :a], one.covariances[0][:a, a:])
    means[:, :a] = px.means
    means[:, a:] = one.means[0, a:] + (px.means - one.means[0, :a]) @ back
    cov = np.zeros((components, b, b))
    rest = one.covariances[0][a:, a:] - one.covariances[0][a:, :a] @ back
    for k, c in enumerate(px.covariances):
        cov[k] = np.block([[c, c @ back], [back.T @ c, rest + back.T @ c @ back]])
    start = Mixture(px.weights, means, shaped(cov, px.weights, "full"))
    hold = (lambda m: replace(m, means=np.hstack([px.means, m.means[:, a:]]))) if anchored else None
    return fit_mixture(joint, "v", components, rounds=rounds, start=start, adjust=hold)


def predict(df: DataFrame, model: Mixture, key: str, given: list[str], order: list[str], rep: str = "mean", true_mode: bool = False) -> DataFrame:
    """(key, estimate): the other columns of `order` from the given ones, by the weighted mean of components or the likeliest one.

    With true_mode, the mode of the conditional mixture, climbed to from both of these; the better end is returned.
    """
    kind = df.schema[key].dataType.simpleString()
    g = [order.index(c) for c in given]
    w = [i for i in range(len(order)) if i not in g]

    def density(at: np.ndarray, m: np.ndarray, s: np.ndarray, p: np.ndarray) -> np.ndarray:
        return log_sum(np.stack([np.log(p[:, k] + 1e-300) - 0.5 * np.einsum("mi,ij,mj->m", at - m[:, k], np.linalg.inv(s[k]), at - m[:, k]) - 0.5 * np.linalg.slogdet(s[k])[1] for k in range(len(s))], 1))

    def climb(at: np.ndarray, m: np.ndarray, s: np.ndarray, p: np.ndarray) -> np.ndarray:
        inv = np.linalg.inv(s)
        for _ in range(50):
            d = at[:, None] - m
            e = np.log(p + 1e-300) - 0.5 * np.einsum("mki,kij,mkj->mk", d, inv, d) - 0.5 * np.linalg.slogdet(s)[1]
            r = np.exp(e - log_sum(e)[:, None])
            at = np.linalg.solve(np.einsum("mk,kij->mij", r, inv), np.einsum("mk,kij,mkj->mi", r, inv, m)[..., None])[..., 0]
        return at

    def run(batches):
        for pdf in batches:
            m, s, p = model.conditional(pdf[given].to_numpy(float), g, w)
            mode, mean = m[np.arange(len(m)), p.argmax(1)], (m * p[:, :, None]).sum(1)
            out = mode if rep == "mode" else mean
            if true_mode:
                ends = [mode, mean, climb(mode, m, s, p), climb(mean, m, s, p)]
                score = np.stack([density(e, m, s, p) for e in ends], 1)
                out = np.stack(ends, 1)[np.arange(len(m)), score.argmax(1)]
            yield pd.DataFrame({"key": pdf["key"], "estimate": list(out)})

    return df.select(F.col(key).alias("key"), *given).mapInPandas(run, f"key {kind}, estimate array<double>").withColumnRenamed("key", key)


def impute(df: DataFrame, key: str, cols: list[str], components: int = 2, rounds: int = 3, seed: int = 0) -> DataFrame:
    """df with nulls filled from the likeliest component given the row's known values; fitted to complete rows first, then to all."""
    raw = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    kind = df.schema[key].dataType.simpleString()
    raw = keep(raw, "holes")  # every round of every fit scans these tables
    filled = keep(raw.dropna(subset=cols), "filled")
    for turn in range(rounds):
        model, _ = fit_mixture(filled.select(F.array(*cols).alias("v")), "v", components, rounds=30, seed=seed)

        def run(batches, model=model):
            for pdf in batches:
                x = pdf[cols].to_numpy(float)
                hole = np.isnan(x)
                for mask in np.unique(hole, axis=0):
                    rows = np.flatnonzero((hole == mask).all(1))
                    g, w = np.flatnonzero(~mask).tolist(), np.flatnonzero(mask).tolist()
                    if not w:
                        continue
                    if not g:
                        x[rows] = model.means[model.weights.argmax()]
                        continue
                    m, _, p = model.conditional(x[np.ix_(rows, g)], g, w)
                    x[np.ix_(rows, w)] = m[np.arange(len(rows)), p.argmax(1)]
                yield pd.DataFrame({"key": pdf["key"]} | {c: x[:, i] for i, c in enumerate(cols)})

        filled = keep(raw.withColumnRenamed(key, "key").mapInPandas(run, f"key {kind}, " + ", ".join(f"{c} double" for c in cols)).withColumnRenamed("key", key), "filled")
    return filled


def sample(model: Mixture, spark, rows: int, seed: int = 0) -> DataFrame:
    """ceil(rows * weight) rows of each component."""
    counts = [int(np.ceil(rows * w)) for w in model.weights]
    plan = spark.createDataFrame(list(enumerate(counts)), "component int, n int").select("component", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("draw"))
    roots = [np.linalg.cholesky(c) for c in model.covariances]

    def run(batches):
        for pdf in batches:
            out = [model.means[k] + roots[k] @ np.random.default_rng([seed, k, d]).normal(size=model.means.shape[1]) for k, d in zip(pdf["component"], pdf["draw"])]
            yield pd.DataFrame({"component": pdf["component"], "v": out})

    return plan.mapInPandas(run, "component int, v array<double>")
