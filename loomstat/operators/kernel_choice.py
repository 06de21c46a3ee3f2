"""Choice of a kernel by cross-validation over the observations of a campaign: one task for each (kernel, fold).

Observations are few by nature; a larger table is represented by the `most` rows of least hash, a documented bound. Candidates
may be any number: they are scored where they lie, and only winners come back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import ppf
from ..models.kernels import Kernel, KernelProcess, PreferenceFit, usual_kernels

#: Observations at most.
MOST = 800


def observations(df: DataFrame, key: str, cols: list[str], y: str, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of at most so many rows without nulls, those of least hash of their key, in the order of keys."""
    rows = df.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("double").alias("y")).dropna()
    got = rows.orderBy(F.xxhash64("k"), "k").limit(most).orderBy("k").toPandas()
    return got[cols].to_numpy(float), got["y"].to_numpy(float)


def tau(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b of a fold's few rows; NaN where one side is constant."""
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    below = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / below) if below > 0 else float("nan")


def median_scales(x: np.ndarray) -> tuple[float, ...]:
    """The median absolute difference of each variable over all pairs of rows; 1 where that is 0."""
    i, j = np.triu_indices(len(x), 1)
    m = np.median(np.abs(x[i] - x[j]), 0) if len(i) else np.ones(x.shape[1])
    return tuple(np.where(m > 0, m, 1.0).tolist())


def preferences(y: np.ndarray) -> np.ndarray:
    """(winner, loser) of all pairs of observations that differ."""
    i, j = np.triu_indices(len(y), 1)
    up, down = np.where(y[i] > y[j], i, j), np.where(y[i] > y[j], j, i)
    return np.stack([up, down], 1)[~np.isclose(y[i], y[j])]


def _fold_score(kernel: Kernel, x: np.ndarray, y: np.ndarray, test: np.ndarray, by: str, repeats: int, seed: list[int]) -> float:
    if by == "r2":
        process = KernelProcess(kernel)
        got = process.predict(process.fit(x[~test], y[~test]), x[test])
        spread = ((y[test] - y[test].mean()) ** 2).sum()
        return float(1 - ((y[test] - got) ** 2).sum() / spread) if spread > 0 else float("nan")
    sx = x.std(0, ddof=1)
    z = (x - x.mean(0)) / np.where(sx > 0, sx, 1.0)
    process = PreferenceFit(kernel)
    mu, sd = process.predict_both(process.fit(z[~test], preferences(y[~test])), z[test])
    rng = np.random.default_rng(seed)
    draws = [tau(rng.normal(mu, sd), y[test]) for _ in range(repeats)]  # Thompson draws
    return float(np.nanmean(draws)) if np.isfinite(draws).any() else float("nan")


def kernel_scores(spark: SparkSession, kernels: list[Kernel], x: np.ndarray, y: np.ndarray, folds: int = 5, by: str = "tau", repeats: int = 5, seed: int = 0) -> DataFrame:
    """(kernel, score): the mean over folds of tau between Thompson draws of a preference process and y, or of the r2 of a regression
    process fitted by its marginal likelihood. A fold that fails, or has no score, is left out; a kernel without any scores -inf."""
    if by not in ("tau", "r2"):
        raise ValueError("kernels are chosen by 'tau' or 'r2'")
    deal = np.random.default_rng(seed).permutation(len(x)) % folds
    cells = [(k, f) for k in range(len(kernels)) for f in range(folds) if (deal == f).sum() > 1 and (deal != f).sum() > 1]
    sent = spark.sparkContext.broadcast((kernels, x, y, deal))  # of bounded size

    def run(batches):
        kernels, x, y, deal = sent.value
        for pdf in batches:
            out = []
            for k, f in zip(pdf["kernel"], pdf["fold"]):
                try:
                    out.append(_fold_score(kernels[k], x, y, deal == f, by, repeats, [seed, int(k), int(f)]))
                except np.linalg.LinAlgError:
                    out.append(float("nan"))
            yield pd.DataFrame({"kernel": pdf["kernel"], "score": out})

    plan = spark.createDataFrame(cells, "kernel int, fold int").repartition(max(1, len(cells)), "kernel", "fold")
    scored = plan.mapInPandas(run, "kernel int, score double").where(~F.isnan("score")).groupBy("kernel").agg(F.avg("score").alias("score"))
    every = spark.createDataFrame([(k,) for k in range(len(kernels))], "kernel int")
    return every.join(scored, "kernel", "left").select("kernel", F.coalesce("score", F.lit(float("-inf"))).alias("score"))


def choose_kernel(spark: SparkSession, x: np.ndarray, y: np.ndarray, folds: int = 5, by: str = "tau", seed: int = 0, kernels: list[Kernel] | None = None) -> tuple[Kernel, int, float]:
    """(kernel, its place, its score): the first of the best."""
    sx = x.std(0, ddof=1)
    options = kernels or usual_kernels(median_scales((x - x.mean(0)) / np.where(sx > 0, sx, 1.0)) if by == "tau" else (1.0,) * x.shape[1], by == "r2")
    best = kernel_scores(spark, options, x, y, folds, by, seed=seed).orderBy(F.desc("score"), "kernel").first()
    return options[best["kernel"]], best["kernel"], best["score"]


def uniform(key: Column, seed: int) -> Column:
    """A number of (0, 1) that belongs to key and seed."""
    return (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) + 0.5) / (1 << 40)


def thompson(mu: Column, sd: Column, key: Column, seed: int) -> Column:
    """A normal draw for each candidate, the same for the same key and seed."""
    return mu + sd * ppf(uniform(key, seed))


def best_candidate(scored: DataFrame, score: str, key: str, seed: int = 0) -> DataFrame:
    """The row of the greatest score; equal scores are told apart by a hash of key and seed, so that no key is favoured."""
    return scored.orderBy(F.desc(score), F.xxhash64(F.lit(seed), F.col(key)), key).limit(1)
