"""Kernels and their slopes, processes, choice of kernels, Kendall's tau by inversions."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat import registry
from loomstat.models.kernels import Constant, Dot, KernelProcess, Matern, PreferenceFit, RBF, White, climb, log_marginal, usual_kernels
from loomstat.operators import kernel_choice, ranks

RNG = np.random.default_rng(1)
X = RNG.normal(size=(24, 3))
EVERY = [*usual_kernels((0.7, 1.0, 2.0)), RBF((0.5,)) * Dot(2.0) + White(0.1), Matern((0.5, 1.0, 2.0), 2.5) * Matern((3.0,), 0.5)]


@pytest.mark.parametrize("kernel", EVERY, ids=range(len(EVERY)))
def test_slopes(kernel):
    t = kernel.theta() + RNG.normal(size=len(kernel.theta())) * 0.3
    kernel = kernel.with_theta(t)
    k, slopes = kernel.full(X)
    assert np.allclose(k, k.T) and np.allclose(np.diag(k), kernel.diag(X)) and len(slopes) == len(t)
    off = ~np.eye(24, dtype=bool)
    assert np.allclose(k[off], kernel.cross(X, X)[off])
    y = np.sin(X[:, 0]) + X[:, 1]
    value, slope = log_marginal(kernel, X, y)
    for i in range(len(t)):
        e = np.eye(len(t))[i] * 1e-5
        assert np.allclose(slopes[i], (kernel.with_theta(t + e).full(X)[0] - kernel.with_theta(t - e).full(X)[0]) / 2e-5, atol=1e-5)
        rise = (log_marginal(kernel.with_theta(t + e), X, y)[0] - log_marginal(kernel.with_theta(t - e), X, y)[0]) / 2e-5
        assert abs(rise - slope[i]) < 1e-3 * max(1, abs(slope[i]))
    best, top = climb(lambda p: log_marginal(kernel.with_theta(p), X, y), t)
    assert top >= value


def test_climb_finds_a_maximum():
    target = np.array([0.5, -2.0, 3.0])
    t, value = climb(lambda t: (-float(((t - target) ** 2 * [1, 10, 0.1]).sum()), -2 * (t - target) * [1, 10, 0.1]), np.zeros(3))
    assert np.allclose(t, target, atol=1e-2) and value > -1e-4


def test_processes():
    y = 2 * X[:, 0] - X[:, 1] + 0.01 * RNG.normal(size=24)
    process = KernelProcess(Constant() * RBF((1.0, 1.0, 1.0)) + White())
    state = process.fit(X, y)
    mu, sd = process.predict_both(state, X)
    assert np.abs(mu - y).max() < 0.3 and (sd > 0).all()
    scales = state["kernel"].a.b.scales
    assert scales[2] > 3 * min(scales[:2])  # a variable without a part in y has a long scale
    fit = PreferenceFit(Constant() * RBF((1.0, 1.0, 1.0)) + White(0.01))
    pairs = kernel_choice.preferences(y)
    got, spread = fit.predict_both(fit.fit(X, pairs), X)
    assert kernel_choice.tau(got, y) > 0.9 and (spread > 0).all()
    assert (y[pairs[:, 0]] > y[pairs[:, 1]]).all() and len(pairs) == 24 * 23 // 2


def test_choice_of_a_kernel(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2))
    line = 3 * x[:, 0] - x[:, 1] + rng.normal(size=60) * 0.5
    scores = kernel_choice.kernel_scores(spark, [Constant() * Dot() + White(), Constant() * Matern((0.05,), 0.5) + White(), Constant() * Matern((1.0,), 9.0)] [:2], x, line, 4, "r2").toPandas().set_index("kernel")["score"]
    assert scores[0] > 0.9 and scores[0] > scores[1] - 0.05
    kernel, place, score = kernel_choice.choose_kernel(spark, x, line, 3, "tau")
    assert kernel == usual_kernels(kernel_choice.median_scales((x - x.mean(0)) / x.std(0, ddof=1)), False)[place] and score > 0.4
    again = kernel_choice.choose_kernel(spark, x, line, 3, "tau")
    assert again[1:] == (place, score)
    with pytest.raises(ValueError):
        kernel_choice.kernel_scores(spark, [Dot()], x, line, 3, "rmse")
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=range(60), y=line))
    assert len(kernel_choice.observations(df, "id", ["a", "b"], "y", 25)[1]) == 25


def test_draws_and_ties(spark):
    df = spark.range(4000).select("id", kernel_choice.thompson(F.lit(2.0), F.lit(3.0), F.col("id"), 1).alias("s"), F.lit(1.0).alias("same"))
    got = df.agg(F.avg("s"), F.stddev_samp("s")).first()
    assert abs(got[0] - 2) < 0.2 and abs(got[1] - 3) < 0.2
    picks = {kernel_choice.best_candidate(df, "same", "id", s).first()["id"] for s in range(6)}
    assert len(picks) > 3 and kernel_choice.best_candidate(df, "same", "id", 0).first()["id"] in picks


def test_inversions():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 17, 64, 100):
        for a in (rng.integers(0, 5, n), rng.normal(size=n), np.zeros(n), np.arange(n)[::-1]):
            assert ranks.inversions(a) == sum(a[i] > a[j] for i in range(n) for j in range(i + 1, n))


@pytest.mark.parametrize("partitions", [2, 7])
def test_kendall_by_inversions(spark, partitions):
    rng = np.random.default_rng(0)
    for x, y in (
        (rng.normal(size=200), rng.normal(size=200)),
        (rng.integers(0, 4, 300), rng.integers(0, 3, 300)),
        (np.where(rng.random(300) < 0.4, 1, rng.integers(0, 9, 300)), np.where(rng.random(300) < 0.5, 2, rng.integers(0, 9, 300))),  # hot values
        (np.repeat([1, 2], 50), np.repeat([3, 1], 50)),
    ):
        df = spark.createDataFrame(pd.DataFrame({"x": x.astype(float), "y": y.astype(float)}))
        assert np.isclose(ranks.kendall(df, "x", "y", partitions), kernel_choice.tau(x, y))
    with_nulls = spark.createDataFrame([(1.0, 2.0), (2.0, None), (None, 3.0), (float("nan"), 1.0), (2.0, 1.0), (0.0, 5.0)], "x double, y double")
    assert ranks.kendall(with_nulls, "x", "y", partitions) == -1.0
    assert np.isnan(ranks.kendall(with_nulls.limit(0), "x", "y", partitions)) and np.isnan(ranks.kendall(with_nulls.withColumn("x", F.lit(1)), "x", "y", partitions))


@pytest.mark.parametrize("name", ["m18_kendall", "m18_kendall_of_lines", "m5_kernels", "t2_random_tie"])
def test_twins(spark, name):
    from tests.test_oracle import TABLES, rows

    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    mine, theirs = registry.queries()[name](spark, "/root/testdata/sf0.001").toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert len(mine) and rows(mine) == rows(theirs)
