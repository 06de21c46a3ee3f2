"""Variational mixtures, models fitted together, their choice by cross-validation, conditional densities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.operators import densities, em, mixtures, tuning
from loomstat.operators.variational import DISTRIBUTION, PROCESS, VariationalFit, Wishart, digamma, fit_variational


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal([0, 0], [1, 0.5], (300, 2)), rng.normal([6, 3], [0.7, 1], (200, 2)), rng.normal([-5, 5], 0.5, (100, 2))])
    y = np.where(x[:, 0] > 3, 2 * x[:, 0], -x[:, 0] + x[:, 1]) + rng.normal(size=600) * 0.1
    pdf = pd.DataFrame({"id": np.arange(600), "a": x[:, 0], "b": x[:, 1], "y": y})
    return spark.createDataFrame(pdf).repartition(5).cache(), pdf


def test_digamma_is_the_slope_of_log_gamma():
    for v in (0.01, 0.3, 1.0, 4.5, 30.0):
        slope = (math.lgamma(v * (1 + 1e-6)) - math.lgamma(v * (1 - 1e-6))) / (2e-6 * v)
        assert abs(float(digamma(v)) - slope) < 1e-5 * max(1, abs(slope))
    assert abs(float(digamma(1.0)) + 0.5772156649015329) < 1e-12


def test_wishart_norm_and_divergence():
    w = Wishart(5.0, np.array([[2.0]]))  # of one variable: a gamma law of shape 5/2 and rate 1
    assert np.isclose(w.mean()[0, 0], 2.5) and np.isclose(w.log_det(), digamma(2.5)) and np.isclose(w.log_norm(), math.lgamma(2.5))
    assert w.divergence(w) == 0 and w.divergence(Wishart(3.0, np.array([[1.0]]))) > 0


@pytest.mark.parametrize("kind", mixtures.KINDS)
@pytest.mark.parametrize("weights", [PROCESS, DISTRIBUTION])
def test_bound_never_falls(planted, kind, weights):
    x = planted[1][["a", "b", "y"]].to_numpy()
    mean, cov = x.mean(0), np.cov(x.T, ddof=0)
    fit = VariationalFit.begin(em.start_mixture(x, mean, cov, 7, kind), len(x), mean, cov, weights=weights)
    for _ in range(60):
        fit = fit if fit.done else fit.step(sum(fit.sums(part) for part in np.array_split(x, 4)))
    assert len(fit.history) > 3 and (np.diff(fit.history) > -1e-7 * np.abs(fit.history[:-1])).all()


def test_surplus_components_lose_their_weight(spark, planted):
    df, pdf = planted
    fit = fit_variational(df.unionByName(df.limit(1).withColumn("a", F.lit(None).cast("double"))), ["a", "b"], 8)
    model = fit.mixture()
    w = np.sort(model.weights)[::-1]
    assert np.allclose(w[:3], [0.5, 1 / 3, 1 / 6], atol=0.02) and w[3:].max() < 0.01
    assert (np.diff(fit.history) > -1e-6).all()
    joint = fit_variational(df, ["a", "b", "y"], 6, rounds=60).mixture()
    for given, wanted in ((["a", "b"], ["y"]), (["y"], ["a", "b"])):  # forward and inverse
        got = mixtures.predict(df, joint, "id", given, ["a", "b", "y"]).toPandas().set_index("id").sort_index()["estimate"]
        own = joint.conditional(pdf[given].to_numpy(), [["a", "b", "y"].index(c) for c in given], [["a", "b", "y"].index(c) for c in wanted])
        assert np.allclose(np.stack(got.to_numpy()), (own[0] * own[2][:, :, None]).sum(1))
    forward = mixtures.predict(df, joint, "id", ["a", "b"], ["a", "b", "y"]).toPandas().set_index("id").sort_index()["estimate"].str[0]
    assert 1 - ((forward - pdf["y"]) ** 2).sum() / ((pdf["y"] - pdf["y"].mean()) ** 2).sum() > 0.98
    with pytest.raises(ValueError):
        fit_variational(df.limit(0), ["a"], 2)


def test_sums_over_partitions_leave_out_a_fold(spark, planted):
    rows = em.vectors(planted[0], ["a", "b"], (F.col("id") % 3).cast("int"))
    x = planted[1][["a", "b"]].to_numpy()
    totals = em.gathered(rows, {0: em.Moments(), 1: em.Moments(1), 2: em.Moments(9)})
    for k, own in ((0, x), (1, x[np.arange(600) % 3 != 1]), (2, x)):
        n, mean, cov = em.mean_and_covariance(totals[k], 2)
        assert n == len(own) and np.allclose(mean, own.mean(0)) and np.allclose(cov, np.cov(own.T, ddof=0))
    assert em.gathered(rows.limit(0), {0: em.Moments()}) == {}


def test_fits_together_equal_fits_alone(spark, planted):
    rows = em.vectors(planted[0], ["a", "b", "y"], (F.col("id") % 2).cast("int"))
    begun = tuning._begun(rows, [tuning.MixtureCell("full", 3), tuning.MapCell(5, 2)], [0, 1], 0)
    together = em.advance(rows, begun, 12)
    x, fold = planted[1][["a", "b", "y"]].to_numpy(), np.arange(600) % 2
    for k, fit in begun.items():
        for _ in range(12):
            fit = fit if fit.done else fit.step(fit.sums(x[fold != fit.fold]))
        assert np.allclose(together[k].mixture().means, fit.mixture().means) and np.allclose(together[k].history, fit.history)
        assert (np.diff(fit.history) > -1e-6 * np.abs(fit.history[:-1])).all() or isinstance(fit, em.MapFit)


def test_choice_of_a_mixture(spark, planted):
    df, pdf = planted
    cells = tuning.grid_of(tuning.MixtureCell, kind=["full", "spherical"], components=[1, 3], rep=["mean", "mode"])
    got = tuning.tune_regression(df, "id", ["a", "b"], ["y"], cells, 4, 40)
    assert set(got.tried) == set(cells) and got.cell.kind == "full" and got.cell.components == 3 and got.score > 0.98
    assert got.tried[got.cell] == max(got.tried.values()) and got.fit.fold is None
    assert got.tried[tuning.MixtureCell("full", 1, "mean")] < 0.9
    one = pdf.assign(fold=pdf["id"] % 4)
    error = 0.0  # one full component is least squares
    for f in range(4):
        train, test = one[one["fold"] != f], one[one["fold"] == f]
        design = lambda d: np.column_stack([np.ones(len(d)), d[["a", "b"]]])
        error += ((test["y"] - design(test) @ np.linalg.lstsq(design(train), train["y"], rcond=None)[0]) ** 2).sum()
    dealt = df.withColumn("deal", (F.col("id") % 4).cast("int"))
    alone = tuning.tune_regression(dealt, "id", ["a", "b"], ["y"], [tuning.MixtureCell("full", 1)], fold="deal")
    assert np.isclose(alone.score, 1 - error / ((pdf["y"] - pdf["y"].mean()) ** 2).sum(), atol=1e-6)
    with pytest.raises(ValueError):
        tuning.tune_regression(df, "id", ["a"], ["y"], [])


def test_choice_by_bayes_scores_part_of_the_grid(spark, planted):
    df = planted[0].limit(200)
    cells = tuning.grid_of(tuning.MixtureCell, kind=mixtures.KINDS, components=range(1, 5), rep=["mean", "mode"])
    got = tuning.tune_regression(df, "id", ["a", "b"], ["y"], cells, 2, 5, bayes=True, bayes_rounds=3)
    assert 15 <= len(got.tried) <= 18 < len(cells) and got.cell in got.tried
    assert got.table(spark).columns == ["kind", "components", "rep", "score"]


def test_choice_of_a_map(spark, planted):
    df = planted[0].limit(150)
    cells = tuning.grid_of(tuning.MapCell, side=[5], bumps=[2, 3], variance=[0.5, 2.0], ridge=[0.01])
    got = tuning.tune_regression(df, "id", ["a", "b"], ["y"], cells, 3, 8)
    assert set(got.tried) == set(cells) and got.score > 0.5
    near = tuning.tune_map_by_neighbours(df, "id", ["a", "b", "y"], cells[:2], k=4, rounds=5)
    assert near.cell in cells[:2] and all(s < 0 for s in near.tried.values())


def test_densities(spark, planted):
    df, pdf = planted
    model = mixtures.Mixture(np.array([0.4, 0.6]), np.array([[0.0, 0, 0], [3, 2, 1]]), np.array([np.diag([1.0, 2, 3]), [[2, 0.5, 0.3], [0.5, 1, 0.1], [0.3, 0.1, 1]]]))
    out = densities.output_density(df, model, "id", ["a", "b"], ["a", "b", "y"]).toPandas().set_index("id").sort_index()
    x = pdf[["a", "b", "y"]].to_numpy()
    joint, marginal = mixtures.log_sum(model.log_parts(x)), mixtures.log_sum(model.log_parts(x[:, :2], [0, 1]))
    assert np.allclose(out["log_density"], joint - marginal) and np.allclose(out["density"], np.exp(joint - marginal))
    parts = densities.conditional_components(df, model, "id", ["a", "b"], ["a", "b", "y"]).toPandas()
    assert np.allclose(parts.groupby("id")["weight"].sum(), 1) and len(parts) == 1200
    mix = parts.assign(s=parts["weight"] * parts["density"]).groupby("id")["s"].sum()
    assert np.allclose(-np.log(mix), parts.groupby("id")["ioe"].first())
    assert densities.conditional_covariances(model, [0, 1], [2]).shape == (2, 1, 1)
    assert densities.output_density(df.limit(0), model, "id", ["a", "b"], ["a", "b", "y"]).count() == 0
