"""Reduced regression, map analysis, crystals as tables, inverse design: against numpy and brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.models.base import PLS, Ridge
from loomstat.operators import crystals, em, map_analysis, mixtures, topographic
from loomstat.operators.inverse_design import Constraints, design
from loomstat.operators.semi_supervised import fit_reduced, principal_axes


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(2)
    t = rng.normal(size=(160, 2))
    x = t @ rng.normal(size=(2, 5)) + rng.normal(size=(160, 5)) * 0.05
    y = t[:, 0] - 2 * t[:, 1]
    pdf = pd.DataFrame(x, columns=list("abcde")).assign(id=np.arange(160), y=y)
    return spark.createDataFrame(pdf[:40]).cache(), spark.createDataFrame(pdf[40:].drop(columns="y")).cache(), pdf


@pytest.mark.parametrize("model", [Ridge(0.0), PLS(1)])
def test_reduced_regression_equals_numpy(spark, sides, model):
    known, new, pdf = sides
    fit = fit_reduced(known, new, list("abcde"), "y", 2, model)
    x = pdf[list("abcde")].to_numpy()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    axes = np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :2]
    s = z @ axes
    m, sd, my, sy = s[:40].mean(0), s[:40].std(0, ddof=1), pdf["y"][:40].mean(), pdf["y"][:40].std(ddof=1)
    want = model.predict(model.fit((s[:40] - m) / sd, (pdf["y"][:40].to_numpy() - my) / sy), (s - m) / sd) * sy + my
    got = new.select("id", fit.predicted().alias("p")).toPandas().set_index("id").sort_index()["p"]
    assert np.allclose(got, want[40:]) and np.corrcoef(got, pdf["y"][40:])[0, 1] > (0.99 if model == Ridge(0.0) else 0.9)
    scores = np.array([list(r) for r in new.orderBy("id").select(*fit.reduction.scores()).collect()])
    assert np.allclose(np.abs(scores), np.abs(s[40:])) and np.allclose(fit.reduction.back(scores), x[40:], atol=0.3)


def test_reduction_within_a_domain_and_edges(spark, sides):
    known, new, pdf = sides
    some = new.where("id < 90").select("id")
    a = fit_reduced(known, new, list("abcde"), "y", 2, within=(some, "id")).reduction
    b = fit_reduced(known, new.where("id < 90"), list("abcde"), "y", 2).reduction
    assert np.allclose(a.axes, b.axes) and np.allclose(a.mean, pdf[list("abcde")][:90].mean())
    with pytest.raises(ValueError):
        fit_reduced(known, new, ["a"], "y", 2)
    with pytest.raises(ValueError):
        fit_reduced(known.limit(0), new, ["a", "b"], "y", 1)


def test_line_on_a_map(spark, sides):
    known, _, pdf = sides
    x, y = pdf[list("ab")][:40].to_numpy(), pdf["y"][:40].to_numpy()
    line = map_analysis.fit_line(known, ["a", "b"], "y")
    z, t = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean()) / y.std(ddof=1)
    b = np.linalg.lstsq(z, t, rcond=None)[0]
    assert np.allclose(line.slopes, b) and np.isclose(line.variance, ((t - z @ b) ** 2).mean())
    points = topographic.grid(6, 6)
    model = topographic.TopographicMap(points, np.hstack([points, np.ones((36, 1))]), np.array([[2.0, 0.3], [0.1, 1.5], [0, 0]]), 9.0, np.full(36, 1 / 36))
    mean, mode, share = map_analysis.invert_line(model, line, 0.7)
    centres = model.phi @ model.w
    # given the point of the map, x and y are one Gaussian: condition it by hand
    for i in (0, 17, 35):
        cov = np.eye(2) / 9
        gain = cov @ b / (b @ cov @ b + line.variance)
        pulled = centres[i] + gain * (0.7 - centres[i] @ b)
        if i == share.argmax():
            assert np.allclose(mode, pulled)
    density = np.exp(-0.5 * (0.7 - centres @ b) ** 2 / (line.variance + b @ b / 9))
    assert np.allclose(share, density / density.sum()) and np.isclose(share.sum(), 1)
    assert abs(mean @ b - 0.7) < 0.5


def test_merges_in_one_scan(spark, sides):
    known, new, pdf = sides
    df = known.select("a", "b").unionByName(new.select("a", "b"))
    model = topographic.fit_map(df.select(F.array("a", "b").alias("v")), "v", (3, 3), (2, 2), rounds=6, sparse=True)[0]
    table, best = map_analysis.merge_by_information(df, model, ["a", "b"])
    got = table.toPandas()
    x = pdf[["a", "b"]].to_numpy()
    shares = model.mixing.copy()
    for i in range(9):  # merge, then a whole pass, again and again
        live = np.flatnonzero(shares > 0)
        parts = np.array([topographic.TopographicMap(model.points[live], model.phi[live], model.w, model.beta, shares[live]).log_parts(x)])[0]
        bic = -2 * mixtures.log_sum(parts).sum() + len(live) * np.log(len(x))
        assert got["components"][i] == len(live) and np.isclose(got["bic"][i], bic) and got["clusters"][i] == len(set(parts.argmax(1)))
        least = live[shares[live].argmin()]
        rest = live[live != least]
        if len(rest):
            shares[rest] += shares[least] / len(rest)
        shares[least] = 0
    assert np.isclose(best.sum(), 1) and (best > 0).sum() == got["components"][got["bic"].argmin()]


def test_reciprocal_points_and_features(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *rng.uniform(2.5, 5, 3).tolist(), *rng.uniform(70, 110, 3).tolist()) for i in range(4)] + [(9, 9.0, 1.0, 1.0, 90.0, 90.0, 90.0)]
    lattices = spark.createDataFrame(rows, "id int, a double, b double, c double, alpha double, beta double, gamma double")
    got = crystals.reciprocal_points(lattices, "id").toPandas()
    for i, a, b, c, al, be, ga in rows:
        al, be, ga = np.radians([al, be, ga])
        v = np.zeros((3, 3))  # axes as rows
        v[0] = [a, 0, 0]
        v[1] = [b * np.cos(ga), b * np.sin(ga), 0]
        cx, cy = c * np.cos(be), c * (np.cos(al) - np.cos(be) * np.cos(ga)) / np.sin(ga)
        v[2] = [cx, cy, np.sqrt(c * c - cx * cx - cy * cy)]
        back = np.linalg.inv(v).T
        hkl = np.stack(np.meshgrid(*[np.arange(-14, 15)] * 3, indexing="ij"), -1).reshape(-1, 3)
        g = np.linalg.norm(hkl @ back, axis=1)
        radius = 1.297 if (g <= 1.297).sum() >= 60 else 1.4
        hkl, g = hkl[(g <= radius) & (g > 0)], g[(g <= radius) & (g > 0)]
        order = np.lexsort((-hkl[:, 2], -hkl[:, 1], -hkl[:, 0], np.abs(hkl).sum(1)))[:59]
        own = got[got["id"] == i].sort_values("place")
        assert (own[["h", "k", "l"]].to_numpy() == hkl[order]).all() and np.allclose(own["g"], g[order])
    sites = spark.createDataFrame([(0, 3, 0.1, 0.2, 0.3), (0, 5, 0.5, 0.5, 0.0), (0, 77, 0.5, 0.1, 0.0), (1, 5, 0.9, 0.0, 0.4)], "id int, element int, x double, y double, z double")
    properties = spark.createDataFrame([(3, [1.0, 0.5]), (5, [2.0, -1.0])], "element int, p array<double>")
    points = crystals.reciprocal_points(lattices, "id")
    for phase in ("linear", "complex"):
        f = crystals.reciprocal_features(sites, points, properties, "id", 2, phase).toPandas()
        own = got[(got["id"] == 0)].sort_values("place")
        dot = own[["h", "k", "l"]].to_numpy() @ np.array([[0.1, 0.2, 0.3], [0.5, 0.5, 0.0]]).T
        p = np.array([[1.0, 0.5], [2.0, -1.0]])
        want = np.pi * dot @ p if phase == "linear" else np.hstack([np.cos(2 * np.pi * dot) @ p, np.sin(2 * np.pi * dot) @ p])
        assert np.allclose(np.stack(f[f["id"] == 0].sort_values("place")["f"].to_numpy()), want)
        assert len(f[f["id"] == 1]) == 59 and 9 not in set(f["id"])  # no sites, no features
    with pytest.raises(ValueError):
        crystals.reciprocal_features(sites, points, properties, "id", 2, "other")


def test_tensors_and_back(spark):
    sites = spark.createDataFrame([(1, 0, 7, 0.1, 0.2, 0.3), (1, 1, 3, 0.4, 0.5, 0.6), (1, 2, 7, 0.7, 0.8, 0.9), (2, 0, 1, 0.0, 1.0, 0.5)], "id int, site int, element int, x double, y double, z double")
    t = crystals.site_table(sites, "id", "site", 3, 4).orderBy("id").collect()
    assert t[0]["elements"] == [7, 3, 0] and t[0]["slots"] == [1, 2, 1, 0] and t[0]["coordinates"][3] == [0.0, 0.0, 0.0] and t[1]["n_sites"] == 1
    with pytest.raises(Exception, match="more than"):
        crystals.site_table(sites, "id", "site", 1, 4).collect()
    tensors = spark.createDataFrame([(1, [[0.1, 0.9], [0.8, 0.2]], [[0.1, 1.4, -0.2], [0.5, 0.5, 0.5], [0.2, 0.2, 0.2]], [[0.9, 0.1], [0.2, 0.6], [0.01, 0.02]])], "id int, element_scores array<array<double>>, coordinates array<array<double>>, occupancy array<array<double>>")
    back = crystals.decode_sites(tensors, "id").orderBy("site").collect()
    assert [tuple(r) for r in back] == [(1, 0, 2, 0.1, 1.0, 0.0), (1, 1, 1, 0.5, 0.5, 0.5)]
    assert crystals.formulas(sites, "id").orderBy("id").collect()[0]["formula"] == "3:1 7:2"
    errors = crystals.site_errors(sites, crystals.decode_sites(tensors, "id"), "id", "site").orderBy("id").collect()
    assert errors[0]["n_sites"] == 3 and errors[0]["found"] == 2 and errors[0]["same_element"] == 0 and errors[1]["mae"] is None
    assert np.isclose(errors[0]["mae"], ((0 + 0.8 + 0.3) / 3 + 0.1 * 2 / 3) / 2)


def test_axes_of_partitions(spark, sides):
    known, _, pdf = sides
    axes = principal_axes(em.vectors(known, ["a", "b", "c"]), ["a", "b", "c"], 3, False)
    assert np.allclose(axes.variance, np.sort(np.linalg.eigvalsh(np.cov(pdf[["a", "b", "c"]][:40].to_numpy().T, ddof=0)))[::-1])


def test_design_obeys_its_constraints_and_reaches_the_target(spark):
    # y is 4 a + b - 2 flag; a and b add up to 1
    rng = np.random.default_rng(0)
    a = rng.random(800)
    x = np.stack([a, 1 - a + rng.normal(size=800) * 0.05, rng.integers(0, 2, 800)], 1)
    joint = np.column_stack([x, 4 * x[:, 0] + x[:, 1] - 2 * x[:, 2] + rng.normal(size=800) * 0.05])
    model = mixtures.Mixture(np.ones(1), joint.mean(0)[None], np.cov(joint.T)[None])
    c = Constraints([0.0, 0.0, 0.0], [1.0, 1.0, 1.0], zero_one=[2], total=([0, 1], 1.0), digits=[2, 2, None])
    seen = []

    def watch(g, table):
        for r in table.collect():
            v = r["v"]
            seen.append(g)
            assert v[2] in (0.0, 1.0) and abs(v[0] + v[1] - 1) < 0.011 and all(0 <= q <= 1 for q in v) and all(abs(q * 100 - round(q * 100)) < 1e-9 for q in v[:2])

    best = design(spark, model, [2.5], c, restarts=2, population=16, generations=4, seed=1, watch=watch).collect()
    assert len(best) == 2 and set(seen) == set(range(5))
    for r in best:
        assert abs(4 * r["v"][0] + r["v"][1] - 2 * r["v"][2] - 2.5) < 0.25
    again = design(spark, model, [2.5], c, restarts=2, population=16, generations=4, seed=1).collect()
    assert sorted(map(tuple, [(r["restart"], *r["v"]) for r in best])) == sorted(map(tuple, [(r["restart"], *r["v"]) for r in again]))
    with pytest.raises(ValueError):
        design(spark, model, [1.0, 2.0], c)
