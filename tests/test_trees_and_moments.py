"""Bagged trees against a plain tree, and linear models from moments against fits on rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat import registry
from loomstat.models.base import PLS, Ridge
from loomstat.operators import forest, learning, linear, splits


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3)).round(2)
    label = np.where(x[:, 0] > 0.3, "up", np.where(x[:, 1] > 0, "mid", "down"))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=np.arange(500), label=label, y=2 * x[:, 0] - x[:, 1] + rng.normal(size=500) * 0.1)
    return spark.createDataFrame(pdf).repartition(4).cache(), pdf


def plain_tree(bins, t, depth, path=1, out=None):
    """Split by the same rule, on rows."""
    out = {} if out is None else out
    out[path] = (len(t), t.sum(0), None)
    best = (1e-9 * len(t), None, None)
    if depth:
        for v in range(bins.shape[1]):
            for b in np.unique(bins[:, v])[:-1]:
                left = bins[:, v] <= b
                gain = (t[left].sum(0) ** 2).sum() / left.sum() + (t[~left].sum(0) ** 2).sum() / (~left).sum() - (t.sum(0) ** 2).sum() / len(t)
                if gain > best[0] + 1e-9:
                    best = (gain, v, b)
    if best[1] is not None:
        out[path] = (len(t), t.sum(0), best[1:])
        left = bins[:, best[1]] <= best[2]
        plain_tree(bins[left], t[left], depth - 1, 2 * path, out)
        plain_tree(bins[~left], t[~left], depth - 1, 2 * path + 1, out)
    return out


@pytest.mark.parametrize("classify", [True, False])
def test_a_tree_without_bootstrap_is_the_plain_tree(table, classify):
    df, pdf = table
    f = forest.grow_forest(df, "id", ["a", "b", "c"], "label" if classify else "y", bags=1, depth=3, bins=8, classify=classify, bootstrap=False)
    bins = f.bins(pdf[["a", "b", "c"]].to_numpy())
    t = (pdf["label"].to_numpy()[:, None] == np.array(f.classes)).astype(float) if classify else pdf[["y"]].to_numpy()
    want = plain_tree(bins, t, 3)
    assert f.classes == (["up", "mid", "down"] if classify else None)
    for node, (n, s, split) in want.items():
        assert f.weight[0, node] == n and np.allclose(f.sums[0, node], s)
        assert (f.variable[0, node], f.cut[0, node]) == split if split else f.variable[0, node] == -1


def test_bags_votes_and_importances(table):
    df, pdf = table
    f = forest.grow_forest(df, "id", ["a", "b", "c"], "label", bags=12, depth=4, bins=16, features=2)
    assert abs(f.weight[:, 1].mean() - 500) < 60 and len(set(f.weight[:, 1])) > 3
    got = forest.predict_forest(df, f, "id").toPandas().set_index("id").sort_index()
    votes = np.stack(got["votes"].to_numpy())
    assert (votes.sum(1) == 12).all() and np.allclose(np.stack(got["probability"].to_numpy()), votes / 12)
    assert (got["label"] == [f.classes[i] for i in votes.argmax(1)]).all() and (got["label"] == pdf["label"]).mean() > 0.9
    share = f.importances()
    assert abs(sum(share.values()) - 1) < 1e-9 and share["c"] < min(share["a"], share["b"])
    assert forest.out_of_bag_error(df, f, "id", "label") < 0.2
    again = forest.grow_forest(df.repartition(7), "id", ["a", "b", "c"], "label", bags=12, depth=4, bins=16, features=2)
    assert (again.variable == f.variable).all() and (again.cut == f.cut).all()  # however rows are dealt
    held = forest.HELD
    try:
        forest.HELD = 1  # a scan a bag
        one = forest.grow_forest(df, "id", ["a", "b", "c"], "label", bags=3, depth=2, bins=16, features=2)
    finally:
        forest.HELD = held
    assert (one.variable[:, :4] == f.variable[:3, :4]).all()


def test_numbers_and_edge_cases(spark, table):
    df, pdf = table
    f = forest.grow_forest(df, "id", ["a", "b", "c"], "y", bags=10, depth=5, classify=False)
    got = forest.predict_forest(df, f, "id").toPandas().set_index("id").sort_index()
    assert 1 - ((got["yhat"] - pdf["y"]) ** 2).sum() / ((pdf["y"] - pdf["y"].mean()) ** 2).sum() > 0.9 and (got["std"] >= 0).all()
    share = forest.importances(df, "id", ["a", "b", "c"], "y", [0.5, 1.0], bags=8, depth=3)
    assert max(share.values()) == 1 and share["a"] == 1 and share["c"] < 0.1
    with pytest.raises(ValueError):
        forest.subspace(3, 5, 0, 0)
    flat = forest.grow_forest(df.withColumn("label", F.lit("x")), "id", ["a"], "label", bags=2, depth=2)
    assert (flat.variable == -1).all() and forest.predict_forest(df, flat, "id").select("label").distinct().first()[0] == "x"
    nulls = df.withColumn("a", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("a")))
    part = forest.grow_forest(nulls, "id", ["a", "b"], "label", bags=1, depth=2, bootstrap=False)
    assert part.weight[0, 1] == 400 and forest.predict_forest(nulls, part, "id").count() == 500


@pytest.mark.parametrize("model", [PLS(1), PLS(2), PLS(3), Ridge(0.0), Ridge(5.0)])
def test_moments_give_the_fit_on_rows(table, model):
    df, pdf = table
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy()
    products = linear.fold_products(df, ["a", "b", "c"], "y", (F.col("id") % 3).cast("int"))
    for f, line in linear.fold_lines(model, products).items():
        rest = np.arange(500) % 3 != f
        want = learning.scaled_predict(model, learning.scaled_fit(model, x[rest], y[rest]), x[~rest])
        assert np.allclose(line[0] + x[~rest] @ line[1:], want)
        assert np.isclose(linear.squared_error(line, products[f]), ((y[~rest] - want) ** 2).sum())
    factors = np.array([1.0, 0.3, 0.0])
    line = linear.solve(model, sum(products.values()), factors)
    state, (mx, sx, my, sy) = learning.scaled_fit(model, x, y)
    state = model.fit((x - mx) / sx * factors, (y - my) / sy)
    assert np.allclose(line[0] + x @ line[1:], model.predict(state, (x - mx) / sx * factors) * sy + my)


def test_bags_by_moments(table):
    df, pdf = table
    own = [np.array([0, 2]), np.array([0, 1, 2])]
    got = learning._bag_products(df, "id", ["a", "b", "c"], "y", own, 5)
    h = df.select("id", F.xxhash64("id").alias("h")).toPandas().set_index("id").sort_index()["h"].to_numpy()
    for b, use in enumerate(own):
        v = np.column_stack([np.ones(500), pdf[["a", "b", "c"]].to_numpy()[:, use], pdf["y"]])
        assert np.allclose(got[b], (v * forest.drawn(h, b, 5)[:, None]).T @ v)
    draws = forest.drawn(np.random.default_rng(0).integers(-(2**63), 2**63, 100_000), 3, 1)
    assert abs(draws.mean() - 1) < 0.02 and abs(draws.var() - 1) < 0.03 and abs((draws == 0).mean() - np.exp(-1)) < 0.01


def test_inner_choice_and_power(table):
    df, pdf = table
    folded = splits.folds(df, "id", 4)
    out = learning.double_cross_validation(folded, [PLS(1), PLS(3)], "id", "fold", ["a", "b", "c"], "y").toPandas()
    assert sorted(out["id"]) == list(range(500)) and learning.pooled_r2(out["y"].to_numpy(), out["yhat"].to_numpy()) > 0.99
    best, r2 = linear.best_power(folded, ["a", "b", "c"], "y", F.col("fold"), {"a": 1.0, "b": 0.5, "c": 0.1}, PLS(1), [0.0, 1.0, 3.0])
    assert r2[best] == max(r2.values()) and len(r2) == 3


def test_places_and_permuted_targets(spark, table):
    df, pdf = table
    got = splits.placed(df, [F.desc("a"), F.col("id")]).toPandas().sort_values("place")
    assert got["place"].tolist() == list(range(500)) and (np.diff(got["a"]) <= 0).all()
    assert splits.placed(df.limit(0), [F.col("a")]).count() == 0
    assert splits.folds(df, "id", 7, order=[F.col("id")]).where("fold <> id % 7").count() == 0
    moved = learning.permuted_targets(df, "id", ["a", "b", "c"], "y", 3, 0).toPandas()
    true = moved[moved["repeat"] == -1].set_index("place").sort_index()
    for r in range(3):
        own = moved[moved["repeat"] == r].set_index("place").sort_index()
        assert (own[["a", "b", "c"]].to_numpy() == true[["a", "b", "c"]].to_numpy()).all()
        assert sorted(own["y"]) == sorted(true["y"]) and (own["y"] != true["y"]).mean() > 0.9
    rand = learning.y_randomization(df, [PLS(1), PLS(3)], "id", ["a", "b", "c"], "y", 4).toPandas().set_index("repeat")
    assert len(rand) == 5 and rand["r2"][-1] > 0.99 and (rand["r2"].drop(-1) < 0.1).all()
    state = learning.scaled_fit(PLS(3), pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy())
    assert np.isclose(rand["mae"][-1], np.abs(pdf["y"] - learning.scaled_predict(PLS(3), state, pdf[["a", "b", "c"]].to_numpy())).mean(), rtol=0.05)


@pytest.mark.parametrize("name", ["l4_best_splits", "v1_linear_grid", "v4_linear_double", "g9_single_component", "g7_output_density", "g5_g6_components"])
def test_twins_on_more_rows(spark, name):
    from tests.test_oracle import TABLES, rows

    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    mine, theirs = registry.queries()[name](spark, "/root/testdata/sf0.01").toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert len(mine) and rows(mine) == rows(theirs)
