"""Operators against independent numpy formulas and invariants."""

from __future__ import annotations

import math
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.functions import normal
from loomstat.models.base import PLS, SVR, GaussianProcess, OneClassSVM, Ridge
from loomstat.operators import frame, learning, mixtures, neighbours, optimization, selection, splits, topographic
from loomstat.streaming import soft_sensor


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.5 * x[:, 2] + 1 + rng.normal(size=120) * 0.05
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, id=np.arange(120), grp=np.arange(120) // 3)
    return spark.createDataFrame(pdf).cache(), pdf


def test_normal_functions(spark):
    xs = np.linspace(-37, 8, 451)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", normal.cdf(F.col("x")).alias("c")).withColumn("back", normal.ppf(F.col("c"))).toPandas()
    exact = np.array([math.erfc(-x / math.sqrt(2)) / 2 for x in df["x"]])
    error = np.abs(df["c"] / exact - 1)
    assert error.max() < 3e-8 and error[np.abs(df["x"]) < 2.5].max() < 5e-15
    assert np.abs(df["back"] - df["x"])[np.abs(df["x"]) < 3].max() < 1e-4


def test_joint_probability_far_from_the_mean(spark):
    # the goals are 20 deviations off, on either side, and a range on the upper side
    df = spark.createDataFrame([(0.0, 1.0)], "mu_a double, sd_a double")
    tail = lambda x: math.erfc(x / math.sqrt(2)) / 2
    for goal, p in ((("a", "max", 20.0, 0.0), tail(20)), (("a", "min", 0.0, -20.0), tail(20)), (("a", "range", 20.0, 20.01), tail(20) - tail(20.01))):
        got = df.select(optimization.joint_log_probability(df, [goal]).alias("p")).first()["p"]
        assert abs(got - math.log(p)) < 1e-6
    assert df.select(optimization.joint_log_probability(df, [("a", "max", 50.0, 0.0)]).alias("p")).first()["p"] == -1e100


def test_constant_variable_is_named(spark):
    with pytest.raises(ValueError, match="flat"):
        frame.Autoscaler.fit(spark.range(5).select(F.col("id").alias("v"), F.lit(1.0).alias("flat")), ["v", "flat"])
    with pytest.raises(ValueError):
        frame.check_columns(3, [0, 1], [1])


def test_models():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 4
    for m in (PLS(3), Ridge()):
        slope, bias = m.fit(x, y)
        assert np.allclose(slope, [1, -2, 0.5]) and np.isclose(bias, 4)
    svr = SVR(c=50, epsilon=0.01, gamma=0.2)
    assert np.abs(svr.predict(svr.fit(x, y), x) - y).max() < 0.5
    gp = GaussianProcess()
    mu, sd = gp.predict_both(gp.fit(x, y), x)
    assert np.abs(mu - y).max() < 0.2 and (sd > 0).all()
    oc = OneClassSVM(nu=0.2, gamma=0.3)
    state = oc.fit(x)
    assert np.isclose(state[1].sum(), 1) and (state[1] <= 1 / (0.2 * 60) + 1e-9).all()
    assert (oc.predict(state, x) < -1e-6).mean() <= 0.25


def test_nearest_over_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = neighbours.nearest(df, df, 4, block=20).orderBy("i", "rank").toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert (got["j"].to_numpy().reshape(90, 4) == np.argsort(d, 1)[:, :4]).all()


@pytest.mark.parametrize("block", [8, 30, 500])
def test_nearest_by_cells_is_exact(spark, monkeypatch, block):
    """Clusters, copies, ties and a hot cell; queries other than the references; fewer references than k."""
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(40, 2)) * 0.1, rng.normal(size=(40, 2)) + 9, np.zeros((30, 2)), rng.integers(0, 3, (30, 2))]).astype(float)
    q = np.vstack([x[::9], rng.normal(size=(10, 2)) * 20])
    refs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    ask = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(q)], "id long, v array<double>")
    monkeypatch.setattr(neighbours, "PIVOTS", 6)
    got = neighbours.nearest(ask, refs, 5, block=block).orderBy("i", "rank").toPandas()
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    want = np.stack([np.lexsort((np.arange(len(x)), row))[:5] for row in d])
    assert (got["j"].to_numpy().reshape(len(q), 5) == want).all() and np.allclose(got["d"], np.take_along_axis(d, want, 1).ravel())
    assert neighbours.nearest(ask, refs.limit(3), 5, block=block).count() == 3 * len(q)
    assert neighbours.nearest(ask, refs.limit(0), 5, block=block).count() == 0


def test_kennard_stone(spark, samples, monkeypatch):
    df = samples[0].select("id", F.array("a", "b", "c").alias("v"))
    small = splits.kennard_stone(df, "id", "v", 12).orderBy("place").toPandas()["id"].tolist()
    x = samples[1][["a", "b", "c"]].to_numpy()
    want = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    while len(want) < 12:
        d = ((x[:, None] - x[want][None]) ** 2).sum(2).min(1)
        d[want] = -1
        want.append(int(d.argmax()))
    monkeypatch.setattr(splits, "SMALL", 10)
    assert small == want == splits.kennard_stone(df, "id", "v", 12).orderBy("place").toPandas()["id"].tolist()


def test_folds_and_groups(spark, samples):
    df = samples[0]
    sizes = splits.folds(df, "id", 5).groupBy("fold").count().toPandas()["count"]
    assert len(sizes) == 5 and sizes.sum() == 120 and sizes.max() - sizes.min() < 20
    split = splits.group_split(df, "grp", 0.3).toPandas()
    assert split.groupby("grp")["test"].nunique().max() == 1 and split[split["test"]]["grp"].nunique() == 12


def test_cross_validation(spark, samples):
    df = splits.folds(samples[0], "id", 4)
    scores, best = learning.grid_search(df, [PLS(1), PLS(3)], "fold", ["a", "b", "c"], "y")
    assert best == PLS(3) and scores.count() == 2
    out = learning.double_cross_validation(df, [PLS(1), PLS(3)], "id", "fold", ["a", "b", "c"], "y").toPandas()
    assert sorted(out["id"]) == list(range(120)) and learning.pooled_r2(out["y"].to_numpy(), out["yhat"].to_numpy()) > 0.99
    rand = learning.y_randomization(samples[0], [PLS(2)], "id", ["a", "b", "c"], "y", 5).toPandas().set_index("repeat")
    assert rand["r2"][-1] > 0.9 and (rand["r2"].drop(-1) < 0.3).all()


def test_bagging_and_outliers(spark, samples):
    df, pdf = samples
    out = learning.combine(learning.bagging(df, df, PLS(3), "id", ["a", "b", "c"], "y", 10), "id").toPandas().set_index("id").sort_index()
    assert np.abs(out["yhat"] - pdf["y"]).max() < 0.5 and (out["std"] >= 0).all()
    planted = df.withColumn("y", F.when(F.col("id") == 7, F.col("y") + 40).otherwise(F.col("y")))
    flags = learning.ensemble_outliers(planted, PLS(3), "id", ["a", "b", "c"], "y", 10, 4).toPandas().set_index("id")["outlier"]
    assert flags[7] and flags.sum() == 1


def test_local_model_with_wide_similarity_is_pls(spark, samples):
    df, pdf = samples
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy()
    got = learning.locally_weighted_pls((x, y), df, "id", ["a", "b", "c"], 2, 1e9).toPandas().set_index("id").sort_index()["yhat"]
    m = PLS(2)
    assert np.allclose(got, m.predict(m.fit(x, y), x), atol=1e-5)


def test_selection(spark, samples):
    df = samples[0].withColumn("a2", F.col("a") * 2)
    assert selection.highly_correlated(df, ["a", "b", "a2"], 0.95) in (["a"], ["a2"])
    clusters = selection.correlation_clusters(df, ["a", "b", "a2"], 0.9)
    assert clusters["a"] == clusters["a2"] != clusters["b"]
    slopes = selection.lomp(df, Ridge(), (np.array([3.0, -2.0, 0.5]), 1.0), "id", ["a", "b", "c"], [1.0, 1.0, 1.0], 20).toPandas()["slopes"]
    assert np.allclose(np.stack(slopes), [3, -2, 0.5])
    importance = selection.cvpfi(splits.folds(df, "id", 3), PLS(3), "id", "fold", ["a", "b", "c"], "y", 2, alpha=1.0).toPandas().set_index("variable")["mean"]
    assert importance["a"] > importance["b"] > importance["c"] > 0
    m, state = Ridge(), (np.array([3.0, -2.0, 0.5]), 1.0)
    x = samples[1][["a", "b", "c"]].to_numpy()
    phi = selection.kernel_shap(m, state, x[0], x)
    assert np.isclose(phi.sum(), m.predict(state, x[:1])[0] - m.predict(state, x).mean()) and np.allclose(phi, state[0] * (x[0] - x.mean(0)))


def test_mixture_of_one_is_least_squares_and_em_rises(spark, samples):
    df, pdf = samples
    order = ["a", "b", "c", "y"]
    one, _ = mixtures.fit_mixture(df.select(F.array(*order).alias("v")), "v", 1, rounds=2)
    got = mixtures.predict(df, one, "id", ["a", "b", "c"], order).toPandas().set_index("id").sort_index()["estimate"].str[0]
    x = np.hstack([pdf[["a", "b", "c"]].to_numpy(), np.ones((120, 1))])
    assert np.allclose(got, x @ np.linalg.lstsq(x, pdf["y"].to_numpy(), rcond=None)[0], atol=1e-3)
    for kind in mixtures.KINDS:
        model, like = mixtures.fit_mixture(df.select(F.array("a", "y").alias("v")), "v", 2, kind, rounds=6)
        assert (np.diff(like) > -1e-6 * abs(like[0])).all() and np.isclose(model.weights.sum(), 1)
    with pytest.raises(ValueError):
        one.conditional(np.zeros((1, 2)), [0, 1], [3])


def test_imputation_keeps_known_cells(spark, samples):
    holes = samples[0].withColumn("y", F.when(F.col("id") % 5 != 0, F.col("y")))
    out = mixtures.impute(holes, "id", ["a", "b", "c", "y"], 1, 2).toPandas().set_index("id").sort_index()
    assert np.abs(out["y"] - samples[1]["y"]).max() < 0.5 and np.allclose(out["a"], samples[1]["a"])


def test_topographic_map(spark, samples):
    df = samples[0].select("id", F.array("a", "b", "c").alias("v"))
    model, like = topographic.fit_map(df, "v", (6, 6), (3, 3), rounds=6, sparse=True)
    assert model.success and like[-1] > like[0] and np.isclose(model.mixing.sum(), 1)
    where = np.stack(topographic.project(df, model, "id", "v").toPandas()["mean"])
    assert np.abs(where).max() <= 1 + 1e-9


def test_unmixing_recovers_fractions(spark):
    rng = np.random.default_rng(4)
    pure, f = rng.uniform(size=(4, 50)), rng.dirichlet(np.ones(4), 6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(f @ pure)], "id long, v array<double>")
    got = np.stack(optimization.unmix(df, "id", "v", pure, 5000).orderBy("id").toPandas()["fractions"])
    assert np.abs(got - f).max() < 1e-4


def test_proposal_and_repair(spark):
    x = np.linspace(-1, 1, 9)[:, None]
    pool = spark.range(41).select("id", ((F.col("id") - 20) / 20.0).alias("x"))
    best = optimization.propose(x, -((x[:, 0] - 0.3) ** 2), pool, "id", ["x"], "mean").first()
    assert abs(best["id"] - 26) <= 2
    df = spark.createDataFrame([([0.7, 5.0, 3.0, 2.0],), ([0.2, 1.0, 8.0, 9.0],)], "v array<double>")
    out = optimization.repaired(df, "v", [1, 10, 10, 10], [0] * 4, [0], ([1, 2, 3], 10.0), None, ([1, 2, 3], 2), [None, 2, 2, 2]).toPandas()["v"].tolist()
    assert [list(map(float, v)) for v in out] == [[1.0, 6.25, 3.75, 0.0], [0.0, 0.0, 4.71, 5.29]]


def test_stream_equals_table(spark, tmp_path):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(60), "key": np.arange(60) % 2, "t": np.arange(60), "x": rng.normal(size=60)})
    pdf["y"] = np.where(pdf["id"] % 3 == 0, np.nan, 2 * pdf["x"] + 1)
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    for k in range(3):
        df.where((F.col("t") >= 20 * k) & (F.col("t") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / f"part{k}"))
    (tmp_path / "in").mkdir()
    stream = soft_sensor.estimate_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "key", ["t"], "id", ["x"], "y")
    q = stream.writeStream.format("memory").queryName("sensor").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    for k in range(3):
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{k}-{f.name}")
        q.processAllAvailable()
    q.stop()
    a = spark.table("sensor").orderBy("id").toPandas()
    b = soft_sensor.estimate(df, "key", ["t"], "id", ["x"], "y").orderBy("id").toPandas()
    assert a["id"].tolist() == b["id"].tolist() and np.allclose(a["estimate"], b["estimate"])
