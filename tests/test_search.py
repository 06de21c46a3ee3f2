from __future__ import annotations

import numpy as np
import pytest

from loomstat.operators import search
from loomstat.sources import files


def test_d_optimal_and_grid():
    cells = np.array([[i, j] for i in range(8) for j in range(8)], float)
    picked = search.d_optimal(cells, 5)
    assert len(set(picked)) == 5
    goal = lambda i: -((cells[i] - [5, 2]) ** 2).sum()
    best, done = search.bayes_grid(cells, lambda w: [goal(i) for i in w], rounds=15, start=10)
    assert goal(best) >= -2 and len(done) == 24
    best, done = search.bayes_grid(cells[:9], lambda w: [goal(i) for i in w])
    assert len(done) == 9


def test_preferences_are_ranked():
    x = np.linspace(0, 1, 8)[:, None]
    pairs = np.array([[i, j] for i in range(8) for j in range(i)])
    mu, sd = search.PreferenceProcess(x, pairs, gamma=2.0).predict_both(x)
    assert (np.diff(mu) > 0).all() and (sd > 0).all()


def test_importance_power():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    assert search.scaled_by_importance(x, x[:, 0], np.array([1.0, 0.1]), lambda: search.PLS(1), [0.0, 1.0]) in (0.0, 1.0)
    m, state, limit = search.support_domain(x, [0.1, 1.0])
    assert ((m.predict(state, x) - limit) < 0).mean() <= 0.02


def test_genes_are_chosen_from_all_rows(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 12000))
    small = [(float(p), float(q), float(p)) for p, q in zip(a, b)]
    large = [(float(p), float(q), float(q)) for p, q in zip(100 * b, 100 * a)]
    df = spark.createDataFrame(small, "a double, b double, y double").where(F.xxhash64("a", "b", "y") < 0)
    df = df.unionByName(spark.createDataFrame(large, "a double, b double, y double").where(F.xxhash64("a", "b", "y") > 0))
    assert search.select_by_genes(df, ["a", "b"], "y", 8, 2) == ["b"]


def test_moments_score_as_fits_do(spark):
    from pyspark.sql import functions as F

    from loomstat.operators.learning import pooled_r2, scaled_fit, scaled_predict

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 50, 3] + [1000, 0, 5]
    df = spark.createDataFrame([(*map(float, r), 4.0, float(r[0] + r[2] / 3)) for r in x], "a double, b double, c double, k double, y double")
    rows = df.select("*", F.pmod(F.xxhash64("a", "b", "c", "k", "y"), F.lit(5)).alias("f")).toPandas()
    moments = search.fold_moments(df, ["a", "b", "c", "k"], "y", 5)
    for use in ([0], [0, 2], [1, 3], [3], [0, 1, 2, 3]):
        v, t, f, out = rows.iloc[:, use].to_numpy(), rows["y"].to_numpy(), rows["f"].to_numpy(), np.empty(300)
        for k in range(5):
            out[f == k] = scaled_predict(search.PLS(1), scaled_fit(search.PLS(1), v[f != k], t[f != k]), v[f == k])
        assert search.one_component_r2(moments, np.array(use)) == pytest.approx(pooled_r2(t, out), abs=1e-9)


def test_gram_variance_of_all_rows(spark):
    from loomstat.operators.learning import gram_variances

    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(400, 2)), rng.integers(0, 4, (300, 2)) * 9.0])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    d2 = ((z[:, None] - z[None]) ** 2).sum(2)
    want = [np.exp(-g * d2).var(ddof=1) for g in (0.05, 0.8)]
    df = spark.createDataFrame(x.tolist(), "a double, b double")
    for block in (100, 2048):
        assert gram_variances(df, ["a", "b"], [0.05, 0.8], block) == pytest.approx(want, rel=1e-9)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,y,x1,note\ns1,1.5,999,hi\ns2,NaN,2,\n")
    df = files.read_samples(spark, str(tmp_path / "a.csv"), ["y", "x1"], ["note"], sentinel=999.0)
    assert [tuple(r) for r in df.orderBy("sample_id").collect()] == [("s1", 1.5, None, "hi"), ("s2", None, 2.0, None)]
    with pytest.raises(ValueError):
        files.read_samples(spark, str(tmp_path / "a.csv"), ["z"])
    files.write_samples(df, str(tmp_path / "out"), "parquet")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    files.save_state(spark, {"round": 3}, str(tmp_path / "state"))
    assert files.load_state(spark, str(tmp_path / "state")) == {"round": 3}
    (tmp_path / "v.json").write_text('{"H": [1, 0], "He": [0, 1]}')
    assert files.read_vectors(spark, str(tmp_path / "v.json")).count() == 2
