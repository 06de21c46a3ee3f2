"""Steps whose memory or work once grew faster than their input: results against brute force, and bounds."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from loomstat.models.base import SVR, rbf
from loomstat.operators import gaps, mixtures, neighbours, relational, selection


def _primal(model: SVR, state: tuple, x: np.ndarray, y: np.ndarray) -> float:
    k = rbf(state[0], state[0], model.gamma) + 1.0
    return 0.5 * state[1] @ k @ state[1] + model.c * np.maximum(0, np.abs(y - model.predict(state, x)) - model.epsilon).sum()


@pytest.mark.parametrize("model", [SVR(3.0, 0.1, 0.5, 5000), SVR(0.5, 0.01, 0.05, 5000)])
def test_rows_at_one_point_are_fitted_together(monkeypatch, model):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.integers(0, 6, 200), rng.integers(0, 4, 200)]) / 2.0
    y = rng.normal(size=200)
    k, t, beta = rbf(x, x, model.gamma) + 1.0, y - y.mean(), np.zeros(200)
    for _ in range(5000):  # a row a step
        before = beta.copy()
        for i in range(200):
            g = t[i] - k[i] @ beta + 2 * beta[i]
            beta[i] = np.clip(np.sign(g) * max(0.0, abs(g) - model.epsilon) / 2, -model.c, model.c)
        if np.abs(beta - before).max() < 1e-5:
            break
    state = model.fit(x, y)
    assert model.predict(state, x) == pytest.approx(k @ beta + y.mean(), abs=1e-3)
    assert _primal(model, state, x, y) <= _primal(model, (x, beta, y.mean()), x, y) * (1 + 1e-5)
    monkeypatch.setattr("loomstat.models.base.HELD", 10)  # columns computed as they are met
    assert model.predict(model.fit(x, y), x) == pytest.approx(model.predict(state, x), abs=1e-9)


def test_a_fit_takes_no_matrix_of_all_pairs():
    rng = np.random.default_rng(1)
    x, y = np.column_stack([rng.integers(0, 25, 20_000), rng.integers(0, 7, 20_000)]) / 10.0, rng.normal(size=20_000)
    tracemalloc.start()
    model = SVR(rounds=3)
    model.predict(model.fit(x, y), x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6  # all pairs: 3.2 GB


def _median_gap(k: np.ndarray, v: np.ndarray) -> float:
    i, j = np.triu_indices(len(v), 1)
    d = np.abs(v[i] - v[j])[k[i] != k[j]]
    return float(np.median(d[d > 0]))


def test_median_gap_without_pairs(spark):
    rng, blocks = np.random.default_rng(3), 3
    for n, v, same in ((404, rng.normal(size=404), 0), (300, rng.integers(0, 3, 300) * 0.1, 20)):
        k = np.where(np.arange(n) % 40 >= same, np.arange(n), np.arange(n) // 20)  # rows may share a key
        df = spark.createDataFrame([*zip(k.tolist(), v.tolist()), (None, 5.0), (9999, None)], "k int, v double")
        assert gaps.median_gap(df, "k", "v", blocks) == pytest.approx(_median_gap(k, v), rel=1e-15)
    assert gaps.median_gap(spark.createDataFrame([(1, 2.0), (2, 2.0)], "k int, v double"), "k", "v") is None


def test_median_gap_meets_few_blocks(spark, monkeypatch):
    met = []
    own = gaps._Gaps.counted

    def seen(self, bounds):
        met.append(int(((self.least <= bounds[-1]) & (self.most > bounds[0])).sum()))
        return own(self, bounds)

    monkeypatch.setattr(gaps._Gaps, "counted", seen)
    v = np.random.default_rng(4).normal(size=8_000)
    got = gaps.median_gap(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "k int, v double"), "k", "v", 100)
    d = np.sort(v)
    assert max(met) < 5 * 100  # of 5,050 pairs of blocks
    below = (np.searchsorted(d, d + got, "right") - np.arange(1, len(d) + 1)).sum()
    assert abs(int(below) - len(d) * (len(d) - 1) // 4) <= 1


def test_neighbours_take_no_row_a_query_and_cell(spark, monkeypatch):
    """In many dimensions a query reaches most cells; keys and vectors that repeat lose nothing."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(330, 12))
    x[300:] = x[0]
    key = np.r_[np.arange(310), np.full(20, 3)]
    rows, own = {}, neighbours.keep

    def seen(df, name):
        out = own(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(neighbours, "keep", seen)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(key, x)], "id long, v array<double>")
    ask = df.dropDuplicates(["id"]).where("id <> 3")
    got = neighbours.nearest(ask, df, 3, block=20).orderBy("i", "rank").toPandas()
    assert rows["reached"] <= 309
    d = np.sqrt(((x[:310, None] - x[None]) ** 2).sum(2))
    for i in set(range(310)) - {3}:
        order = [j for j in np.lexsort((key, d[i])) if key[j] != i][:3]
        mine = got[got["i"] == i]
        assert mine["j"].tolist() == key[order].tolist() and mine["d"].to_numpy() == pytest.approx(d[i][order], abs=1e-12)


def test_quantiles_by_counting(spark):
    rng = np.random.default_rng(6)
    v = np.r_[rng.normal(size=301), np.full(50, 0.25), 1e9]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    for share in (0.0, 0.01, 0.37, 0.997, 1.0):
        assert gaps.quantile(df, "v", share) == pytest.approx(np.quantile(v, share), rel=1e-12)
    assert gaps.order_statistics(df.dropna(), "v", [0, 100, 351], bins=3) == np.sort(v)[[0, 100, 351]].tolist()
    assert gaps.quantile(df.where("v IS NULL"), "v", 0.5) is None


def test_no_task_of_permutation_importance_takes_the_table(spark, monkeypatch):
    """The loss is that of draws from the rows outside the fold, and no cell gets a copy of the rows."""
    from pyspark.sql import GroupedData

    from loomstat.models.base import Ridge
    from loomstat.operators.splits import folds

    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 2))
    y = 2 * x[:, 0] + 0.3 * rng.normal(size=600)
    df = folds(spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, y double"), "id", 3)
    own = GroupedData.applyInPandas

    def seen(self, run, schema):
        def counted(key, pdf):
            assert len(pdf) < 600
            return run(key, pdf)

        return own(self, counted if run.__code__.co_argcount == 2 else run, schema)

    monkeypatch.setattr(GroupedData, "applyInPandas", seen)
    got = selection.cvpfi(df, Ridge(), "id", "fold", ["a", "b"], "y", 4, alpha=1.0).toPandas().set_index("variable")
    assert got.loc["a", "mean"] == pytest.approx(2 * 4 * x[:, 0].var() / y.var(), rel=0.1)  # the expected loss of r2
    assert abs(got.loc["b", "mean"]) < 0.01 and (got["std"] < 0.2).all()


def test_pairs_of_one_group_come_from_many_tasks(spark, request):
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a table as small as this would be one task
    df = neighbours.keep(spark.range(60).selectExpr("id", "id * 0 AS g", "CAST(id DIV 2 AS DOUBLE) AS y").coalesce(1), "one-file")
    out = relational.preference_pairs(df, "id", "g", "y").selectExpr("winner", "loser", "spark_partition_id() AS task").toPandas()
    want = {(a, b) for a in range(60) for b in range(60) if a // 2 > b // 2}
    assert out["task"].nunique() > 1 and len(out) == len(want) and set(zip(out["winner"], out["loser"])) == want


def test_rounds_of_imputation_scan_written_tables(spark, monkeypatch):
    seen, own = [], mixtures.fit_mixture

    def fit(df, *args, **kw):
        seen.append(df.inputFiles())
        return own(df, *args, **kw)

    monkeypatch.setattr(mixtures, "fit_mixture", fit)
    rows = [(i, float(i % 7), float(i % 7) * 2 if i % 5 else None) for i in range(60)]
    out = mixtures.impute(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], 1, 2).toPandas()
    assert len(seen) == 2 and all(seen) and np.allclose(out["b"], 2 * out["a"], atol=1e-3)


def test_soft_sensor_fits_rows_together_and_carries_keys_over_batches(spark, request, monkeypatch):
    """Estimates are those of a fit a row, also where a key outgrows a batch; no key is gathered as a whole."""
    from pyspark.sql import GroupedData

    from loomstat.models.base import PLS
    from loomstat.streaming import soft_sensor

    def whole(*_):
        raise AssertionError("a key is gathered")

    monkeypatch.setattr(GroupedData, "applyInPandas", whole)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for key, n in ((None, 9), ("a", 120), ("b", 3), ("c", 40)):
        known, pending, last = [], [], 0.0
        for t in range(n):
            x, y = [float(rng.integers(0, 4)), 1.5 if key == "c" else float(rng.normal())], float(rng.normal()) if rng.random() > 0.2 else None
            if key == "a" and t == 30:
                x[0] = None
            data = np.array([[np.nan if v is None else v for v in r] for r in known], float)
            q = np.array([np.nan if v is None else v for v in x])
            if len(known) >= 5:
                a, b = data[:, :-1], data[:, -1]
                dev = a.std(0, ddof=1)
                z, at = (a - a.mean(0)) / np.where(dev > 0, dev, 1.0), (q - a.mean(0)) / np.where(dev > 0, dev, 1.0)
                d = np.sqrt(((z - at) ** 2).sum(1))
                spread = d.std(ddof=1)
                got = PLS(2).predict(PLS(2).fit(z, b, np.exp(-d / spread) if spread > 0 else None), at[None])[0]
                last = float(got) if np.isfinite(got) else last
            want[len(rows)] = last
            rows.append((len(rows), key, t, *x, y))
            pending.append([*x, y])
            if len(pending) > 3 and (first := pending.pop(0))[-1] is not None:
                known = [*known, first][-20:]
    df = spark.createDataFrame(rows, "id long, key string, t int, x0 double, x1 double, y double").repartition(3)
    got = {r["id"]: r["estimate"] for r in soft_sensor.estimate(df, "key", ["t"], "id", ["x0", "x1"], "y", most=20).collect()}
    assert len(got) == len(rows) and [got[i] for i in range(len(rows))] == pytest.approx([want[i] for i in range(len(rows))], abs=1e-9)


def test_ensemble_outliers_make_no_row_a_model(spark, monkeypatch):
    """Flags are those of bags drawn and fitted row by row; no table has more rows than the input, repeated and null keys stay."""
    from pyspark.sql import functions as F

    from loomstat.models.base import PLS
    from loomstat.operators import forest, learning, linear

    rows, own = [], learning.keep

    def seen(df, name):
        out = own(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(learning, "keep", seen)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 2))
    y = x @ [2.0, -1.0] + 0.2 * rng.normal(size=200)
    y[:6] += 60
    key = [None, 7, *range(2, 200)]
    df = spark.createDataFrame([(k, *map(float, r), float(t)) for k, r, t in zip(key, x, y)] + [(300, None, 1.0, 2.0)], "id long, a double, b double, y double")
    h = np.array([r[0] for r in df.select(F.xxhash64("id")).collect()][:200])
    flags = np.zeros(200, bool)
    for r in range(4):
        v = np.column_stack([np.ones(200), x, y])[~flags]
        lines = [linear.solve(PLS(2), (v * forest.drawn(h[~flags], b, r)[:, None]).T @ v) for b in range(10)]
        every = np.stack([k[0] + x @ k[1:] for k in lines], 1)
        mid = np.median(every, 1)
        new = np.abs(y - mid) > 3 * 1.4826 * np.median(np.abs(every - np.median(mid)))
        done, flags = (new == flags).all() and r > 0, new
        if done:
            break
    got = learning.ensemble_outliers(df, PLS(2), "id", ["a", "b"], "y", 10, 4).collect()
    want = [(k, bool(o)) for k, o in zip(key, flags)] + [(300, None)]
    assert max(rows) == 201 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and 6 <= flags.sum() < 100


def test_points_of_lattices_are_neither_shuffled_nor_sorted(spark):
    """Points are those of a search of whole boxes, of small, skew, wide and missing lattices; a join of sites moves rows of lattices only."""
    from pyspark.sql import functions as F

    from loomstat.operators import crystals

    rows = [(i, 3 + 0.2 * i, 3.5, 4 + 0.1 * i, 80.0 + i, 95.0 - i, 90.0) for i in range(20)] + [(20, 1.0, 1.2, 1.5, 90.0, 90.0, 90.0), (21, 0.6, 0.5, 0.7, 90.0, 90.0, 90.0), (22, 60.0, 2.0, 3.0, 90.0, 90.0, 100.0), (23, None, 1.0, 1.0, 90.0, 90.0, 90.0), (24, 2.1, 2.6, 2.3, 62.0, 71.0, 65.0)]
    lattices = spark.createDataFrame(rows, "id long, a double, b double, c double, alpha double, beta double, gamma double")
    out = crystals.reciprocal_points(lattices, "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    got = {}
    for r in out.orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["place"], r["h"], r["k"], r["l"], r["g"]))
    for r in lattices.dropna().select("id", "a", "b", "c", *[m.alias(n) for n, m in crystals.reciprocal_metric().items()]).collect():
        h, k, m = (x.ravel() for x in np.meshgrid(*[np.arange(-e, e + 1) for e in (int(np.ceil(r[c] * 1.4)) for c in "abc")], indexing="ij"))
        g = np.sqrt(np.maximum(0, r["g11"] * h * h + r["g22"] * k * k + r["g33"] * m * m + 2 * (r["g12"] * h * k + r["g13"] * h * m + r["g23"] * k * m)))
        inside = g <= (1.297 if (g <= 1.297).sum() >= 60 else 1.4)
        at = [j for j in np.lexsort((-m, -k, -h, abs(h) + abs(k) + abs(m))) if inside[j] and (h[j] or k[j] or m[j])][:59]
        assert [x[:4] for x in got.get(r["id"], [])] == [(p + 1, h[j], k[j], m[j]) for p, j in enumerate(at)]
        assert [x[4] for x in got.get(r["id"], [])] == pytest.approx(g[at], abs=1e-12)
    assert len(got[20]) < 59 and len(got[22]) == 59 and 23 not in got
    sites = spark.createDataFrame([(i, e, None if e == 3 else 0.1 * i, 0.2, 0.3) for i in range(24) for e in (1, 2, 3, 9)] + [(24, 3, None, 0.1, 0.1)], "id long, element int, x double, y double, z double")
    properties = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, None]), (3, [5.0, 5.0])], "element int, p array<double>")
    told = crystals.lattice_features(sites, lattices, properties, "id", 2).orderBy("id", "place").collect()
    assert [tuple(r) for r in told] == [tuple(r) for r in crystals.reciprocal_features(sites, out, properties, "id", 2).orderBy("id", "place").collect()]
    assert len(told) == sum(map(len, got.values()))
    for r in told:
        _, h, k, m, _ = got[r["id"]][r["place"] - 1]
        dot = np.pi * (0.1 * r["id"] * h + 0.2 * k + 0.3 * m)
        assert r["f"] == ([None, None] if r["id"] == 24 else pytest.approx([4 * dot, 2 * dot], abs=1e-9))
