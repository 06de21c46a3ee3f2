"""Validation and ensemble learning: linear models come from moments, others fit in tasks, scores are aggregates.

PLS and ridge are fitted on the driver from sums of products that one scan adds up by fold or bag, so no row is copied. For
other estimators a cell (parameters, fold, repeat) gets its rows through a shuffle, fits in its task with the statistics of
its own training rows, and returns predictions. Scores pool the predictions of all folds.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..models.base import PLS, Estimator
from ..tables import keep
from . import linear
from .em import gathered, vectors
from .forest import drawn, subspace
from .gaps import quantile
from .neighbours import BLOCK
from .splits import placed


def scaled_fit(estimator: Estimator, x: np.ndarray, y: np.ndarray) -> tuple[Any, tuple]:
    """Fit on autoscaled rows; a constant variable is divided by 1."""
    mx, sx = x.mean(0), x.std(0, ddof=1)
    my, sy = y.mean(), y.std(ddof=1)
    sx, sy = np.where(sx > 0, sx, 1.0), sy if sy > 0 else 1.0
    return estimator.fit((x - mx) / sx, (y - my) / sy), (mx, sx, my, sy)


def scaled_predict(estimator: Estimator, fitted: tuple[Any, tuple], x: np.ndarray) -> np.ndarray:
    state, (mx, sx, my, sy) = fitted
    return estimator.predict(state, (x - mx) / sx) * sy + my


def pooled_r2(y: np.ndarray, yhat: np.ndarray) -> float:
    return float(1 - ((y - yhat) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def inner_search(candidates: list[Estimator], x: np.ndarray, y: np.ndarray, folds: int, seed: int) -> Estimator:
    """The first candidate with the best pooled r2 over folds, within one task."""
    order = np.random.default_rng(seed).permutation(len(y)) % folds
    scores = []
    for e in candidates:
        out = np.empty(len(y))
        for f in range(folds):
            out[order == f] = scaled_predict(e, scaled_fit(e, x[order != f], y[order != f]), x[order == f])
        scores.append(pooled_r2(y, out))
    return candidates[int(np.argmax(scores))]


def grid_search(df: DataFrame, candidates: list[Estimator], fold: str, cols: list[str], y: str) -> tuple[DataFrame, Estimator]:
    """((candidate, r2) by pooled held-out predictions, the best candidate; the first wins a tie)."""
    spark = df.sparkSession
    if all(isinstance(c, linear.Linear) for c in candidates):
        products = linear.fold_products(df, cols, y, F.col(fold))
        r2 = [linear.pooled_r2(linear.fold_lines(c, products), products) for c in candidates]
        return spark.createDataFrame(list(enumerate(r2)), "candidate int, r2 double"), candidates[int(np.argmax(np.nan_to_num(r2, nan=-1e10)))]
    n = df.agg(F.max(fold)).first()[0] + 1
    cells = spark.createDataFrame([(c, f) for c in range(len(candidates)) for f in range(n)], "candidate int, cell int")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c, f = int(key[0]), int(key[1])
        test = (pdf["fold"] == f).to_numpy()
        x, t = pdf[cols].to_numpy(float), pdf["y"].to_numpy(float)
        got = scaled_predict(candidates[c], scaled_fit(candidates[c], x[~test], t[~test]), x[test])
        return pd.DataFrame({"candidate": c, "y": t[test], "yhat": got})

    rows = df.select(F.col(fold).alias("fold"), *cols, F.col(y).alias("y")).crossJoin(F.broadcast(cells))  # cells: one a fit
    out = rows.groupBy("candidate", "cell").applyInPandas(run, "candidate int, y double, yhat double")
    scores = out.groupBy("candidate").agg((1 - F.sum((F.col("y") - F.col("yhat")) ** 2) / (F.var_pop("y") * F.count("y"))).alias("r2"))
    best = scores.orderBy(F.desc("r2"), "candidate").first()["candidate"]
    return scores, candidates[best]


def double_cross_validation(df: DataFrame, candidates: list[Estimator], key: str, outer: str, cols: list[str], y: str, inner_folds: int = 5, seed: int = 0) -> DataFrame:
    """(key, y, yhat, fold): each outer fold is predicted by a model chosen and fitted on the others."""
    spark = df.sparkSession
    if all(isinstance(c, linear.Linear) for c in candidates):
        return _double_by_moments(df, candidates, key, outer, cols, y, inner_folds, seed)
    cells = spark.createDataFrame([(r[0],) for r in df.select(outer).distinct().collect()], "cell int")
    kind = df.schema[key].dataType.simpleString()

    def run(cell: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        test = (pdf["fold"] == int(cell[0])).to_numpy()
        x, t = pdf[cols].to_numpy(float), pdf["y"].to_numpy(float)
        best = inner_search(candidates, x[~test], t[~test], inner_folds, seed)
        got = scaled_predict(best, scaled_fit(best, x[~test], t[~test]), x[test])
        return pd.DataFrame({"key": pdf["key"].to_numpy()[test], "y": t[test], "yhat": got, "fold": int(cell[0])})

    rows = df.select(F.col(key).alias("key"), F.col(outer).alias("fold"), *cols, F.col(y).alias("y")).crossJoin(F.broadcast(cells))
    return rows.groupBy("cell").applyInPandas(run, f"key {kind}, y double, yhat double, fold int").withColumnRenamed("key", key)


def _double_by_moments(df: DataFrame, candidates: list[linear.Linear], key: str, outer: str, cols: list[str], y: str, inner_folds: int, seed: int) -> DataFrame:
    """One scan for all (outer, inner) folds; inner folds are dealt by the hash of the key."""
    inner = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(inner_folds)).cast("int")
    products = linear.fold_products(df, cols, y, F.col(outer) * inner_folds + inner)
    lines = {}
    for o in sorted({code // inner_folds for code in products}):
        rest = {code: s for code, s in products.items() if code // inner_folds != o}
        if not rest:
            continue
        parts = {i: sum(own) for i in range(inner_folds) if (own := [s for code, s in rest.items() if code % inner_folds == i])}
        r2 = [linear.pooled_r2(linear.fold_lines(c, parts), parts) if len(parts) > 1 else 0.0 for c in candidates]
        lines[o] = linear.solve(candidates[int(np.argmax(np.nan_to_num(r2, nan=-1e10)))], sum(rest.values()))
    told = linear.predicted(lines, F.col(outer), cols)
    return df.select(F.col(key), F.col(y).cast("double").alias("y"), told.alias("yhat"), F.col(outer).cast("int").alias("fold"))


def y_randomization(df: DataFrame, candidates: list[Estimator], key: str, cols: list[str], y: str, repeats: int = 30, seed: int = 0, folds: int = 5) -> DataFrame:
    """(repeat, mae, r2) of models fitted to permuted targets; repeat -1 is the true target."""
    if all(isinstance(c, linear.Linear) for c in candidates):
        return _randomized_by_moments(df, candidates, key, cols, y, repeats, seed, folds)
    cells = df.sparkSession.range(-1, repeats).select(F.col("id").cast("int").alias("repeat"))

    def run(cell: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        r, x, t = int(cell[0]), pdf[cols].to_numpy(float), pdf["y"].to_numpy(float)
        if r >= 0:
            t = np.random.default_rng([seed, r]).permutation(t)
        best = candidates[0] if len(candidates) == 1 else inner_search(candidates, x, t, folds, seed)
        got = scaled_predict(best, scaled_fit(best, x, t), x)
        return pd.DataFrame({"repeat": [r], "mae": [np.abs(t - got).mean()], "r2": [pooled_r2(t, got)]})

    rows = df.select(F.col(key).alias("key"), *cols, F.col(y).alias("y")).crossJoin(F.broadcast(cells))
    return rows.groupBy("repeat").applyInPandas(run, "repeat int, mae double, r2 double")


def permuted_targets(df: DataFrame, key: str, cols: list[str], y: str, repeats: int, seed: int) -> DataFrame:
    """(repeat, place, cols, y): the rows with their own targets (repeat -1), and once for each repeat with all targets in a random order.

    A row has one place by the hash of its key; in a repeat it takes the target whose row has that place by another hash. One
    sort places the targets of all repeats.
    """
    own = placed(df.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("double").alias("y")).dropna(), [F.xxhash64("k"), F.col("k")])
    n = own.count()
    drawn = own.select("k", "y", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    drawn = placed(drawn, [F.col("repeat"), F.xxhash64(F.lit(seed), "repeat", "k"), F.col("k")], "turn")
    moved = drawn.select("repeat", (F.col("turn") - F.col("repeat") * n).alias("place"), "y")
    true = own.select(F.lit(-1).alias("repeat"), "place", *cols, "y")
    return true.unionByName(own.select("place", *cols).join(moved, "place").select("repeat", "place", *cols, "y"))


@dataclass(frozen=True)
class _AbsoluteErrors:
    """The sum of absolute errors of a line on the rows of a fold."""

    line: np.ndarray
    fold: int
    inside: bool = True

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.array([np.abs(x[:, -1] - self.line[0] - x[:, :-1] @ self.line[1:]).sum()])


def _randomized_by_moments(df: DataFrame, candidates: list[linear.Linear], key: str, cols: list[str], y: str, repeats: int, seed: int, inner: int) -> DataFrame:
    """All repeats in one scan of moments and one of absolute errors; a candidate is chosen over inner folds dealt by place."""
    rows = permuted_targets(df, key, cols, y, repeats, seed)
    code = (F.col("repeat") + 1) * inner + F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(inner))
    table = vectors(rows, [*cols, "y"], code)
    products = linear.products_of(table)
    lines, r2 = {}, {}
    for r in range(-1, repeats):
        parts = {i: products[c] for i in range(inner) if (c := (r + 1) * inner + i) in products}
        if not parts:
            continue
        scores = [linear.pooled_r2(linear.fold_lines(c, parts), parts) if len(candidates) > 1 and len(parts) > 1 else 0.0 for c in candidates]
        lines[r] = linear.solve(candidates[int(np.argmax(np.nan_to_num(scores, nan=-1e10)))], sum(parts.values()))
        r2[r] = linear.pooled_r2({0: lines[r]}, {0: sum(parts.values())})
    errors = gathered(table, {c: _AbsoluteErrors(lines[c // inner - 1], c) for c in products})
    out = []
    for r in lines:
        own = [c for c in products if c // inner - 1 == r]
        out.append((r, float(sum(errors[c][0] for c in own) / sum(products[c][0, 0] for c in own)), r2[r]))
    return df.sparkSession.createDataFrame(out, "repeat int, mae double, r2 double")


def mae_cce(df: DataFrame, candidates: list[Estimator], key: str, cols: list[str], y: str, repeats: int = 30, seed: int = 0) -> DataFrame:
    """(repeat, mae_cce): error of the model, plus that of the mean, less that of a model of permuted targets."""
    scores = y_randomization(df, candidates, key, cols, y, repeats, seed)
    mean = df.agg(F.avg(y)).first()[0]
    mean_error = df.agg(F.avg(F.abs(F.col(y) - mean))).first()[0]
    true = scores.where("repeat < 0").first()["mae"]
    return scores.where("repeat >= 0").select("repeat", (F.lit(true) + F.lit(mean_error) - F.col("mae")).alias("mae_cce"))


def bagging(train: DataFrame, test: DataFrame, estimator: Estimator, key: str, cols: list[str], y: str, models: int = 100, seed: int = 0, subspace_size: int | float = 1.0) -> DataFrame:
    """(key, model, yhat) of every test row by every bag's model, which sees subspace_size variables (a number, or a share rounded up).

    Linear models come from weighted moments of all bags in one scan; others are one task a bag.
    """
    fits = _fitted_bags(train, estimator, key, cols, y, models, seed, subspace_size)
    kind = test.schema[key].dataType.simpleString()

    def predict(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(float)
            for m, fit in fits.items():
                yield pd.DataFrame({"key": pdf["key"], "model": m, "yhat": fit(x)})

    return test.select(F.col(key).alias("key"), *cols).mapInPandas(predict, f"key {kind}, model int, yhat double").withColumnRenamed("key", key)


def _fitted_bags(train: DataFrame, estimator: Estimator, key: str, cols: list[str], y: str, models: int, seed: int, subspace_size: int | float = 1.0) -> dict[int, Callable[[np.ndarray], np.ndarray]]:
    """For each bag the predictions that its model makes."""
    own = [subspace(len(cols), subspace_size, seed, b) for b in range(models)]
    if isinstance(estimator, linear.Linear):
        lines = {b: linear.solve(estimator, s) for b, s in _bag_products(train, key, cols, y, own, seed).items()}
        return {b: lambda x, b=b: lines[b][0] + x[:, own[b]] @ lines[b][1:] for b in lines}
    states = _fit_bags(train, estimator, key, cols, y, models, seed, own)
    return {b: lambda x, b=b: scaled_predict(estimator, pickle.loads(states[b]), x[:, own[b]]) for b in states}


def _bag_products(train: DataFrame, key: str, cols: list[str], y: str, own: list[np.ndarray], seed: int) -> dict[int, np.ndarray]:
    """For each bag the sums of products of (1, its variables, y), rows weighted by how often the bag draws them."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            v = np.column_stack([np.ones(len(pdf)), pdf[[*cols, "y"]].to_numpy(float)])
            h = pdf["h"].to_numpy()
            for b, use in enumerate(own):
                at = v[:, [0, *(use + 1), v.shape[1] - 1]]
                s = (at * drawn(h, b, seed)[:, None]).T @ at
                total[b] = total[b] + s if b in total else s
        yield pd.DataFrame({"bag": list(total), "s": [s.tobytes() for s in total.values()]})

    def add(bag: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bag": [bag[0]], "s": [sum(np.frombuffer(s) for s in pdf["s"]).tobytes()]})

    rows = train.select(F.xxhash64(key).alias("h"), *[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("double").alias("y")).dropna()
    found = rows.mapInPandas(run, "bag long, s binary").groupBy("bag").applyInPandas(add, "bag long, s binary").collect()  # one matrix a bag
    return {r["bag"]: np.frombuffer(r["s"]).reshape(len(own[r["bag"]]) + 2, -1) for r in found}


def _fit_bags(train: DataFrame, estimator: Estimator, key: str, cols: list[str], y: str, models: int, seed: int, own: list[np.ndarray]) -> dict[int, bytes]:
    from .splits import bootstrap

    bags = bootstrap(train.select(key), key, models, seed)
    rows = bags.join(train.select(key, *cols, y), key).select("model", "weight", *cols, F.col(y).alias("y"))

    def fit(cell: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*cols, "y"]).loc[lambda d: d.index.repeat(d["weight"])]
        fitted = scaled_fit(estimator, pdf[cols].to_numpy(float)[:, own[int(cell[0])]], pdf["y"].to_numpy(float))
        return pd.DataFrame({"model": [int(cell[0])], "state": [pickle.dumps(fitted)]})

    return {r["model"]: r["state"] for r in rows.groupBy("model").applyInPandas(fit, "model int, state binary").collect()}  # models


def combine(predictions: DataFrame, key: str, robust: bool = True) -> DataFrame:
    """(key, yhat, std): median and 1.4826 MAD of the models, or mean and population deviation."""
    if not robust:
        return predictions.groupBy(key).agg(F.avg("yhat").alias("yhat"), F.stddev_pop("yhat").alias("std"))
    mid = predictions.groupBy(key).agg(F.median("yhat").alias("m"))
    return predictions.join(mid, key).groupBy(key).agg(F.first("m").alias("yhat"), (1.4826 * F.median(F.abs(F.col("yhat") - F.col("m")))).alias("std"))


def outlier_flags(df: DataFrame, key: str, y: str, yhat: str) -> DataFrame:
    """(key, outlier): |y - estimate| above 3 times 1.4826 MAD of the estimates about their median (one number for all)."""
    mid = quantile(df, yhat, 0.5)
    spread = 1.4826 * quantile(df.select(F.abs(F.col(yhat) - mid).alias("gap")), "gap", 0.5)
    return df.select(key, (F.abs(F.col(y) - F.col(yhat)) > 3 * spread).alias("outlier"))


def ensemble_outliers(df: DataFrame, estimator: Estimator, key: str, cols: list[str], y: str, models: int = 100, rounds: int = 30, seed: int = 0) -> DataFrame:
    """(key, outlier): bag on the rows that are no outliers, flag anew, until the flags repeat.

    A row keeps its flag and carries the estimates of all models, so a round shuffles no rows; medians of all rows are found by counting.
    """
    rows = keep(df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in cols], F.col(y).alias("y"), F.lit(None).cast("boolean").alias("outlier")), "rows")
    names = rows.columns
    for r in range(rounds):
        fits = _fitted_bags(rows.where(~F.coalesce("outlier", F.lit(False))), estimator, "key", cols, "y", models, seed + r)

        def estimated(batches, fits=fits):
            for b in batches:
                x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols])
                yhat = np.stack([fit(x) for fit in fits.values()], 1)
                n, rise, at = (~np.isnan(yhat)).sum(1), np.sort(yhat, 1), np.arange(len(yhat))  # without a number there is no estimate
                mid = np.where(n > 0, (rise[at, (n - 1) // 2] + rise[at, n // 2]) / 2, np.nan)
                every = pa.ListArray.from_arrays(np.arange(len(yhat) + 1, dtype=np.int32) * yhat.shape[1], pa.array(yhat.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mid, from_pandas=True), every], [*names, "m", "yhat"])

        told = keep(rows.mapInArrow(estimated, StructType([*rows.schema, StructField("m", DoubleType()), StructField("yhat", ArrayType(DoubleType()))])), "bagged")
        middle = quantile(told, "m", 0.5)
        spread = 1.4826 * quantile(told.select(F.explode("yhat").alias("v")).select(F.abs(F.col("v") - middle).alias("gap")), "gap", 0.5)
        found = keep(told.select(*names[:-1], (F.abs(F.col("y") - F.col("m")) > 3 * spread).alias("outlier"), F.col("outlier").alias("before")), "outliers")
        rows = found.drop("before")
        if r and found.where("outlier <> before").isEmpty():
            break
    return rows.select(F.col("key").alias(key), "outlier")


def augmented(source: DataFrame, target: DataFrame, cols: list[str]) -> DataFrame:
    """Transfer by features: source rows carry [x, x, 0], target rows [x, 0, x]."""
    zero = F.lit(0.0)
    s = source.withColumns({f"{c}_source": F.col(c) for c in cols} | {f"{c}_target": zero for c in cols})
    t = target.withColumns({f"{c}_source": zero for c in cols} | {f"{c}_target": F.col(c) for c in cols})
    return s.unionByName(t)


def locally_weighted_pls(train: tuple[np.ndarray, np.ndarray], queries: DataFrame, key: str, cols: list[str], components: int = 2, lam: float = 1.0) -> DataFrame:
    """(key, yhat): for each query, PLS weighted by exp(-d / std(d) / lambda); the mean of y where that fails.

    train is the bounded database of a just-in-time model; queries stay distributed.
    """
    x, y = train
    kind = queries.schema[key].dataType.simpleString()
    model = PLS(components)

    def run(batches):
        for pdf in batches:
            out = []
            for q in pdf[cols].to_numpy(float):
                d = np.sqrt(((x - q) ** 2).sum(1))
                spread = d.std(ddof=1)
                w = np.exp(-d / spread / lam) if spread > 0 else np.ones(len(d))
                got = model.predict(model.fit(x, y, w), q[None])[0]
                out.append(got if np.isfinite(got) else y.mean())
            yield pd.DataFrame({"key": pdf["key"], "yhat": out})

    return queries.select(F.col(key).alias("key"), *cols).mapInPandas(run, f"key {kind}, yhat double").withColumnRenamed("key", key)


def gram_variances(df: DataFrame, cols: list[str], gammas: list[float], block: int = BLOCK, scaled: bool = True) -> np.ndarray:
    """The variance of all entries of the Gram matrix of the rows, standardized unless told not to, for each gamma.

    Equal rows are one point with a weight; points are dealt to blocks, and a task that compares two blocks returns sums.
    """
    s = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    z = [((F.col(c) - F.lit(s[f"m{i}"])) / F.lit(s[f"s{i}"] or 1.0) if scaled else F.col(c)).alias(f"z{i}") for i, c in enumerate(cols)]
    points = df.groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias("w")).select(*z, "w", F.xxhash64(*cols).alias("deal"))
    b = max(1, -(-points.count() // block))
    own = F.pmod("deal", F.lit(b)).cast("int")
    rows = points.select(*[f"z{i}" for i in range(len(cols))], "w", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("other"))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = int(key[0]), int(key[1])
        side = lambda k: (pdf.loc[pdf["own"] == k, [f"z{i}" for i in range(len(cols))]].to_numpy(float), pdf.loc[pdf["own"] == k, "w"].to_numpy())
        (p, u), (q, v) = side(low), side(high)
        d2 = np.maximum(0, (p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * p @ q.T)
        grams = [np.exp(-g * d2) for g in gammas]
        twice = 1 if low == high else 2
        return pd.DataFrame({"g": range(len(gammas)), "a": [twice * (u @ k @ v) for k in grams], "b": [twice * (u @ (k * k) @ v) for k in grams]})

    sums = rows.groupBy("low", "high").applyInPandas(run, "g int, a double, b double").groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = float(s["n"]) ** 2
    found = {r["g"]: (r["b"] - r["a"] ** 2 / n) / max(n - 1, 1) for r in sums.collect()}  # a number a gamma
    return np.array([found[k] for k in range(len(gammas))])


def tune_svr(df: DataFrame, fold: str, cols: list[str], y: str, make: Callable[..., Estimator], cs: list[float], epsilons: list[float], gammas: list[float]) -> tuple[float, float, float]:
    """(C, epsilon, gamma): gamma by the variance of the Gram matrix of all rows, then epsilon, C and gamma in turn."""
    gamma = gammas[int(np.argmax(gram_variances(df, cols, gammas)))]
    c, epsilon = 3.0, epsilons[0]
    epsilon = grid_search(df, [make(c=c, epsilon=e, gamma=gamma) for e in epsilons], fold, cols, y)[1].epsilon
    c = grid_search(df, [make(c=v, epsilon=epsilon, gamma=gamma) for v in cs], fold, cols, y)[1].c
    gamma = grid_search(df, [make(c=c, epsilon=epsilon, gamma=g) for g in gammas], fold, cols, y)[1].gamma
    return c, epsilon, gamma
