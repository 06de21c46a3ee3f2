"""Variable selection and interpretation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import fisher_interval
from ..models.base import Estimator
from . import linear
from .metrics import correlations
from .splits import placed


def modal_rates(df: DataFrame, cols: list[str]) -> DataFrame:
    """(variable, rate): share of rows with the most frequent value; null is no value but counts as a row."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "variable", "value")
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("variable").agg((F.max(F.when(F.col("value").isNotNull(), F.col("n"))) / F.sum("n")).alias("rate"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> np.ndarray:
    """From one aggregation; NaN becomes 0."""
    out, at = np.eye(len(cols)), {c: i for i, c in enumerate(cols)}
    for r in correlations(df, cols).collect():  # a row a pair of variables
        value = r["r"] if r["r"] is not None and np.isfinite(r["r"]) else 0.0
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = value
    return out


def highly_correlated(df: DataFrame, cols: list[str], threshold: float) -> list[str]:
    """The variables to drop: of the pair with the largest |r|, again and again, the one with the larger sum of |r|."""
    r = np.abs(correlation_matrix(df, cols))
    np.fill_diagonal(r, 0)
    dropped = []
    while r.max(initial=0) >= threshold:
        i, j = np.unravel_index(r.argmax(), r.shape)
        out = int(i if r[i].sum() >= r[j].sum() else j)
        dropped.append(cols[out])
        r[out] = r[:, out] = 0
    return dropped


def correlation_clusters(df: DataFrame, cols: list[str], threshold: float) -> dict[str, int]:
    """Complete linkage on 1 / |r|: clusters in which every |r| is at least threshold."""
    r = np.abs(correlation_matrix(df, cols))
    gap = 1 / np.maximum(r, 1e-300)
    groups = [[i] for i in range(len(cols))]
    while len(groups) > 1:
        far = [(max(gap[a, b] for a in x for b in y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j]
        d, i, j = min(far)
        if d > 1 / threshold:
            break
        groups[i] += groups.pop(j)
    return {cols[v]: k for k, g in enumerate(sorted(groups, key=min), 1) for v in g}


def cluster_means(df: DataFrame, clusters: dict[str, int]) -> DataFrame:
    """df with the mean of each cluster's (autoscaled) variables, all clusters included."""
    names = {k: [v for v in clusters if clusters[v] == k] for k in sorted(set(clusters.values()))}
    return df.withColumns({f"cluster_{k}": sum((F.col(v) for v in vs[1:]), F.col(vs[0])) / len(vs) for k, vs in names.items()})


def corrected_correlations(df: DataFrame, cols: list[str], alpha: float, use_bound: bool = True) -> np.ndarray:
    """|r| lowered to the near end of its confidence interval, 0 where that holds 0; alpha 1 gives the identity, 0 plain |r|."""
    out, at = np.eye(len(cols)), {c: i for i, c in enumerate(cols)}
    c = correlations(df, cols)
    if 0 < alpha < 1:
        low, high = fisher_interval(F.greatest(F.least("r", F.lit(1 - 1e-12)), F.lit(-1 + 1e-12)), F.col("n"), alpha)
        c = c.withColumns({"low": low, "high": high})
    for r in c.collect():
        value = 0.0 if alpha >= 1 else abs(r["r"] or 0.0)
        if 0 < alpha < 1 and r["r"] is not None:
            value = 0.0 if r["low"] * r["high"] <= 0 else min(abs(r["low"]), abs(r["high"])) if use_bound else abs(r["r"])
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = value
    return out


def cvpfi(df: DataFrame, estimator: Estimator, key: str, fold: str, cols: list[str], y: str, repeats: int = 5, alpha: float = 0.999, seed: int = 0, use_bound: bool = True) -> DataFrame:
    """(variable, mean, std): loss of r2 when a variable, and what is correlated with it, is drawn anew in held-out folds.

    Correlated columns are drawn with a chance of the corrected |r|. PLS and ridge come from moments of the folds, and what is drawn is joined
    by its place among the rows outside the fold, so no task holds the table. For other estimators the cells (fold, variable,
    repeat) are tasks; each fits its fold's model on the rows outside the fold.
    """
    linked = corrected_correlations(df, cols, alpha, use_bound)
    if isinstance(estimator, linear.Linear):
        return _cvpfi_by_moments(df, estimator, key, fold, cols, y, linked, repeats, seed)
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    spark = df.sparkSession
    cells = spark.createDataFrame([(f, v, r) for f in folds for v in range(-1, len(cols)) for r in range(repeats if v >= 0 else 1)], "cell_fold int, variable int, repeat int")
    rows = df.select(F.col(key).alias("id"), F.col(fold).alias("fold"), *cols, F.col(y).alias("y"))

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f, v, r = (int(x) for x in k)
        pdf = pdf.sort_values("id")
        train, test = pdf[pdf["fold"] != f], pdf[pdf["fold"] == f]
        x, pool = test[cols].to_numpy(float).copy(), train[cols].to_numpy(float)
        rng = np.random.default_rng([seed, f, v + 1, r])
        if v >= 0:
            for c in range(len(cols)):
                drawn = rng.random(len(x)) < linked[v, c]
                x[drawn, c] = rng.choice(pool[:, c], drawn.sum())
        state = estimator.fit(pool, train["y"].to_numpy(float))
        return pd.DataFrame({"variable": v, "repeat": r, "y": test["y"].to_numpy(float), "yhat": estimator.predict(state, x)})

    out = rows.crossJoin(F.broadcast(cells)).groupBy("cell_fold", "variable", "repeat").applyInPandas(run, "variable int, repeat int, y double, yhat double")
    score = out.groupBy("variable", "repeat").agg((1 - F.sum((F.col("y") - F.col("yhat")) ** 2) / (F.var_pop("y") * F.count("y"))).alias("r2"))
    base = score.where("variable < 0").select(F.col("r2").alias("base"))
    names = F.element_at(F.array(*map(F.lit, cols)), F.col("variable") + 1)
    return score.where("variable >= 0").crossJoin(F.broadcast(base)).groupBy(names.alias("variable")).agg(F.avg(F.col("base") - F.col("r2")).alias("mean"), F.stddev_samp(F.col("base") - F.col("r2")).alias("std"))


def _cvpfi_by_moments(df: DataFrame, estimator: linear.Linear, key: str, fold: str, cols: list[str], y: str, linked: np.ndarray, repeats: int, seed: int) -> DataFrame:
    """Rows lie in the order of folds, so those outside a fold are the places before and behind it; a hash draws one of them."""
    names = F.element_at(F.array(*map(F.lit, cols)), F.col("variable") + 1)
    z = [f"z{i}" for i in range(len(cols))]
    rows = df.select(F.col(key).alias("id"), F.col(fold).cast("int").alias("fold"), *[F.col(c).cast("double").alias(i) for c, i in zip(cols, z)], F.col(y).cast("double").alias("y")).dropna(subset=["fold", *z, "y"])
    rows = placed(rows, [F.col("fold"), F.xxhash64(F.lit(seed), "id"), F.col("id")])
    products = linear.fold_products(rows, z, "y", F.col("fold"))
    whole, begin, lines = sum(products.values()), {}, {}
    for f in sorted(products):
        begin[f] = int(sum(products[b][0, 0] for b in begin))
        lines[f] = linear.unscaled(estimator, whole - products[f])
    n = int(whole[0, 0])
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("fold"))
    slope = lambda i: of({f: float(line[i + 1]) for f, line in lines.items()})
    rows = rows.withColumns({"e": F.col("y") - linear.predicted(lines, F.col("fold"), z), "begin": of(begin), "size": of({f: int(p[0, 0]) for f, p in products.items()})})
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(r).alias("repeat"), F.lit(c).alias("c"), F.lit(float(linked[v, c])).alias("chance")) for v in range(len(cols)) for r in range(repeats) for c in range(len(cols)) if linked[v, c] > 0]))
    asked = rows.withColumn("cell", cells).select("*", "cell.*")
    chance = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "place", "variable", "repeat", "c")
    asked = asked.where((F.col("chance") >= 1) | (F.pmod(chance(1), F.lit(1 << 30)) < F.col("chance") * (1 << 30)))
    turn = F.pmod(chance(2), F.lit(n) - F.col("size"))
    pick = lambda f: F.array(*[f(i) for i in range(len(cols))])[F.col("c")]
    asked = asked.select("place", "variable", "repeat", "e", "c", pick(slope).alias("b"), pick(lambda i: F.col(z[i])).alias("own"), (turn + F.when(turn >= F.col("begin"), F.col("size")).otherwise(0)).alias("at"))
    drawn = asked.join(rows.select(F.col("place").alias("at"), F.array(*z).alias("x")), "at")
    moved = drawn.groupBy("place", "variable", "repeat").agg(F.first("e").alias("e"), F.sum(F.col("b") * (F.col("x")[F.col("c")] - F.col("own"))).alias("d"))
    # a row that draws nothing adds nothing to the difference of squares
    spread = whole[-1, -1] - whole[0, -1] ** 2 / n
    loss = moved.groupBy("variable", "repeat").agg((F.sum((F.col("e") - F.col("d")) ** 2 - F.col("e") ** 2) / F.lit(float(spread) if spread > 0 else float("nan"))).alias("loss"))
    none = df.sparkSession.createDataFrame([(v, r, 0.0) for v in range(len(cols)) for r in range(repeats)], "variable int, repeat int, loss double")  # where nothing is drawn
    loss = loss.unionByName(none).groupBy("variable", "repeat").agg(F.sum("loss").alias("loss"))
    return loss.groupBy(names.alias("variable")).agg(F.avg("loss").alias("mean"), F.stddev_samp("loss").alias("std"))


def lomp(df: DataFrame, estimator: Estimator, state: object, key: str, cols: list[str], half_range: list[float], samples: int = 100, seed: int = 0) -> DataFrame:
    """(key, slopes): least-squares slopes of the model over virtual points in a box around each row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for i, row in zip(pdf["key"], pdf[cols].to_numpy(float)):
                rng = np.random.default_rng([seed, abs(int(i))])
                x = row + rng.uniform(-1, 1, (samples, len(cols))) * np.array(half_range)
                y = estimator.predict(state, x)
                out.append(np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0].tolist())
            yield pd.DataFrame({"key": pdf["key"], "slopes": out})

    return df.select(F.col(key).alias("key"), *cols).mapInPandas(run, f"key {kind}, slopes array<double>").withColumnRenamed("key", key)


def kernel_shap(estimator: Estimator, state: object, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Shapley values of one row by weighted least squares over all coalitions of a few variables; they add up to f(x) - E f."""
    n = len(x)
    masks = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    value = np.array([estimator.predict(state, np.where(m, x, background)).mean() for m in masks])
    size = masks.sum(1)
    inner = (size > 0) & (size < n)
    from math import comb

    weight = np.array([(n - 1) / (comb(n, s) * s * (n - s)) for s in size[inner]])
    total = value[-1] - value[0]
    z, t = masks[inner], value[inner] - value[0] - masks[inner][:, -1] * total
    a = z[:, :-1] - z[:, -1:]
    head = np.linalg.lstsq(a * np.sqrt(weight)[:, None], t * np.sqrt(weight), rcond=None)[0] if n > 1 else np.zeros(0)
    return np.append(head, total - head.sum())
