"""Black-box optimization: acquisitions, candidate choice, spectral unmixing, constrained inverse design, campaign tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import between, cdf, pdf
from ..models.base import GaussianProcess


def acquisition(name: str, mu: Column, sd: Column, best: float = 0.0, low: float = 0.0, high: float = 0.0, cumulative: float = 0.0, xi: float = 0.01, delta: float = 1e-6) -> Column:
    """'mean', 'mi' (mutual information), 'ei', 'pi' or 'ptr' (probability of the target range low..high); 0 where sd is 0."""
    z = (mu - best - xi) / sd
    value = {
        "mean": lambda: mu,
        "mi": lambda: mu + np.sqrt(np.log(2 / delta)) * (F.sqrt(sd**2 + cumulative) - np.sqrt(cumulative)),
        "ei": lambda: (mu - best - xi) * cdf(z) + sd * pdf(z),
        "pi": lambda: cdf(z),
        "ptr": lambda: between((F.lit(low) - mu) / sd, (F.lit(high) - mu) / sd),
    }[name]()
    return value if name == "mean" else F.when(sd > 0, value).otherwise(0.0)


def scored_candidates(x: np.ndarray, y: np.ndarray, candidates: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, mu, sd) of every candidate under a Gaussian process on the (few) observations."""
    gp = GaussianProcess()
    state = gp.fit(x, y)
    kind = candidates.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            mu, sd = gp.predict_both(state, pdf[cols].to_numpy(float))
            yield pd.DataFrame({"key": pdf["key"], "mu": mu, "sd": sd})

    return candidates.select(F.col(key).alias("key"), *cols).mapInPandas(run, f"key {kind}, mu double, sd double").withColumnRenamed("key", key)


def propose(x: np.ndarray, y: np.ndarray, candidates: DataFrame, key: str, cols: list[str], name: str = "ei") -> DataFrame:
    """The candidate with the largest acquisition on autoscaled y; the least key wins a tie."""
    mean, dev = y.mean(), y.std(ddof=1) or 1.0
    z = (y - mean) / dev
    return scored_candidates(x, z, candidates, key, cols).withColumn("score", acquisition(name, F.col("mu"), F.col("sd"), best=float(z.max()))).orderBy(F.desc("score"), key).limit(1)


def propose_batch(x: np.ndarray, y: np.ndarray, candidates: DataFrame, key: str, cols: list[str], n: int, beta: float = 0.3) -> list:
    """Keys of n candidates by upper confidence bound; each chosen one counts as observed at its mean for the next."""
    out = []
    for _ in range(n):
        scored = scored_candidates(x, y, candidates.where(~F.col(key).isin(out)) if out else candidates, key, cols)
        best = scored.withColumn("score", F.col("mu") + np.sqrt(beta) * F.col("sd")).orderBy(F.desc("score"), key).first()
        row = candidates.where(F.col(key) == best[key]).select(*cols).first()
        x, y = np.vstack([x, [float(row[c]) for c in cols]]), np.append(y, best["mu"])
        out.append(best[key])
    return out


def joint_log_probability(df: DataFrame, goals: list[tuple[str, str, float, float]]) -> Column:
    """Sum of log probabilities that each target meets its goal: (name, 'max' | 'min' | 'range', low, high); -1e100 if one cannot."""
    parts = []
    for name, way, low, high in goals:
        mu, sd = F.col(f"mu_{name}"), F.col(f"sd_{name}")
        parts.append({"max": cdf((mu - F.lit(low)) / sd), "min": cdf((F.lit(high) - mu) / sd), "range": between((F.lit(low) - mu) / sd, (F.lit(high) - mu) / sd)}[way])
    total = sum((F.log(p) for p in parts[1:]), F.log(parts[0]))
    bad = parts[0] <= 0
    for p in parts[1:]:
        bad = bad | (p <= 0)
    return F.when(bad, F.lit(-1e100)).otherwise(total)


def on_simplex(v: np.ndarray) -> np.ndarray:
    """For each row the nearest point with parts of at least 0 that add up to 1."""
    rows = np.atleast_2d(v)
    u = np.sort(rows, 1)[:, ::-1]
    c = np.cumsum(u, 1) - 1
    n = np.arange(1, rows.shape[1] + 1)
    k = rows.shape[1] - 1 - (u > c / n)[:, ::-1].argmax(1)
    out = np.maximum(rows - (c[np.arange(len(rows)), k] / (k + 1))[:, None], 0)
    return out if np.ndim(v) > 1 else out[0]


def unmix(mixtures: DataFrame, key: str, vector: str, pure: np.ndarray, rounds: int = 2000) -> DataFrame:
    """(key, fractions, residual): least squares on the simplex by accelerated projected gradient, all spectra of a batch as one
    matrix; a spectrum that moves no more leaves it."""
    kind = mixtures.schema[key].dataType.simpleString()
    gram = pure @ pure.T
    step = 1 / np.linalg.eigvalsh(gram)[-1]

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            target = x @ pure.T
            done = np.full(target.shape, 1 / len(pure))
            live, f, z, t = np.arange(len(x)), done.copy(), done.copy(), 1.0
            for _ in range(rounds):
                new = on_simplex(z - step * (z @ gram - target[live]))
                t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
                z = new + (old - 1) / t * (new - f)
                on = np.abs(new - f).max(1) >= 1e-12
                done[live] = new
                live, f, z = live[on], new[on], z[on]
                if not len(live):
                    break
            yield pd.DataFrame({"key": pdf["key"], "fractions": list(done), "residual": ((x - done @ pure) ** 2).sum(1)})

    return mixtures.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInPandas(run, f"key {kind}, fractions array<double>, residual double").withColumnRenamed("key", key)


def repaired(df: DataFrame, vector: str, upper: list[float], lower: list[float], zero_one: list[int], total: tuple[list[int], float] | None, only_one: tuple[list[int], int] | None, nonzero: tuple[list[int], int] | None, digits: list[int | None]) -> DataFrame:
    """Individuals with their constraints put right: flags to 0 or 1, the first `n` of a group kept, a group's sum, rounding; then those outside their bounds leave."""
    n = len(upper)
    x = [F.col(vector)[i] for i in range(n)]
    for i in zero_one:
        x[i] = F.when(x[i] >= 0.5, 1.0).otherwise(0.0)
    for group in (only_one, nonzero):
        if group:
            at, k = group
            order = [F.struct((-F.abs(x[i])).alias("s"), F.lit(i).alias("i")) for i in at]
            first = F.slice(F.array_sort(F.array(*order)), 1, k)["i"]
            for i in at:
                x[i] = F.when(F.array_contains(first, i), x[i]).otherwise(0.0)
    if total:
        at, s = total
        whole = sum((x[i] for i in at[1:]), x[at[0]])
        for i in at:
            x[i] = F.when(whole != 0, x[i] / whole * s).otherwise(x[i])
    out = df.withColumn(vector, F.array(*[x[i] if digits[i] is None else F.bround(x[i], digits[i]) for i in range(n)]))
    for i in range(n):
        out = out.where((F.col(vector)[i] >= lower[i]) & (F.col(vector)[i] <= upper[i]) | (F.col(vector)[i] == 0))
    return out


def evolve(fitness, bounds: np.ndarray, spark, population: int = 60, generations: int = 10, seed: int = 0) -> tuple[np.ndarray, float]:
    """The best individual found by tournaments, blend crossover and mutation; each generation is scored by tasks."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(bounds[:, 0], bounds[:, 1], (population, len(bounds)))

    def score(batches):
        for pdf in batches:
            yield pd.DataFrame({"i": pdf["i"], "s": [float(fitness(np.asarray(v))) for v in pdf["v"]]})

    def scored(x: np.ndarray) -> np.ndarray:
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>").mapInPandas(score, "i int, s double").orderBy("i").collect()
        return np.array([r["s"] for r in rows])

    s = scored(x)
    for _ in range(generations):
        pick = lambda: x[max(rng.integers(0, population, 3), key=lambda i: s[i])]
        children = []
        for _ in range(population - 1):
            a, b, t = pick(), pick(), rng.uniform(-0.25, 1.25, len(bounds))
            child = a + t * (b - a)
            hit = rng.random(len(bounds)) < 0.1
            child[hit] = rng.uniform(bounds[:, 0], bounds[:, 1])[hit]
            children.append(np.clip(child, bounds[:, 0], bounds[:, 1]))
        x = np.vstack([x[s.argmax()], children])
        s = scored(x)
    return x[s.argmax()], float(s.max())


def campaign_progress(observed: DataFrame, round_col: str, y: str) -> DataFrame:
    """(round, n, best, best_so_far)."""
    r = observed.where(F.col(y).isNotNull()).groupBy(round_col).agg(F.count(F.lit(1)).alias("n"), F.max(y).alias("best"))
    return r.withColumn("best_so_far", F.max("best").over(Window.orderBy(round_col)))  # a row a round
