"""Bagged decision trees for classes and numbers, grown level by level on all bags at once.

Variables are binned by quantiles. At each level tasks drop their rows through the trees so far and add up, for every (bag,
node, variable, bin), the number of rows and the sums of the targets; Spark adds these histograms, takes running sums over
bins and picks the best split of each node. Only splits come to the driver, as many as the trees have nodes. A row's weight in a
bag is a Poisson draw from the hash of its key, so that no bag is ever written out.

A class target is one sum a class, a numeric target one sum. The gain of a split is the fall of the Gini impurity or of the
squared error, times the weight of the node: for sums s and weight n, the s^2 / n of both sides less that of the node. Ties go to the first
variable, then the lowest bin.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import keep

#: Numbers of histograms that a task holds at once; more bags take further scans of a level.
HELD = 1 << 23
_CUTS = np.exp(-1) * np.cumsum(1 / np.cumprod(np.concatenate([[1.0], np.arange(1, 12)])))


def drawn(h: np.ndarray, bag: int, seed: int) -> np.ndarray:
    """How often rows of key hash h are in a bag: Poisson of mean 1, by another bijection of 64-bit words a bag."""
    u = h.view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (2 * bag + 1) + 0xD1B54A32D192ED03 * (seed + 1)) % 2**64)
    for _ in range(2):
        u = (u ^ (u >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.searchsorted(_CUTS, ((u ^ (u >> np.uint64(32))) >> np.uint64(11)) * 2.0**-53).astype(float)


@dataclass(frozen=True)
class Forest:
    """Trees as arrays by (bag, node); the root is node 1, the children of i are 2 i and 2 i + 1. variable is -1 at leaves."""

    cols: list[str]
    edges: list[np.ndarray]
    classes: list | None
    variable: np.ndarray
    cut: np.ndarray
    weight: np.ndarray
    sums: np.ndarray
    gains: np.ndarray = field(repr=False)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The bin of each value: how many edges are below it. NaN goes to the last."""
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def nodes(self, bins: np.ndarray, bag: int, levels: int) -> np.ndarray:
        at = np.ones(len(bins), np.int64)
        for _ in range(levels):
            v = self.variable[bag, at]
            go = v >= 0
            at = np.where(go, 2 * at + (bins[np.arange(len(bins)), np.maximum(v, 0)] > self.cut[bag, at]), at)
        return at

    def depth(self) -> int:
        return self.variable.shape[1].bit_length() - 2

    def importances(self) -> dict[str, float]:
        """Each variable's share of the gains of a tree, averaged over the trees that split."""
        total = self.gains.sum(1, keepdims=True)
        share = np.where(total > 0, self.gains / np.where(total > 0, total, 1), 0).sum(0)
        return dict(zip(self.cols, (share / max(share.sum(), 1e-300)).tolist()))


def best_splits(histogram: DataFrame, sums: int, least: float = 1.0) -> DataFrame:
    """(bag, node, variable, bin, gain, n, s, n_left, s_left) of the best split of each node, from histogram(bag, node, variable,
    bin, n, s0, s1, ...). Rows of bins up to `bin` go left; sides lighter than `least` are no split, variable is null without any."""
    names = ["n", *(f"s{i}" for i in range(sums))]
    over = Window.partitionBy("bag", "node", "variable")
    run = histogram.select("bag", "node", "variable", "bin", *[F.sum(c).over(over.orderBy("bin")).alias(f"{c}_left") for c in names], *[F.sum(c).over(over).alias(c) for c in names])
    square = lambda side, n: sum((side(i) * side(i) for i in range(1, sums)), side(0) * side(0)) / n
    col = F.col
    left = square(lambda i: col(f"s{i}_left"), col("n_left"))
    right = square(lambda i: col(f"s{i}") - col(f"s{i}_left"), col("n") - col("n_left"))
    can = (col("n_left") >= least) & (col("n") - col("n_left") >= least)
    gain = F.when(can, left + right - square(lambda i: col(f"s{i}"), col("n")))
    array = lambda side: F.array(*[col(f"s{i}{side}") for i in range(sums)])
    found = run.withColumn("gain", gain).withColumn("gain", F.when(col("gain") > 1e-9 * col("n"), col("gain")))
    row = F.struct("variable", "bin", "gain", "n_left", array("_left").alias("s_left"), "n", array("").alias("s"))
    # without any split the row of the first variable stays, for the totals
    order = F.struct(F.coalesce("gain", F.lit(-1.0)), -col("variable"), -col("bin"))
    best = found.groupBy("bag", "node").agg(F.max_by(row, order).alias("r")).select("bag", "node", "r.*")
    split = lambda c: F.when(col("gain").isNotNull(), col(c)).alias(c)
    return best.select("bag", "node", split("variable"), split("bin"), "gain", "n", "s", split("n_left"), split("s_left"))


def _targets(y: np.ndarray, classes: list | None) -> np.ndarray:
    return y[:, None].astype(float) if classes is None else (y[:, None] == np.arange(len(classes))).astype(float)


def _histogram(rows: DataFrame, forest: Forest, level: int, bags: range, subsets: list[np.ndarray], bootstrap: bool, seed: int) -> DataFrame:
    """Sums of the nodes of one level for some bags, added up in tasks and then by Spark."""
    m = forest.sums.shape[2]
    width, first = 1 << level, 1 << level
    deep = max(len(e) for e in forest.edges) + 1
    p = len(forest.cols)
    sent = rows.sparkSession.sparkContext.broadcast(forest)  # as large as the trees

    def run(batches):
        f = sent.value
        held = np.zeros((len(bags), width * p * deep, 1 + m))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, p).astype(np.int64)
            t = _targets(batch.column("y").to_numpy(zero_copy_only=False), f.classes)
            h = batch.column("h").to_numpy()
            for i, bag in enumerate(bags):
                w = drawn(h, bag, seed) if bootstrap else np.ones(len(h))
                at = f.nodes(bins, bag, level)
                live = np.flatnonzero((at >= first) & (w > 0))
                place = (at[live] - first) * p
                for v in subsets[bag]:
                    key = (place + v) * deep + bins[live, v]
                    held[i, :, 0] += np.bincount(key, w[live], width * p * deep)
                    for k in range(m):
                        held[i, :, 1 + k] += np.bincount(key, w[live] * t[live, k], width * p * deep)
        i, key = np.nonzero(held[:, :, 0])
        found = held[i, key]
        node, rest = np.divmod(key, p * deep)
        said = [np.array(bags)[i] if len(i) else i, node + first, rest // deep, rest % deep]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in said), *(pa.array(found[:, k]) for k in range(1 + m))], names)

    names = ["bag", "node", "variable", "bin", "n", *(f"s{k}" for k in range(m))]
    schema = ", ".join(f"{c} {'long' if c in ('bag', 'node', 'variable', 'bin') else 'double'}" for c in names)
    return rows.mapInArrow(run, schema).groupBy("bag", "node", "variable", "bin").agg(*[F.sum(c).alias(c) for c in names[4:]])


def quantile_edges(df: DataFrame, cols: list[str], bins: int) -> list[np.ndarray]:
    """At most bins - 1 distinct inner quantiles of each variable, in one aggregation; what is above the last edge is the last bin."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return [np.unique(np.array(row[f"q{i}"] or [], float)) for i in range(len(cols))]


def _binned(cols: list[str], edges: list[np.ndarray]) -> Column:
    """The array of bins, by Spark: how many edges are below each value."""
    return F.array(*[sum((F.when(F.col(c) > float(e), 1).otherwise(0) for e in edge), F.lit(0)) for c, edge in zip(cols, edges)])


def subspace(p: int, features: int | float, seed: int, bag: int) -> np.ndarray:
    """The variables of a bag: so many, or that share of p rounded up."""
    n = features if isinstance(features, int) else int(np.ceil(features * p))
    if not 1 <= n <= p:
        raise ValueError(f"{n} of {p} variables")
    return np.sort(np.random.default_rng([seed, bag]).permutation(p)[:n])


def grow_forest(df: DataFrame, key: str, cols: list[str], y: str, bags: int = 100, depth: int = 6, bins: int = 32, features: int | float = 1.0, least: float = 1.0, classify: bool = True, bootstrap: bool = True, seed: int = 0) -> Forest:
    """A forest on the rows without nulls. Classes are the distinct values of y, in descending order; their number is that of the target's sums."""
    clean = df.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(c) for c in cols], F.col(y).alias("y")).dropna()
    classes = sorted((r["y"] for r in clean.select("y").distinct().collect()), reverse=True) if classify else None  # labels
    edges = quantile_edges(clean, cols, bins)
    code = F.coalesce(*[F.when(F.col("y") == c, i) for i, c in enumerate(classes)], F.lit(-1)).cast("double") if classes else F.col("y").cast("double")
    rows = keep(clean.select(_binned(cols, edges).alias("bins"), code.alias("y"), F.xxhash64("k").alias("h")), "binned")
    m = len(classes) if classify else 1
    size = 1 << (depth + 1)
    forest = Forest(cols, edges, classes, np.full((bags, size), -1), np.zeros((bags, size), np.int64), np.zeros((bags, size)), np.zeros((bags, size, max(m, 1))), np.zeros((bags, len(cols))))
    subsets = [subspace(len(cols), features, seed, b) for b in range(bags)]
    deep = max(len(e) for e in edges) + 1
    for level in range(depth):
        at_once = max(1, HELD // ((1 << level) * len(cols) * deep * (1 + m)))
        split = 0
        for a in range(0, bags, at_once):
            some = range(a, min(bags, a + at_once))
            for r in best_splits(_histogram(rows, forest, level, some, subsets, bootstrap, seed), m, least).collect():  # a row a node
                b, i = r["bag"], r["node"]
                forest.weight[b, i], forest.sums[b, i] = r["n"], r["s"]
                if r["gain"] is None:
                    continue
                split += 1
                forest.variable[b, i], forest.cut[b, i] = r["variable"], r["bin"]
                forest.gains[b, r["variable"]] += r["gain"]
                left, whole = np.array([r["n_left"], *r["s_left"]]), np.array([r["n"], *r["s"]])
                for child, side in ((2 * i, left), (2 * i + 1, whole - left)):
                    forest.weight[b, child], forest.sums[b, child] = side[0], side[1:]
        if not split:
            break
    return forest


def predict_forest(df: DataFrame, forest: Forest, key: str) -> DataFrame:
    """Classes: (key, label, votes, probability), arrays in the order of forest.classes, equal votes going to the first (greatest)
    label; within a tree too. Numbers: (key, yhat, std) over the trees, std of the population. Rows with a null go with their other variables, a
    null being above all edges."""
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(forest)
    label = df.sparkSession.createDataFrame([(c,) for c in forest.classes], None).schema[0].dataType.simpleString() if forest.classes else ""

    def run(batches):
        f = sent.value
        bags = len(f.variable)
        for pdf in batches:
            bins = f.bins(pdf[f.cols].to_numpy(float)) if len(pdf) else np.zeros((0, len(f.cols)), np.int64)
            leaf = [f.nodes(bins, b, f.depth()) for b in range(bags)]
            if f.classes:
                votes = np.zeros((len(pdf), len(f.classes)), np.int64)
                for b in range(bags):
                    votes[np.arange(len(pdf)), f.sums[b, leaf[b]].argmax(1)] += 1
                yield pd.DataFrame({"key": pdf["key"], "label": [f.classes[i] for i in votes.argmax(1)], "votes": list(votes), "probability": list(votes / bags)})
            else:
                each = np.stack([f.sums[b, leaf[b], 0] / np.maximum(f.weight[b, leaf[b]], 1e-300) for b in range(bags)], 1)
                yield pd.DataFrame({"key": pdf["key"], "yhat": each.mean(1), "std": each.std(1)})

    schema = f"key {kind}, " + (f"label {label}, votes array<long>, probability array<double>" if forest.classes else "yhat double, std double")
    rows = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in forest.cols])
    return rows.mapInPandas(run, schema).withColumnRenamed("key", key)


def out_of_bag_error(df: DataFrame, forest: Forest, key: str, y: str, seed: int = 0) -> float:
    """The root mean squared error (classes: the share of wrong labels) of rows, each judged by the trees whose bag has not drawn it."""
    sent = df.sparkSession.sparkContext.broadcast(forest)
    rows = df.select(F.xxhash64(key).alias("h"), *[F.col(c).cast("double").alias(c) for c in forest.cols], F.col(y).alias("y")).dropna()

    def run(batches):
        f = sent.value
        bags, total = range(len(f.variable)), np.zeros(2)
        for pdf in batches:
            if not len(pdf):
                continue
            bins, h = f.bins(pdf[f.cols].to_numpy(float)), pdf["h"].to_numpy()
            said, judged = np.zeros((len(pdf), len(f.classes) if f.classes else 1)), np.zeros(len(pdf))
            for b in bags:
                out = drawn(h, b, seed) == 0
                leaf = f.nodes(bins[out], b, f.depth())
                judged[out] += 1
                if f.classes:
                    said[np.flatnonzero(out), f.sums[b, leaf].argmax(1)] += 1
                else:
                    said[out, 0] += f.sums[b, leaf, 0] / np.maximum(f.weight[b, leaf], 1e-300)
            on = judged > 0
            if f.classes:
                wrong = np.array([f.classes[i] for i in said.argmax(1)], object) != pdf["y"].to_numpy(object)
                total += wrong[on].sum(), on.sum()
            else:
                total += ((pdf["y"].to_numpy(float) - said[:, 0] / np.maximum(judged, 1))[on] ** 2).sum(), on.sum()
        yield pd.DataFrame({"error": total[:1], "n": total[1:]})

    s = rows.mapInPandas(run, "error double, n double").agg(F.sum("error").alias("e"), F.sum("n").alias("n")).first()
    share = (s["e"] or 0.0) / max(s["n"] or 0.0, 1.0)
    return float(share if forest.classes else share**0.5)


def importances(df: DataFrame, key: str, cols: list[str], y: str, rates: list[float], bags: int = 100, depth: int = 6, seed: int = 0) -> dict[str, float]:
    """Importances of a forest of numbers, divided by the greatest; the share of variables of a bag is the one with the least out-of-bag error."""
    grown = [grow_forest(df, key, cols, y, bags, depth, features=float(r), classify=False, seed=seed) for r in rates]
    best = min(grown, key=lambda f: out_of_bag_error(df, f, key, y, seed)).importances()
    return {c: v / max(*best.values(), 1e-300) for c, v in best.items()}
