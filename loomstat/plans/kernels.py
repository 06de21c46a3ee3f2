"""Queries over kernels and preference processes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.kernels import Constant, Dot, KernelProcess, Matern, PreferenceFit, RBF, White, usual_kernels
from ..operators import kernel_choice as op
from ..registry import query, table

_COLS = ["nation", "rest"]


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("nation"), (F.col("s_suppkey") % 7).cast("double").alias("rest"), (F.col("s_acctbal") + 900 * (F.col("s_suppkey") % 7)).alias("y"))


@query()
def b5_kernel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = op.observations(_observed(spark, sf_dir), "id", _COLS, "y", 60)
    return op.kernel_scores(spark, usual_kernels((1.0, 1.0)), x, y, 3, "r2")


@query()
def b9_kernel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = op.observations(_observed(spark, sf_dir), "id", _COLS, "y", 60)
    return op.kernel_scores(spark, usual_kernels((1.0, 1.0), False), x, y, 5, "tau")


@query()
def b9_preferred_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten candidates of the greatest Thompson draw of a preference process under the chosen kernel."""
    x, y = op.observations(_observed(spark, sf_dir), "id", _COLS, "y", 60)
    kernel, _, _ = op.choose_kernel(spark, x, y, 3, "tau")
    process, centre, spread = PreferenceFit(kernel), x.mean(0), np.where(x.std(0, ddof=1) > 0, x.std(0, ddof=1), 1.0)
    state = process.fit((x - centre) / spread, op.preferences(y))

    def score(batches):
        for pdf in batches:
            mu, sd = process.predict_both(state, (pdf[_COLS].to_numpy(float) - centre) / spread)
            yield pd.DataFrame({"id": pdf["id"], "mu": mu, "sd": sd})

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_custkey") % 7).cast("double").alias("rest"))
    scored = c.mapInPandas(score, "id long, mu double, sd double").withColumn("draw", op.thompson(F.col("mu"), F.col("sd"), F.col("id"), 3))
    return scored.orderBy(F.desc("draw"), "id").limit(10)


_S = "SELECT s_suppkey AS id, s_nationkey / 12.0 AS a, s_acctbal / 5000.0 AS b FROM supplier"
_N = "SELECT n_nationkey AS node, n_nationkey / 12.0 AS a, (n_nationkey % 7) / 3.0 AS b FROM nation"
_Q = "sqrt(power(u.a - v.a, 2) / 4 + power(u.b - v.b, 2))"


@query(f"WITH s AS ({_S}), n AS ({_N}) SELECT u.id, v.node, round(2 * exp(-(power(u.a - v.a, 2) / 4 + power(u.b - v.b, 2)) / 2), 6) AS gaussian, round(exp(-{_Q}), 6) AS matern_1, round((1 + sqrt(3) * {_Q}) * exp(-sqrt(3) * {_Q}), 6) AS matern_3, round((1 + sqrt(5) * {_Q} + 5 * power({_Q}, 2) / 3) * exp(-sqrt(5) * {_Q}), 6) AS matern_5, round(0.25 + u.a * v.a + u.b * v.b, 6) + 0.0 AS dot FROM s u, n v")
def m5_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernels between all suppliers and one point a nation: a kernel's rows against the few points that a process rests on."""
    n = table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").toPandas()["n_nationkey"].to_numpy()  # 25
    points = np.stack([n / 12.0, n % 7 / 3.0], 1)
    named = {"gaussian": Constant(2.0) * RBF((2.0, 1.0)), "matern_1": Matern((2.0, 1.0), 0.5), "matern_3": Matern((2.0, 1.0), 1.5), "matern_5": Matern((2.0, 1.0), 2.5), "dot": Dot(0.5) + White(0.5)}

    def run(batches):
        for pdf in batches:
            x = pdf[["a", "b"]].to_numpy(float)
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), len(n)), "node": np.tile(n, len(x))} | {k: v.cross(x, points).ravel() for k, v in named.items()})

    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") / 12.0).cast("double").alias("a"), (F.col("s_acctbal") / 5000.0).cast("double").alias("b"))
    out = s.mapInPandas(run, "id long, node long, " + ", ".join(f"{k} double" for k in named))
    return out.withColumns({k: F.round(k, 6) + 0.0 for k in named})


@query()
def b5_process_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, mu, sd) of all customers under a process with scales of each variable, fitted to suppliers by its marginal likelihood."""
    x, y = op.observations(_observed(spark, sf_dir), "id", _COLS, "y", 200)
    process = KernelProcess(Constant() * Matern((1.0, 1.0), 2.5) + White())
    state = process.fit(x, y)

    def run(batches):
        for pdf in batches:
            mu, sd = process.predict_both(state, pdf[_COLS].to_numpy(float))
            yield pd.DataFrame({"id": pdf["id"], "mu": mu, "sd": sd})

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_custkey") % 7).cast("double").alias("rest"))
    return c.mapInPandas(run, "id long, mu double, sd double")


@query("WITH m AS (SELECT max(l_quantity) AS q FROM lineitem), t AS (SELECT count(*) AS ties FROM lineitem, m WHERE l_quantity = q) SELECT q AS quantity, ties, true AS among FROM m, t")
def t2_random_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the rows of greatest quantity, drawn by hash: how many there were, and that it is one of them."""
    df = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    pick = op.best_candidate(df, "l_quantity", "id", 5).first()
    top = df.where(F.col("l_quantity") == pick["l_quantity"])
    return top.agg(F.max("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("ties"), F.bool_or(F.col("id") == pick["id"]).alias("among"))
