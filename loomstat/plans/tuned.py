"""Queries over variational mixtures, conditional densities and the choice of mixtures and maps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import densities, mixtures, tuning
from ..operators.variational import DISTRIBUTION, PROCESS, fit_variational
from ..registry import query, table
from .generative import _ORDER, _scaled

_XS, _YS = _ORDER[:3], _ORDER[3:]


def _variational(spark: SparkSession, sf_dir: str):
    return fit_variational(_scaled(spark, sf_dir), _ORDER, 6, rounds=25)


@query()
def g11_variational_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _variational(spark, sf_dir).mixture()
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.weights)], "component int, weight double")


@query()
def g11_evidence_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, float(b)) for i, b in enumerate(_variational(spark, sf_dir).history)], "round int, bound double")


@query()
def g11_variational_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixtures.predict(_scaled(spark, sf_dir), _variational(spark, sf_dir).mixture(), "id", _XS, _ORDER)


@query()
def g11_variational_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixtures.predict(_scaled(spark, sf_dir), _variational(spark, sf_dir).mixture(), "id", _YS, _ORDER, rep="mode")


@query()
def g9_tuned_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tuning.grid_of(tuning.MixtureCell, kind=mixtures.KINDS, components=[1, 2, 3], rep=["mean", "mode"])
    return tuning.tune_regression(_scaled(spark, sf_dir), "id", _XS, _YS, cells, rounds=15).table(spark)


@query()
def g9_tuned_variational(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tuning.grid_of(tuning.VariationalCell, kind=["full", "diag"], components=[6], weights=[PROCESS, DISTRIBUTION], concentration=[1e-2, 1.0], rep=["mean", "mode"])
    return tuning.tune_regression(_scaled(spark, sf_dir), "id", _XS, _YS, cells, fold_number=3, rounds=15).table(spark)


_FOLDED = "WITH p AS (SELECT p_partkey % 5 AS fold, p_size::DOUBLE AS x, p_retailprice AS y FROM part), f AS (SELECT DISTINCT fold FROM p)"


@query(_FOLDED + """, m AS (SELECT f.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM f JOIN p ON p.fold <> f.fold GROUP BY f.fold)
SELECT 'full' AS kind, 1 AS components, rep, round(1 - sum(power(y - a * x - b, 2)) / (var_pop(y) * count(*)), 6) AS score FROM p JOIN m USING (fold), (SELECT unnest(['mean', 'mode']) AS rep) GROUP BY rep""")
def g9_single_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 5).cast("int").alias("deal"))
    cells = tuning.grid_of(tuning.MixtureCell, kind=["full"], components=[1], rep=["mean", "mode"])
    found = tuning.tune_regression(df, "id", ["x"], ["y"], cells, rounds=3, fold="deal").table(spark)
    return found.select("kind", F.col("components").cast("int").alias("components"), "rep", F.round("score", 6).alias("score"))


@query()
def g10_tuned_mixture_by_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tuning.grid_of(tuning.MixtureCell, kind=mixtures.KINDS, components=range(1, 7), rep=["mean", "mode"])
    return tuning.tune_regression(_scaled(spark, sf_dir), "id", _XS, _YS, cells, fold_number=3, rounds=10, bayes=True, bayes_rounds=4).table(spark)


@query()
def g20_tuned_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tuning.grid_of(tuning.MapCell, side=[6], bumps=[2, 3], variance=[0.5, 2.0], ridge=[0.0, 0.125], rep=["mean", "mode"])
    return tuning.tune_regression(_scaled(spark, sf_dir), "id", _XS, _YS, cells, fold_number=3, rounds=8).table(spark)


@query()
def g20_map_by_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    df = s.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") / 12.0).alias("nation"), (F.col("s_suppkey") % 7 / 3.0).alias("rest"), (F.col("s_acctbal") / 5000.0).alias("balance"))
    cells = tuning.grid_of(tuning.MapCell, side=[6], bumps=[2, 3], variance=[0.5, 2.0])
    return tuning.tune_map_by_neighbours(df, "id", ["nation", "rest", "balance"], cells, k=5, rounds=6).table(spark)


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, mixtures.Mixture]:
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 25.0).alias("x"), (F.col("p_retailprice") / 500.0).alias("y"))
    return df, mixtures.fit_mixture(df.select(F.array("x", "y").alias("v")), "v", 1, rounds=2)[0]


_LAW = "WITH p AS (SELECT p_partkey, p_size / 25.0 AS x, p_retailprice / 500.0 AS y FROM part), m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b, var_pop(y) * (1 - regr_r2(y, x)) AS s, avg(x) AS mx, var_pop(x) AS sx FROM p)"


@query(f"{_LAW} SELECT p_partkey, round(-0.5 * ln({2 * math.pi} * s) - power(y - a * x - b, 2) / (2 * s), 6) AS log_density FROM p, m")
def g7_output_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, model = _pair(spark, sf_dir)
    return densities.output_density(df, model, "p_partkey", ["x"], ["x", "y"]).select("p_partkey", F.round("log_density", 6).alias("log_density"))


@query(f"{_LAW} SELECT p_partkey, 0 AS component, round(a * x + b, 6) AS mean, round(0.5 * ln({2 * math.pi} * sx) + power(x - mx, 2) / (2 * sx), 6) AS ioe FROM p, m")
def g5_g6_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, model = _pair(spark, sf_dir)
    out = densities.conditional_components(df, model, "p_partkey", ["x"], ["x", "y"])
    return out.select("p_partkey", "component", F.round(F.col("mean")[0], 6).alias("mean"), F.round("ioe", 6).alias("ioe"))
