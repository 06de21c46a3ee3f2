"""Queries over generative models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mixtures as op
from ..operators import topographic
from ..operators.frame import Autoscaler
from ..registry import query, table

_ORDER = ["quantity", "discount", "tax", "price"]


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("quantity"), F.length("p_name").cast("double").alias("discount"), (F.col("p_partkey") % 7).cast("double").alias("tax"), F.col("p_retailprice").alias("price"))
    return Autoscaler.fit(df, _ORDER, zero_std="one").transform(df)


def _mixture(spark: SparkSession, sf_dir: str, components: int = 2, **kw) -> tuple[op.Mixture, list[float]]:
    return op.fit_mixture(_scaled(spark, sf_dir).select(F.array(*_ORDER).alias("v")), "v", components, rounds=10, **kw)


@query()
def g1_g3_mixture_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _mixture(spark, sf_dir)
    return op.predict(_scaled(spark, sf_dir), model, "id", _ORDER[:3], _ORDER)


@query()
def g4_g8_inverse_true_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _mixture(spark, sf_dir)
    return op.predict(_scaled(spark, sf_dir), model, "id", ["price"], _ORDER, true_mode=True)


@query()
def g12_semi_supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scaled(spark, sf_dir)
    known = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    model, _ = op.fit_semi_supervised(df.where(known), df.where(~known), _ORDER[:3], ["price"], 2, rounds=8)
    return op.predict(df, model, "id", _ORDER[:3], _ORDER)


@query()
def g14_g17_topographic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scaled(spark, sf_dir).select("id", F.array(*_ORDER).alias("v"))
    model, _ = topographic.fit_map(df, "v", (8, 8), (3, 3), rounds=6)
    return topographic.project(df, model, "id", "v")


@query("SELECT i.r::INT AS x, j.r::INT AS y, round(-1 + 2 * i.r / 9.0, 6) AS u, round(1 - 2 * j.r / 4.0, 6) AS v FROM range(10) i(r), range(5) j(r)")
def g15_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = topographic.grid(10, 5)
    return spark.createDataFrame([(k % 10, k // 10, float(u), float(v)) for k, (u, v) in enumerate(g)], "x int, y int, u double, v double").withColumns({c: F.round(c, 6) for c in "uv"})


@query()
def g19_map_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scaled(spark, sf_dir)
    model, _ = topographic.fit_map(df.select(F.array(*_ORDER).alias("v")), "v", (8, 8), (3, 3), rounds=6)
    return op.predict(df, model.as_mixture(), "id", _ORDER[:3], _ORDER)


@query()
def g23_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scaled(spark, sf_dir)
    holes = df.withColumn("price", F.when(F.pmod(F.xxhash64("id"), F.lit(10)) != 0, F.col("price")))
    return op.impute(holes, "id", _ORDER, rounds=2)


@query()
def g24_a20_information_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = _scaled(spark, sf_dir).count(), []
    for kind in op.KINDS:
        for k in (1, 2):
            model, history = _mixture(spark, sf_dir, k, kind=kind)
            bic, aic = op.information(model, history[-1], rows)
            out.append((kind, k, float(bic), float(aic)))
    return spark.createDataFrame(out, "kind string, components int, bic double, aic double")


@query()
def r9_sample_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sample(_mixture(spark, sf_dir)[0], spark, 1000)


_N = "((p_size - 25) / 10.0)::DOUBLE"
_TWO = [(0.4, -1.0, 0.5, 0.8), (0.6, 1.0, 2.0, 1.5)]  # weight, mean of x, mean of y, deviation of x


@query("WITH w AS (SELECT p_partkey, " + ", ".join(f"{w} * exp(-0.5 * power(({_N} - ({m})) / {s}, 2)) / ({s} * {math.sqrt(2 * math.pi)}) AS w{i}" for i, (w, m, _, s) in enumerate(_TWO)) + f" FROM part) SELECT p_partkey, round(w0 / (w0 + w1), 6) AS share, round((w0 * {_TWO[0][2]} + w1 * {_TWO[1][2]}) / (w0 + w1), 6) AS mean, CASE WHEN w0 >= w1 THEN {_TWO[0][2]}::DOUBLE ELSE {_TWO[1][2]}::DOUBLE END AS mode FROM w")
def g3_diagonal_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("p_size") - 25) / F.lit(10.0)
    w = [wt * F.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi)) for wt, m, _, s in _TWO]
    return table(spark, sf_dir, "part").select("p_partkey", F.round(w[0] / (w[0] + w[1]), 6).alias("share"), F.round((w[0] * _TWO[0][2] + w[1] * _TWO[1][2]) / (w[0] + w[1]), 6).alias("mean"), F.when(w[0] >= w[1], _TWO[0][2]).otherwise(_TWO[1][2]).alias("mode"))
