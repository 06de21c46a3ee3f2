"""Queries over searches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.base import Ridge
from ..operators import kernel_choice, mixtures, search
from ..operators.splits import folds
from ..registry import query, table


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("nation"), (F.col("s_suppkey") % 7).cast("double").alias("rest"), F.col("s_acctbal").alias("y"))


@query()
def r11_d_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.d_optimal_rows(_accounts(spark, sf_dir), "id", ["nation", "rest"])


@query()
def b2_grid_by_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = [Ridge(r) for r in np.logspace(-3, 6, 12)]
    best = search.choose_model(folds(_accounts(spark, sf_dir), "id", 3), grid, np.log10([[g.ridge] for g in grid]), "fold", ["nation", "rest"], "y", 3, 5)
    return spark.createDataFrame([(float(best.ridge),)], "ridge double")


@query()
def b6_preference_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, mu, sd) of all suppliers, scored where they lie; the preferences of the observations (`kernel_choice.MOST` at most) are within groups."""
    df = _accounts(spark, sf_dir)
    x, y = kernel_choice.observations(df, "id", ["nation", "rest"], "y")
    pairs = kernel_choice.preferences(y)
    pairs = pairs[x[pairs[:, 0], 1] == x[pairs[:, 1], 1]]
    p = search.PreferenceProcess(x / [10, 3], pairs)

    def run(batches):
        for pdf in batches:
            mu, sd = p.predict_both(pdf[["nation", "rest"]].to_numpy(float) / [10, 3])
            yield pd.DataFrame({"id": pdf["id"], "mu": mu, "sd": sd})

    return df.select("id", "nation", "rest").mapInPandas(run, "id long, mu double, sd double")


@query()
def f11_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _accounts(spark, sf_dir).withColumn("double", F.col("y") * 2 + F.col("rest"))
    return spark.createDataFrame([(v,) for v in search.select_by_genes(df, ["nation", "rest", "double"], "y", 12, 3)], "variable string")


@query()
def v10_one_class_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, domain) of all suppliers; the support is fitted to at most `kernel_choice.MOST` of them."""
    df = _accounts(spark, sf_dir)
    x, _ = kernel_choice.observations(df, "id", ["nation", "rest"], "y")
    m, state, limit = search.support_domain(x, [0.01, 0.1, 1.0])

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "domain": m.predict(state, pdf[["nation", "rest"]].to_numpy(float)) - limit})

    return df.select("id", "nation", "rest").mapInPandas(run, "id long, domain double")


@query()
def v14_inverse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") - 25) / 15.0).alias("a"), ((F.col("p_partkey") % 7 - 3) / 2.0).alias("b"))
    df = p.withColumn("y", 3 * F.col("a") - 2 * F.col("b"))  # a known generator
    model, _ = mixtures.fit_mixture(df.select(F.array("a", "b", "y").alias("v")), "v", 1, rounds=2)
    back = mixtures.predict(df, model, "id", ["y"], ["a", "b", "y"])
    again = back.join(df.select("id", "y"), "id").withColumn("yhat", 3 * F.col("estimate")[0] - 2 * F.col("estimate")[1])
    return again.agg(F.round(1 - F.sum((F.col("y") - F.col("yhat")) ** 2) / (F.var_pop("y") * F.count("y")), 4).alias("r2"), F.round(F.avg(F.abs(F.col("y") - F.col("yhat"))), 4).alias("mae"))
