"""Queries over validation and ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.base import PLS, SVR
from ..operators import learning as op
from ..operators.kernel_choice import observations
from ..operators.splits import folds, group_split
from ..registry import query, table

X = ["size", "name", "brand"]
_Z = ["nation", "rest"]


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of parts: price against size, length of name and brand number."""
    p = table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("double")
    return p.select(F.col("p_partkey").alias("id"), "p_type", F.col("p_size").cast("double").alias("size"), F.length("p_name").cast("double").alias("name"), F.coalesce(brand, F.lit(0.0)).alias("brand"), F.col("p_retailprice").alias("y"))


def _accounts(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    k = side[0]
    return table(spark, sf_dir, side).select(F.col(f"{k}_{'supp' if k == 's' else 'cust'}key").alias("id"), F.col(f"{k}_nationkey").cast("double").alias("nation"), (F.col(f"{k}_{'supp' if k == 's' else 'cust'}key") % 7).cast("double").alias("rest"), F.col(f"{k}_acctbal").alias("y"))


@query()
def v1_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.grid_search(folds(_samples(spark, sf_dir), "id", 5), [PLS(k) for k in (1, 2, 3)], "fold", X, "y")[0]


@query()
def v4_double_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.double_cross_validation(folds(_samples(spark, sf_dir), "id", 5), [PLS(k) for k in (1, 2, 3)], "id", "fold", X, "y")


@query()
def v5_double_cross_validation_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _samples(spark, sf_dir).withColumn("fold", F.pmod(F.xxhash64("p_type"), F.lit(5)).cast("int"))
    return op.double_cross_validation(df, [PLS(k) for k in (1, 2, 3)], "id", "fold", X, "y")


@query()
def v6_v7_y_randomization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.y_randomization(_samples(spark, sf_dir), [PLS(k) for k in (1, 2)], "id", X, "y", repeats=10)


@query()
def v8_mae_cce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.mae_cce(_samples(spark, sf_dir), [PLS(2)], "id", X, "y", repeats=10)


@query()
def l1_l2_locally_weighted_pls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The database of the model is at most 2,000 suppliers, those of least hash."""
    return op.locally_weighted_pls(observations(_accounts(spark, sf_dir, "supplier"), "id", _Z, "y", 2000), _accounts(spark, sf_dir, "customer"), "id", _Z)


@query()
def l3_bagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = group_split(_samples(spark, sf_dir), "p_type", 0.3)
    out = op.bagging(df.where(~F.col("test")), df.where("test"), PLS(2), "id", X, "y", models=20)
    return op.combine(out, "id")


@query("""WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), p AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_extendedprice AS y, a + b * l_quantity AS yhat FROM lineitem, s),
m AS (SELECT median(yhat) AS m FROM p), d AS (SELECT 1.4826 * median(abs(yhat - m)) AS s FROM p, m) SELECT id, abs(y - yhat) > 3 * s AS outlier FROM p, d""")
def l5_outlier_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    f = df.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"), F.regr_intercept("l_extendedprice", "l_quantity").alias("a")).first()
    p = df.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("y"), (F.lit(f["a"]) + F.lit(f["b"]) * F.col("l_quantity")).alias("yhat"))
    return op.outlier_flags(p, "id", "y", "yhat")


@query()
def l5_ensemble_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ensemble_outliers(_samples(spark, sf_dir), PLS(2), "id", X, "y", models=20, rounds=5)


@query()
def l8_svr_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folds(_accounts(spark, sf_dir, "supplier"), "id", 3)
    c, e, g = op.tune_svr(df, "fold", _Z, "y", SVR, [0.5, 2.0, 8.0], [0.01, 0.1], [0.05, 0.2, 0.8])
    return spark.createDataFrame([(float(c), float(e), float(g))], "c double, epsilon double, gamma double")


