"""Queries over bagged trees, and over linear models that come from moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.base import PLS, Ridge
from ..operators import forest, learning, linear
from ..registry import query, table
from .learning import X, _samples

_BINS = {"quantity": "round(l_quantity / 5)::BIGINT", "discount": "round(l_discount * 100)::BIGINT", "tax": "round(l_tax * 100)::BIGINT"}
_FLAGS = ["R", "N", "A"]


@query(
    "WITH b AS ("
    + " UNION ALL ".join(f"SELECT l_linenumber AS node, {i} AS variable, {sql} AS bin, l_returnflag AS c FROM lineitem" for i, sql in enumerate(_BINS.values()))
    + "), h AS (SELECT node, variable, bin, count(*) AS n, "
    + ", ".join(f"count(*) FILTER (c = '{c}') AS s{i}" for i, c in enumerate(_FLAGS))
    + " FROM b GROUP BY ALL), r AS (SELECT node, variable, bin, "
    + ", ".join(f"sum({c}) OVER (PARTITION BY node, variable ORDER BY bin)::DOUBLE AS {c}_left, sum({c}) OVER (PARTITION BY node, variable)::DOUBLE AS {c}" for c in ("n", "s0", "s1", "s2"))
    + " FROM h), g AS (SELECT *, (s0_left * s0_left + s1_left * s1_left + s2_left * s2_left) / n_left + (power(s0 - s0_left, 2) + power(s1 - s1_left, 2) + power(s2 - s2_left, 2)) / (n - n_left) - (s0 * s0 + s1 * s1 + s2 * s2) / n AS gain FROM r WHERE n_left < n)"
    + " SELECT node, variable, bin, round(gain, 6) AS gain, n::BIGINT AS n, n_left::BIGINT AS n_left FROM g QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, variable, bin) = 1"
)
def l4_best_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level: the best split by class of the rows of each line number."""
    df = table(spark, sf_dir, "lineitem")
    said = [F.round(F.col("l_quantity") / 5).cast("long"), F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long")]
    each = df.select("l_linenumber", "l_returnflag", F.posexplode(F.array(*said)).alias("variable", "bin"))
    sums = [F.sum((F.col("l_returnflag") == c).cast("double")).alias(f"s{i}") for i, c in enumerate(_FLAGS)]
    histogram = each.groupBy(F.lit(0).alias("bag"), F.col("l_linenumber").alias("node"), "variable", "bin").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)
    best = forest.best_splits(histogram, len(_FLAGS))
    return best.select("node", "variable", "bin", F.round("gain", 6).alias("gain"), F.col("n").cast("long").alias("n"), F.col("n_left").cast("long").alias("n_left"))


_LINES = ["quantity", "price", "shipped", "tax"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double").alias("shipped"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("label"))


def _bagged(df: DataFrame) -> forest.Forest:
    return forest.grow_forest(df, "id", _LINES, "label", bags=10, depth=4, bins=16, features=0.75)


@query()
def l4_bagged_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lines(spark, sf_dir)
    return forest.predict_forest(df, _bagged(df), "id")


@query()
def l4_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(_bagged(_lines(spark, sf_dir)).importances().items()), "variable string, importance double")


@query()
def f10_importance_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power of the importances of a forest with which a linear model predicts best, and the r2 of each."""
    df = _samples(spark, sf_dir)
    share = forest.importances(df, "id", X, "y", [0.4, 0.7, 1.0], bags=20, depth=4)
    best, r2 = linear.best_power(df, X, "y", F.pmod(F.xxhash64("id"), F.lit(5)), share, PLS(1), [i / 2 for i in range(7)])
    return spark.createDataFrame([(p, v, p == best) for p, v in r2.items()], "power double, r2 double, best boolean")


_DEAL = "WITH p AS (SELECT p_partkey AS id, p_partkey % 5 AS fold, p_size::DOUBLE AS x, p_retailprice AS y FROM part), f AS (SELECT DISTINCT fold FROM p), m AS (SELECT f.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM f JOIN p ON p.fold <> f.fold GROUP BY f.fold)"


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).cast("int").alias("fold"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


@query(f"{_DEAL} SELECT candidate, round(1 - sum(power(y - a * x - b, 2)) / (var_pop(y) * count(*)), 6) AS r2 FROM p JOIN m USING (fold), (SELECT unnest([0, 1]) AS candidate) GROUP BY candidate")
def v1_linear_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = learning.grid_search(_dealt(spark, sf_dir), [PLS(1), Ridge(0.0)], "fold", ["x"], "y")[0]
    return scores.select("candidate", F.round("r2", 6).alias("r2"))


@query(f"{_DEAL} SELECT id, y, round(a * x + b, 6) AS yhat, fold::INT AS fold FROM p JOIN m USING (fold)")
def v4_linear_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = learning.double_cross_validation(_dealt(spark, sf_dir), [PLS(1), Ridge(0.0)], "id", "fold", ["x"], "y")
    return out.withColumn("yhat", F.round("yhat", 6))
