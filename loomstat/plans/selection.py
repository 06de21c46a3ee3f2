"""Queries over variable selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.base import PLS
from ..operators import selection as op
from ..operators.frame import Autoscaler
from ..operators.splits import folds
from ..registry import query, table

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""WITH l AS (SELECT variable, v FROM (SELECT l_linenumber::DOUBLE AS l_linenumber, l_quantity, l_discount FROM lineitem) UNPIVOT (v FOR variable IN (l_linenumber, l_quantity, l_discount))),
c AS (SELECT variable, v, count(*) AS n FROM l GROUP BY ALL) SELECT variable, round(max(n) / sum(n), 6) AS rate FROM c GROUP BY variable""")
def a6_f1_modal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.modal_rates(table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_quantity", "l_discount"]).withColumn("rate", F.round("rate", 6))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(*COLS, (q * 2 + F.col("l_tax")).alias("twice"), (-q + 10 * F.col("l_discount")).alias("minus"))


_WIDE = "w AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_quantity * 2 + l_tax AS twice, -l_quantity + 10 * l_discount AS minus FROM lineitem)"


@query(f"WITH {_WIDE} SELECT * FROM (SELECT 'l_quantity' AS a, 'twice' AS b, (abs(corr(l_quantity, twice)) >= 0.9) AS high FROM w UNION ALL SELECT 'l_quantity', 'minus', abs(corr(l_quantity, minus)) >= 0.9 FROM w UNION ALL SELECT 'twice', 'minus', abs(corr(twice, minus)) >= 0.9 FROM w) WHERE high")
def f2_high_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metrics import correlations

    return correlations(_wide(spark, sf_dir), ["l_quantity", "twice", "minus"]).where(F.abs("r") >= 0.9).select("a", "b", F.lit(True).alias("high"))


@query()
def f2_dropped_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in op.highly_correlated(_wide(spark, sf_dir), [*COLS, "twice", "minus"], 0.95)], "variable string")


@query()
def f3_correlation_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(op.correlation_clusters(_wide(spark, sf_dir), [*COLS, "twice", "minus"], 0.9).items()), "variable string, cluster int")


@query("""SELECT l_orderkey, l_linenumber, round(((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () + (l_tax - avg(l_tax) OVER ()) / stddev_samp(l_tax) OVER ()) / 2, 6) AS cluster_1,
round((l_discount - avg(l_discount) OVER ()) / stddev_samp(l_discount) OVER (), 6) AS cluster_2 FROM lineitem""")
def f4_cluster_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount")
    cols = ["l_quantity", "l_tax", "l_discount"]
    out = op.cluster_means(Autoscaler.fit(df, cols).transform(df), {"l_quantity": 1, "l_tax": 1, "l_discount": 2})
    return out.select("l_orderkey", "l_linenumber", F.round("cluster_1", 6).alias("cluster_1"), F.round("cluster_2", 6).alias("cluster_2"))


@query()
def f5_permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.length("p_name").cast("double").alias("name"), (F.col("p_partkey") % 7).cast("double").alias("rest"), "p_retailprice")
    return op.cvpfi(folds(df, "p_partkey", 5), PLS(2), "p_partkey", "fold", ["size", "name", "rest"], "p_retailprice", repeats=3)


@query()
def f7_local_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x1"), (F.col("p_partkey") % 7).cast("double").alias("x2"))
    return op.lomp(df, PLS(2), ([2.0, -3.0], 1.0), "p_partkey", ["x1", "x2"], [5.0, 1.0], samples=20)
