"""Queries over decoded tensors and reconstruction errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table


@query("""WITH e AS (SELECT vec_id, embedding[1:16] AS a, embedding[17:32] AS b FROM embeddings)
SELECT vec_id, (list_position(a, list_max(a)) = list_position(b, list_max(b)))::INT AS same_element, round(list_max(a)::DOUBLE, 5) AS top FROM e""")
def g27_g28_slot_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.slice("embedding", 1, 16), F.slice("embedding", 17, 16)
    same = F.array_position(a, F.array_max(a)) == F.array_position(b, F.array_max(b))
    return table(spark, sf_dir, "embeddings").select("vec_id", same.cast("int").alias("same_element"), F.round(F.array_max(a).cast("double"), 5).alias("top"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding[1:6]::DOUBLE[]) AS a, unnest(embedding[7:12]::DOUBLE[]) AS b FROM embeddings)
SELECT vec_id, round(avg(abs((a - b) / (a + 1e-12))) * 100, 2) AS lattice_mape FROM e GROUP BY vec_id""")
def g28_lattice_mape(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    gap = F.zip_with(F.slice(e, 1, 6), F.slice(e, 7, 6), lambda a, b: F.abs((a - b) / (a + 1e-12)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / 6 * 100, 2).alias("lattice_mape"))


@query("""WITH w AS (SELECT l_orderkey, avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a, avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, pair, round(mae, 6) AS mae FROM w UNPIVOT (mae FOR pair IN (a, n, r))""")
def g29_wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda v: F.avg(F.when(F.col("l_returnflag") == v.upper(), F.col("l_quantity"))).alias(v)
    wide = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(flag("a"), flag("n"), flag("r"))
    return wide.unpivot("l_orderkey", ["a", "n", "r"], "pair", "mae").where(F.col("mae").isNotNull()).withColumn("mae", F.round("mae", 6))
