"""Queries over splitting and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits as op
from ..operators.frame import closed_to, within_box
from ..operators.learning import augmented
from ..registry import query, table


def _hash(c: str):
    return F.pmod(F.col(c) * 1103515245 + 12345, F.lit(2147483648))


@query("SELECT p_partkey, ((row_number() OVER (ORDER BY (p_partkey * 1103515245 + 12345) % 2147483648, p_partkey) - 1) % 5)::INT AS fold FROM part")
def r2_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.folds(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 5, order=[_hash("p_partkey"), F.col("p_partkey")])


@query("SELECT doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 1103515245 + 12345) % 2147483648, doc_id) - 1) % 5)::INT AS fold FROM labels")
def r3_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.folds(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", 5, stratify="quality", order=[_hash("doc_id"), F.col("doc_id")]).drop("quality")


@query("""WITH g AS (SELECT DISTINCT c_nationkey AS n FROM customer), t AS (SELECT n FROM g QUALIFY row_number() OVER (ORDER BY (n::BIGINT * 1103515245 + 12345) % 2147483648, n) <= ceil((SELECT count(*) FROM g) * 0.3))
SELECT c_custkey, c_nationkey IN (SELECT n FROM t) AS test FROM customer""")
def r4_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("n"))
    return op.group_split(df, "n", 0.3, order=[_hash("n"), F.col("n")]).select("c_custkey", "test")


@query()
def r5_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.bootstrap(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 10).groupBy("model").agg(F.sum("weight").alias("drawn"), F.count(F.lit(1)).alias("different"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity / (l_quantity + l_discount + l_tax) AS a, l_discount / (l_quantity + l_discount + l_tax) AS b, l_tax / (l_quantity + l_discount + l_tax) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM b WHERE a BETWEEN 0.5 AND 0.997 AND b BETWEEN 0.0011 AND 1""")
def r10_restricted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("c"))
    out = within_box(closed_to(df, ["a", "b", "c"], 1.0), {"a": (0.5, 0.997), "b": (0.0011, 1.0)})
    return out.withColumns({c: F.round(c, 6) for c in "abc"})


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey * 1103515245 + 12345) % 2147483648, p_partkey) <= 7")
def r12_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.quota(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 7, [_hash("p_partkey"), F.col("p_partkey")])


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), m AS (SELECT p, avg(x) AS m FROM e GROUP BY p)
SELECT vec_id, round(sum((x - m) * (x - m)), 6) AS d2 FROM e JOIN m USING (p) GROUP BY vec_id ORDER BY d2 DESC, vec_id LIMIT 1""")
def r1_first_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.farthest_from_mean(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("d2", F.round("d2", 6))


@query()
def r1_kennard_stone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.kennard_stone(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 30)


@query("""SELECT c_custkey AS id, c_acctbal AS y, c_nationkey::DOUBLE AS x, c_nationkey::DOUBLE AS x_source, 0.0 AS x_target FROM customer UNION ALL
SELECT s_suppkey, s_acctbal, s_nationkey::DOUBLE, 0.0, s_nationkey::DOUBLE FROM supplier""")
def l6_transfer_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("y"), F.col("c_nationkey").cast("double").alias("x"))
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("y"), F.col("s_nationkey").cast("double").alias("x"))
    return augmented(s, t, ["x"])
