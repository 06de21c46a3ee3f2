"""Queries over joins, sets (U1-U5) and unions of result files (S7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as op
from ..registry import query, table


@query("SELECT o_orderkey, o_custkey, c_mktsegment, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j1_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j2_unused_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(used, "c_custkey", "left_anti")


@query("WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS batch_order FROM customer QUALIFY batch_order <= 20) SELECT batch_order, c_custkey, c_name FROM p JOIN customer USING (c_custkey)")
def j3_proposals_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    best = c.orderBy(F.desc("c_acctbal"), "c_custkey").select("c_custkey").limit(20)
    first = best.join(c, "c_custkey").withColumn("batch_order", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")))  # 20 rows
    return first.select("batch_order", "c_custkey", "c_name").orderBy("batch_order")


@query("SELECT l_orderkey, l_linenumber, (o_orderkey IS NOT NULL)::INT AS observed FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON l_orderkey = o_orderkey AND l_linenumber = 1")
def j4_mark_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(1).alias("observed"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return rows.join(done, ["l_orderkey", "l_linenumber"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))


@query("SELECT doc_id, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)")
def j5_j6_column_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("""WITH d AS (SELECT s_suppkey AS i, s_nationkey % 5 AS g, s_acctbal AS y FROM supplier)
SELECT a.i AS winner, b.i AS loser FROM d a JOIN d b ON a.g = b.g AND a.y > b.y AND abs(a.y - b.y) > 1e-8 + 1e-5 * abs(b.y)""")
def j9_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_nationkey") % 5).alias("g"), F.col("s_acctbal").alias("y"))
    return op.preference_pairs(df, "i", "g", "y")


@query("SELECT event_id, lag(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS known FROM events")
def j12_delayed_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.lag("value", 3).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("known"))


@query("""WITH a AS (SELECT o_custkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS k FROM orders WHERE o_orderkey % 2 = 0),
b AS (SELECT o_custkey, o_totalprice AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS k FROM orders WHERE o_orderkey % 2 = 1)
SELECT o_custkey, round(avg(abs(x - y)) / 7, 4) AS mae, count(*) AS n FROM a JOIN b USING (o_custkey, k) GROUP BY o_custkey""")
def j14_sorted_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    out = op.sorted_pairing(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "o_totalprice")
    return out.withColumn("mae", F.round(F.col("mae") / 7, 4))


@query("SELECT p_partkey FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size > 48)")
def j15_unseen_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_type").join(p.where("p_size > 48").select("p_type").distinct(), "p_type", "left_anti").select("p_partkey")


@query("SELECT cov, n, rep FROM (VALUES ('full'), ('diag'), ('tied'), ('spherical')) a(cov), range(1, 6) b(n), (VALUES ('mean'), ('mode')) c(rep)")
def j16_parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.parameter_grid(spark, {"cov": ["full", "diag", "tied", "spherical"], "n": [1, 2, 3, 4, 5], "rep": ["mean", "mode"]})


@query("SELECT c_custkey AS id, 'customer' AS side, c_acctbal AS y FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal FROM supplier")
def u1_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("side"), F.col("c_acctbal").alias("y"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("side"), F.col("s_acctbal").alias("y")))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u3_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def u4_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey").subtract(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size > 40")
def u5_used_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return a.union(table(spark, sf_dir, "part").where("p_size > 40").select("p_partkey")).distinct()


@query("SELECT 'customer' AS source, count(*) AS n, round(avg(c_acctbal), 4) AS c_acctbal, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT 'supplier', count(*), NULL, round(avg(s_acctbal), 4) FROM supplier")
def s7_union_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = op.union_of_files(spark, [f"{sf_dir}/customer.parquet", f"{sf_dir}/supplier.parquet", f"{sf_dir}/no_such_run.parquet"], r"/([a-z]+)\.parquet")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("c_acctbal"), F.round(F.avg("s_acctbal"), 4).alias("s_acctbal"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts)::VARCHAR AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x4_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("event_type", F.col("w.start").cast("string").alias("day"), "n", "total")
