"""Queries over windows and sorting (T1-T8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..operators import ranking as op
from ..registry import query, table


@query("""WITH t AS (SELECT user_id, value AS y, avg(value) OVER w AS yhat, lag(value) OVER o AS prev FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(1 - sum(power(y - coalesce(yhat, y), 2)) / nullif(sum(power(y - prev, 2)), 0), 6) AS r2lm FROM t GROUP BY user_id""")
def w1_r2lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, -1)
    df = table(spark, sf_dir, "events").withColumn("est", F.coalesce(F.avg("value").over(before), F.col("value")))
    return op.r2_by_last_value(df, "user_id", ["ts", "event_id"], "value", "est").withColumn("r2lm", F.round("r2lm", 6))


@query("""SELECT event_id, user_id, value, lag(value, 2) OVER w AS value_lag2, lag(value, 4) OVER w AS value_lag4 FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY row_number() OVER w > 4""")
def w2_lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return op.lag_features(df, "user_id", ["ts", "event_id"], ["value"], 2, 4).drop("ts")


@query("""SELECT o_orderkey, round(sqrt(avg(o_totalprice * o_totalprice) OVER w) / 1000, 6) AS rmse, row_number() OVER w AS place FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
def w3_coverage_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.coverage_curve(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey", "o_totalprice")
    return out.select("o_orderkey", F.round(F.col("rmse") / 1000, 6).alias("rmse"), "place")


@query("""WITH r AS (SELECT user_id, date_trunc('day', ts)::DATE::VARCHAR AS day, max(value) AS best FROM events GROUP BY ALL)
SELECT user_id, day, round(max(best) OVER (PARTITION BY user_id ORDER BY day), 6) AS best FROM r""")
def w4_a21_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.max("value").alias("best"))
    return r.withColumn("best", F.round(F.max("best").over(Window.partitionBy("user_id").orderBy("day")), 6))


@query("""WITH m AS (SELECT p_brand, avg(p_retailprice) AS price, avg(p_size) AS size FROM part GROUP BY p_brand)
SELECT p_brand, rank() OVER (ORDER BY round(price, 4)) + rank() OVER (ORDER BY round(size, 4) DESC) AS total FROM m""")
def w5_rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("price"), F.round(F.avg("p_size"), 4).alias("size"))
    total = F.rank().over(Window.orderBy("price")) + F.rank().over(Window.orderBy(F.desc("size")))  # a row a brand
    return m.select("p_brand", total.cast("long").alias("total"))


_RANKED = "SELECT p_partkey, p_type, (rank() OVER (PARTITION BY p_type ORDER BY p_size) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY p_type) AS q FROM part"


@query(f"SELECT p_partkey, round({normal.ppf_sql('least(greatest(q, 1e-6), 1 - 1e-6)::DOUBLE')}, 6) AS score FROM ({_RANKED})")
def w6_b8_normal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("p_type"))
    q = (op.average_rank("p_size", "p_type") - 0.5) / n
    df = table(spark, sf_dir, "part").select("p_partkey", q.alias("q"))
    return df.select("p_partkey", F.round(normal.ppf(F.least(F.greatest("q", F.lit(1e-6)), F.lit(1 - 1e-6))), 6).alias("score"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS slot FROM orders")
def w8_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("slot"))


def _unit_sql(c: str) -> str:
    w = "OVER (PARTITION BY p_brand)"
    return f"CASE WHEN max({c}) {w} > min({c}) {w} THEN ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w})::DOUBLE ELSE 0 END"


@query(f"SELECT p_partkey, round(0.25 * ({_unit_sql('p_size')}) + 0.75 * ({_unit_sql('p_retailprice')}), 6) AS score FROM part")
def w9_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = 0.25 * op.scaled_to_unit("p_size", "p_brand") + 0.75 * op.scaled_to_unit("p_retailprice", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query("""SELECT event_id, last_value(CASE WHEN event_id % 4 <> 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events""")
def w10_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_id") % 4 != 0, F.col("value")), ignorenulls=True).over(w).alias("carried"))


@query("SELECT arg_max(p_partkey, (p_retailprice, -p_partkey)) AS best, arg_min(p_partkey, (p_retailprice, p_partkey)) AS worst FROM part")
def t1_first_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").agg(F.max_by("p_partkey", F.struct(F.col("p_retailprice"), -F.col("p_partkey"))).alias("best"), F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("worst"))


@query("(SELECT 'low' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10) UNION ALL (SELECT 'high', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)")
def t3_smallest_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    side = lambda name, key: df.orderBy(key, "o_orderkey").limit(10).select(F.lit(name).alias("side"), "*")
    return side("low", F.asc("o_totalprice")).unionByName(side("high", F.desc("o_totalprice")))


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size, p_partkey) <= 10")
def t4_top_per_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    return op.top_rows(df, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_size"), F.asc("p_partkey")], 10).drop("p_size")


def _order_statistic(spark: SparkSession, sf_dir: str, share: float, down: bool) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_retailprice")
    k = round(df.count() * share)
    if not k:
        return spark.createDataFrame([(0.0,)], "threshold double")
    return df.orderBy(F.desc("p_retailprice") if down else "p_retailprice").limit(k).agg((F.min if down else F.max)("p_retailprice").alias("threshold"))


@query("SELECT p_retailprice AS threshold FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice) = (SELECT round_even(count(*) * 0.05, 0) FROM part)")
def t5_order_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_statistic(spark, sf_dir, 0.05, False)


@query("SELECT p_retailprice AS threshold FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice DESC) = (SELECT round_even(count(*) * 0.003, 0) FROM part)")
def t7_descending_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_statistic(spark, sf_dir, 0.003, True)


@query("""SELECT h, k, l FROM (SELECT a.r - 3 AS h, b.r - 3 AS k, c.r - 3 AS l FROM range(7) a(r), range(7) b(r), range(7) c(r))
ORDER BY abs(h) + abs(k) + abs(l), h DESC, k DESC, l DESC LIMIT 59""")
def t6_index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = lambda n: F.explode(F.sequence(F.lit(-3).cast("long"), F.lit(3).cast("long"))).alias(n)
    grid = spark.range(1).select(axis("h")).select("h", axis("k")).select("h", "k", axis("l"))
    return grid.orderBy(F.abs("h") + F.abs("k") + F.abs("l"), F.desc("h"), F.desc("k"), F.desc("l")).limit(59)


@query("""WITH m AS (SELECT p_brand, round(avg(p_retailprice), 4) AS price, round(avg(p_size), 4) AS size FROM part GROUP BY p_brand),
l AS (SELECT p_brand, metric, v FROM m UNPIVOT (v FOR metric IN (price, size)))
SELECT metric, p_brand, v FROM l QUALIFY row_number() OVER (PARTITION BY metric ORDER BY CASE metric WHEN 'price' THEN -v ELSE v END, p_brand) = 1""")
def t8_best_per_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("price"), F.round(F.avg("p_size"), 4).alias("size"))
    long = m.unpivot("p_brand", ["price", "size"], "metric", "v")
    way = F.when(F.col("metric") == "price", -F.col("v")).otherwise(F.col("v"))
    return op.top_rows(long, ["metric"], [way, F.asc("p_brand")], 1).select("metric", "p_brand", "v")
