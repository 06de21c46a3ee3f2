"""Queries over scaling, cleaning and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frame as op
from ..registry import query, table


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS l_quantity,
round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), 6) AS l_extendedprice FROM lineitem""")
def p1_autoscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    cols = ["l_quantity", "l_extendedprice"]
    return op.Autoscaler.fit(df, cols).transform(df).withColumns({c: F.round(c, 6) for c in cols})


@query("SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders")
def p2_inverse_autoscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    scaler = op.Autoscaler.fit(df, ["o_totalprice"])
    return scaler.inverse(scaler.transform(df)).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("""SELECT p_partkey, p_size FROM part""")
def p4_drop_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size").withColumn("flat", F.lit(3.5))
    return df.select("p_partkey", *op.varying_columns(df, ["p_size", "flat"]))


@query("""SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / coalesce(nullif(stddev_samp(p_size) OVER (), 0), 1), 6) AS p_size, 0.0::DOUBLE AS flat FROM part""")
def p5_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.lit(3.5).alias("flat"))
    out = op.Autoscaler.fit(df, ["p_size", "flat"], zero_std="one").transform(df)
    return out.select("p_partkey", F.round("p_size", 6).alias("p_size"), "flat")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem""")
def p6_complete_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.try_divide(F.lit(1.0), F.col("l_linenumber") - 1).alias("hole"), F.log(F.col("l_linenumber") - 1).alias("low"))
    return df.select("l_orderkey", "l_linenumber", *op.complete_columns(df, ["l_quantity", "hole", "low"]))


@query("""SELECT column_name AS name FROM (DESCRIBE SELECT * FROM part) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')""")
def p7_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in op.numeric_columns(table(spark, sf_dir, "part"))], "name string")


@query("""SELECT event_id, user_id, value FROM events WHERE NOT (event_id % 7 = 0)""")
def p9_measured_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("y", F.when(F.col("event_id") % 7 == 0, 999.0).otherwise(F.col("value")))
    return df.withColumn("y", F.nullif("y", F.lit(999.0))).where(F.col("y").isNotNull()).select("event_id", "user_id", F.col("y").alias("value"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 AND l_discount BETWEEN 0.02 AND 0.08""")
def p10_box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return op.within_box(df, {"l_quantity": (10.0, 40.0), "l_discount": (0.02, 0.08)})


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity / (l_quantity + l_discount + l_tax) * 100, 6) AS l_quantity,
round(l_discount / (l_quantity + l_discount + l_tax) * 100, 6) AS l_discount, round(l_tax / (l_quantity + l_discount + l_tax) * 100, 6) AS l_tax FROM lineitem""")
def p11_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_quantity", "l_discount", "l_tax"]
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    return op.closed_to(df, cols, 100.0).withColumns({c: F.round(c, 6) for c in cols})


@query("""SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 7.31, 1) AS tenth, round_even(l_extendedprice / 7.31, -2) AS hundred FROM lineitem""")
def p12_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice") / 7.31
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.bround(x, 1).alias("tenth"), F.bround(x, -2).alias("hundred"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT - 1 AS pos FROM embeddings),
s AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM e GROUP BY pos)
SELECT vec_id, pos, round((x - lo) / coalesce(nullif(hi - lo, 0), 1), 6) AS x FROM e JOIN s USING (pos)""")
def p13_minmax_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    s = e.groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # a row an axis
    span = F.coalesce(F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(1.0))
    return e.join(s, "pos").select("vec_id", "pos", F.round((F.col("x") - F.col("lo")) / span, 6).alias("x"))


@query("""SELECT vec_id, len(embedding) + 3 AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings""")
def p14_zero_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), 3))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", padded.alias("v")).select("vec_id", F.size("v").cast("long").alias("n"), F.round(total, 4).alias("total"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x < 0.1 THEN 0 ELSE x END)), 4) AS total FROM embeddings""")
def p15_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x < 0.1, 0.0).otherwise(x))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS c_mktsegment_{s}" for s in _SEGMENTS) + " FROM customer")
def p16_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = op.dummies(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", _SEGMENTS)
    return df.drop("c_mktsegment")


@query("""SELECT p_partkey, round(log10(p_retailprice), 6) AS price, p_size - 1 AS size FROM part""")
def p17_log_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"), (F.col("p_size") - 1).alias("size"))
    low = df.agg(F.min("price").alias("price"), F.min("size").alias("size")).first()
    return df.withColumns({c: F.round(F.log10(c), 6) for c in ("price", "size") if low[c] > 0})


@query("""SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' +'), lambda x: x <> '')))::INT AS n FROM documents""")
def p18_distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " +")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(F.filter(words, lambda x: x != ""))).alias("n"))


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g') AS name FROM pages""")
def p19_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "[^A-Za-z0-9._-]", "_"), "_+", "_").alias("name"))


@query("""SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)', 1) AS word, regexp_extract(p_brand, '([0-9]+)', 1) AS number FROM part""")
def p20_tag_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.struct(F.regexp_extract("p_brand", "([A-Za-z]+)", 1).alias("word"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("number"))
    return table(spark, sf_dir, "part").select("p_partkey", tag.alias("t")).select("p_partkey", "t.*")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN '5' ELSE '1-4' END AS subset FROM orders""")
def p22_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority").startswith("5"), "5").otherwise("1-4").alias("subset"))
