"""Queries over metrics and aggregations and scalar functions (M1-M20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal
from ..operators import metrics as op
from ..operators.gaps import quantile
from ..operators.ranks import kendall
from ..registry import query, table

_LINE = """WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_extendedprice AS y, a + b * l_quantity AS yhat FROM lineitem, s)"""


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_extendedprice against its straight line on l_quantity."""
    df = table(spark, sf_dir, "lineitem")
    fit = df.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"), F.regr_intercept("l_extendedprice", "l_quantity").alias("a")).first()
    return df.select("l_orderkey", "l_linenumber", "l_linestatus", F.col("l_extendedprice").alias("y"), (F.lit(fit["a"]) + F.lit(fit["b"]) * F.col("l_quantity")).alias("yhat"))


@query(_LINE + " SELECT round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - yhat) * (y - yhat))) / 1000, 6) AS rmse, round(avg(abs(y - yhat)) / 1000, 6) AS mae FROM p")
def a1_a2_regression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, e = F.col("y"), F.col("yhat")
    return _line(spark, sf_dir).agg(F.round(op.r2(y, e), 6).alias("r2"), F.round(op.rmse(y, e) / 1000, 6).alias("rmse"), F.round(op.mae(y, e) / 1000, 6).alias("mae"))


@query(_LINE + ", t AS (SELECT avg(y) AS m FROM p WHERE l_orderkey % 2 = 0) SELECT round(1 - sum((y - yhat) * (y - yhat)) / sum((y - m) * (y - m)), 6) AS r2p FROM p, t WHERE l_orderkey % 2 = 1")
def a3_r2_training_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _line(spark, sf_dir)
    mean = df.where(F.col("l_orderkey") % 2 == 0).agg(F.avg("y")).first()[0]
    return df.where(F.col("l_orderkey") % 2 == 1).agg(F.round(op.r2(F.col("y"), F.col("yhat"), mean), 6).alias("r2p"))


@query("SELECT round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels")
def a4_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").agg(F.round(op.accuracy(F.col("quality"), F.col("toxic")), 6).alias("accuracy"))


@query("SELECT quality AS actual, count(*) FILTER (toxic = 1) AS \"1\", count(*) FILTER (toxic = 0) AS \"0\" FROM labels GROUP BY quality")
def a5_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labels").select(F.col("quality").alias("actual"), F.col("toxic").alias("pred"))
    return op.confusion(df, "actual", "pred", [1, 0])


@query("SELECT round(median(p_retailprice), 6) AS median, round(1.4826 * mad(p_retailprice), 6) AS mad FROM part")
def a8_median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    mid = df.agg(F.median("p_retailprice")).first()[0]
    return df.agg(F.round(F.median("p_retailprice"), 6).alias("median"), F.round(1.4826 * F.median(F.abs(F.col("p_retailprice") - mid)), 6).alias("mad"))


@query("SELECT o_custkey, round(avg(o_totalprice) / 7, 4) AS mean, round(stddev_pop(o_totalprice) / 7, 4) AS std FROM orders GROUP BY o_custkey")
def a9_ensemble_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice") / 7, 4).alias("mean"), F.round(F.stddev_pop("o_totalprice") / 7, 4).alias("std"))


@query("""WITH v AS (SELECT o_custkey, o_orderstatus AS cls, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, cls AS winner, round(n / sum(n) OVER (PARTITION BY o_custkey), 6) AS probability FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, cls DESC) = 1""")
def a10_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.vote(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")
    return out.withColumn("probability", F.round("probability", 6))


@query("SELECT round(quantile_cont(l_extendedprice, 0.01), 4) AS p01, round(quantile_cont(l_extendedprice, 0.997), 4) AS p997 FROM lineitem")
def a11_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [quantile(table(spark, sf_dir, "lineitem"), "l_extendedprice", p) for p in (0.01, 0.997)]
    return spark.createDataFrame([tuple(found)], "p01 double, p997 double").select(F.round("p01", 4).alias("p01"), F.round("p997", 4).alias("p997"))


@query("SELECT p_brand, round(avg(p_retailprice), 4) AS mean, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) >= 5")
def a12_a13_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("mean"), F.count(F.lit(1)).alias("n")).where("n >= 5")


@query("SELECT lang, count(*) FILTER (quality = 1) AS correct, count(*) AS total FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def a14_correct_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return joined.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("correct"), F.count(F.lit(1)).alias("total"))


@query(_LINE + " SELECT l_linestatus, round(avg(abs((y - yhat) / (y + 1e-12))) * 100, 4) AS mape FROM p GROUP BY l_linestatus")
def a15_mape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line(spark, sf_dir).groupBy("l_linestatus").agg(F.round(op.mape(F.col("y"), F.col("yhat")), 4).alias("mape"))


@query("""WITH e AS (SELECT vec_id, label, unnest((embedding::DOUBLE[])[1:8]) AS a, unnest((embedding::DOUBLE[])[9:16]) AS b, unnest(range(8)) AS pos FROM embeddings)
SELECT vec_id, round(avg(abs(a - b)), 6) AS mae FROM e WHERE pos < greatest(label % 8, 1) GROUP BY vec_id""")
def a16_ragged_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = F.col("embedding").cast("array<double>"), F.greatest(F.col("label") % 8, F.lit(1))
    gap = F.zip_with(F.slice(e, F.lit(1), n), F.slice(e, F.lit(9), n), lambda a, b: F.abs(a - b))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / n, 6).alias("mae"))


@query("SELECT user_id, round(avg(CASE WHEN event_id % 5 <> 0 THEN value END), 6) AS mean FROM events GROUP BY user_id")
def a17_finite_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 10 == 5, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(op.finite_mean(x), 6).alias("mean"))


@query("SELECT DISTINCT event_type, user_id FROM events")
def a22_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", "user_id").distinct()


@query("SELECT event_type, metric, value FROM (SELECT event_type, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY event_type) UNPIVOT (value FOR metric IN (mean, low, high))")
def a23_pivot_and_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.round(f("value"), 6).alias(n) for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max))])
    return wide.unpivot("event_type", ["mean", "low", "high"], "metric", "value")


@query(_LINE + " SELECT l_linestatus, (l_linenumber >= 5)::VARCHAR AS subset, round(sqrt(avg((y - yhat) * (y - yhat))) / 1000, 6) AS rmse, round(avg(abs(y - yhat)) / 1000, 6) AS mae, count(*) AS n FROM p GROUP BY ALL")
def a24_metrics_by_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, e = F.col("y"), F.col("yhat")
    by = _line(spark, sf_dir).groupBy("l_linestatus", (F.col("l_linenumber") >= 5).cast("string").alias("subset"))
    return by.agg(F.round(op.rmse(y, e) / 1000, 6).alias("rmse"), F.round(op.mae(y, e) / 1000, 6).alias("mae"), F.count(F.lit(1)).alias("n"))


_X = "((p_size - 25) / 10.0)::DOUBLE"


def _x() -> Column:
    return (F.col("p_size") - 25) / F.lit(10.0)


@query(f"SELECT p_partkey, round({normal.cdf_sql(_X)}, 6) AS cdf, round({normal.pdf_sql(_X)}, 6) AS pdf, round({normal.ppf_sql('((p_size - 0.5) / 51.0)::DOUBLE')}, 6) AS ppf FROM part")
def m1_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(normal.cdf(_x()), 6).alias("cdf"), F.round(normal.pdf(_x()), 6).alias("pdf"), F.round(normal.ppf((F.col("p_size") - 0.5) / 51.0), 6).alias("ppf"))


@query("SELECT vec_id, round(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 6) AS lse FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def m2_logsumexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(normal.logsumexp(F.col("embedding").cast("array<double>")), 6).alias("lse"))


_MOMENTS = """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
s AS (SELECT pos, avg(x) AS m, var_samp(x) AS v FROM e GROUP BY pos)"""


@query(_MOMENTS + " SELECT vec_id, round(sum(-0.5 * ((x - m) * (x - m) / v + ln(2 * pi() * v))), 4) AS logpdf, round(sqrt(sum((x - m) * (x - m) / v)), 6) AS sdist FROM e JOIN s USING (pos) GROUP BY vec_id")
def m3_m4_diagonal_logpdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    s = e.groupBy("pos").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    q = (F.col("x") - F.col("m")) ** 2 / F.col("v")
    both = e.join(F.broadcast(s), "pos")  # a row a variable
    return both.groupBy("vec_id").agg(F.round(F.sum(-0.5 * (q + F.log(2 * F.pi() * F.col("v")))), 4).alias("logpdf"), F.round(F.sqrt(F.sum(q)), 6).alias("sdist"))


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1 :]]
_CORR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM lineitem" for a, b in _PAIRS)


@query(f"SELECT a, b, round(r, 6) AS r FROM ({_CORR_SQL})")
def a7_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.correlations(table(spark, sf_dir, "lineitem"), _CORR_COLS).select("a", "b", F.round("r", 6).alias("r"))


@query(f"""WITH c AS ({_CORR_SQL}), z AS (SELECT a, b, r, ln((1 + r) / (1 - r)) / 2 AS z, 1.9599639845400545 / sqrt(n - 3) AS h FROM c)
SELECT a, b, round(tanh(z - h), 5) AS low, round(tanh(z + h), 5) AS high, round(CASE WHEN tanh(z - h) * tanh(z + h) <= 0 THEN 0 ELSE least(abs(tanh(z - h)), abs(tanh(z + h))) END, 5) AS corrected FROM z""")
def m6_f5_corrected_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = op.correlations(table(spark, sf_dir, "lineitem"), _CORR_COLS)
    low, high = normal.fisher_interval(F.col("r"), F.col("n"), 0.95)
    c = c.withColumns({"low": low, "high": high})
    bound = F.when(F.col("low") * F.col("high") <= 0, 0.0).otherwise(F.least(F.abs("low"), F.abs("high")))
    return c.select("a", "b", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), F.round(bound, 5).alias("corrected"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS pos, len(list_filter(embedding, lambda x: x > 0.05))::INT AS filled FROM embeddings")
def m11_argmax_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.array_position(e, F.array_max(e)) - 1).cast("int").alias("pos"), F.size(F.filter(e, lambda x: x > 0.05)).alias("filled"))


@query("""WITH t AS (SELECT item_id, regexp_extract_all(text, '[a-z]+') AS ts FROM benchmark), o AS (SELECT item_id, unnest(ts) AS tok, generate_subscripts(ts, 1) - 1 AS pos FROM t),
a AS (SELECT tok, row_number() OVER (ORDER BY tok) - 1 AS code FROM (SELECT DISTINCT tok FROM o)) SELECT item_id, pos::INT AS pos, code::INT AS code FROM o JOIN a USING (tok)""")
def m13_symbol_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "benchmark")
    occ = text.select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit("([a-z]+)"))).alias("pos", "tok"))
    return op.symbol_codes(occ, "tok").select("item_id", "pos", "code")


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def m16_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_TAU = """WITH d AS (SELECT s_suppkey AS i, s_nationkey AS x, s_acctbal AS y FROM supplier),
p AS (SELECT sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM d a JOIN d b ON a.i < b.i)
SELECT round(sum(sx * sy) / sqrt(sum(abs(sx)) * sum(abs(sy))), 6) AS tau FROM p"""


@query(_TAU)
def m18_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(kendall(table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal"), 6),)], "tau double")


@query("""WITH g AS (SELECT l_quantity AS x, l_extendedprice AS y, count(*)::HUGEINT AS n FROM lineitem GROUP BY ALL),
x AS (SELECT sum(n * (n - 1) // 2) AS t FROM (SELECT sum(n) AS n FROM g GROUP BY x)), y AS (SELECT sum(n * (n - 1) // 2) AS t FROM (SELECT sum(n) AS n FROM g GROUP BY y)),
b AS (SELECT sum(n * (n - 1) // 2) AS t, sum(n) * (sum(n) - 1) // 2 AS pairs FROM g), k AS (SELECT DISTINCT x AS k FROM g),
o AS (SELECT k, x, n, sum(CASE WHEN x < k THEN n ELSE 0 END) OVER (PARTITION BY k ORDER BY y DESC GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM k, g),
c AS (SELECT sum(n * coalesce(above, 0)) AS c FROM o WHERE x = k)
SELECT round((b.pairs - x.t - y.t + b.t - 2 * c.c)::DOUBLE / sqrt((b.pairs - x.t)::DOUBLE * (b.pairs - y.t)::DOUBLE), 6) AS tau FROM x, y, b, c""")
def m18_kendall_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(kendall(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), 6),)], "tau double")


@query("SELECT l_orderkey, CASE WHEN min(l_discount) <= 0 THEN -1e100 ELSE round(sum(ln(greatest(l_discount, 1e-300))), 6) END AS logp FROM lineitem GROUP BY l_orderkey")
def m19_log_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when(F.min("l_discount") <= 0, F.lit(-1e100)).otherwise(F.round(F.sum(F.log(F.greatest("l_discount", F.lit(1e-300)))), 6)).alias("logp"))


@query("SELECT lang, round(avg(abs(quality - toxic) / greatest(quality, 1) * 100), 4) AS gap, round(avg((quality = toxic)::INT), 6) AS agree FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def m20_structure_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    a, b = F.col("quality"), F.col("toxic")
    return d.groupBy("lang").agg(F.round(F.avg(F.abs(a - b) / F.greatest(a, F.lit(1)) * 100), 4).alias("gap"), F.round(F.avg((a == b).cast("int")), 6).alias("agree"))
