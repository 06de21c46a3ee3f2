"""Queries over neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import squared_distance
from ..operators import metrics, ranking
from ..operators import neighbours as op
from ..operators.gaps import median_gap
from ..operators.learning import gram_variances
from ..registry import query, table

_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_R = f"WITH {_E}, d AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id), r AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM d), n AS (SELECT * FROM r WHERE rank <= 10)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _near(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    p = _points(spark, sf_dir)
    return op.nearest(p, p, k, "vec_id")


@query(_R + " SELECT i, j, rank, round(d, 6) AS d FROM n")
def w7_v2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select("i", "j", "rank", F.round("d", 6).alias("d"))


@query(f"WITH {_E} SELECT q.vec_id AS i, e.vec_id AS j, round(list_distance(q.v, e.v), 6) AS d FROM e q, e WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, e.v), e.vec_id) <= 5")
def j7_j8_query_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return op.nearest(p.where("vec_id % 50 = 0"), p, 5, "vec_id", skip_self=False).select("i", "j", F.round("d", 6).alias("d"))


@query(_R + " SELECT i, j, rank, round((a.label + b.label) / 2, 4) AS y, round((a.v[1] + b.v[1]) / 2, 6) AS x1, round((a.v[64] + b.v[64]) / 2, 6) AS x64 FROM n JOIN e a ON i = a.vec_id JOIN e b ON j = b.vec_id")
def v3_j10_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.midpoints(_points(spark, sf_dir), _near(spark, sf_dir), "vec_id", "v", "label")
    return out.select("i", "j", "rank", F.round("y", 4).alias("y"), F.round(F.col("v")[0], 6).alias("x1"), F.round(F.col("v")[63], 6).alias("x64"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) x1, CAST(embedding AS DOUBLE[])[1:2] x2 FROM embeddings),
p AS (SELECT a.vec_id i, b.vec_id j, list_distance(a.x1,b.x1) d1, list_distance(a.x2,b.x2) d2r FROM e a CROSS JOIN e b),
z AS (SELECT i, j, d1, CASE WHEN d2r=0 THEN min(CASE WHEN d2r>0 THEN d2r END) OVER (PARTITION BY i) ELSE d2r END d2 FROM p),
n AS (SELECT i, d2, row_number() OVER (PARTITION BY i ORDER BY CASE WHEN i=j THEN 0 ELSE 1 END, d1, j) r1, row_number() OVER (PARTITION BY i ORDER BY d2, j) r2 FROM z),
a AS (SELECT i, d2, row_number() OVER (PARTITION BY i ORDER BY d2) r FROM n WHERE r1 BETWEEN 2 AND 11), b AS (SELECT i, d2, r2-1 r FROM n WHERE r2 BETWEEN 2 AND 11)
SELECT round(sum((a.d2-b.d2)/b.d2)/(SELECT count(*) FROM e)/10,6) AS error FROM a JOIN b USING (i,r)""")
def v9_m7_k3n_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).withColumn("x2", F.slice("v", 1, 2))
    return op.k3n_error(p, "vec_id", "v", "x2", 10).select(F.round("error", 6).alias("error"))


@query(_R + ", s AS (SELECT i, 1 / (avg(d) + 1) AS ad FROM n GROUP BY i) SELECT i AS id, round(ad - (SELECT quantile_cont(ad, 0.01) FROM s), 6) AS domain FROM s")
def v10_knn_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = op.knn_domain(_near(spark, sf_dir), 0.01)
    return out.select("id", F.round("domain", 6).alias("domain"))


@query(_R + """, k AS (SELECT i, max(d) AS kd FROM n GROUP BY i), l AS (SELECT n.i, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN k ON n.j = k.i GROUP BY n.i)
SELECT n.i AS id, round(avg(b.lrd / a.lrd), 6) AS lof FROM n JOIN l a ON n.i = a.i JOIN l b ON n.j = b.i GROUP BY n.i""")
def v10_lof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.local_outlier_factor(_near(spark, sf_dir)).select("id", F.round("lof", 6).alias("lof"))


@query(_R + """, a AS (SELECT k, i, 1 / (avg(d) + 1) AS ad FROM r, (VALUES (1), (5), (10)) g(k) WHERE rank <= k GROUP BY ALL),
c AS (SELECT k, sqrt(avg(power((label - 4.5) * (1 - ad), 2)) OVER (PARTITION BY k ORDER BY ad DESC, i ROWS UNBOUNDED PRECEDING)) AS rmse, row_number() OVER (PARTITION BY k ORDER BY ad DESC, i) AS place FROM a JOIN e ON i = vec_id)
SELECT k, round(sum(rmse), 4) AS area FROM c WHERE place >= 30 GROUP BY k""")
def v11_domain_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, labels = _near(spark, sf_dir), _points(spark, sf_dir).select(F.col("vec_id").alias("i"), "label")
    each = near.withColumn("k", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10)))).where("rank <= k")
    ad = each.groupBy("k", "i").agg((1 / (F.avg("d") + 1)).alias("ad")).join(labels, "i")
    curve = ranking.coverage_curve(ad.withColumn("e", (F.col("label") - 4.5) * (1 - F.col("ad"))), ["k"], "ad", "i", "e")
    return curve.where("place >= 30").groupBy("k").agg(F.round(F.sum("rmse"), 4).alias("area"))


@query(_R + " SELECT a.label AS label, round(avg((a.label = b.label)::INT), 6) AS agreement FROM n JOIN e a ON i = a.vec_id JOIN e b ON j = b.vec_id GROUP BY a.label")
def v12_cluster_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    a, b = p.select(F.col("vec_id").alias("i"), "label"), p.select(F.col("vec_id").alias("j"), F.col("label").alias("other"))
    out = _near(spark, sf_dir).join(a, "i").join(b, "j")
    return out.groupBy("label").agg(F.round(metrics.accuracy(F.col("label"), F.col("other")), 6).alias("agreement"))


@query(_R + " SELECT round(sqrt(sum(power((a.label + b.label) / 2 - 4.5, 2)) / (count(*) - 1)), 6) AS rmse FROM n JOIN e a ON i = a.vec_id JOIN e b ON j = b.vec_id")
def v13_midknn_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = op.midpoints(_points(spark, sf_dir), _near(spark, sf_dir), "vec_id", "v", "label")
    return mid.agg(F.round(F.sqrt(F.sum((F.col("y") - 4.5) ** 2) / (F.count(F.lit(1)) - 1)), 6).alias("rmse"))


@query(_R + " SELECT i, round(avg(b.v[1]), 6) AS x1, round(avg(b.v[2]), 6) AS x2 FROM n JOIN e b ON j = b.vec_id GROUP BY i")
def f8_j11_neighbour_mean_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _points(spark, sf_dir).select(F.col("vec_id").alias("j"), "v")
    return _near(spark, sf_dir).join(b, "j").groupBy("i").agg(F.round(F.avg(F.col("v")[0]), 6).alias("x1"), F.round(F.avg(F.col("v")[1]), 6).alias("x2"))


@query(_R + " SELECT i, j, round(exp(-d / stddev_samp(d) OVER (PARTITION BY i) / 2), 6) AS w FROM n")
def m8_l1_similarity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select("i", "j", F.round(op.similarity(F.col("d"), 2.0, "i"), 6).alias("w"))


@query("""WITH e AS (SELECT s_acctbal / 1000 AS a, s_nationkey / 10.0 AS b FROM supplier), g AS (SELECT unnest([0.01, 0.1, 1.0])::DOUBLE AS gamma), d AS (SELECT power(x.a - y.a, 2) + power(x.b - y.b, 2) AS d2 FROM e x, e y)
SELECT gamma, round(var_samp(exp(-gamma * d2)) * 100, 6) AS variance FROM d, g GROUP BY gamma""")
def a19_l8_gram_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") / 1000).alias("a"), (F.col("s_nationkey") / F.lit(10.0)).cast("double").alias("b"))
    gammas = [0.01, 0.1, 1.0]
    return spark.createDataFrame([(g, round(float(v) * 100, 6)) for g, v in zip(gammas, gram_variances(p, ["a", "b"], gammas, scaled=False))], "gamma double, variance double")


@query(_R + """, s AS (SELECT i, avg(d) AS m FROM n GROUP BY i), t AS (SELECT m FROM s QUALIFY row_number() OVER (ORDER BY m) = (SELECT round_even(count(*) * 0.9, 0) FROM s))
SELECT i AS id FROM s WHERE m <= (SELECT m FROM t)""")
def l7_unlabelled_within_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _near(spark, sf_dir).groupBy(F.col("i").alias("id")).agg(F.avg("d").alias("m"))
    limit = s.orderBy("m", "id").limit(round(s.count() * 0.9)).agg(F.max("m")).first()[0]
    return s.where(F.col("m") <= limit).select("id")


@query("""WITH d AS (SELECT abs(a.s_nationkey - b.s_nationkey) AS n, abs(a.s_acctbal - b.s_acctbal) AS y FROM supplier a, supplier b WHERE a.s_suppkey < b.s_suppkey)
SELECT round(coalesce(median(n) FILTER (n > 0), 1), 4) AS nation, round(coalesce(median(y) FILTER (y > 0), 1), 4) AS balance FROM d""")
def b7_median_length_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    gaps = [median_gap(s, "s_suppkey", c) for c in ("s_nationkey", "s_acctbal")]
    return spark.createDataFrame([tuple(1.0 if g is None else g for g in gaps)], "nation double, balance double").select(F.round("nation", 4).alias("nation"), F.round("balance", 4).alias("balance"))
