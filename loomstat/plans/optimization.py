"""Queries over design of experiments and optimization."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal
from ..operators import optimization as op
from ..operators.kernel_choice import observations
from ..registry import query, table

_MU, _SD = "((p_retailprice - 1000) / 500)::DOUBLE", "(p_size / 25.0)::DOUBLE"
_Z = f"(({_MU} - 0.5 - 0.01) / {_SD})"


def _mu():
    return (F.col("p_retailprice") - 1000) / 500, F.col("p_size") / F.lit(25.0)


@query(f"""SELECT p_partkey, round(({_MU} - 0.5 - 0.01) * {normal.cdf_sql(_Z)} + {_SD} * {normal.pdf_sql(_Z)}, 5) + 0.0 AS ei, round({normal.cdf_sql(_Z)}, 5) + 0.0 AS pi,
round({_MU} + sqrt(ln(2 / 1e-6)) * {_SD}, 5) + 0.0 AS mi, round({normal.cdf_sql(f'((1.0 - {_MU}) / {_SD})')} - {normal.cdf_sql(f'((0.0 - {_MU}) / {_SD})')}, 5) + 0.0 AS ptr FROM part""")
def b1_b3_acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu, sd = _mu()
    score = lambda n, **k: (F.round(op.acquisition(n, mu, sd, **k), 5) + 0.0).alias(n)  # no -0
    return table(spark, sf_dir, "part").select("p_partkey", score("ei", best=0.5), score("pi", best=0.5), score("mi"), score("ptr", low=0.0, high=1.0))


@query(f"""WITH p AS (SELECT p_partkey, {normal.cdf_sql(f'(({_MU} - 0.2) / {_SD})')} AS a, {normal.cdf_sql('((0.8 - 0.5) / (p_size / 50.0))::DOUBLE')} - {normal.cdf_sql('((0.1 - 0.5) / (p_size / 50.0))::DOUBLE')} AS b FROM part)
SELECT p_partkey, CASE WHEN a <= 0 OR b <= 0 THEN -1e100 ELSE round(ln(a) + ln(b), 4) END AS logp FROM p""")
def b4_m19_joint_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu, sd = _mu()
    df = table(spark, sf_dir, "part").withColumns({"mu_a": mu, "sd_a": sd, "mu_b": F.lit(0.5), "sd_b": F.col("p_size") / F.lit(50.0)})
    p = op.joint_log_probability(df, [("a", "max", 0.2, 0.0), ("b", "range", 0.1, 0.8)])
    return df.select("p_partkey", F.when(p == -1e100, p).otherwise(F.round(p, 4)).alias("logp"))


@query()
def b1_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = observations(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_nationkey"], "s_acctbal")
    pool = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("nation"))
    return op.propose(x, y, pool, "c_custkey", ["nation"])


@query()
def b10_batch_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = observations(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_nationkey"], "s_acctbal")
    pool = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    keys = op.propose_batch(x, y, pool, "p_partkey", ["size"], 3)
    return spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "p_partkey long, place int")


@query("""WITH r AS (SELECT month(o_orderdate)::INT AS round, count(*) AS n, max(o_totalprice) AS best FROM orders GROUP BY 1)
SELECT round, n, round(best, 4) AS best, round(max(best) OVER (ORDER BY round), 4) AS best_so_far FROM r""")
def b11_campaign_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.month("o_orderdate").alias("round"), "o_totalprice")
    return op.campaign_progress(df, "round", "o_totalprice").withColumns({c: F.round(c, 4) for c in ("best", "best_so_far")})


@query()
def b12_unmixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pure = np.random.default_rng(3).uniform(0, 1, (4, 64))
    return op.unmix(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", pure, rounds=200)


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, (l_discount >= 0.05)::INT::DOUBLE AS flag, l_quantity AS q, l_tax * 100 AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, flag, round_even(q / (q + t) * 10, 1) AS q, round_even(t / (q + t) * 10, 1) AS t FROM b WHERE round_even(q / (q + t) * 10, 1) BETWEEN 5 AND 9.5""")
def b13_repaired_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.array(F.col("l_discount") * 10, F.col("l_quantity"), F.col("l_tax") * 100)
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))
    out = op.repaired(df, "v", [1.0, 9.5, 10.0], [0.0, 5.0, 0.0], [0], ([1, 2], 10.0), None, None, [None, 1, 1])
    return out.select("l_orderkey", "l_linenumber", F.col("v")[0].alias("flag"), F.col("v")[1].alias("q"), F.col("v")[2].alias("t"))


@query()
def b13_evolved_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, score = op.evolve(lambda v: -float(((v - np.array([0.3, -0.2])) ** 2).sum()), np.array([[-1.0, 1.0], [-1.0, 1.0]]), spark, 30, 5)
    return spark.createDataFrame([(best.tolist(), score)], "x array<double>, score double")
