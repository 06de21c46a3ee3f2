"""Queries over reduced spaces, map analysis, crystals as tables and inverse design."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crystals, map_analysis, mixtures, topographic
from ..operators.em import vectors
from ..operators.inverse_design import Constraints, design
from ..operators.semi_supervised import fit_reduced, principal_axes
from ..registry import query, table
from .generative import _ORDER, _scaled

_SUPPLIERS = "SELECT s_suppkey AS id, s_nationkey::DOUBLE AS a, (s_suppkey % 7)::DOUBLE AS b, s_acctbal AS y FROM supplier"
_CUSTOMERS = "SELECT c_custkey AS id, c_nationkey::DOUBLE AS a, (c_custkey % 7)::DOUBLE AS b FROM customer"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    two = lambda k: [F.col(f"{k}nationkey").cast("double").alias("a")]
    return (
        s.select(F.col("s_suppkey").alias("id"), *two("s_"), (F.col("s_suppkey") % 7).cast("double").alias("b"), F.col("s_acctbal").alias("y")),
        c.select(F.col("c_custkey").alias("id"), *two("c_"), (F.col("c_custkey") % 7).cast("double").alias("b")),
    )


@query(f"""WITH s AS ({_SUPPLIERS}), c AS ({_CUSTOMERS}), u AS (SELECT a, b FROM s UNION ALL SELECT a, b FROM c),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_samp(a) AS sa, stddev_samp(b) AS sb, sign(corr(a, b)) AS k FROM u),
z AS (SELECT id, y, ((a - ma) / sa + k * (b - mb) / sb) / sqrt(2) AS t FROM s, m), f AS (SELECT regr_slope(y, t) AS g, regr_intercept(y, t) AS h FROM z)
SELECT id, round(h + g * ((a - ma) / sa + k * (b - mb) / sb) / sqrt(2), 6) AS yhat FROM c, m, f""")
def l7_reduced_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One component of suppliers and customers together, a line on the suppliers, predictions of the customers."""
    known, new = _sides(spark, sf_dir)
    return new.select("id", F.round(fit_reduced(known, new, ["a", "b"], "y", 1).predicted(), 6).alias("yhat"))


@query(f"WITH s AS ({_SUPPLIERS}), f AS (SELECT regr_slope(y, a) AS g, regr_intercept(y, a) AS h, stddev_samp(a) AS sa, stddev_samp(y) AS sy FROM s) SELECT round(any_value(g * sa / sy), 6) AS slope, round(avg(power((y - h - g * a) / sy, 2)), 6) AS variance FROM s, f")
def g18_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = map_analysis.fit_line(_sides(spark, sf_dir)[0], ["a"], "y")
    return spark.createDataFrame([(round(float(line.slopes[0]), 6), round(float(line.variance), 6))], "slope double, variance double")


def _map(spark: SparkSession, sf_dir: str, side: int, rounds: int, cols: list[str], sparse: bool = False) -> topographic.TopographicMap:
    df = _scaled(spark, sf_dir)
    return topographic.fit_map(df.select(F.array(*cols).alias("v")), "v", (side, side), (3, 3), rounds=rounds, sparse=sparse)[0]


@query()
def g18_inverse_on_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, share, x...): how much each point of the map answers for a target of one deviation above the mean."""
    line = map_analysis.fit_line(_scaled(spark, sf_dir), _ORDER[:3], "price")
    model = _map(spark, sf_dir, 5, 5, _ORDER[:3])
    mean, mode, share = map_analysis.invert_line(model, line, 1.0)
    return spark.createDataFrame([(i, float(s), mean.tolist(), mode.tolist()) for i, s in enumerate(share)], "node int, share double, mean array<double>, mode array<double>")


@query()
def g22_merged_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_analysis.merge_by_information(_scaled(spark, sf_dir), _map(spark, sf_dir, 4, 5, _ORDER, True), _ORDER)[0]


_LATTICE = "SELECT vec_id, 3 + embedding[1]::DOUBLE AS a, 3.5 + embedding[2]::DOUBLE AS b, 4 + embedding[3]::DOUBLE AS c, 90 + 20 * embedding[4]::DOUBLE AS alpha, 90 + 20 * embedding[5]::DOUBLE AS beta, 90 + 20 * embedding[6]::DOUBLE AS gamma FROM embeddings"
_N_SITES = 4


def _lattices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    turn = lambda i: 90 + 20 * e(i)
    return table(spark, sf_dir, "embeddings").select("vec_id", (3 + e(0)).alias("a"), (3.5 + e(1)).alias("b"), (4 + e(2)).alias("c"), turn(3).alias("alpha"), turn(4).alias("beta"), turn(5).alias("gamma"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sites of each vector; the element follows from the vector and the site, two of them at most three kinds."""
    place = lambda i, c: (0.5 + F.col("embedding")[6 + 3 * i + c].cast("double"))
    each = F.array(*[F.struct(F.lit(i).alias("site"), (1 + (F.col("vec_id") + i // 2) % 5).cast("int").alias("element"), *[place(i, c).alias(n) for c, n in enumerate("xyz")]) for i in range(_N_SITES)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.inline(each))


def _properties(spark: SparkSession) -> DataFrame:
    return spark.range(1, 6).select(F.col("id").cast("int").alias("element"), F.array(F.col("id").cast("double"), (F.col("id") * F.col("id") / 10.0)).alias("p"))


_CA, _CB, _CG = (f"cos(radians({x}))" for x in ("alpha", "beta", "gamma"))
_POINTS = f"""WITH l AS ({_LATTICE}), u AS (SELECT *, 1 - {_CA} * {_CA} - {_CB} * {_CB} - {_CG} * {_CG} + 2 * {_CA} * {_CB} * {_CG} AS u FROM l),
p AS (SELECT vec_id, h, k, l3 AS l, sqrt(greatest(0, (1 - {_CA} * {_CA}) / (a * a * u) * h * h + (1 - {_CB} * {_CB}) / (b * b * u) * k * k + (1 - {_CG} * {_CG}) / (c * c * u) * l3 * l3
  + 2 * (({_CA} * {_CB} - {_CG}) / (a * b * u) * h * k + ({_CA} * {_CG} - {_CB}) / (a * c * u) * h * l3 + ({_CB} * {_CG} - {_CA}) / (b * c * u) * k * l3))) AS g
  FROM u, range(-9, 10) x(h), range(-9, 10) y(k), range(-9, 10) z(l3) WHERE NOT (h = 0 AND k = 0 AND l3 = 0)),
n AS (SELECT *, count(*) FILTER (g <= 1.297) OVER (PARTITION BY vec_id) + 1 >= 60 AS small FROM p WHERE g <= 1.4),
t AS (SELECT vec_id, h, k, l, g, row_number() OVER (PARTITION BY vec_id ORDER BY abs(h) + abs(k) + abs(l), h DESC, k DESC, l DESC) AS place FROM n WHERE NOT small OR g <= 1.297)"""
_SITES_SQL = ", s AS (SELECT vec_id, i AS site, (1 + (vec_id + i // 2) % 5)::INT AS element, 0.5 + embedding[7 + 3 * i]::DOUBLE AS x, 0.5 + embedding[8 + 3 * i]::DOUBLE AS y, 0.5 + embedding[9 + 3 * i]::DOUBLE AS z FROM embeddings, range(4) r(i))"


@query(f"{_POINTS} SELECT vec_id, place::INT AS place, h::INT AS h, k::INT AS k, l::INT AS l, round(g, 6) AS g FROM t WHERE place <= 59")
def g25_reciprocal_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crystals.reciprocal_points(_lattices(spark, sf_dir), "vec_id").withColumn("g", F.round("g", 6))


@query(_POINTS + _SITES_SQL + f" SELECT t.vec_id, place::INT AS place, round(sum(element * {math.pi} * (h * x + k * y + l * z)), 5) + 0.0 AS f0, round(sum(element * element / 10.0 * {math.pi} * (h * x + k * y + l * z)), 5) + 0.0 AS f1 FROM t JOIN s ON s.vec_id = t.vec_id WHERE place <= 59 GROUP BY t.vec_id, place")
def g25_m12_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crystals.lattice_features(_sites(spark, sf_dir), _lattices(spark, sf_dir), _properties(spark), "vec_id", 2)
    return out.select("vec_id", "place", *[(F.round(F.col("f")[i], 5) + 0.0).alias(f"f{i}") for i in range(2)])


@query(_POINTS + _SITES_SQL + f" SELECT t.vec_id, place::INT AS place, round(sqrt(power(sum(element * cos({2 * math.pi} * (h * x + k * y + l * z))), 2) + power(sum(element * sin({2 * math.pi} * (h * x + k * y + l * z))), 2)), 5) + 0.0 AS amplitude FROM t JOIN s ON s.vec_id = t.vec_id WHERE place <= 59 GROUP BY t.vec_id, place")
def m12_structure_amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crystals.lattice_features(_sites(spark, sf_dir), _lattices(spark, sf_dir), _properties(spark), "vec_id", 2, "complex")
    return out.select("vec_id", "place", (F.round(F.sqrt(F.col("f")[0] ** 2 + F.col("f")[2] ** 2), 5) + 0.0).alias("amplitude"))


@query("WITH s AS (SELECT vec_id, (1 + (vec_id + i // 2) % 5)::INT AS element FROM embeddings, range(4) r(i)), n AS (SELECT vec_id, element, count(*) AS n FROM s GROUP BY ALL) SELECT vec_id, string_agg(element || ':' || n, ' ' ORDER BY element) AS formula FROM n GROUP BY vec_id")
def g27_decoded_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites go into tensors and are decoded again."""
    return crystals.formulas(crystals.decode_sites(_tensors(_sites(spark, sf_dir)), "vec_id"), "vec_id")


def _tensors(sites: DataFrame) -> DataFrame:
    t = crystals.site_table(sites, "vec_id", "site", 3, 6)
    scores = F.transform("elements", lambda e: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: (k == e).cast("double")))
    occupancy = F.transform("slots", lambda s: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: (k == s).cast("double")))
    return t.select("vec_id", "coordinates", scores.alias("element_scores"), occupancy.alias("occupancy"))


@query()
def g28_reconstructed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of sites whose coordinates were carried through the four leading principal axes of all structures and back."""
    sites = _sites(spark, sf_dir)
    cols = [f"{c}{i}" for i in range(_N_SITES) for c in "xyz"]
    wide = sites.groupBy("vec_id").agg(*[F.max(F.when(F.col("site") == i, F.col(c))).alias(f"{c}{i}") for i in range(_N_SITES) for c in "xyz"])
    axes = principal_axes(vectors(wide, cols), cols, 4, False)
    schema = f"vec_id {sites.schema['vec_id'].dataType.simpleString()}, site int, r array<double>"

    def carried(batches):
        for pdf in batches:
            back = axes.back((pdf[cols].to_numpy(float) - axes.mean) @ axes.axes).reshape(-1, 3)
            yield pd.DataFrame({"vec_id": np.repeat(pdf["vec_id"].to_numpy(), _N_SITES), "site": np.tile(np.arange(_N_SITES), len(pdf)), "r": list(back)})

    again = wide.mapInPandas(carried, schema)
    moved = sites.drop("x", "y", "z").join(again, ["vec_id", "site"]).select("vec_id", "site", "element", *[F.col("r")[i].alias(c) for i, c in enumerate("xyz")])
    return crystals.site_errors(sites, crystals.decode_sites(_tensors(moved), "vec_id"), "vec_id", "site")


@query()
def b13_inverse_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts designed for a price one deviation above the mean: two variables that add up to 1, the third a flag."""
    df = _scaled(spark, sf_dir)
    model = mixtures.fit_mixture(df.select(F.array(*_ORDER).alias("v")), "v", 2, rounds=8)[0]
    bounds = Constraints([-1.5, -1.5, 0.0], [2.5, 2.5, 1.0], zero_one=[2], total=([0, 1], 1.0), digits=[3, 3, None])
    return design(spark, model, [1.0], bounds, restarts=3, population=30, generations=4)
