"""Inverse design by a genetic search under constraints: a population is a table, and every generation of every restart is one job.

Individuals are repaired and filtered by `optimization.repaired`, so each generation obeys the constraints. Fitness is the log
density of the target given the individual under a mixture. Draws come from hashes of (seed, generation, restart, place), so that
a rerun gives the same population. The best individual of a restart lives on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import keep
from .densities import log_conditional
from .mixtures import Mixture
from .optimization import repaired

#: A new generation makes so many children for each place, as repairs may leave some outside their bounds.
SPARE = 3


@dataclass(frozen=True)
class Constraints:
    """Bounds of each variable; variables that are 0 or 1; (group, total); (group, how many may be other than 0), twice; decimals."""

    lower: list[float]
    upper: list[float]
    zero_one: list[int] = field(default_factory=list)
    total: tuple[list[int], float] | None = None
    only_one: tuple[list[int], int] | None = None
    nonzero: tuple[list[int], int] | None = None
    digits: list[int | None] | None = None

    def repaired(self, df: DataFrame, vector: str = "v") -> DataFrame:
        return repaired(df, vector, self.upper, self.lower, self.zero_one, self.total, self.only_one, self.nonzero, self.digits or [None] * len(self.lower))


def _u(*of: Column | int | str) -> Column:
    """A number of (0, 1) that belongs to what it is made of."""
    return (F.pmod(F.xxhash64(*[F.lit(x) if isinstance(x, int | str) else x for x in of]), F.lit(1 << 40)) + 0.5) / (1 << 40)


def _scored(df: DataFrame, model: Mixture, n: int, targets: list[float]) -> DataFrame:
    """(restart, v, fitness): log density of the targets, the model's last variables, given the first n."""
    given, wanted = list(range(n)), list(range(n, n + len(targets)))

    def run(batches):
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, n))
            y = np.tile(np.array(targets, float), (len(x), 1))
            yield pd.DataFrame({"restart": pdf["restart"], "v": pdf["v"], "fitness": np.maximum(log_conditional(model, x, y, given, wanted), -1e300) if len(x) else np.zeros(0)})

    return df.select("restart", "v").mapInPandas(run, "restart int, v array<double>, fitness double")


def _ranked(df: DataFrame, population: int) -> DataFrame:
    """(restart, place, v, fitness): the fittest of each restart; equal ones are told apart by their values."""
    order = Window.partitionBy("restart").orderBy(F.desc("fitness"), F.xxhash64("v"))  # a population
    return df.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < population).select("restart", "place", "v", "fitness")


def first_generation(spark: SparkSession, c: Constraints, restarts: int, population: int, seed: int) -> DataFrame:
    base = spark.range(restarts * population * SPARE).select((F.col("id") % restarts).cast("int").alias("restart"), F.col("id").alias("i"))
    v = [F.lit(float(a)) + _u(seed, "first", F.col("i"), j) * float(b - a) for j, (a, b) in enumerate(zip(c.lower, c.upper))]
    return c.repaired(base.select("restart", F.array(*v).alias("v"))).distinct()


def children(parents: DataFrame, c: Constraints, population: int, generation: int, seed: int, rivals: int = 3, mutate: float = 0.1) -> DataFrame:
    """(restart, v) of the next generation: two tournaments a child, a point on the line through both winners, now and then a gene drawn anew."""
    size = parents.groupBy("restart").agg(F.count(F.lit(1)).alias("size"))
    wish = size.select("restart", "size", F.explode(F.sequence(F.lit(0), F.lit(population * SPARE - 1))).alias("child"))
    draws = wish.select("restart", "child", F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.floor(_u(seed, generation, F.col("restart"), F.col("child"), 10 * side + r) * F.col("size")).cast("int").alias("place")) for side in (0, 1) for r in range(rivals)])).alias("d"))
    met = draws.select("restart", "child", "d.side", "d.place").join(parents, ["restart", "place"])
    won = met.groupBy("restart", "child").pivot("side", [0, 1]).agg(F.max_by("v", F.struct(F.col("fitness"), -F.col("place"))))
    at = [F.col("restart"), F.col("child")]
    step = lambda j: -0.25 + 1.5 * _u(seed, generation, *at, 100 + j)
    genes = []
    for j, (a, b) in enumerate(zip(c.lower, c.upper)):
        x, y = F.col("0")[j], F.col("1")[j]
        fresh = F.lit(float(a)) + _u(seed, generation, *at, 300 + j) * float(b - a)
        mixed = F.least(F.lit(float(b)), F.greatest(F.lit(float(a)), x + step(j) * (y - x)))
        genes.append(F.when(_u(seed, generation, *at, 200 + j) < mutate, fresh).otherwise(mixed))
    return c.repaired(won.select("restart", F.array(*genes).alias("v")))


def design(spark: SparkSession, model: Mixture, targets: list[float], c: Constraints, restarts: int = 10, population: int = 100, generations: int = 30, seed: int = 0, watch=None) -> DataFrame:
    """(restart, v, fitness) of the best individual of each restart; restarts that the constraints leave empty are missing. The
    model's variables are those of the individuals, then the targets. watch(generation, table) sees every generation."""
    n = len(c.lower)
    if model.means.shape[1] != n + len(targets):
        raise ValueError(f"the model has {model.means.shape[1]} variables, {n} designed and {len(targets)} targets")
    now = keep(_ranked(_scored(first_generation(spark, c, restarts, population, seed), model, n, targets), population), "generation")
    for g in range(generations):
        if watch:
            watch(g, now)
        born = _scored(children(now, c, population, g, seed).distinct(), model, n, targets)
        now = keep(_ranked(born.unionByName(now.where("place = 0").select("restart", "v", "fitness")).distinct(), population), "generation")
    if watch:
        watch(generations, now)
    return now.where("place = 0").select("restart", "v", "fitness")
