"""A campaign of experiments that can stop at any point and go on: propose, wait for results, apply them, propose again.

Its table is a `VersionedTable` of (round, place, id, status, y): round 0 holds the first observations. The state beside it
holds settings and the positions of four random streams (folds of the kernel choice, draws, ties of fantasies, length scales), so that a proposal that
was lost before its version was published is made again, the same. Candidates may be any number of rows: each of a batch's
picks is one scan in which they are scored where they lie. Observations are those of the campaign, `kernel_choice.MOST` at most
enter a model (those of least hash).
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.kernels import PreferenceFit, usual_kernels
from ..streaming.versions import Version, VersionedTable
from . import kernel_choice
from .optimization import campaign_progress

STREAMS = ("folds", "draws", "fantasies", "scales")
COLUMNS = "round int, place int, id long, status string, y double"


class Streams:
    """Four generators whose positions go into the state and come back from it."""

    def __init__(self, seed: int | None = None, positions: dict[str, Any] | None = None) -> None:
        roots = np.random.SeedSequence(seed).spawn(len(STREAMS))
        self.of = {n: np.random.Generator(np.random.PCG64(r)) for n, r in zip(STREAMS, roots)}
        for n, p in (positions or {}).items():
            self.of[n].bit_generator.state = p

    def positions(self) -> dict[str, Any]:
        return {n: g.bit_generator.state for n, g in self.of.items()}

    def number(self, name: str) -> int:
        return int(self.of[name].integers(0, 2**31 - 1))


class Campaign:
    def __init__(self, spark: SparkSession, folder: str, candidates: DataFrame, cols: list[str], key: str = "id") -> None:
        self.spark, self.cols = spark, cols
        self.candidates = candidates.select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in cols])
        self.table = VersionedTable(spark, folder)

    def start(self, observed: DataFrame, seed: int = 0, choose: bool = True, folds: int = 5) -> Version:
        """Version 0 from observed (id, y), with the kernel chosen once; a campaign that has begun is left as it is."""
        if (there := self.table.latest()) is not None:
            return there
        streams = Streams(seed)
        rows = observed.select(F.lit(0).alias("round"), F.lit(0).alias("place"), F.col("id").cast("long"), F.lit("observed").alias("status"), F.col("y").cast("double"))
        place = 0
        if choose:
            x, y = self._observed(rows)
            place = kernel_choice.choose_kernel(self.spark, x, y, folds, "tau", streams.number("folds"))[1]
        return self.table.commit(rows, None, {"seed": seed, "kernel": place, "streams": streams.positions()})

    def _observed(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """x and autoscaled y of the observations."""
        known = rows.where("y IS NOT NULL").select("id", "y", F.struct("round", "place").alias("at")).join(self.candidates, "id")
        x, y = kernel_choice.observations(known, "id", self.cols, "y")
        if not len(y):
            raise ValueError("no observation is among the candidates")
        spread = y.std(ddof=1) if len(y) > 1 else 0.0
        return x, (y - y.mean()) / (spread if spread > 0 else 1.0)

    def propose(self, batch: int) -> DataFrame:
        """The next batch (round, place, id), published as pending. While results are pending, none is made."""
        after = self.table.latest()
        if after is None:
            raise ValueError("the campaign has not begun")
        rows = self.table.read(after)
        if not rows.where("status = 'proposed'").isEmpty():
            raise ValueError("results of the last proposal are pending")
        streams = Streams(positions=after.state["streams"])
        x, y = self._observed(rows)
        used = rows.select("id").distinct()
        pool = self.candidates.join(used, "id", "left_anti")
        if pool.limit(batch).count() < batch:
            raise ValueError(f"fewer than {batch} candidates are left")
        chosen: list[int] = []
        for _ in range(batch):
            centre, spread = x.mean(0), np.where((s := x.std(0, ddof=1)) > 0, s, 1.0)
            z = (x - centre) / spread
            kernel = usual_kernels(kernel_choice.median_scales(z), False)[after.state["kernel"]]
            process = PreferenceFit(kernel)
            state = process.fit(z, kernel_choice.preferences(y))

            def score(batches, cols=self.cols, process=process, state=state, centre=centre, spread=spread):
                for pdf in batches:
                    mu, sd = process.predict_both(state, (pdf[cols].to_numpy(float) - centre) / spread)
                    yield pd.DataFrame({"id": pdf["id"], "mu": mu, "sd": sd})

            left = pool.where(~F.col("id").isin(chosen)) if chosen else pool  # a batch
            scored = left.mapInPandas(score, "id long, mu double, sd double")
            drawn = scored.withColumn("draw", kernel_choice.thompson(F.col("mu"), F.col("sd"), F.col("id"), streams.number("draws")))
            best = kernel_choice.best_candidate(drawn, "draw", "id", streams.number("fantasies")).first()
            chosen.append(best["id"])
            # the pick counts as observed at its mean for the rest of the batch
            row = self.candidates.where(F.col("id") == best["id"]).first()
            x, y = np.vstack([x, [row[c] for c in self.cols]]), np.append(y, best["mu"])
        turn = rows.agg(F.max("round")).first()[0] + 1
        made = self.spark.createDataFrame([(turn, i + 1, k, "proposed", None) for i, k in enumerate(chosen)], COLUMNS)
        self.table.commit(rows.unionByName(made), after, after.state | {"streams": streams.positions()})
        return made.select("round", "place", "id")

    def apply(self, results: DataFrame, token: tuple[str, int] | None = None) -> Version:
        """Results (round, id, y): proposals become observed; a result that was not proposed is an observation of its round. Null y are
        still pending. A replayed token changes nothing."""
        after = self.table.latest()
        if after is None:
            raise ValueError("the campaign has not begun")
        if token and after.tokens.get(token[0], -1) >= token[1]:
            return after
        new = results.select(F.col("round").cast("int"), F.col("id").cast("long"), F.col("y").cast("double")).where("y IS NOT NULL AND NOT isnan(y)")
        new = new.groupBy("round", "id").agg(F.max("y").alias("new"))  # results of a batch
        if new.isEmpty():
            raise ValueError("no results to apply")
        both = self.table.read(after).join(new, ["round", "id"], "full")
        status = F.when(F.col("new").isNotNull(), F.lit("observed")).otherwise(F.col("status"))
        rows = both.select("round", F.coalesce("place", F.lit(0)).alias("place"), "id", status.alias("status"), F.coalesce("new", "y").alias("y"))
        return self.table.commit(rows, after, token=token)

    def progress(self) -> DataFrame:
        """(round, n, best, best_so_far)."""
        return campaign_progress(self.table.read(), "round", "y")
