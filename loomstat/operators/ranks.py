"""Kendall's tau by counting inversions: sorted twice, no pairs.

Rows are range-partitioned by (x, y), which puts them into blocks, and again by (y, block), into bins. A discordant pair lies in
one block (inversions there), or in two blocks and one bin (inversions of blocks along y), or in two blocks and two bins
(products of the table of block and bin sizes). Equal x come in the order of y and equal y in the order of blocks, so that
ties never count, even where a value that a third of the rows share is cut into many parts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import keep


def inversions(a: np.ndarray) -> int:
    """Pairs of places i < j with a[i] > a[j], by merging ever longer runs."""
    r = np.unique(a, return_inverse=True)[1]
    place, total, width = np.arange(len(r)), 0, 1
    while width < len(r):
        block, right = place // (2 * width), (place // width) & 1
        order = np.lexsort((right, r, block))
        seen = np.cumsum(right[order])
        begins = np.searchsorted(block[order], block[order], "left")
        before = seen - np.where(begins > 0, seen[begins - 1], 0)
        total += int(before[right[order] == 0].sum())
        width *= 2
    return total


def _ties(df: DataFrame, *cols: str) -> int:
    """Pairs of rows that are equal in all of cols."""
    n = df.groupBy(*cols).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n")).where("n > 1")
    return int(n.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0)


def discordant(df: DataFrame, partitions: int | None = None) -> int:
    """Pairs of rows of df(x, y) whose orders by x and by y differ."""
    spark = df.sparkSession
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = F.monotonically_increasing_id()
    dealt = df.withColumn("t", tie).repartitionByRange(n, "x", "y", "t")
    blocks = keep(dealt.select("x", "y", "t", F.spark_partition_id().cast("long").alias("block")), "blocks")
    bins = blocks.repartitionByRange(n, "y", "block", "t").select("y", "block", F.spark_partition_id().cast("long").alias("bin"))
    bins = keep(bins, "bins")

    def inside(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [inversions(pdf.sort_values(["x", "y"])["y"].to_numpy())]})

    def between(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [inversions(pdf.sort_values(["y", "block"])["block"].to_numpy())]})

    whole = lambda d: int(d.agg(F.sum(F.col("n").cast("decimal(38,0)"))).first()[0] or 0)
    total = whole(blocks.select("x", "y", "block").groupBy("block").applyInPandas(inside, "n long"))
    total += whole(bins.groupBy("bin").applyInPandas(between, "n long"))
    sizes = np.zeros((n, n), object)
    for r in bins.groupBy("block", "bin").count().collect():  # a number a pair of partitions
        sizes[r["block"], r["bin"]] = r["count"]
    later = np.cumsum(np.cumsum(sizes[::-1], 0)[::-1], 1)  # rows of this block and those after it, in this bin and those before it
    for p in range(n - 1):
        for b in range(1, n):
            total += sizes[p, b] * later[p + 1, b - 1]
    return total


def kendall(df: DataFrame, x: str, y: str, partitions: int | None = None) -> float:
    """Kendall's tau-b of two columns; rows with a null or NaN in one are left out. NaN where a column is constant."""
    number = lambda c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))
    rows = keep(df.select((number(x) + 0.0).alias("x"), (number(y) + 0.0).alias("y")).dropna(), "pairs")
    n = rows.count()
    pairs, tx, ty, both = n * (n - 1) // 2, _ties(rows, "x"), _ties(rows, "y"), _ties(rows, "x", "y")
    below = (pairs - tx) * (pairs - ty)
    return (pairs - tx - ty + both - 2 * discordant(rows, partitions)) / math.sqrt(below) if below else float("nan")
