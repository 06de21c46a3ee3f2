"""Folds, group splits, bootstrap draws, quotas and Kennard-Stone selection. Ids are explicit; hashes of them shuffle."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import keep

#: Rows up to which Kennard-Stone runs in one numpy step.
SMALL = 20_000


def shuffled(key: str, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with the place of each row, from 0, in that order: rows are range-partitioned and sorted in their tasks, and each partition
    begins where those before it end. A written table; equal rows of `order` may take any turn."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = keep(dealt, "placed")
    part = F.shiftright("__id", 33)
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a number a partition
    begins, total = [], 0
    for p, n in sizes:
        begins += [F.lit(p), F.lit(total)]
        total += n
    if not begins:
        return rows.withColumn(name, F.lit(0).cast("long")).drop("__id")
    begin = F.create_map(*begins)[part]
    return rows.withColumn(name, (begin + F.col("__id").bitwiseAND((1 << 33) - 1)).cast("long")).drop("__id")


def folds(df: DataFrame, key: str, n: int, seed: int = 0, stratify: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """df with `fold` from 0 to n - 1; sizes differ by one at most, within each stratum if given.

    Without a stratum or an order, rows are ranked within 64 buckets of a hash, so that no task ranks the whole table; each
    bucket deals on from another fold, and fold sizes differ by a few rows.
    """
    if stratify:
        return df.withColumn("fold", ((F.row_number().over(Window.partitionBy(stratify).orderBy(*(order or shuffled(key, seed)))) - 1) % n).cast("int"))
    if order:
        return placed(df, order, "__place").withColumn("fold", (F.col("__place") % n).cast("int")).drop("__place")
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(64))
    dealt = df.withColumn("__b", bucket).withColumn("fold", ((F.row_number().over(Window.partitionBy("__b").orderBy(*shuffled(key, seed))) - 1 + F.col("__b")) % n).cast("int"))
    return dealt.drop("__b")


def group_split(df: DataFrame, group: str, test_share: float, seed: int = 0, order: list[Column] | None = None) -> DataFrame:
    """df with `test`: whole groups, as many as the share of the number of groups says (rounded up)."""
    groups = df.select(group).distinct()
    n = int(np.ceil(groups.count() * test_share))
    chosen = groups.orderBy(*(order or shuffled(group, seed))).limit(n).withColumn("test", F.lit(True))
    return df.join(chosen, group, "left").withColumn("test", F.coalesce("test", F.lit(False)))


def bootstrap(df: DataFrame, key: str, models: int, seed: int = 0) -> DataFrame:
    """(model, key, weight): how often each row is drawn for each model, by Poisson(1) weights from hashes; 0 is left out."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("model"), F.col(key)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    cuts, total, term = [], 0.0, float(np.exp(-1))
    for k in range(12):
        total += term
        cuts.append(total)
        term /= k + 1
    weight = sum((F.when(u > c, 1).otherwise(0) for c in cuts[1:]), F.when(u > cuts[0], 1).otherwise(0))
    return df.select(key, F.explode(F.sequence(F.lit(0), F.lit(models - 1))).alias("model")).withColumn("weight", weight).where("weight > 0")


def quota(df: DataFrame, stratum: str, key: str, n: int, order: list[Column] | None = None) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy(*(order or shuffled(key, 0)))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def farthest_from_mean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, d2): the first Kennard-Stone pick."""
    parts = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"))
    each = df.select(F.col(key), F.posexplode(F.col(vector).cast("array<double>")).alias("p", "x")).join(F.broadcast(parts), "p")  # a row a variable
    return each.groupBy(key).agg(F.sum((F.col("x") - F.col("m")) ** 2).alias("d2")).orderBy(F.desc("d2"), key).limit(1)


def _cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder (spark.checkpoint.dir); local mode takes a folder of its own where none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        said = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not said and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder, and a folder of one machine is of no use to a cluster")
        context.setCheckpointDir(said or tempfile.mkdtemp(prefix="loomstat-"))
    return df.checkpoint()


def kennard_stone(df: DataFrame, key: str, vector: str, n: int) -> DataFrame:
    """(key, place): farthest from the mean, then again and again the row farthest from all chosen; ties to the least key.

    Each turn is one pass that lowers a row's distance to the chosen ones, with one row back to the driver; a small
    table is done in one numpy step.
    """
    spark = df.sparkSession
    base = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    if base.count() <= SMALL:
        rows = base.orderBy("k").collect()
        x = np.array([r["v"] for r in rows])
        d = ((x - x.mean(0)) ** 2).sum(1)
        chosen = [int(d.argmax())]
        d = ((x - x[chosen[0]]) ** 2).sum(1)
        d[chosen[0]] = -1
        while len(chosen) < min(n, len(x)):
            chosen.append(int(d.argmax()))
            d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
            d[chosen] = -1
        picks = [rows[i]["k"] for i in chosen]
    else:
        first = farthest_from_mean(df, key, vector).first()[key]
        picks, vectors = [first], [base.where(F.col("k") == first).first()["v"]]
        far = base
        while len(picks) < n:
            near = [F.aggregate(F.zip_with("v", F.array(*map(F.lit, c)), lambda a, b: (a - b) ** 2), F.lit(0.0), lambda s, t: s + t) for c in vectors[-1:]][0]
            far = far.withColumn("d", F.least("d", near) if "d" in far.columns else near)
            if len(picks) % 10 == 0:
                far = _cut(far)
            top = far.where(~F.col("k").isin(picks)).orderBy(F.desc("d"), "k").limit(1).first()
            if top is None:  # fewer rows than picks
                break
            picks.append(top["k"])
            vectors.append(top["v"])
    return spark.createDataFrame([(k, i) for i, k in enumerate(picks)], f"{key} {base.schema['k'].dataType.simpleString()}, place int")
