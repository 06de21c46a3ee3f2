"""Join-shaped operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a group whose pairs are made apart.
PARTS = 64


def preference_pairs(df: DataFrame, key: str, group: str, y: str) -> DataFrame:
    """(winner, loser) within a group; values that are close (1e-8 + 1e-5 |loser|) make no pair.

    The pairs are the result, so the work grows with them; winners are dealt to PARTS of each group, so that no task makes all pairs of one.
    """
    a = df.select(F.col(group).alias("g"), F.col(key).alias("winner"), F.col(y).alias("ya"))
    b = df.select(F.col(group).alias("g"), F.col(key).alias("loser"), F.col(y).alias("yb"))
    far = F.col("ya") - F.col("yb") > 1e-8 + 1e-5 * F.abs("yb")
    a = a.withColumn("part", F.pmod(F.xxhash64("winner", "ya"), F.lit(PARTS)).cast("int"))
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return a.hint("merge").join(b, ["g", "part"]).where((F.col("ya") > F.col("yb")) & far).select("winner", "loser")


def sorted_pairing(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mae, n): values of both sides paired by their place in order, as many as the shorter side has."""
    w = Window.partitionBy(key).orderBy(value)
    left = a.select(key, F.col(value).alias("x"), F.row_number().over(w).alias("k"))
    right = b.select(key, F.col(value).alias("y"), F.row_number().over(w).alias("k"))
    return left.join(right, [key, "k"]).groupBy(key).agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"), F.count(F.lit(1)).alias("n"))


def parameter_grid(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """All combinations of the candidates, a row each."""
    df = spark.range(1).select()
    for name, values in grid.items():
        kind = "long" if isinstance(values[0], int) else "double" if isinstance(values[0], float) else "string"
        df = df.select("*", F.explode(F.array(*map(F.lit, values)).cast(f"array<{kind}>")).alias(name))
    return df


def union_of_files(spark: SparkSession, paths: list[str], tag: str) -> DataFrame:
    """Numeric columns of all files that exist, with the tag that the pattern takes from each file's path."""
    parts = []
    for p in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            continue
        df = spark.read.parquet(p)
        keep = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
        parts.append(df.select(*keep, F.regexp_extract(F.col("_metadata.file_path"), tag, 1).alias("source")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
