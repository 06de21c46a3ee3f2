"""Scores and summaries as aggregate expressions and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def r2(y: Column, estimate: Column, mean: float | None = None) -> Column:
    """1 - SSE / SST; SST about the scored rows' own mean, or about a given (training) mean."""
    sst = F.var_pop(y) * F.count(y) if mean is None else F.sum((y - mean) ** 2)
    return 1 - F.sum((y - estimate) ** 2) / sst


def rmse(y: Column, estimate: Column) -> Column:
    return F.sqrt(F.avg((y - estimate) ** 2))


def mae(y: Column, estimate: Column) -> Column:
    return F.avg(F.abs(y - estimate))


def mape(y: Column, estimate: Column) -> Column:
    return F.avg(F.abs((y - estimate) / (y + 1e-12))) * 100


def accuracy(y: Column, estimate: Column) -> Column:
    return F.avg((y == estimate).cast("int"))


def finite_mean(x: Column) -> Column:
    return F.avg(F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))


def confusion(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """Counts, a row a true class and a column a predicted one, in the order of labels."""
    return df.groupBy(actual).pivot(predicted, labels).count().na.fill(0)


def vote(df: DataFrame, key: str, cls: str) -> DataFrame:
    """(key, winner, probability): the class with most rows; the last in order wins a tie."""
    counts = df.groupBy(key, F.col(cls).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.max(F.struct("n", "cls")).alias("top"), F.sum("n").alias("all"))
    return best.select(key, F.col("top.cls").alias("winner"), (F.col("top.n") / F.col("all")).alias("probability"))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r, n) of every pair of columns, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)], F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), F.col("n")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(each))


def symbol_codes(df: DataFrame, symbol: str) -> DataFrame:
    """df with the place of its symbol in the sorted alphabet."""
    alphabet = df.select(symbol).distinct().withColumn("code", F.row_number().over(Window.orderBy(symbol)) - 1)
    return df.join(alphabet, symbol)
