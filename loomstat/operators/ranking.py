"""Window-shaped operators: ordered series, running values, ranks and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def r2_by_last_value(df: DataFrame, key: str, order: list[str], y: str, estimate: str) -> DataFrame:
    """(key, r2lm): 1 - sum (y - estimate)^2 / sum (y_t - y_{t-1})^2; the first row has no difference."""
    gap = F.col(y) - F.lag(y).over(Window.partitionBy(key).orderBy(*order))
    rows = df.withColumns({"__e": (F.col(y) - F.col(estimate)) ** 2, "__g": gap**2})
    return rows.groupBy(key).agg((1 - F.sum("__e") / F.nullif(F.sum("__g"), F.lit(0.0))).alias("r2lm"))


def lag_features(df: DataFrame, key: str, order: list[str], cols: list[str], span: int, most: int) -> DataFrame:
    """Copies of cols delayed by span, 2 span, ... up to most rows; the first `most` rows of each key go."""
    w = Window.partitionBy(key).orderBy(*order)
    out = df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in range(span, most + 1, span)})
    return out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") > most).drop("__n")


def coverage_curve(df: DataFrame, group: list[str], score: str, key: str, error: str) -> DataFrame:
    """df with `rmse`, over the rows of a group whose score is at least as high (the key breaks ties), and the row's place."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), key)
    return df.withColumn("rmse", F.sqrt(F.avg(F.col(error) ** 2).over(w.rowsBetween(Window.unboundedPreceding, 0)))).withColumn("place", F.row_number().over(w))


def average_rank(column: str, *partition: str) -> Column:
    """Rank from 1, the mean rank among equals."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(column)) + (F.count(F.lit(1)).over(w.partitionBy(*partition, column)) - 1) / 2


def top_rows(df: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def scaled_to_unit(column: str, *partition: str) -> Column:
    """(x - min) / (max - min) of the partition; 0 where all are equal."""
    w = Window.partitionBy(*partition)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.0)
