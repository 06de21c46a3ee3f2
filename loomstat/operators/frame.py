"""Scaling and cleaning of samples-by-variables tables. Statistics are fitted on one table and applied to any other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Autoscaler:
    """z-scores with the fitted table's mean and sample standard deviation."""

    mean: dict[str, float]
    std: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, cols: list[str], zero_std: str = "error") -> Autoscaler:
        """One aggregation over the table. zero_std: 'error' names the constant variables, 'one' divides them by 1."""
        row = df.agg(*[f(c).alias(f"{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        std = {c: row[f"s_{c}"] or 0.0 for c in cols}
        flat = [c for c in cols if not std[c]]
        if flat and zero_std == "error":
            raise ValueError(f"variables without variance: {', '.join(flat)}")
        return Autoscaler({c: row[f"m_{c}"] for c in cols}, {c: std[c] or 1.0 for c in cols})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.mean[c]) / self.std[c] for c in self.mean})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * self.std[c] + self.mean[c] for c in self.mean})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def varying_columns(df: DataFrame, cols: list[str]) -> list[str]:
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def finite(c: Column) -> Column:
    """c, with NaN and infinities as null."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def complete_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """The columns that hold a finite value in every row."""
    row = df.agg(*[F.count_if(finite(F.col(c).cast("double")).isNull()).alias(c) for c in cols]).first()
    return [c for c in cols if not row[c]]


def within_box(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    for c, (low, high) in bounds.items():
        df = df.where(F.col(c).between(low, high))
    return df


def closed_to(df: DataFrame, cols: list[str], total: float) -> DataFrame:
    """The group of columns scaled so that it adds up to total."""
    whole = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return df.withColumns({c: F.col(c) / whole * total for c in cols})


def dummies(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.withColumns({f"{col}_{v}": (F.col(col) == v).cast("int") for v in values})


def check_columns(n: int, *groups: list[int]) -> None:
    """Column numbers must lie in range, occur once and cover the table."""
    flat = [c for g in groups for c in g]
    if any(c < 0 or c >= n for c in flat) or len(set(flat)) != len(flat) or len(flat) != n:
        raise ValueError(f"column numbers must cover 0..{n - 1} once each, got {groups}")
