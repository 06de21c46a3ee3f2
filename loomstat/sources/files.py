"""Sample tables and run states as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_samples(spark: SparkSession, path: str, numeric: list[str], strings: list[str] = (), label: str | None = "sample_id", sentinel: float | None = None) -> DataFrame:
    """A CSV file with a header. label names the first column (None: the file has no label column); columns are numeric doubles
    unless named in strings; NaN, infinities and the sentinel become null. The schema is given, so the file is read once."""
    fields = [] if label is None else [T.StructField(label, T.StringType())]
    order = spark.read.option("header", True).csv(path).columns[len(fields) :]
    missing = set(numeric) | set(strings)
    if missing - set(order):
        raise ValueError(f"columns not in the file: {sorted(missing - set(order))}")
    fields += [T.StructField(c, T.DoubleType() if c in numeric else T.StringType()) for c in order]
    df = spark.read.option("header", True).option("enforceSchema", True).schema(T.StructType(fields)).csv(path)

    def clean(c: str):
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(~(bad | (F.col(c) == sentinel)) if sentinel is not None else ~bad, F.col(c))

    keep = [*([label] if label else []), *[c for c in order if c in missing]]
    return df.select(*keep).withColumns({c: clean(c) for c in numeric})


def write_samples(df: DataFrame, path: str, kind: str = "csv") -> None:
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(key, vector) of one JSON object from names to number lists."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("key", "vector"))


def save_state(spark: SparkSession, state: dict, path: str) -> None:
    """A run's state as one JSON row; a rerun overwrites it whole."""
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
