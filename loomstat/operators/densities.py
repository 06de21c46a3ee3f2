"""What a mixture says of some variables given others, as densities: components, log densities, and how far inputs lie from the data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixtures import Mixture, log_normal, log_sum


def log_conditional(model: Mixture, x: np.ndarray, y: np.ndarray, given: list[int], wanted: list[int]) -> np.ndarray:
    """log p(y | x) of each row."""
    means, covs, p = model.conditional(x, given, wanted)
    with np.errstate(divide="ignore"):
        return log_sum(np.stack([np.log(p[:, k]) + log_normal(y - means[:, k], np.zeros(len(wanted)), covs[k]) for k in range(len(covs))], 1))


def output_density(df: DataFrame, model: Mixture, key: str, given: list[str], order: list[str]) -> DataFrame:
    """(key, log_density, density) of each row's own values of the other columns of `order`, given its values of the given ones."""
    kind = df.schema[key].dataType.simpleString()
    wanted = [c for c in order if c not in given]
    g, w = [order.index(c) for c in given], [order.index(c) for c in wanted]

    def run(batches):
        for pdf in batches:
            out = log_conditional(model, pdf[given].to_numpy(float), pdf[wanted].to_numpy(float), g, w) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"key": pdf["key"], "log_density": out, "density": np.exp(out)})

    rows = df.select(F.col(key).alias("key"), *given, *wanted)
    return rows.mapInPandas(run, f"key {kind}, log_density double, density double").withColumnRenamed("key", key)


def conditional_components(df: DataFrame, model: Mixture, key: str, given: list[str], order: list[str]) -> DataFrame:
    """A row for each (row of df, component): key, component, weight, mean of the other columns, log_density and density of the given
    values under the component, and ioe: minus the log of the components' densities summed by weight (large far from the data)."""
    kind = df.schema[key].dataType.simpleString()
    g = [order.index(c) for c in given]
    w = [i for i in range(len(order)) if i not in g]
    parts = len(model.weights)

    def run(batches):
        for pdf in batches:
            x = pdf[given].to_numpy(float)
            means, _, p = model.conditional(x, g, w)
            logs = np.stack([log_normal(x, m[g], s[np.ix_(g, g)]) for m, s in zip(model.means, model.covariances)], 1)
            with np.errstate(divide="ignore"):
                ioe = -log_sum(logs + np.log(p))
            yield pd.DataFrame({"key": np.repeat(pdf["key"].to_numpy(), parts), "component": np.tile(np.arange(parts), len(x)), "weight": p.ravel(), "mean": list(means.reshape(-1, len(w))), "log_density": logs.ravel(), "density": np.exp(logs).ravel(), "ioe": np.repeat(ioe, parts)})

    said = f"key {kind}, component int, weight double, mean array<double>, log_density double, density double, ioe double"
    return df.select(F.col(key).alias("key"), *given).mapInPandas(run, said).withColumnRenamed("key", key)


def conditional_covariances(model: Mixture, given: list[int], wanted: list[int]) -> np.ndarray:
    """(components, wanted, wanted): the same for every row."""
    return model.conditional(np.zeros((1, len(given))), given, wanted)[1]
