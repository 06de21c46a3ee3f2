"""An adaptive soft sensor: per key, each arriving x is estimated by locally weighted PLS on the rows whose y is known by then.

The same step serves a table (replay in order) and a stream (state per key). y of a row becomes known `delay` rows later; the
database keeps the last `most` rows; a failed estimate carries the last one forward. What a row is estimated from does not
hang on other estimates, so the rows of a batch, of many keys, are fitted together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of databases that are fitted together.
TOGETHER = 1 << 16
#: Known rows below which there is no estimate.
FEWEST = 5


def _mean(w: np.ndarray, total: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("nm,...nm->...n", w, v) / total


def local_estimates(a: np.ndarray, b: np.ndarray, there: np.ndarray, x: np.ndarray, components: int, lam: float) -> np.ndarray:
    """n estimates at x (p, n) by PLS, each from its own rows a (p, n, m) and b (n, m) where there (n, m) is 1; rows are weighted by
    exp(-d / std(d) / lam), scaled in each database. Places without a row hold zeros."""
    count = there.sum(1)
    first = a[:, np.arange(len(b)), there.argmax(1)]
    a, x = (a - first[..., None]) * there, x - first  # a constant variable is 0 throughout
    centre = _mean(there, count, a)
    dev = np.sqrt(_mean(there, count - 1, (a - centre[..., None]) ** 2))
    dev = np.where(dev > 0, dev, 1.0)
    a, x = (a - centre[..., None]) / dev[..., None] * there, (x - centre) / dev
    d = np.sqrt(((a - x[..., None]) ** 2).sum(0))
    spread = np.sqrt(_mean(there, count - 1, (d - _mean(there, count, d)[:, None]) ** 2))
    even = ~(spread > 0)
    w = np.where(even[:, None], 1.0, np.exp(-d / np.where(even, 1.0, spread)[:, None] / lam)) * there
    total = w.sum(1)
    mx, out = _mean(w, total, a), _mean(w, total, b)
    a, b, x = a - mx[..., None], b - out[:, None], x - mx
    going = np.ones(len(b), bool)
    for _ in range(min(components, len(a))):
        v = np.einsum("pnm,nm->pn", a, w * b)
        norm = np.sqrt((v * v).sum(0))
        v = v / np.where(norm > 1e-12, norm, 1.0)
        t = np.einsum("pnm,pn->nm", a, v)
        wt = w * t
        tt = np.einsum("nm,nm->n", t, wt)
        going &= (norm > 1e-12) & (tt > 1e-12)  # one that ends here has no more components
        tt = np.where(going, tt, 1.0)
        p, q = np.einsum("pnm,nm->pn", a, wt) / tt, np.where(going, np.einsum("nm,nm->n", b, wt) / tt, 0.0)
        at = (x * v).sum(0)
        out = out + at * q
        a, b, x = a - p[..., None] * t, b - q[:, None] * t, x - p * at
    return out + 0.0 * x.sum(0)  # without a number in x there is none


@dataclass(frozen=True)
class Sensor:
    delay: int
    most: int
    components: int = 2
    lam: float = 1.0

    def estimates(self, x: np.ndarray, y: np.ndarray, start: np.ndarray, last: np.ndarray, old: int) -> np.ndarray:
        """The estimate of each row (x: p, n; y: n, NaN where it never becomes known) after the first `old` ones, which have theirs. start is
        the place of the first row of each row's key, last what is carried forward where the key has no estimate yet."""
        n = len(y)
        known = np.isfinite(y)
        before = np.concatenate([[0], np.cumsum(known)])  # known rows before each place
        own_x, own_y = x[:, known], y[known]
        high = before[np.maximum(np.arange(n) - self.delay, start)]
        low = np.maximum(before[start], high - self.most)
        out = np.full(n, np.nan)
        fit = old + np.flatnonzero((high - low >= FEWEST)[old:])
        step = max(1, TOGETHER // self.most)
        for k in range(0, len(fit), step):
            i = fit[k : k + step]
            at = high[i, None] - np.arange((high[i] - low[i]).max(), 0, -1)
            there = (at >= low[i, None]).astype(float)
            at = np.maximum(at, low[i, None])
            a = np.where(there > 0, own_x[:, at], 0.0)
            with np.errstate(all="ignore"):
                out[i] = local_estimates(a, np.where(there > 0, own_y[at], 0.0), there, x[:, i], self.components, self.lam)
        done = np.maximum.accumulate(np.where(np.isfinite(out), np.arange(n), -1))
        return np.where(done >= start, out[done], last)[old:]

    def kept(self, y: np.ndarray) -> np.ndarray:
        """Places of the rows of a key that its next rows still need: the database and those whose y is not known yet."""
        settled = max(0, len(y) - self.delay)
        return np.concatenate([np.flatnonzero(np.isfinite(y[:settled]))[-self.most :], np.arange(settled, len(y))])


def estimate(df: DataFrame, key: str, order: list[str], id_col: str, cols: list[str], y: str, delay: int = 3, most: int = 50) -> DataFrame:
    """(id, estimate) of a table, keys in parallel, rows of a key in order; a key's state is carried on from batch to batch."""
    kind, sensor = df.schema[id_col].dataType.simpleString(), Sensor(delay, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, t, last = np.zeros((len(cols), 0)), np.zeros(0), 0.0
        for b in batches:
            if not len(b):
                continue
            of = lambda c: b.column(c).to_numpy(zero_copy_only=False)
            old = len(t)
            x, t = np.concatenate([x, np.stack([of(f"x{i}") for i in range(len(cols))])], 1), np.concatenate([t, of("y")])
            fresh = np.concatenate([np.zeros(old, bool), of("place") == 1])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(t)), 0))
            out = sensor.estimates(x, t, start, np.where((start == 0) & ~fresh[0], last, 0.0), old)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out)], ["id", "estimate"])
            x, t, last = x[:, start[-1] :], t[start[-1] :], float(out[-1])
            left = sensor.kept(t)
            x, t = x[:, left], t[left]

    ends = [F.col(key).asc(), *[F.col(c).asc_nulls_last() for c in order]]
    rows = df.select(*dict.fromkeys([key, *order, id_col, *cols, y]), F.row_number().over(Window.partitionBy(key).orderBy(*ends[1:])).alias("_place")).sortWithinPartitions(*ends)
    numbers = [F.col(c).cast("double").alias(n) for c, n in [*((c, f"x{i}") for i, c in enumerate(cols)), (y, "y")]]
    return rows.select(F.col(id_col).alias("id"), F.col("_place").alias("place"), *numbers).mapInArrow(run, f"id {kind}, estimate double").withColumnRenamed("id", id_col)


def estimate_stream(df: DataFrame, key: str, order: list[str], id_col: str, cols: list[str], y: str, delay: int = 3, most: int = 50) -> DataFrame:
    """The same over a stream, with the database, the pending rows and the last estimate as state; arrivals of a batch are put in order."""
    kind, sensor = df.schema[id_col].dataType.simpleString(), Sensor(delay, most)

    def run(_key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows, pending, last = state.get if state.exists else ([], [], 0.0)
        pdf = pd.concat(list(batches)).sort_values(order)
        old = len(rows) + len(pending)
        data = np.concatenate([np.array([*rows, *pending], float).reshape(old, len(cols) + 1), pdf[[*cols, y]].to_numpy(float)])
        out = sensor.estimates(data[:, :-1].T, data[:, -1], np.zeros(len(data), int), np.full(len(data), last), old)
        left = sensor.kept(data[:, -1])
        cut = np.searchsorted(left, max(0, len(data) - delay))
        state.update((data[left[:cut]].tolist(), data[left[cut:]].tolist(), float(out[-1])))
        yield pd.DataFrame({"id": pdf[id_col].to_numpy(), "estimate": out})

    kept = df.select(*dict.fromkeys([key, *order, id_col, *cols, y]))
    out = kept.groupBy(key).applyInPandasWithState(run, f"id {kind}, estimate double", "rows array<array<double>>, pending array<array<double>>, last double", "append", "NoTimeout")
    return out.withColumn("id", F.col("id")).withColumnRenamed("id", id_col)
