"""Many models fitted together: each round is one scan of the rows, in which every unfinished model adds up its sums.

A fitting is a model under way. Its `sums` runs in tasks and turns a batch of rows into one flat array; a task hands on one
array a fitting, Spark adds those up by fitting, and `step` makes the next model from the total. Fittings that are done leave
the scan. A fitting of fold f does not see the rows of that fold.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import keep
from .mixtures import Mixture, log_sum, safe_covariance, shaped
from .topographic import TopographicMap, grid

#: Rows at most from which starts are chosen; they are those of least hash.
START_ROWS = 2048


class Fitting(Protocol):
    fold: int | None
    done: bool
    history: tuple[float, ...]

    def sums(self, x: np.ndarray) -> np.ndarray: ...

    def step(self, s: np.ndarray) -> Fitting: ...


def vectors(df: DataFrame, cols: list[str], fold: Column | None = None) -> DataFrame:
    """(v, fold) of the rows in which no variable is null: the written table that all rounds read. Without folds, fold is -1."""
    v = F.array(*[F.col(c).cast("double") for c in cols])
    return keep(df.dropna(subset=cols).select(v.alias("v"), (F.lit(-1) if fold is None else fold).cast("int").alias("fold")), "vectors")


def gathered(rows: DataFrame, cells: dict[int, Any]) -> dict[int, np.ndarray]:
    """The total of each cell's `sums` over the rows(v, fold) outside of its fold (of its fold, if it says `inside`), in one scan.
    A cell without rows is missing."""
    sent = rows.sparkSession.sparkContext.broadcast(cells)  # as large as the models

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, fold = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1), batch.column("fold").to_numpy()
            for k, cell in sent.value.items():
                own = x if cell.fold is None else x[(fold == cell.fold) == getattr(cell, "inside", False)]
                if len(own):
                    s = cell.sums(own)
                    total[k] = total[k] + s if k in total else s
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([s.tobytes() for s in total.values()], pa.binary())], ["cell", "s"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [key[0]], "s": [sum(np.frombuffer(s) for s in pdf["s"]).tobytes()]})

    kind = "cell long, s binary"
    found = rows.mapInArrow(run, kind).groupBy("cell").applyInPandas(add, kind).collect()  # one array a cell
    sent.unpersist()
    return {r["cell"]: np.frombuffer(r["s"]) for r in found}


def advance(rows: DataFrame, fittings: dict[int, Fitting], rounds: int) -> dict[int, Fitting]:
    """The fittings after at most so many rounds, one Spark job a round."""
    out = dict(fittings)
    for _ in range(rounds):
        live = {k: f for k, f in out.items() if not f.done}
        if not live:
            break
        totals = gathered(rows, live)
        out |= {k: f.step(totals[k]) if k in totals else replace(f, done=True) for k, f in live.items()}
    return out


@dataclass(frozen=True)
class Moments:
    """Sums of 1, x and x x' of the rows outside of a fold."""

    fold: int | None = None

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])


def mean_and_covariance(s: np.ndarray, n: int) -> tuple[float, np.ndarray, np.ndarray]:
    mean = s[1 : n + 1] / s[0]
    return s[0], mean, s[n + 1 :].reshape(n, n) / s[0] - np.outer(mean, mean)


def weighted_sums(x: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Sums of r, r x, r x x' by component, of the log total and of 1."""
    total = log_sum(parts)
    r = np.where(np.isfinite(total)[:, None], np.exp(parts - np.where(np.isfinite(total), total, 0)[:, None]), 1 / parts.shape[1])
    squares = np.stack([(x * r[:, k : k + 1]).T @ x for k in range(r.shape[1])])
    return np.concatenate([r.sum(0), (r.T @ x).ravel(), squares.ravel(), [total.sum(), len(x)]])


def split_sums(s: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    return s[:k], s[k : k + k * n].reshape(k, n), s[k + k * n : -2].reshape(k, n, n), float(s[-2]), float(s[-1])


def settled(history: tuple[float, ...], tolerance: float) -> bool:
    return len(history) > 1 and abs(history[-1] - history[-2]) < tolerance * max(1.0, abs(history[-1]))


@dataclass(frozen=True)
class MixtureFit:
    """Expectation-maximization of a Gaussian mixture; history is the log-likelihood."""

    model: Mixture
    fold: int | None = None
    tolerance: float = 1e-6
    history: tuple[float, ...] = ()
    done: bool = False

    def sums(self, x: np.ndarray) -> np.ndarray:
        return weighted_sums(x, self.model.log_parts(x))

    def step(self, s: np.ndarray) -> MixtureFit:
        n, s1, s2, like, _ = split_sums(s, *self.model.means.shape)
        history = (*self.history, like)
        if settled(history, self.tolerance):
            return replace(self, history=history, done=True)
        n = np.maximum(n, 1e-10)
        means = s1 / n[:, None]
        cov = s2 / n[:, None, None] - means[:, :, None] * means[:, None, :]
        return replace(self, model=Mixture(n / n.sum(), means, shaped(cov, n / n.sum(), self.model.kind), self.model.kind), history=history)

    def mixture(self) -> Mixture:
        return self.model


@dataclass(frozen=True)
class MapFit:
    """Expectation-maximization of a topographic map; history is the log-likelihood. A map that cannot be solved is done without success."""

    model: TopographicMap
    ridge: float = 0.001
    fold: int | None = None
    tolerance: float = 1e-6
    history: tuple[float, ...] = ()
    done: bool = False

    def sums(self, x: np.ndarray) -> np.ndarray:
        parts = self.model.log_parts(x)
        total = log_sum(parts)
        r = np.exp(parts - total[:, None])
        return np.concatenate([r.sum(0), (r.T @ x).ravel(), [(x * x).sum(), total.sum(), len(x)]])

    def step(self, s: np.ndarray) -> MapFit:
        m, k = self.model, len(self.model.points)
        n = m.w.shape[1]
        g, rx, squares, like, rows = s[:k], s[k:-3].reshape(k, n), s[-3], float(s[-2]), s[-1]
        history = (*self.history, like)
        a = m.phi.T @ (g[:, None] * m.phi) + self.ridge / m.beta * np.eye(m.phi.shape[1])
        if not np.isfinite(a).all() or np.linalg.cond(a) > 1e15:
            return replace(self, model=replace(m, success=False), history=history, done=True)
        if settled(history, self.tolerance):
            return replace(self, history=history, done=True)
        w = np.linalg.solve(a, m.phi.T @ rx)
        c = m.phi @ w
        spread = squares - 2 * (rx * c).sum() + (g[:, None] * c * c).sum()
        return replace(self, model=replace(m, w=w, beta=rows * n / max(spread, 1e-12)), history=history)

    def mixture(self) -> Mixture:
        return self.model.as_mixture()


def start_map(mean: np.ndarray, cov: np.ndarray, shape: tuple[int, int], bumps: tuple[int, int], variance: float) -> TopographicMap:
    """The plane of the two leading principal axes as a map."""
    z, centres = grid(*shape), grid(*bumps)
    phi = np.hstack([np.exp(-((z[:, None] - centres[None]) ** 2).sum(2) / (2 * variance)), np.ones((len(z), 1))])
    value, axis = np.linalg.eigh(cov)
    value, axis = value[::-1], axis[:, ::-1]
    plane = mean + (z / np.maximum(z.std(0), 1e-12)) @ (axis[:, :2] * np.sqrt(np.maximum(value[:2], 0))).T
    gap = np.sort(((plane[:, None] - plane[None]) ** 2).sum(2), 1)[:, 1].mean() / 2 if len(z) > 1 else 1.0
    third = value[2] if len(value) > 2 else 0.0
    return TopographicMap(z, phi, np.linalg.lstsq(phi, plane, rcond=None)[0], 1 / max(third, gap, 1e-12), np.full(len(z), 1 / len(z)))


def start_rows(rows: DataFrame, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, folds) of at most START_ROWS rows, those of least hash: only starts are chosen from them."""
    got = rows.orderBy(F.xxhash64(F.lit(seed), "v")).limit(START_ROWS).collect()
    return np.array([r["v"] for r in got], float), np.array([r["fold"] for r in got])


def clusters(x: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(centres, shares) of a few turns of k-means from well-spread first rows; k may exceed the number of rows."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    d2 = ((x - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        pick = rng.choice(len(x), p=d2 / d2.sum()) if d2.sum() > 0 else rng.integers(len(x))
        centres.append(x[pick])
        d2 = np.minimum(d2, ((x - x[pick]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(10):
        own = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(1)
        size = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c, (size + 1) / (size + 1).sum()


def start_mixture(sample: np.ndarray, mean: np.ndarray, cov: np.ndarray, components: int, kind: str, seed: int = 0) -> Mixture:
    if components == 1:
        return Mixture(np.ones(1), mean[None], shaped(cov[None], np.ones(1), kind), kind)
    centres, shares = clusters(sample, components, seed)
    within = safe_covariance(cov - np.cov(centres.T, aweights=shares, ddof=0).reshape(cov.shape), 1e-3 * max(np.trace(cov) / len(cov), 1e-12))
    return Mixture(shares, centres, shaped(np.repeat(within[None], components, 0), shares, kind), kind)
