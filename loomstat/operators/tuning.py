"""Choice of mixtures and topographic maps by cross-validation: all cells (settings x fold) are fitted together.

Each round is one scan in which every unfinished cell adds up its sums (`em`); one more scan scores each fold's rows by the
models that have not seen them and brings back sums of squares, so no prediction leaves its task. Cells that differ only in
how they predict (mean or mode) share their models. The first cell of the best pooled r2 wins and is fitted to all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .em import Fitting, MapFit, MixtureFit, Moments, advance, gathered, mean_and_covariance, start_map, start_mixture, start_rows, vectors
from .mixtures import KINDS, Mixture
from .neighbours import k3n_error
from .search import bayes_grid
from .splits import folds
from .topographic import project
from .variational import DISTRIBUTION, PROCESS, VariationalFit

#: The score of settings whose fit fails.
FAILED = -1e10


@dataclass(frozen=True)
class Start:
    """What a fit begins from: the moments of its rows and at most em.START_ROWS of them."""

    rows: float
    mean: np.ndarray
    cov: np.ndarray
    sample: np.ndarray


@dataclass(frozen=True)
class MixtureCell:
    kind: str = "full"
    components: int = 1
    rep: str = "mean"

    def begin(self, s: Start, seed: int) -> Fitting:
        return MixtureFit(start_mixture(s.sample, s.mean, s.cov, self.components, self.kind, seed))

    def numbers(self) -> list[float]:
        return [self.components, *(float(self.kind == k) for k in KINDS), float(self.rep == "mode")]


@dataclass(frozen=True)
class VariationalCell:
    kind: str = "full"
    components: int = 10
    weights: str = PROCESS
    concentration: float = 0.01
    rep: str = "mean"

    def begin(self, s: Start, seed: int) -> Fitting:
        start = start_mixture(s.sample, s.mean, s.cov, self.components, self.kind, seed)
        return VariationalFit.begin(start, s.rows, s.mean, s.cov, weights=self.weights, concentration=self.concentration)

    def numbers(self) -> list[float]:
        return [self.components, *(float(self.kind == k) for k in KINDS), float(self.weights == DISTRIBUTION), np.log10(self.concentration), float(self.rep == "mode")]


@dataclass(frozen=True)
class MapCell:
    side: int = 10
    bumps: int = 4
    variance: float = 1.0
    ridge: float = 0.001
    rep: str = "mean"

    def begin(self, s: Start, seed: int) -> Fitting:
        return MapFit(start_map(s.mean, s.cov, (self.side, self.side), (self.bumps, self.bumps), self.variance), self.ridge)

    def numbers(self) -> list[float]:
        return [self.side, self.bumps, np.log2(self.variance), np.log2(self.ridge) if self.ridge > 0 else -20.0, float(self.rep == "mode")]


Cell = MixtureCell | VariationalCell | MapCell


def grid_of(cell: type[Cell], /, **values: Iterable) -> list[Cell]:
    """All combinations of the values, the last name fastest."""
    return [cell(**dict(zip(values, v))) for v in product(*values.values())]


@dataclass(frozen=True)
class _Score:
    """Sums of squared errors by mean and by mode of rows that a model predicts."""

    model: Mixture
    given: tuple[int, ...]
    wanted: tuple[int, ...]
    fold: int | None
    inside: bool = True

    def sums(self, x: np.ndarray) -> np.ndarray:
        means, _, p = self.model.conditional(x[:, self.given], list(self.given), list(self.wanted))
        y = x[:, self.wanted]
        mean, mode = (means * p[:, :, None]).sum(1), means[np.arange(len(x)), p.argmax(1)]
        return np.array([((y - mean) ** 2).sum(), ((y - mode) ** 2).sum()])


@dataclass(frozen=True)
class _Targets:
    wanted: tuple[int, ...]
    fold: int | None = None

    def sums(self, x: np.ndarray) -> np.ndarray:
        y = x[:, self.wanted]
        return np.array([y.size, y.sum(), (y * y).sum()])


def _begun(rows: DataFrame, models: list[Cell], left_out: list[int | None], seed: int) -> dict[int, Fitting]:
    """A fitting of each model for each fold to leave out, keyed by model * len(left_out) + fold's place."""
    sample, own = start_rows(rows, seed)
    totals = gathered(rows, {i: Moments(f) for i, f in enumerate(left_out)})
    out: dict[int, Fitting] = {}
    for i, f in enumerate(left_out):
        if i not in totals:
            continue
        n, mean, cov = mean_and_covariance(totals[i], sample.shape[1])
        start = Start(n, mean, cov, sample if f is None or not (own != f).any() else sample[own != f])
        out |= {k * len(left_out) + i: replace(m.begin(start, seed), fold=f) for k, m in enumerate(models)}
    return out


def _mixture(fit: Fitting) -> Mixture | None:
    """The density of a finished fit; None where the fit failed."""
    if isinstance(fit, MapFit) and not fit.model.success:
        return None
    m = fit.mixture()
    return m if np.isfinite(m.means).all() and np.isfinite(m.covariances).all() and np.isfinite(m.weights).all() else None


def cross_validate(rows: DataFrame, cells: list[Cell], given: list[int], wanted: list[int], rounds: int, seed: int = 0) -> list[float]:
    """The pooled r2 of each cell over the folds of rows(v, fold); outputs are pooled too."""
    every = [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]  # folds
    models = list(dict.fromkeys(replace(c, rep="mean") for c in cells))
    fits = advance(rows, _begun(rows, models, every, seed), rounds)
    score = {k: _Score(m, tuple(given), tuple(wanted), every[k % len(every)]) for k, f in fits.items() if (m := _mixture(f)) is not None}
    totals = gathered(rows, score | {-1: _Targets(tuple(wanted))})
    n, y, yy = totals[-1]
    sst = yy - y * y / n
    out = []
    for c in cells:
        keys = [models.index(replace(c, rep="mean")) * len(every) + i for i in range(len(every))]
        error = sum(totals[k][int(c.rep == "mode")] if k in totals else np.inf for k in keys)
        r2 = 1 - error / sst if sst > 0 else FAILED
        out.append(float(r2) if np.isfinite(r2) else FAILED)
    return out


@dataclass(frozen=True)
class Tuned:
    """The winner of a search, its score, the scores of all cells that were tried, and the winner fitted to all rows."""

    cell: Cell
    score: float
    tried: dict[Cell, float]
    fit: Fitting

    def table(self, spark) -> DataFrame:
        """The settings tried, each with its score."""
        return spark.createDataFrame(pd.DataFrame([vars(c) | {"score": s} for c, s in self.tried.items()]))


def _search(cells: list[Cell], score: Callable[[list[Cell]], list[float]], bayes: bool, rounds: int) -> dict[Cell, float]:
    if not bayes:
        return dict(zip(cells, score(cells)))
    numbers = np.array([c.numbers() for c in cells], float)
    done = bayes_grid(numbers, lambda which: score([cells[i] for i in which]), rounds)[1]
    return {cells[i]: s for i, s in sorted(done.items())}


def _won(rows: DataFrame, tried: dict[Cell, float], rounds: int, seed: int) -> Tuned:
    best = max(tried, key=lambda c: tried[c])
    fit = advance(rows, _begun(rows, [best], [None], seed), rounds)[0]
    return Tuned(best, tried[best], tried, fit)


def tune_regression(df: DataFrame, key: str, xs: list[str], ys: list[str], cells: list[Cell], fold_number: int = 5, rounds: int = 50, bayes: bool = False, bayes_rounds: int = 15, fold: str | None = None, seed: int = 0) -> Tuned:
    """The cell that predicts ys from xs best. With bayes, only 15 cells of a D-optimal start and those that the search asks for
    are scored, unless the grid is no larger than that. `fold` names a column of folds from 0; else keys are dealt by hash."""
    if not cells:
        raise ValueError("no cells to choose from")
    base = df if fold else folds(df, key, fold_number, seed)
    rows = vectors(base, [*xs, *ys], F.col(fold or "fold"))
    given, wanted = list(range(len(xs))), list(range(len(xs), len(xs) + len(ys)))
    tried = _search(cells, lambda some: cross_validate(rows, some, given, wanted, rounds, seed), bayes, bayes_rounds)
    return _won(rows, tried, rounds, seed)


def tune_map_by_neighbours(df: DataFrame, key: str, cols: list[str], cells: list[MapCell], k: int = 10, rounds: int = 20, bayes_rounds: int = 15, seed: int = 0) -> Tuned:
    """The map with the least sum of both k3n errors (data to map and map to data), searched over the cells; scores are negative errors."""
    rows = vectors(df, cols)
    points = df.dropna(subset=cols).select(F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))

    def score(some: list[Cell]) -> list[float]:
        models = list(dict.fromkeys(replace(c, rep="mean") for c in some))
        fits, found = advance(rows, _begun(rows, models, [None], seed), rounds), {}
        for i, m in enumerate(models):
            if _mixture(fits[i]) is None:
                found[m] = FAILED
                continue
            there = points.join(project(points, fits[i].model, "id", "v").select("id", F.col("mean").alias("z")), "id")
            both = [k3n_error(there, "id", a, b, k).first()["error"] for a, b in (("v", "z"), ("z", "v"))]
            found[m] = FAILED if None in both or not np.isfinite(sum(both)) else -sum(both)
        return [found[replace(c, rep="mean")] for c in some]

    return _won(rows, _search(cells, score, True, bayes_rounds), rounds, seed)
