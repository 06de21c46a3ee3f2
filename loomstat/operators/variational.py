"""Variational Gaussian mixtures: surplus components lose their weight.

Posteriors: Dirichlet weights or the sticks of a Dirichlet process, Gaussian means given precisions, Wishart precisions (one
of each component, one of all, or gamma laws of single variables or of one scale). A round is one scan that adds up
responsibilities and their moments; the rest is algebra on the driver. The evidence bound needs no further pass: with
responsibilities at their optimum it is the sum of the log totals, which the scan brings, less the divergences of the
posteriors from their priors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from .em import Fitting, Moments, advance, gathered, mean_and_covariance, settled, split_sums, start_mixture, start_rows, vectors, weighted_sums
from .mixtures import Mixture, safe_covariance

PROCESS, DISTRIBUTION = "dirichlet_process", "dirichlet_distribution"
log_gamma = np.vectorize(math.lgamma, otypes=[float])


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of log gamma for positive x: carried up to 10 by its recurrence, then its asymptotic series."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    while (low := x < 10).any():
        shift = np.where(low, shift - 1 / x, shift)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


@dataclass(frozen=True)
class Wishart:
    """A law of precision matrices with `dof` degrees of freedom and mean dof * inverse(inverse_scale)."""

    dof: float
    inverse_scale: np.ndarray

    def _halves(self) -> np.ndarray:
        return (self.dof + 1 - np.arange(1, len(self.inverse_scale) + 1)) / 2

    def mean(self) -> np.ndarray:
        return self.dof * np.linalg.inv(self.inverse_scale)

    def log_det(self) -> float:
        """The expected logarithm of the determinant."""
        return float(digamma(self._halves()).sum() + len(self.inverse_scale) * math.log(2) - np.linalg.slogdet(self.inverse_scale)[1])

    def log_norm(self) -> float:
        d = len(self.inverse_scale)
        return float(self.dof / 2 * (d * math.log(2) - np.linalg.slogdet(self.inverse_scale)[1]) + d * (d - 1) / 4 * math.log(math.pi) + log_gamma(self._halves()).sum())

    def divergence(self, prior: Wishart) -> float:
        d = len(self.inverse_scale)
        pulled = np.trace(prior.inverse_scale @ self.mean()) - self.dof * d
        return (self.dof - prior.dof) / 2 * self.log_det() + pulled / 2 + prior.log_norm() - self.log_norm()


@dataclass(frozen=True)
class VariationalFit:
    """A variational mixture under way; history is the evidence bound, which never falls."""

    sizes: np.ndarray
    means: np.ndarray
    laws: tuple[tuple[Wishart, ...], ...]  # of each component, the laws of its blocks of variables; of one tuple, of all
    prior_mean: np.ndarray
    prior_cov: np.ndarray
    kind: str = "full"
    weights: str = PROCESS
    concentration: float = 0.01
    fold: int | None = None
    tolerance: float = 1e-7
    history: tuple[float, ...] = ()
    done: bool = False
    prior_strength: float = 1.0

    @staticmethod
    def begin(start: Mixture, rows: float, mean: np.ndarray, cov: np.ndarray, **settings) -> VariationalFit:
        """The posterior as if the start were the moments of so many rows."""
        n = start.weights * rows
        empty = VariationalFit(n, start.means, (), mean, safe_covariance(cov), start.kind, **settings)
        return empty._updated(n, n[:, None] * start.means, n[:, None, None] * (start.covariances + start.means[:, :, None] * start.means[:, None, :]))

    def _strength(self) -> np.ndarray:
        return self.prior_strength + self.sizes

    def _prior(self) -> tuple[Wishart, ...]:
        d, c = len(self.prior_mean), self.prior_cov
        if self.kind == "diag":
            return tuple(Wishart(d, c[i : i + 1, i : i + 1]) for i in range(d))
        return (Wishart(d, np.array([[np.trace(c) / d]]) if self.kind == "spherical" else c),)

    def _updated(self, n: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> VariationalFit:
        m0, b0 = self.prior_mean, self.prior_strength
        b = b0 + n
        means = (b0 * m0 + s1) / b[:, None]
        scatter = s2 + b0 * np.outer(m0, m0) - b[:, None, None] * means[:, :, None] * means[:, None, :]
        prior, d = self._prior(), len(m0)
        if self.kind == "tied":
            laws = ((Wishart(prior[0].dof + n.sum(), prior[0].inverse_scale + scatter.sum(0)),),)
        elif self.kind == "diag":
            laws = tuple(tuple(Wishart(p.dof + n[k], p.inverse_scale + scatter[k, i, i]) for i, p in enumerate(prior)) for k in range(len(n)))
        elif self.kind == "spherical":
            laws = tuple((Wishart(prior[0].dof + d * n[k], prior[0].inverse_scale + np.trace(scatter[k])),) for k in range(len(n)))
        else:
            laws = tuple((Wishart(prior[0].dof + n[k], prior[0].inverse_scale + scatter[k]),) for k in range(len(n)))
        return replace(self, sizes=n, means=means, laws=laws)

    def _law(self, k: int) -> tuple[Wishart, ...]:
        return self.laws[k if len(self.laws) > 1 or self.kind != "tied" else 0]

    def precision(self, k: int) -> np.ndarray:
        d, law = len(self.prior_mean), self._law(k)
        if self.kind == "diag":
            return np.diag([w.mean()[0, 0] for w in law])
        return np.eye(d) * law[0].mean()[0, 0] if self.kind == "spherical" else law[0].mean()

    def _log_det(self, k: int) -> float:
        return sum(w.log_det() for w in self._law(k)) * (len(self.prior_mean) if self.kind == "spherical" else 1)

    def _sticks(self) -> tuple[np.ndarray, np.ndarray]:
        return 1 + self.sizes, self.concentration + np.concatenate([np.cumsum(self.sizes[::-1])[::-1][1:], [0.0]])

    def log_weights(self) -> np.ndarray:
        """The expected logarithms of the weights."""
        if self.weights == DISTRIBUTION:
            a = self.concentration + self.sizes
            return digamma(a) - digamma(a.sum())
        a, b = self._sticks()
        left = digamma(b) - digamma(a + b)
        return digamma(a) - digamma(a + b) + np.concatenate([[0.0], np.cumsum(left)[:-1]])

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        d, out = x.shape[1], []
        for k, (lw, b) in enumerate(zip(self.log_weights(), self._strength())):
            z = x - self.means[k]
            out.append(lw + 0.5 * (self._log_det(k) - d * math.log(2 * math.pi) - d / b - ((z @ self.precision(k)) * z).sum(1)))
        return np.stack(out, 1)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return weighted_sums(x, self.log_parts(x))

    def divergence(self) -> float:
        """Of the posteriors of weights, means and precisions from their priors."""
        c = self.concentration
        if self.weights == DISTRIBUTION:
            a, k = c + self.sizes, len(self.sizes)
            out = math.lgamma(a.sum()) - log_gamma(a).sum() - math.lgamma(k * c) + k * math.lgamma(c) + (self.sizes * (digamma(a) - digamma(a.sum()))).sum()
        else:
            a, b = self._sticks()
            beta = log_gamma(a) + log_gamma(b) - log_gamma(a + b)
            out = (-math.log(c) - beta + (a - 1) * digamma(a) + (b - c) * digamma(b) + (1 - a + c - b) * digamma(a + b)).sum()
        d, b0, b = len(self.prior_mean), self.prior_strength, self._strength()
        for k in range(len(b)):
            z = self.means[k] - self.prior_mean
            out += 0.5 * (d * (b0 / b[k] - math.log(b0 / b[k]) - 1) + b0 * z @ self.precision(k) @ z)
        return float(out + sum(w.divergence(p) for law in self.laws for w, p in zip(law, self._prior())))

    def step(self, s: np.ndarray) -> VariationalFit:
        n, s1, s2, total, _ = split_sums(s, *self.means.shape)
        history = (*self.history, total - self.divergence())
        if settled(history, self.tolerance):
            return replace(self, history=history, done=True)
        return replace(self._updated(n, s1, s2), history=history)

    def mixture(self) -> Mixture:
        """Posterior means as a plain mixture: prediction in every direction follows from it."""
        if self.weights == DISTRIBUTION:
            w = self.concentration + self.sizes
        else:
            a, b = self._sticks()
            w = a / (a + b) * np.concatenate([[1.0], np.cumprod(b / (a + b))[:-1]])
        return Mixture(w / w.sum(), self.means, np.stack([safe_covariance(np.linalg.inv(self.precision(k))) for k in range(len(w))]), self.kind)


def fit_variational(df: DataFrame, cols: list[str], components: int = 30, kind: str = "full", weights: str = PROCESS, concentration: float = 0.01, rounds: int = 100, seed: int = 0) -> VariationalFit:
    """The variational mixture of the rows of df that have no null in cols."""
    rows = vectors(df, cols)
    totals = gathered(rows, {0: Moments()})
    if not totals:
        raise ValueError("no row without nulls to fit to")
    n, mean, cov = mean_and_covariance(totals[0], len(cols))
    start = start_mixture(start_rows(rows, seed)[0], mean, cov, components, kind, seed)
    begun: Fitting = VariationalFit.begin(start, n, mean, cov, weights=weights, concentration=concentration)
    return advance(rows, {0: begun}, rounds)[0]
