"""Covariance kernels as values that add and multiply, and Gaussian processes fitted by the gradient of their marginal likelihood.

Parameters are logarithms, one after the other in the order of the expression. Everything here runs inside a task or on the
bounded observations of a campaign.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

#: Logarithms between which parameters are kept.
LOW, HIGH = np.log(1e-5), np.log(1e5)


class Kernel:
    def __add__(self, other: Kernel) -> Kernel:
        return Sum(self, other)

    def __mul__(self, other: Kernel) -> Kernel:
        return Product(self, other)

    def theta(self) -> np.ndarray:
        raise NotImplementedError

    def with_theta(self, t: np.ndarray) -> Kernel:
        raise NotImplementedError

    def full(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The matrix of the rows with themselves, and its slopes by each parameter."""
        raise NotImplementedError

    def cross(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def diag(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError


@dataclass(frozen=True)
class Constant(Kernel):
    value: float = 1.0

    def theta(self) -> np.ndarray:
        return np.array([np.log(self.value)])

    def with_theta(self, t: np.ndarray) -> Kernel:
        return Constant(float(np.exp(t[0])))

    def full(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        k = np.full((len(x), len(x)), self.value)
        return k, [k]

    def cross(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        return np.full((len(x), len(z)), self.value)

    def diag(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


@dataclass(frozen=True)
class White(Kernel):
    """Noise of each row for itself."""

    noise: float = 1.0

    def theta(self) -> np.ndarray:
        return np.array([np.log(self.noise)])

    def with_theta(self, t: np.ndarray) -> Kernel:
        return White(float(np.exp(t[0])))

    def full(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        k = self.noise * np.eye(len(x))
        return k, [k]

    def cross(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        return np.zeros((len(x), len(z)))

    def diag(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.noise)


@dataclass(frozen=True)
class Dot(Kernel):
    sigma: float = 1.0

    def theta(self) -> np.ndarray:
        return np.array([np.log(self.sigma)])

    def with_theta(self, t: np.ndarray) -> Kernel:
        return Dot(float(np.exp(t[0])))

    def full(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return self.cross(x, x), [np.full((len(x), len(x)), 2 * self.sigma**2)]

    def cross(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        return self.sigma**2 + x @ z.T

    def diag(self, x: np.ndarray) -> np.ndarray:
        return self.sigma**2 + (x * x).sum(1)


@dataclass(frozen=True)
class Stationary(Kernel):
    """Kernels of the distance after dividing each variable by its scale; one scale serves all variables."""

    scales: tuple[float, ...] = (1.0,)

    def theta(self) -> np.ndarray:
        return np.log(self.scales)

    def with_theta(self, t: np.ndarray) -> Kernel:
        return replace(self, scales=tuple(np.exp(t).tolist()))

    def _squares(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """(variables, rows of x, rows of z); with one scale the variables are summed."""
        s = np.broadcast_to(self.scales, x.shape[1])
        d = np.stack([((x[:, None, j] - z[None, :, j]) / s[j]) ** 2 for j in range(x.shape[1])])
        return d if len(self.scales) > 1 else d.sum(0, keepdims=True)

    def shape(self, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kernel, and its slope by the logarithm of a scale over that scale's squares."""
        raise NotImplementedError

    def full(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        d = self._squares(x, x)
        k, slope = self.shape(d.sum(0))
        return k, [slope * part for part in d]

    def cross(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        return self.shape(self._squares(x, z).sum(0))[0]

    def diag(self, x: np.ndarray) -> np.ndarray:
        return np.ones(len(x))


@dataclass(frozen=True)
class RBF(Stationary):
    def shape(self, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.exp(-r2 / 2)
        return k, k


@dataclass(frozen=True)
class Matern(Stationary):
    nu: float = 1.5

    def shape(self, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = np.sqrt(r2)
        if self.nu == 0.5:
            k = np.exp(-r)
            return k, np.divide(k, r, out=np.zeros_like(k), where=r > 0)
        if self.nu == 1.5:
            e = np.exp(-np.sqrt(3) * r)
            return (1 + np.sqrt(3) * r) * e, 3 * e
        if self.nu == 2.5:
            a = np.sqrt(5) * r
            e = np.exp(-a)
            return (1 + a + a * a / 3) * e, 5 / 3 * (1 + a) * e
        raise ValueError("nu is 0.5, 1.5 or 2.5")


@dataclass(frozen=True)
class Sum(Kernel):
    a: Kernel
    b: Kernel

    def theta(self) -> np.ndarray:
        return np.concatenate([self.a.theta(), self.b.theta()])

    def with_theta(self, t: np.ndarray) -> Kernel:
        n = len(self.a.theta())
        return type(self)(self.a.with_theta(t[:n]), self.b.with_theta(t[n:]))

    def full(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        (k, d), (q, e) = self.a.full(x), self.b.full(x)
        return k + q, d + e

    def cross(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        return self.a.cross(x, z) + self.b.cross(x, z)

    def diag(self, x: np.ndarray) -> np.ndarray:
        return self.a.diag(x) + self.b.diag(x)


class Product(Sum):
    def full(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        (k, d), (q, e) = self.a.full(x), self.b.full(x)
        return k * q, [s * q for s in d] + [k * s for s in e]

    def cross(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        return self.a.cross(x, z) * self.b.cross(x, z)

    def diag(self, x: np.ndarray) -> np.ndarray:
        return self.a.diag(x) * self.b.diag(x)


def usual_kernels(scales: tuple[float, ...], all_eleven: bool = True) -> list[Kernel]:
    """The compositions to choose from: dot product, and each stationary kernel without and with one. `scales` starts one scale a
    variable; without all_eleven the two Gaussian kernels of a single scale are left out."""
    linear = Constant() * Dot()
    out: list[Kernel] = [linear + White()]
    several: list[Kernel] = [RBF((1.0,))] if all_eleven else []
    for k in [*several, RBF(tuple(scales)), Matern((1.0,), 1.5), Matern((1.0,), 0.5), Matern((1.0,), 2.5)]:
        out += [Constant() * k + White(), Constant() * k + White() + linear]
    return out


def climb(f, t: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """The (t, value) at which f, which returns value and gradient, is greatest within the bounds: quasi-Newton steps, halved until they rise."""
    value, slope = f(t)
    h = np.eye(len(t))
    for _ in range(rounds):
        free = ~((t <= LOW) & (slope < 0) | (t >= HIGH) & (slope > 0))
        step = np.where(free, h @ np.where(free, slope, 0), 0)
        if step @ slope <= 0:
            h, step = np.eye(len(t)), np.where(free, slope, 0)
        rate = min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        for _ in range(30):
            new = np.clip(t + rate * step, LOW, HIGH)
            got = f(new)
            if np.isfinite(got[0]) and got[0] > value + 1e-4 * (slope @ (new - t)):
                break
            rate /= 2
        else:
            break
        moved, bend = new - t, slope - got[1]
        gain, t, value, slope = got[0] - value, new, *got
        if (c := moved @ bend) > 1e-12:
            v = np.eye(len(t)) - np.outer(moved, bend) / c
            h = v @ h @ v.T + np.outer(moved, moved) / c
        if gain < 1e-7 * max(1.0, abs(value)):
            break
    return t, value


def log_marginal(kernel: Kernel, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The log marginal likelihood of y, and its slope by the kernel's parameters; -inf where the matrix has no root."""
    k, slopes = kernel.full(x)
    try:
        low = np.linalg.cholesky(k + 1e-10 * np.eye(len(x)))
    except np.linalg.LinAlgError:
        return -np.inf, np.zeros(len(slopes))
    inverse = np.linalg.inv(k + 1e-10 * np.eye(len(x)))
    a = inverse @ y
    value = -0.5 * y @ a - np.log(np.diag(low)).sum() - 0.5 * len(x) * np.log(2 * np.pi)
    pull = np.outer(a, a) - inverse
    return float(value), np.array([0.5 * (pull * s).sum() for s in slopes])


@dataclass(frozen=True)
class KernelProcess:
    """Gaussian process regression on autoscaled x and y; the kernel's parameters climb the marginal likelihood."""

    kernel: Kernel

    def fit(self, x: np.ndarray, y: np.ndarray) -> dict:
        mx, sx, my, sy = x.mean(0), x.std(0, ddof=1), y.mean(), y.std(ddof=1)
        sx, sy = np.where(sx > 0, sx, 1.0), sy if sy > 0 else 1.0
        z, t = (x - mx) / sx, (y - my) / sy
        theta, value = climb(lambda p: log_marginal(self.kernel.with_theta(p), z, t), self.kernel.theta())
        kernel = self.kernel.with_theta(theta)
        inverse = np.linalg.inv(kernel.full(z)[0] + 1e-10 * np.eye(len(z)))
        return {"kernel": kernel, "x": z, "inverse": inverse, "a": inverse @ t, "value": value, "mx": mx, "sx": sx, "my": my, "sy": sy}

    def predict_both(self, state: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x - state["mx"]) / state["sx"]
        k = state["kernel"].cross(z, state["x"])
        var = state["kernel"].diag(z) - ((k @ state["inverse"]) * k).sum(1)
        return k @ state["a"] * state["sy"] + state["my"], np.sqrt(np.maximum(var, 1e-12)) * state["sy"]

    def predict(self, state: dict, x: np.ndarray) -> np.ndarray:
        return self.predict_both(state, x)[0]


_erf = np.vectorize(__import__("math").erf, otypes=[float])


@dataclass(frozen=True)
class PreferenceFit:
    """A latent score from pairs (winner, loser) of rows of x: probit likelihood, Laplace approximation by Newton steps."""

    kernel: Kernel
    jitter: float = 1e-6

    def fit(self, x: np.ndarray, pairs: np.ndarray) -> dict:
        n = len(x)
        k = self.kernel.full(x)[0] + self.jitter * np.eye(n)
        f, w = np.zeros(n), np.zeros((n, n))
        a, b = pairs[:, 0], pairs[:, 1]
        for _ in range(40):
            z = f[a] - f[b]
            p = np.maximum(0.5 * (1 + _erf(z / np.sqrt(2))), 1e-9)
            r = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) / p
            h, slope, w = r * (r + z), np.zeros(n), np.zeros((n, n))
            np.add.at(slope, a, r)
            np.add.at(slope, b, -r)
            for i, j, s in ((a, a, 1), (b, b, 1), (a, b, -1), (b, a, -1)):
                np.add.at(w, (i, j), s * h)
            new = np.linalg.solve(np.eye(n) + k @ w, k @ (w @ f + slope))
            moved, f = np.abs(new - f).max(), new
            if moved < 1e-6:
                break
        # k' (k + w^-1)^-1 k, written without the inverse of w
        return {"x": x, "a": np.linalg.solve(k, f), "back": w @ np.linalg.inv(np.eye(n) + k @ w)}

    def predict_both(self, state: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.kernel.cross(x, state["x"])
        return k @ state["a"], np.sqrt(np.maximum(1e-12, self.kernel.diag(x) - ((k @ state["back"]) * k).sum(1)))
