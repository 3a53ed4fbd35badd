"""Exact Gaussian processes, one per objective, in numpy.

Training sets are the few dozen rows that a campaign has measured, so fitting is driver-side;
pools are scored on the executors with the fitted model broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .climb import climb


@dataclass
class Process:
    """Zero-mean process with an ARD squared-exponential kernel on unit-scaled inputs."""

    x: np.ndarray
    length: np.ndarray
    noise: np.ndarray
    mean: float
    scale: float
    chol: np.ndarray
    alpha: np.ndarray

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a / self.length, b / self.length
        d = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)
        return np.exp(-0.5 * d)


@dataclass
class Surrogate:
    low: np.ndarray
    span: np.ndarray
    parts: list[Process]

    def unit(self, x: np.ndarray) -> np.ndarray:
        return (np.asarray(x, float) - self.low) / self.span

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and variances, [n, m], in the objectives' own units."""
        u, means, variances = self.unit(x), [], []
        for p in self.parts:
            k = p.kernel(u, p.x)
            v = np.linalg.solve(p.chol, k.T)
            means.append(p.mean + p.scale * (k @ p.alpha))
            variances.append(p.scale**2 * np.maximum(1 - (v * v).sum(0), 1e-12))
        return np.stack(means, 1), np.stack(variances, 1)

    def conditional(self, base: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For joint sampling with rows ``base``: of each objective its mean and Cholesky factor there."""
        u, out = self.unit(base), []
        for p in self.parts:
            k = p.kernel(u, p.x)
            v = np.linalg.solve(p.chol, k.T)
            cov = p.kernel(u, u) - v.T @ v
            out.append((k @ p.alpha, np.linalg.cholesky(cov + 1e-6 * np.eye(len(u)))))
        return out


def _evidence(x, y, length, noise):
    d = ((x[:, None] / length - x[None] / length) ** 2).sum(2)
    k = np.exp(-0.5 * d) + np.diag(noise + 1e-6)
    chol = np.linalg.cholesky(k)
    a = np.linalg.solve(chol, y)
    return float(-0.5 * a @ a - np.log(np.diag(chol)).sum()), chol, np.linalg.solve(chol.T, a)


def _prior(log_length, log_noise, d):
    """Log-normal priors: lengths grow with the root of the dimension, noise is small."""
    centre = np.sqrt(2) + 0.5 * np.log(d)
    return -0.5 * (((log_length - centre) / np.sqrt(3)) ** 2).sum() - 0.5 * (log_noise + 4.0) ** 2


def posterior_mode(u: np.ndarray, z: np.ndarray, fixed: np.ndarray | None):
    """A function of the logarithms of the lengths and the noise, to log evidence and log prior
    together, and to their gradient. ``fixed`` noise leaves only the prior's share in the last one."""
    d = u.shape[1]
    square = (u[:, None] - u[None]) ** 2

    def value(h: np.ndarray) -> tuple[float, np.ndarray]:
        length = np.exp(h[:-1])
        noise = np.full(len(u), np.exp(h[-1])) if fixed is None else fixed
        try:
            score, chol, alpha = _evidence(u, z, length, noise)
        except np.linalg.LinAlgError:
            return -np.inf, np.zeros(d + 1)
        inverse = np.linalg.inv(chol)
        # half the trace of (alpha alpha' - K^-1) dK, of a symmetric dK the sum over its elements
        weight = 0.5 * (np.outer(alpha, alpha) - inverse.T @ inverse)
        kernel = np.exp(-0.5 * (square / length**2).sum(2))
        slope = np.empty(d + 1)
        slope[:-1] = np.einsum("ij,ij,ijk->k", weight, kernel, square) / length**2 - (h[:-1] - np.sqrt(2) - 0.5 * np.log(d)) / 3
        slope[-1] = (np.exp(h[-1]) * np.trace(weight) if fixed is None else 0.0) - (h[-1] + 4.0)
        return score + _prior(h[:-1], h[-1], d), slope

    return value


#: The box that the logarithms of lengths and noise are looked for in.
LENGTHS, NOISES = (-6.0, 8.0), (-14.0, 4.0)


def fit(x: np.ndarray, y: np.ndarray, y_var: np.ndarray | None = None, tries: int = 160, starts: int = 4, seed: int = 0) -> Surrogate:
    """Posterior-mode hyper-parameters: the best of seeded tries are climbed from, by the gradient."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if x.ndim != 2 or y.ndim != 2 or len(x) != len(y) or not len(x):
        raise ValueError(f"X and Y must be two-dimensional with as many rows, got {x.shape} and {y.shape}")
    if y_var is not None and np.shape(y_var) != y.shape:
        raise ValueError("Yvar must have the shape of Y")
    low = x.min(0)
    span = np.where(x.max(0) > low, x.max(0) - low, 1.0)
    u, d = (x - low) / span, x.shape[1]
    parts = []
    for j in range(y.shape[1]):
        mean, scale = y[:, j].mean(), y[:, j].std(ddof=1) if len(y) > 1 else 1.0
        scale = scale if scale > 0 else 1.0
        z = (y[:, j] - mean) / scale
        fixed = None if y_var is None else np.asarray(y_var, float)[:, j] / scale**2

        value = posterior_mode(u, z, fixed)
        r = np.random.default_rng(seed + j)
        trial = np.concatenate((r.uniform(-2, 2.5, (tries, 1)) + r.normal(0, 0.6, (tries, d)), r.uniform(-8, -0.5, (tries, 1))), 1)
        scores = np.array([value(h)[0] for h in trial])
        bounds = (np.array([*[LENGTHS[k]] * d, NOISES[k]]) for k in (0, 1))
        low_h, high_h = bounds
        tops = [climb(value, trial[i], low_h, high_h) for i in np.argsort(-scores, kind="stable")[:starts]]
        h = max(tops, key=lambda t: t[1])[0]
        noise = np.full(len(u), np.exp(h[-1])) if fixed is None else fixed
        _, chol, alpha = _evidence(u, z, np.exp(h[:-1]), noise)
        parts.append(Process(u, np.exp(h[:-1]), noise, float(mean), float(scale), chol, alpha))
    return Surrogate(low, span, parts)


def posterior(pool: DataFrame, model: Surrogate) -> DataFrame:
    """``pool(id, x)`` with mean and variance arrays, scored on the executors."""
    sent = pool.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for pdf in batches:
            if len(pdf):
                m, v = sent.value.posterior(np.stack(pdf["x"].to_numpy()))
                yield pd.DataFrame({"id": pdf["id"], "mean": list(m), "variance": list(v)})

    return pool.select("id", "x").mapInPandas(score, "id bigint, mean array<double>, variance array<double>")
