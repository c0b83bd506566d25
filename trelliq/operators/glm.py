"""Ridge logistic and Poisson regression. With few inputs by Newton's method, each step one aggregation in Catalyst; with many by a limited-memory
quasi-Newton method, whose value and gradient are one pass of matrix products in Arrow batches and need no squares of inputs."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.linalg import lbfgs, newton
from ..sources.obs import VECTOR, ObservationError, added, vector_batch
from .emissions import logistic


def newton_sums(family: str, eta: Column, xs: list[Column], y: Column, w: Column) -> list[Column]:
    """Sums of the negative log-likelihood, its gradient and the upper triangle of its Hessian in the coefficients."""
    if family == "bernoulli":
        mean = E.logistic(eta)
        value, slope, bend = E.softplus(eta) - y * eta, mean - y, mean * (1 - mean)
    else:
        eta = F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0))
        mean = F.exp(eta)
        value, slope, bend = mean - y * eta, mean - y, mean
    out = [F.sum(w * value)] + [F.sum(w * slope * x) for x in xs]
    return out + [F.sum(w * bend * xs[i] * xs[j]) for i in range(len(xs)) for j in range(i, len(xs))]


def gradient_sums(family: str, x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """For K columns of coefficients (p, K) and weights (n, K): K negative log-likelihoods, then their gradients, (p, K) flat."""
    eta = x @ beta
    if family == "bernoulli":
        value, mean = np.logaddexp(0, eta) - y[:, None] * eta, logistic(eta)
    else:
        eta = np.clip(eta, -30, 30)
        mean = np.exp(eta)
        value = mean - y[:, None] * eta
    return np.concatenate([(w * value).sum(axis=0), (x.T @ (w * (mean - y[:, None]))).ravel()])


def _fit_wide(emissions: list, df: DataFrame, y: str, u: str, weights: list[str]) -> list:
    first, k = emissions[0], len(emissions)
    p, inputs, intercept, family = len(first.beta), first.input_dim, first.include_intercept, first.family
    penalty = np.stack([e.penalty() for e in emissions], axis=1)
    rows = df.select(F.get(F.col(y), F.lit(0)).cast("double").alias("y"), F.col(u).cast("array<double>").alias("u"), F.array(*[F.coalesce(w, F.lit(0.0)) for w in weights]).alias("w"))

    def objective(flat: np.ndarray) -> tuple[float, np.ndarray]:
        beta = flat.reshape(p, k)

        def run(batches):
            out = np.zeros(k + p * k)
            for b in batches:
                n, x = b.num_rows, b.column("u").flatten().to_numpy(zero_copy_only=False)
                if len(x) != n * inputs:
                    raise ObservationError(f"inputs that are not {inputs} numbers")
                x = x.reshape(n, inputs)
                x = np.hstack([np.ones((n, 1)), x]) if intercept else x
                out += gradient_sums(family, x, b.column("y").to_numpy(), b.column("w").flatten().to_numpy(zero_copy_only=False).reshape(n, k), beta)
            yield vector_batch(out)

        s = added(rows.mapInArrow(run, VECTOR), k + p * k)
        if np.isnan(s).any():
            raise ObservationError("NaN or infinite observations, inputs or weights")
        return float(s[:k].sum() + 0.5 * (penalty * beta**2).sum()), s[k:] + (penalty * beta).ravel()

    start = np.hstack([e.beta for e in emissions])
    beta = lbfgs(objective, start.ravel(), tolerance=1e-9).reshape(p, k)
    return [replace(e, beta=beta[:, i]) for i, e in enumerate(emissions)]


def fit_weighted(emissions: list, df: DataFrame, y: str, u: str, weights: list[Column]) -> list:
    """New coefficients for several emissions of one family, each with its own weight column; all share every aggregation.

    A row with a null in its target, inputs or weight says nothing and is left out; a NaN or infinite one is an ``ObservationError``.
    """
    first = emissions[0]
    p = len(first.beta)
    df = df.select(F.col(y).alias(y), F.col(u).alias(u), *[c.alias(f"w{k}") for k, c in enumerate(weights)])
    df = df.filter(~F.exists(u, lambda v: v.isNull()) & F.get(F.col(y), F.lit(0)).isNotNull() & F.coalesce(*[f"w{k}" for k in range(len(weights))]).isNotNull()).persist()
    weights = [F.col(f"w{k}") for k in range(len(weights))]
    if p > E.WIDE:
        try:
            return _fit_wide(emissions, df, y, u, [f"w{k}" for k in range(len(weights))])
        finally:
            df.unpersist()
    us = E.elements(F.col(u), first.input_dim)
    xs = [F.lit(1.0), *us] if first.include_intercept else us
    target = F.get(F.col(y), F.lit(0)).cast("double")
    size = 1 + p + p * (p + 1) // 2
    penalty = np.concatenate([e.penalty() for e in emissions])
    seen: dict[bytes, tuple] = {}

    def evaluate(flat: np.ndarray) -> tuple:
        key = flat.tobytes()
        if key not in seen:
            seen.clear()
            columns = []
            for k, w in enumerate(weights):
                columns += newton_sums(first.family, E.linear(xs, flat[k * p : (k + 1) * p]), xs, target, w)
            row = np.array([v or 0.0 for v in df.agg(*[c.alias(f"s{i}") for i, c in enumerate(columns)]).first()])
            if np.isnan(row).any() and np.isfinite(flat).all():
                raise ObservationError("NaN or infinite observations, inputs or weights")
            value, gradient, hessian = 0.0, np.zeros(len(flat)), np.zeros((len(flat),) * 2)
            for k in range(len(weights)):
                s, at = row[k * size : (k + 1) * size], slice(k * p, (k + 1) * p)
                h = np.zeros((p, p))
                h[np.triu_indices(p)] = s[1 + p :]
                value += s[0]
                gradient[at] = s[1 : 1 + p]
                hessian[at, at] = h + np.triu(h, 1).T
            seen[key] = value + 0.5 * float(penalty @ flat**2), gradient + penalty * flat, hessian + np.diag(penalty + 1e-12)
        return seen[key]

    start = np.concatenate([e.beta[:, 0] for e in emissions])
    try:
        flat = newton(lambda b: evaluate(b)[0], lambda b: evaluate(b)[1:], start, iterations=50, tolerance=1e-8)
    finally:
        df.unpersist()
    return [replace(e, beta=flat[k * p : (k + 1) * p]) for k, e in enumerate(emissions)]


def fit_glm(emission, df: DataFrame, y: str = "y", u: str = "u", w: str | None = None):
    """Minimum of the weighted negative log-likelihood plus l2/2 times the squared coefficients without the intercept."""
    return fit_weighted([emission], df, y, u, [F.col(w) if w else F.lit(1.0)])[0]


def fit_by_ascent(emissions: list, df: DataFrame, y: str, u: str, weights: list[Column]) -> list:
    """New parameters for emissions of any kind, each with its own weight column, by ascent of the weighted log-likelihood.

    An emission offers ``logpdf(y, u)``, ``parameters()``, a vector of any real numbers, and ``with_parameters(vector)``; its derivatives by these
    are ``score(y, u)``, (n, parameters), or else are taken by differences. All emissions share each pass over the rows, which gives the
    values and gradients. A row with a null weight says nothing; a likelihood that is NaN is an ``ObservationError``.
    """
    sizes = [len(e.parameters()) for e in emissions]
    ends, k = np.cumsum([0, *sizes]), len(emissions)
    rows = df.select(F.col(y).alias("y"), F.col(u).alias("u"), F.array(*[F.coalesce(w, F.lit(0.0)) for w in weights]).alias("w")).persist()

    def stacked(column: pa.Array) -> np.ndarray | None:
        return None if column.null_count == len(column) else np.stack(column.to_pandas().to_numpy()).astype(float)

    def objective(flat: np.ndarray) -> tuple[float, np.ndarray]:
        now = [e.with_parameters(flat[a:b]) for e, a, b in zip(emissions, ends[:-1], ends[1:], strict=True)]

        def run(batches):
            out = np.zeros(1 + len(flat))
            for batch in batches:
                if not batch.num_rows:
                    continue
                ys, us, w = stacked(batch.column("y")), stacked(batch.column("u")), stacked(batch.column("w"))
                for i, (e, a, b) in enumerate(zip(now, ends[:-1], ends[1:], strict=True)):
                    out[0] -= w[:, i] @ e.logpdf(ys, us)
                    out[1 + a : 1 + b] -= w[:, i] @ (e.score(ys, us) if hasattr(e, "score") else differences(e, ys, us))
            yield vector_batch(out)

        s = added(rows.mapInArrow(run, VECTOR), 1 + len(flat))
        return float(s[0]), s[1:]

    try:
        start = np.concatenate([e.parameters() for e in emissions])
        if not np.isfinite(objective(start)[0]):
            raise ObservationError("the likelihood of the observations is not a number")
        flat = lbfgs(objective, start, iterations=100, tolerance=1e-7)
    finally:
        rows.unpersist()
    return [e.with_parameters(flat[a:b]) for e, a, b in zip(emissions, ends[:-1], ends[1:], strict=True)]


def differences(emission, y: np.ndarray, u: np.ndarray | None) -> np.ndarray:
    """Derivatives of each row's log-density by the emission's parameters, by central differences."""
    at = np.asarray(emission.parameters(), float)
    out = np.empty((len(y), len(at)))
    for i, v in enumerate(at):
        step = np.zeros(len(at))
        step[i] = 1e-6 * max(1.0, abs(v))
        out[:, i] = (emission.with_parameters(at + step).logpdf(y, u) - emission.with_parameters(at - step).logpdf(y, u)) / (2 * step[i])
    return out
