"""Emission models. Parameters are immutable; ``fit`` and ``mstep`` return new ones.

Rows of a design matrix are time steps. A closed-form emission sums a vector of statistics over rows with weights and solves for
its parameters on the driver; the others minimise a convex objective by Newton steps, each one aggregation (see ``glm``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.linalg import make_posdef, stabilize_covariance, undefined
from .families import EmissionFamily, RegressionFamily


class Emission(Protocol):
    """What a state's observation model offers; users may pass their own."""

    closed_form: bool

    def logpdf(self, y: np.ndarray, u: np.ndarray | None) -> np.ndarray: ...

    def sample(self, rng: np.random.Generator, n: int, u: np.ndarray | None = None) -> np.ndarray: ...


def _array(x) -> np.ndarray:
    a = np.array(x, float)
    a.setflags(write=False)
    return a


def logistic(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


@dataclass(frozen=True, repr=False)
class GaussianEmission(EmissionFamily):
    """y ~ N(mean, cov)."""

    mean: np.ndarray
    cov: np.ndarray
    closed_form = True

    def __post_init__(self):
        object.__setattr__(self, "mean", _array(self.mean))
        object.__setattr__(self, "cov", _array(self.cov))
        if self.cov.shape != (len(self.mean),) * 2:
            raise ValueError("mean and covariance do not fit together")

    @property
    def output_dim(self) -> int:
        return len(self.mean)

    def logpdf(self, y, u=None):
        low = np.linalg.cholesky(self.cov)
        z = np.linalg.solve(low, (y - self.mean).T)
        return -0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * len(self.mean) * math.log(2 * math.pi)

    def logpdf_expr(self, y: list[Column], u: list[Column] | None = None) -> Column:
        return E.mvn_logpdf(y, self.mean, self.cov)

    def statistics(self, y, u, w) -> np.ndarray:
        return np.concatenate([[w.sum()], w @ y, ((y * w[:, None]).T @ y).ravel()])

    def width(self) -> int:
        d = self.output_dim
        return 1 + d + d * d

    def mstep(self, s: np.ndarray) -> GaussianEmission:
        d = self.output_dim
        n, sy, syy = s[0], s[1 : 1 + d], s[1 + d :].reshape(d, d)
        if n <= 0:
            return self
        if not np.isfinite(s).all():
            return undefined(self)
        mean = sy / n
        return GaussianEmission(mean, stabilize_covariance(syy / n - np.outer(mean, mean)))

    def sample(self, rng, n, u=None):
        return rng.multivariate_normal(self.mean, self.cov, size=n, method="cholesky")

    def moved(self, y: np.ndarray, u: np.ndarray | None = None) -> GaussianEmission:
        """The same emission of observations that are moved by ``y``."""
        return replace(self, mean=self.mean + y)

    def fit(self, df: DataFrame, y: str = "y", w: str | None = None) -> GaussianEmission:
        """Weighted mean and covariance (divided by the sum of weights) of an array column: means first, then moments about them."""
        weight = F.col(w) if w else F.lit(1.0)
        ys = E.elements(F.col(y), self.output_dim)
        centre = E.weighted_means(df, ys, weight)
        n, s, q = E.second_moments(df, ys, weight, centre)
        return self.moved(-centre).mstep(np.concatenate([[n], s, q.ravel()])).moved(centre)


@dataclass(frozen=True, repr=False)
class _Regression(RegressionFamily):
    """beta is (inputs [+ 1], outputs), the intercept's row first; ``l2`` penalises all rows but the intercept's."""

    beta: np.ndarray
    include_intercept: bool = True
    l2: float = 0.0

    def __post_init__(self):
        beta = np.array(self.beta, float)
        object.__setattr__(self, "beta", _array(beta.reshape(len(beta), -1)))

    @property
    def input_dim(self) -> int:
        return len(self.beta) - self.include_intercept

    @property
    def output_dim(self) -> int:
        return self.beta.shape[1]

    def design(self, u: np.ndarray) -> np.ndarray:
        u = np.asarray(u, float).reshape(len(u), -1)
        return np.hstack([np.ones((len(u), 1)), u]) if self.include_intercept else u

    def penalty(self) -> np.ndarray:
        p = np.full(len(self.beta), float(self.l2))
        if self.include_intercept:
            p[0] = 0.0
        return p

    def regularization(self) -> float:
        return 0.5 * float((self.penalty()[:, None] * self.beta**2).sum())

    def regularization_gradient(self) -> np.ndarray:
        return self.penalty()[:, None] * self.beta

    def predictor_exprs(self, u: list[Column]) -> list[Column]:
        xs = [F.lit(1.0), *u] if self.include_intercept else u
        return [E.linear(xs, self.beta[:, j]) for j in range(self.output_dim)]


@dataclass(frozen=True, repr=False)
class GaussianRegressionEmission(_Regression):
    """y ~ N(beta' [1, u], cov). ``normalized=False`` scores by -r'r/2 alone, whatever the covariance."""

    cov: np.ndarray = field(default=None)
    normalized: bool = True
    closed_form = True

    def __post_init__(self):
        super().__post_init__()
        object.__setattr__(self, "cov", _array(np.eye(self.output_dim) if self.cov is None else self.cov))

    def logpdf(self, y, u):
        r = y - self.design(u) @ self.beta
        if not self.normalized:
            return -0.5 * (r * r).sum(axis=1)
        return GaussianEmission(np.zeros(self.output_dim), self.cov).logpdf(r)

    def logpdf_expr(self, y, u):
        r = [a - b for a, b in zip(y, self.predictor_exprs(u), strict=True)]
        return E.mvn_logpdf(r, np.zeros(len(r)), self.cov) if self.normalized else -0.5 * E.total([x * x for x in r])

    def statistics(self, y, u, w):
        x = self.design(u)
        xw = x * w[:, None]
        return np.concatenate([[w.sum()], (xw.T @ x).ravel(), (xw.T @ y).ravel(), ((y * w[:, None]).T @ y).ravel()])

    def width(self) -> int:
        p, d = self.beta.shape
        return 1 + p * p + p * d + d * d

    def mstep(self, s):
        p, d = self.beta.shape
        n, sxx, sxy, syy = s[0], s[1 : 1 + p * p].reshape(p, p), s[1 + p * p : 1 + p * p + p * d].reshape(p, d), s[1 + p * p + p * d :].reshape(d, d)
        if n <= 0:
            return self
        if not np.isfinite(s).all():
            return undefined(self)
        beta = np.linalg.lstsq(sxx + np.diag(self.penalty()), sxy, rcond=None)[0]
        scatter = syy - sxy.T @ beta - beta.T @ sxy + beta.T @ sxx @ beta
        return replace(self, beta=beta, cov=make_posdef(scatter / n))

    def sample(self, rng, n, u=None):
        mean = self.design(u) @ self.beta
        return mean + rng.multivariate_normal(np.zeros(self.output_dim), self.cov, size=len(mean), method="cholesky")

    def moved(self, y: np.ndarray, u: np.ndarray | None = None):
        """The same emission of observations moved by ``y`` and inputs moved by ``u``; None without an intercept to take them up."""
        if not self.include_intercept:
            return None
        beta = np.array(self.beta)
        beta[0] += y - (0 if u is None else u @ beta[1:])
        return replace(self, beta=beta)

    def fit(self, df: DataFrame, y: str = "y", u: str = "u", w: str | None = None):
        """Weighted ridge regression by its normal equations; with an intercept about the means, which are found first."""
        weight = F.col(w) if w else F.lit(1.0)
        p, d = self.input_dim, self.output_dim
        cols = [*E.elements(F.col(u), p), *E.elements(F.col(y), d)]
        centre = E.weighted_means(df, cols, weight) if self.include_intercept else np.zeros(p + d)
        n, s, q = E.second_moments(df, cols, weight, centre)
        if self.include_intercept:
            q = np.block([[np.array([[n]]), s[None, :]], [s[:, None], q]])
        k = len(self.beta)
        new = (self.moved(-centre[p:], -centre[:p]) or self).mstep(np.concatenate([[n], q[:k, :k].ravel(), q[:k, k:].ravel(), q[k:, k:].ravel()]))
        return new.moved(centre[p:], centre[:p]) or new


@dataclass(frozen=True, repr=False)
class AutoRegressionEmission(GaussianRegressionEmission):
    """y_t ~ N(beta' [1, y_{t-1}, ..., y_{t-order}], cov); the lags are the row's u (see ``lagged``)."""

    order: int = 1

    def __post_init__(self):
        super().__post_init__()
        if self.input_dim != self.order * self.output_dim:
            raise ValueError("beta needs order * output_dim input rows")

    def sample_next(self, rng: np.random.Generator, past: np.ndarray) -> np.ndarray:
        """The step after ``past`` (at least ``order`` rows, oldest first)."""
        return self.sample(rng, 1, past[::-1][: self.order].reshape(1, -1))[0]


@dataclass(frozen=True, repr=False)
class BernoulliRegressionEmission(_Regression):
    """y ~ Bernoulli(logistic(beta' [1, u])); one output."""

    closed_form = False
    family = "bernoulli"

    def logpdf(self, y, u):
        p = np.clip(logistic(self.design(u) @ self.beta), np.finfo(float).eps, 1 - np.finfo(float).eps)
        return (y * np.log(p) + (1 - y) * np.log1p(-p)).sum(axis=1)

    def logpdf_expr(self, y, u):
        return E.total([a * eta - E.softplus(eta) for a, eta in zip(y, self.predictor_exprs(u), strict=True)])

    def sample(self, rng, n, u=None):
        p = logistic(self.design(u) @ self.beta)
        return (rng.random(p.shape) < p).astype(float)

    def fit(self, df: DataFrame, y: str = "y", u: str = "u", w: str | None = None):
        from .glm import fit_glm

        return fit_glm(self, df, y, u, w)


@dataclass(frozen=True, repr=False)
class PoissonRegressionEmission(_Regression):
    """y ~ Poisson(exp(beta' [1, u])); the predictor is clamped to +-30."""

    closed_form = False
    family = "poisson"

    def logpdf(self, y, u):
        eta = np.clip(self.design(u) @ self.beta, -30, 30)
        return (y * eta - np.exp(eta) - _lgamma(y + 1)).sum(axis=1)

    def logpdf_expr(self, y, u):
        eta = [F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0)) for x in self.predictor_exprs(u)]
        return E.total([a * x - F.exp(x) - E.log_factorial(a) for a, x in zip(y, eta, strict=True)])

    def sample(self, rng, n, u=None):
        return rng.poisson(np.exp(np.clip(self.design(u) @ self.beta, -30, 30))).astype(float)

    def fit(self, df: DataFrame, y: str = "y", u: str = "u", w: str | None = None):
        from .glm import fit_glm

        return fit_glm(self, df, y, u, w)


def loglikelihood(emission, df: DataFrame, y: str = "y", u: str = "u", w: str | None = None) -> DataFrame:
    """``df`` with the (weighted) log-likelihood of each row under an emission, as a column ``ll``."""
    us = E.elements(F.col(u), emission.input_dim) if isinstance(emission, _Regression) else None
    ll = emission.logpdf_expr(E.elements(F.col(y), emission.output_dim), us)
    return df.withColumn("ll", ll * F.col(w) if w else ll)


def sample_rows(emission: Emission, spark: SparkSession, n: int, seed: int = 0, inputs: Callable[[np.random.Generator, int], np.ndarray] | None = None) -> DataFrame:
    """(id, u, y): n draws from any emission; ``inputs(rng, rows)`` makes a regression's covariates, without it they are normal.

    A block of 4096 ids has a generator of its own, so results do not depend on partitioning.
    """
    block = 4096
    width = emission.input_dim if isinstance(emission, _Regression) else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, ids in pdf.groupby(pdf["id"] // block)["id"]:
                rng = np.random.Generator(np.random.Philox(key=[seed, int(number)]))
                u = None if not width else inputs(rng, block) if inputs else rng.standard_normal((block, width))
                y = emission.sample(rng, block, u).reshape(block, -1)
                at = (ids % block).to_numpy()
                yield pd.DataFrame({"id": ids.to_numpy(), "u": list(u[at]) if width else None, "y": list(y[at])})

    return spark.range(n).mapInPandas(run, "id long, u array<double>, y array<double>")


def lagged(obs: DataFrame, order: int, include_current: bool = False, intercept: bool = False) -> DataFrame:
    """``obs`` (trial_id, t, y, ...) with autoregressive features in ``u``, without the steps that lack a full past.

    By default y_{t-1}, ..., y_{t-order}. With ``include_current`` the steps t-order..t, oldest first, each after a 1 if ``intercept``.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("trial_id").orderBy("t")
    if include_current:
        step = F.concat(F.array(F.lit(1.0)), F.col("y")) if intercept else F.col("y")
        u = F.flatten(F.collect_list(step).over(w.rowsBetween(-order, 0)))
    else:
        u = F.concat(*[F.lag("y", i).over(w) for i in range(1, order + 1)])
    return obs.withColumn("u", u).filter(F.col("t") > order)
