"""Switching linear dynamical systems: a Markov chain chooses which of K systems moves and observes at each step."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.linalg import BlockTridiagonal, is_probvec, undefined
from ..sources.obs import by_trial, finite, kept, matrix, refuse_faults, summed, trials
from .families import DynamicalFamily
from .hmm import _log, posterior
from .lds import LinearDynamicalSystem, PoissonObservation, _poisson_curvature, minimise_poisson, poisson_terms


@dataclass(frozen=True, repr=False)
class SLDS(DynamicalFamily):
    a: np.ndarray
    pi: np.ndarray
    systems: tuple[LinearDynamicalSystem, ...]

    def __post_init__(self):
        object.__setattr__(self, "a", np.array(self.a, float))
        object.__setattr__(self, "pi", np.array(self.pi, float))
        object.__setattr__(self, "systems", tuple(self.systems))
        k = len(self.pi)
        if self.a.shape != (k, k) or len(self.systems) != k:
            raise ValueError("a, pi and systems disagree about the number of states")
        if not is_probvec(self.pi) or not all(is_probvec(r) for r in self.a):
            raise ValueError("pi and the rows of a must be probability vectors")
        if len({(s.latent_dim, s.obs_dim) for s in self.systems}) != 1:
            raise ValueError("systems differ in their dimensions")
        if len({s.poisson for s in self.systems}) != 1:
            raise TypeError("systems mix Gaussian and Poisson observations")

    @property
    def k(self) -> int:
        return len(self.pi)

    def __repr__(self) -> str:
        return f"SLDS(k={self.k}, systems=[{self.systems[0]!r}, ...])"

    # One trial; w is (K, T)

    def loglik(self, x, y, w) -> float:
        return float(sum((w[k] * s.loglik(x, y)).sum() for k, s in enumerate(self.systems)))

    def gradient(self, x, y, w) -> np.ndarray:
        return sum(s.gradient(x, y, w[k]) for k, s in enumerate(self.systems))

    def neg_hessian(self, x, w) -> tuple[np.ndarray, np.ndarray]:
        parts = [s.neg_hessian(x, w[k]) for k, s in enumerate(self.systems)]
        return sum(p[0] for p in parts), sum(p[1] for p in parts)

    def smooth_trial(self, y, w, start=None, iterations: int = 100, tolerance: float = 1e-8):
        """Path's mode under state weights, covariances and entropy."""
        x = np.zeros((len(y), self.systems[0].latent_dim)) if start is None else np.array(start, float)
        if self.systems[0].poisson:
            x = self._mode(x, y, w, iterations, tolerance)
            system = BlockTridiagonal(*self.neg_hessian(x, w))
        else:  # quadratic: one step is exact
            system = BlockTridiagonal(*self.neg_hessian(x, w))
            x = x + system.solve(self.gradient(x, y, w))
        diag, lag = system.selected_inverse()
        entropy = 0.5 * x.size * (1 + math.log(2 * math.pi)) - 0.5 * system.log_det()
        return x, diag, lag, entropy

    def _mode(self, x, y, w, iterations: int, tolerance: float) -> np.ndarray:
        now = -self.loglik(x, y, w)
        with np.errstate(over="ignore", invalid="ignore"):
            for _ in range(iterations):
                g = self.gradient(x, y, w)
                step = BlockTridiagonal(*self.neg_hessian(x, w)).solve(g)
                size, slope = 1.0, float((g * step).sum())
                while True:
                    new = x + size * step
                    then = -self.loglik(new, y, w)
                    if then <= now - 1e-4 * size * slope or size < 1e-12:
                        break
                    size /= 2
                if not then <= now:
                    break
                x, now = new, then
                if np.abs(size * step).max() < tolerance:
                    break
        return x

    def infer_trial(self, rng, x, cov, y):
        """One E-step: sample a path, score it by every system, infer the states, smooth under their weights."""
        sampled, _ = sample_posterior(rng, x, cov)
        ll = np.stack([s.loglik(sampled, y) for s in self.systems], axis=1)[None]
        gamma, xi, _ = posterior(ll, np.array([len(y)]), _log(self.a), _log(self.pi))
        w = gamma[0].T
        return w, xi[0], *self.smooth_trial(y, w, start=x)

    def _uniform(self, y) -> np.ndarray:
        return np.full((self.k, len(y)), 1 / self.k)

    # Tables

    def smooth(self, obs: DataFrame, weights: str | None = None) -> DataFrame:
        """(trial_id, t, x, p, p_lag, entropy) under the state weights in an array column, uniform without."""
        from .lds import _smoothed

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for some in trials(batches):
                for p in some:
                    y = matrix(p, "y")
                    w = matrix(p, weights).T if weights else self._uniform(y)
                    yield _smoothed(p, *self.smooth_trial(y, w))

        cols = ["trial_id", "t", "y", *([weights] if weights else [])]
        return by_trial(obs.select(*cols)).mapInPandas(run, "trial_id long, t int, x array<double>, p array<double>, p_lag array<double>, entropy double")

    def fit(self, obs: DataFrame, max_iters: int = 50, seed: int = 0, strict: bool = True) -> tuple[SLDS, list[float]]:
        """Variational Laplace EM, ``max_iters`` rounds: (model, ELBO of each round). Paths between rounds are ``kept``.

        An observation that is not finite is an error, or with ``strict=False`` makes every parameter NaN, as sums over it are.
        """
        if not strict and not finite(obs, "y"):
            return undefined(self), [math.nan] * max_iters
        n, k = self.systems[0].latent_dim, self.k
        width = self.systems[0].width()
        # About the means of the data, so that covariances keep their digits.
        poisson = self.systems[0].poisson
        means = np.zeros(self.systems[0].obs_dim) if poisson else E.weighted_means(obs, E.elements(F.col("y"), self.systems[0].obs_dim), F.lit(1.0))
        arranged = by_trial(obs.select("trial_id", "t", F.col("y") if poisson else F.zip_with("y", E.lit_array(means), lambda a, b: a - b).alias("y")))
        refuse_faults(arranged)
        schema = "trial_id long, t int, y array<double>, x array<double>, p array<double>, p_lag array<double>, w array<double>, xi array<double>, entropy double"
        flat = lambda a: list(a.reshape(len(a), -1))

        def table(p, y, x, cov, lag, w, xi, entropy) -> pd.DataFrame:
            return pd.DataFrame({
                "trial_id": p["trial_id"].to_numpy(), "t": p["t"].to_numpy(), "y": list(y), "x": list(x), "p": flat(cov), "p_lag": flat(lag), "w": list(w.T), "xi": [xi.ravel()] * len(y), "entropy": entropy,
            })

        model, history = SLDS(self.a, self.pi, tuple(s._moved(-means) for s in self.systems)), []

        def first(batches, model=model):
            for some in trials(batches):
                parts = []
                for p in some:
                    y = matrix(p, "y")
                    x, cov, lag, entropy = model.smooth_trial(y, self._uniform(y))
                    parts.append(table(p, y, x, cov, lag, self._uniform(y), np.zeros((k, k)), entropy))
                yield pd.concat(parts, ignore_index=True)

        paths = arranged.mapInPandas(first, schema).persist()
        for it in range(max_iters):

            def estep(batches, model=model, it=it):
                for some in trials(batches):
                    parts = []
                    for p in some:
                        y, x, cov = matrix(p, "y"), matrix(p, "x"), matrix(p, "p").reshape(-1, n, n)
                        rng = np.random.Generator(np.random.Philox(key=[seed * 1000003 + it, int(p["trial_id"].iat[0]) & ((1 << 63) - 1)]))
                        w, xi, x, cov, lag, entropy = model.infer_trial(rng, x, cov, y)
                        parts.append(table(p, y, x, cov, lag, w, xi, entropy))
                    yield pd.concat(parts, ignore_index=True)

            new = kept(paths.mapInPandas(estep, schema), it)

            def statistics(p, model=model):
                y, x, w = matrix(p, "y"), matrix(p, "x"), matrix(p, "w").T
                cov, lag = matrix(p, "p").reshape(-1, n, n), matrix(p, "p_lag").reshape(-1, n, n)
                g = np.clip(w, 1e-300, 1)
                chain = [[1.0, model.loglik(x, y, w), float(p["entropy"].iat[0]), -float((w * np.log(g)).sum())], w[:, 0], np.asarray(p["xi"].iat[0])]
                parts = [np.concatenate([s.sums(x, cov, lag, y, w[i]), [0.0, 1.0]]) for i, s in enumerate(model.systems)]
                return np.concatenate([*chain, *parts])

            s = summed(new, statistics, 4 + k + k * k + k * width)
            paths.unpersist()
            paths = new
            w1, xi = s[4 : 4 + k], s[4 + k : 4 + k + k * k].reshape(k, k)
            history.append(float(s[1] + w1 @ np.log(model.pi + 1e-12) + (xi * np.log(model.a + 1e-12)).sum() + s[2] + s[3]))
            rows = xi.sum(axis=1, keepdims=True)
            a = np.where(rows > 0, xi / np.where(rows > 0, rows, 1), model.a)
            pi = w1 / w1.sum()
            at, systems = 4 + k + k * k, []
            for i, lds in enumerate(model.systems):
                out = lds.mstep(s[at : at + width])
                if lds.poisson and lds.fit_parts[4]:

                    def objective(c, log_d, i=i):
                        def terms(p):
                            return poisson_terms(matrix(p, "x"), matrix(p, "p").reshape(-1, n, n), matrix(p, "y"), matrix(p, "w")[:, i], c, log_d)

                        found = summed(paths, terms, 1 + c.size + len(log_d))
                        return float(found[0]), found[1:]

                    bend = _poisson_curvature(paths, lds.obs.c, lds.obs.log_d, lambda p, i=i: matrix(p, "w")[:, i])
                    out = replace(out, obs=PoissonObservation(*minimise_poisson(objective, lds.obs.c, lds.obs.log_d, curvature=bend)))
                systems.append(out)
                at += width
            model = SLDS(a / a.sum(axis=1, keepdims=True), pi, tuple(systems))
        paths.unpersist()
        return SLDS(model.a, model.pi, tuple(s._moved(means) for s in model.systems)), history

    # Sampling

    def sample_trial(self, rng: np.random.Generator, steps: int, compat: bool = False):
        """States (from 1), path and observations; with ``compat`` step t moves by the system of step t-1."""
        n = self.systems[0].latent_dim
        z, x, y = np.empty(steps, int), np.empty((steps, n)), np.empty((steps, self.systems[0].obs_dim))
        for t in range(steps):
            z[t] = rng.choice(self.k, p=self.pi if t == 0 else self.a[z[t - 1]])
            st = self.systems[z[t - 1] if compat and t else z[t]].state
            x[t] = rng.multivariate_normal(st.x0, st.p0, method="cholesky") if t == 0 else st.a @ x[t - 1] + st.b + np.linalg.cholesky(st.q) @ rng.standard_normal(n)
            o = self.systems[z[t]].obs
            h = o.c @ x[t] + o.d
            y[t] = rng.poisson(np.exp(h)) if isinstance(o, PoissonObservation) else h + np.linalg.cholesky(o.r) @ rng.standard_normal(len(h))
        return z + 1, x, y

    def sample(self, spark: SparkSession, n_trials: int, steps: int, seed: int = 0, compat: bool = False) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in pdf["id"]:
                    z, x, y = self.sample_trial(np.random.Generator(np.random.Philox(key=[seed, int(i)])), steps, compat)
                    yield pd.DataFrame({"trial_id": i, "t": np.arange(1, steps + 1, dtype=np.int32), "state": z.astype(np.int32), "x": list(x), "y": list(y), "w": 1.0})

        return spark.range(n_trials).mapInPandas(run, "trial_id long, t int, state int, x array<double>, y array<double>, w double")


def sample_posterior(rng: np.random.Generator, x: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, float]:
    """A draw from each step's marginal, and the sum of the marginals' entropies; covariances get growing jitter if need be."""
    n = x.shape[1]
    for attempt in range(6):
        try:
            low = np.linalg.cholesky(cov if attempt == 0 else cov + 1e-8 * 10 ** (attempt - 1) * np.eye(n))
            break
        except np.linalg.LinAlgError:
            if attempt == 5:
                raise
    draw = x + np.einsum("tij,tj->ti", low, rng.standard_normal(x.shape))
    entropy = 0.5 * x.size * (1 + math.log(2 * math.pi)) + float(np.log(np.diagonal(low, axis1=1, axis2=2)).sum())
    return draw, entropy


def sample_posteriors(smoothed: DataFrame, n_samples: int = 1, seed: int = 0) -> DataFrame:
    """(trial_id, sample_id, t, x) draws from a smoother's table, per-step marginals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in trials(batches):
            for p in some:
                x = matrix(p, "x")
                cov = matrix(p, "p").reshape(len(x), x.shape[1], -1)
                for i in range(n_samples):
                    rng = np.random.Generator(np.random.Philox(key=[seed * 1000003 + i, int(p["trial_id"].iat[0]) & ((1 << 63) - 1)]))
                    yield pd.DataFrame({"trial_id": p["trial_id"].to_numpy(), "sample_id": np.int32(i), "t": p["t"].to_numpy(), "x": list(sample_posterior(rng, x, cov)[0])})

    return by_trial(smoothed.select("trial_id", "t", "x", "p")).mapInPandas(run, "trial_id long, sample_id int, t int, x array<double>")


def weighted_loglik(df: DataFrame, w: str = "w", lls: str = "lls") -> DataFrame:
    """``df`` with ``ll``: each step's state log-likelihoods weighted by its state probabilities."""
    return df.withColumn("ll", F.aggregate(F.zip_with(w, lls, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
