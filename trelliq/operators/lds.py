"""Linear dynamical systems with Gaussian or Poisson observations over collections of trials.

x_1 ~ N(x0, p0), x_t ~ N(a x_{t-1} + b, q); y_t ~ N(c x_t + d, r), or Poisson(exp(c x_t + d)) with d = exp(log_d).

A trial's smoother is a Newton method on its whole path with a block-tridiagonal Hessian, O(T D^3); for Gaussian observations one
step is exact and all trials of a length share one factorisation. A fit sends one vector of sums per task to the driver.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expr as E
from ..functions.display import Described
from ..functions.linalg import BlockTridiagonal, iw_log_prior, iw_map, make_posdef, stabilize_covariance, undefined, valid_covariance
from ..sources.obs import by_trial, finite, kept, matrix, numbers, refuse_faults, summed, trials
from .families import DynamicalFamily, ObservationFamily, StateFamily

log = logging.getLogger(__name__)


@dataclass(frozen=True, repr=False)
class IWPrior(Described):
    """Inverse-Wishart prior of a covariance."""

    psi: np.ndarray
    nu: float


def _freeze(self, names) -> None:
    for n in names:
        object.__setattr__(self, n, np.array(getattr(self, n), float))


@dataclass(frozen=True, repr=False)
class GaussianState(StateFamily):
    a: np.ndarray
    q: np.ndarray
    b: np.ndarray
    x0: np.ndarray
    p0: np.ndarray
    q_prior: IWPrior | None = None
    p0_prior: IWPrior | None = None

    def __post_init__(self):
        _freeze(self, ("a", "q", "b", "x0", "p0"))


@dataclass(frozen=True, repr=False)
class GaussianObservation(ObservationFamily):
    c: np.ndarray
    r: np.ndarray
    d: np.ndarray
    r_prior: IWPrior | None = None

    def __post_init__(self):
        _freeze(self, ("c", "r", "d"))


@dataclass(frozen=True, repr=False)
class PoissonObservation(ObservationFamily):
    c: np.ndarray
    log_d: np.ndarray

    def __post_init__(self):
        _freeze(self, ("c", "log_d"))

    @property
    def d(self) -> np.ndarray:
        return np.exp(self.log_d)


def validate(state: GaussianState, obs: GaussianObservation | PoissonObservation) -> list[str]:
    """What is wrong with a model's parameters; empty if nothing."""
    n, p, bad = len(state.x0), len(obs.c), []
    shapes = {"a": (state.a, (n, n)), "q": (state.q, (n, n)), "b": (state.b, (n,)), "p0": (state.p0, (n, n)), "c": (obs.c, (p, n))}
    shapes |= {"r": (obs.r, (p, p)), "d": (obs.d, (p,))} if isinstance(obs, GaussianObservation) else {"log_d": (obs.log_d, (p,))}
    bad += [f"{k} has shape {v.shape}, not {s}" for k, (v, s) in shapes.items() if v.shape != s]
    if not bad:
        covs = {"q": state.q, "p0": state.p0} | ({"r": obs.r} if isinstance(obs, GaussianObservation) else {})
        bad += [f"{k} is not a covariance" for k, v in covs.items() if not valid_covariance(v)]
        if isinstance(obs, PoissonObservation) and (np.abs(obs.log_d) > 50).any():
            bad.append("log_d is beyond 50")
    return bad


#: Parts of a model that a fit may change, in the order of fit flags.
PARTS = ("x0", "p0", "ab", "q", "c", "r")


@dataclass(frozen=True, repr=False)
class LinearDynamicalSystem(DynamicalFamily):
    state: GaussianState
    obs: GaussianObservation | PoissonObservation
    fit_parts: tuple[bool, ...] = (True,) * 6

    def __post_init__(self):
        if bad := validate(self.state, self.obs):
            raise ValueError("; ".join(bad))
        need = 6 if isinstance(self.obs, GaussianObservation) else 5
        parts = tuple(bool(x) for x in self.fit_parts)
        if len(parts) == 6 and need == 5:
            parts = parts[:5]
        if len(parts) != need:
            raise ValueError(f"fit_parts needs {need} entries")
        object.__setattr__(self, "fit_parts", parts)

    @property
    def poisson(self) -> bool:
        return isinstance(self.obs, PoissonObservation)

    @property
    def latent_dim(self) -> int:
        return len(self.state.x0)

    @property
    def obs_dim(self) -> int:
        return len(self.obs.c)

    def __repr__(self) -> str:
        fitted = ", ".join(n for n, f in zip(PARTS, self.fit_parts, strict=False) if f)
        return f"LinearDynamicalSystem(latent_dim={self.latent_dim}, obs_dim={self.obs_dim}, {'Poisson' if self.poisson else 'Gaussian'}, fits {fitted})"

    def parameters(self) -> np.ndarray:
        s, o = self.state, self.obs
        tail = [o.c, o.log_d] if self.poisson else [o.c, o.r, o.d]
        return np.concatenate([np.ravel(v) for v in (s.a, s.q, s.b, s.x0, s.p0, *tail)])

    def rotated(self, r: np.ndarray) -> LinearDynamicalSystem:
        """The same system in latent coordinates r x."""
        s, inv = self.state, np.linalg.inv(r)
        state = replace(s, a=r @ s.a @ inv, q=_sym(r @ s.q @ r.T), b=r @ s.b, x0=r @ s.x0, p0=_sym(r @ s.p0 @ r.T))
        return replace(self, state=state, obs=replace(self.obs, c=self.obs.c @ inv))

    # One trial

    def loglik(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, normalized: bool = False) -> np.ndarray:
        """Complete-data log-density of each step, weighted; without normalisers and ln y! unless ``normalized``."""
        s, o = self.state, self.obs
        res = np.vstack([x[:1] - s.x0, x[1:] - x[:-1] @ s.a.T - s.b])
        out = np.empty(len(x))
        out[0] = -0.5 * res[0] @ np.linalg.solve(s.p0, res[0])
        out[1:] = -0.5 * np.einsum("ti,ti->t", res[1:], np.linalg.solve(s.q, res[1:].T).T)
        h = x @ o.c.T + o.d
        if self.poisson:
            out += (y * h - np.exp(h)).sum(axis=1)
        else:
            e = y - h
            out += -0.5 * np.einsum("ti,ti->t", e, np.linalg.solve(o.r, e.T).T)
        if normalized:
            ld = lambda m: np.linalg.slogdet(m)[1] + len(m) * math.log(2 * math.pi)
            out[0] -= 0.5 * ld(s.p0)
            out[1:] -= 0.5 * ld(s.q)
            out -= np.vectorize(math.lgamma)(y + 1).sum(axis=1) if self.poisson else 0.5 * ld(o.r)
        return out if w is None else out * w

    def gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        """Derivative of the (weighted) complete-data log-density by the path; step t's weight goes with its own terms."""
        s, o = self.state, self.obs
        w = np.ones(len(x)) if w is None else w
        h = x @ o.c.T + o.d
        e = y - np.exp(h) if self.poisson else np.linalg.solve(o.r, (y - h).T).T
        g = (e @ o.c) * w[:, None]
        g[0] -= w[0] * np.linalg.solve(s.p0, x[0] - s.x0)
        if len(x) > 1:
            res = np.linalg.solve(s.q, (x[1:] - x[:-1] @ s.a.T - s.b).T).T * w[1:, None]
            g[1:] -= res
            g[:-1] += res @ s.a
        return g

    def neg_hessian(self, x: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Blocks on and below the diagonal of minus the Hessian of the (weighted) complete-data log-density."""
        s, o, t = self.state, self.obs, len(x)
        w = np.ones(t) if w is None else w
        if self.poisson:
            main = np.einsum("tp,pi,pj->tij", np.exp(x @ o.c.T + o.d) * w[:, None], o.c, o.c)
        else:
            main = w[:, None, None] * (o.c.T @ np.linalg.solve(o.r, o.c))
        qi = np.linalg.inv(s.q)
        main[0] += w[0] * np.linalg.inv(s.p0)
        main[1:] += w[1:, None, None] * qi
        main[:-1] += w[1:, None, None] * (s.a.T @ qi @ s.a)
        return main, -w[1:, None, None] * (qi @ s.a)

    def smooth_trial(self, y: np.ndarray, w: np.ndarray | None = None, start: np.ndarray | None = None, factors: dict | None = None):
        """Path's mode, its covariances (t, t) and (t, t-1), and the entropy of the Gaussian there."""
        t = len(y)
        shared = factors if factors is not None and w is None and not self.poisson else None
        x = np.zeros((t, self.latent_dim)) if start is None else np.array(start, float)
        if self.poisson:
            x = self._mode(y, w, x)
            system = BlockTridiagonal(*self.neg_hessian(x, w))
            diag, lag = system.selected_inverse()
        else:
            if shared is not None and t in shared:
                system, diag, lag = shared[t]
            else:
                system = BlockTridiagonal(*self.neg_hessian(x, w))
                diag, lag = system.selected_inverse()
                if shared is not None:
                    shared[t] = (system, diag, lag)
            with np.errstate(invalid="ignore"):
                x = x + system.solve(self.gradient(x, y, w))
            # The step after an infinite observation differs from what is expected there by one infinity from another.
            if not np.isfinite(y[:-1]).all():
                x = np.full_like(x, math.nan)
            elif not np.isfinite(y[-1]).all():
                x = self.ended(y[-1] if w is None else w[-1] * y[-1], diag, lag)
        entropy = 0.5 * t * self.latent_dim * (1 + math.log(2 * math.pi)) - 0.5 * system.log_det()
        return x, diag, lag, entropy

    def ended(self, last: np.ndarray, diag: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Path before and at an observation that is the only one not finite, and a trial's last, from the path's covariances.

        As a filter and the smoother after it give it, step by step: infinities of one sign stay, and those of both signs are NaN.
        """
        x = np.empty(diag.shape[:2])
        with np.errstate(invalid="ignore"):
            x[-1] = (np.linalg.solve(self.obs.r, self.obs.c @ diag[-1]).T * last).sum(axis=1)
            for t in range(len(x) - 1, 0, -1):
                x[t - 1] = (np.linalg.solve(diag[t], lag[t]).T * x[t]).sum(axis=1)
        return x

    def _mode(self, y, w, x, iterations: int = 100, tolerance: float = 1e-8):
        value = lambda z: -self.loglik(z, y, w).sum()
        with np.errstate(over="ignore", invalid="ignore"):
            now = value(x)
            for _ in range(iterations):
                g = self.gradient(x, y, w)
                step = BlockTridiagonal(*self.neg_hessian(x, w)).solve(g)
                size, slope = 1.0, float((g * step).sum())
                while True:
                    new = x + size * step
                    then = value(new)
                    if then <= now - 1e-4 * size * slope or size < 1e-12:
                        break
                    size /= 2
                if not then <= now:
                    break
                x, now = new, then
                if np.abs(size * step).max() < tolerance:
                    break
        return x

    def marginal_trial(self, y: np.ndarray, rng: np.random.Generator, draws: int) -> tuple[float, float, float]:
        """Log-likelihood of a trial's observations, its Laplace approximation, and the effective number of draws.

        The Gaussian at the path's mode, with the block-tridiagonal Hessian there as precision, gives the approximation; draws from it in
        pairs on either side of the mode, weighted by the ratio of densities, remove its error. For Gaussian observations both are exact.
        """
        w = None
        x = self._mode(y, w, np.zeros((len(y), self.latent_dim))) if self.poisson else self.smooth_trial(y)[0]
        system = BlockTridiagonal(*self.neg_hessian(x))
        size = x.size
        top = self.loglik(x, y, normalized=True).sum()
        laplace = top + 0.5 * size * math.log(2 * math.pi) - 0.5 * system.log_det()
        if not self.poisson or draws < 2:
            return float(laplace), float(laplace), float(max(draws, 1))
        half = system.draws(rng.standard_normal((draws // 2, *x.shape)))
        z = np.concatenate([half, -half])
        main, sub = self.neg_hessian(x)
        quad = np.einsum("nti,tij,ntj->n", z, main, z) + 2 * np.einsum("nti,tij,ntj->n", z[:, 1:], sub, z[:, :-1])
        log_w = np.array([self.loglik(x + v, y, normalized=True).sum() for v in z]) - top + 0.5 * quad
        peak = log_w.max()
        weights = np.exp(log_w - peak)
        return float(laplace + peak + math.log(weights.mean())), float(laplace), float(weights.sum() ** 2 / (weights**2).sum())

    # Sums over trials

    def width(self) -> int:
        n, p = self.latent_dim, self.obs_dim
        return 3 + n + n * n + 3 * n * n + 2 * n + n + n * n + p + p * p + p * n + 2

    def sums(self, x, cov, lag, y, w) -> np.ndarray:
        """Everything that the closed-form updates and the Gaussian ELBO need, from one trial."""
        ww = w[:, None]
        ezz = cov + x[:, :, None] * x[:, None, :]
        prev = lag[1:] + x[1:, :, None] * x[:-1, None, :]
        v = w[1:]
        parts = [
            [w[0], v.sum(), w.sum()], w[0] * x[0], w[0] * ezz[0], np.tensordot(v, ezz[1:], 1), np.tensordot(v, ezz[:-1], 1), np.tensordot(v, prev, 1), v @ x[1:], v @ x[:-1],
            w @ x, np.tensordot(w, ezz, 1), w @ y, (y * ww).T @ y, (y * ww).T @ x,
        ]
        return np.concatenate([np.ravel(p) for p in parts])

    def unpack(self, s: np.ndarray) -> dict[str, np.ndarray]:
        n, p = self.latent_dim, self.obs_dim
        shapes = {"n0": (), "n": (), "m": (), "z1": (n,), "zz1": (n, n), "s11": (n, n), "s00": (n, n), "s10": (n, n), "mu1": (n,), "mu0": (n,), "sz": (n,), "szz": (n, n), "sy": (p,), "syy": (p, p), "syz": (p, n)}
        out, at = {}, 0
        for k, shape in shapes.items():
            size = int(np.prod(shape))
            out[k] = s[at : at + size].reshape(shape)
            at += size
        out["entropy"], out["ntrials"] = s[at], s[at + 1]
        return out

    def _scatter_state(self, u, a, b) -> np.ndarray:
        return (
            u["s11"] - u["s10"] @ a.T - a @ u["s10"].T + a @ u["s00"] @ a.T - np.outer(u["mu1"], b) - np.outer(b, u["mu1"]) + a @ np.outer(u["mu0"], b) + np.outer(b, u["mu0"]) @ a.T + u["n"] * np.outer(b, b)
        )

    def _scatter_obs(self, u, c, d) -> np.ndarray:
        return u["syy"] - u["syz"] @ c.T - c @ u["syz"].T + c @ u["szz"] @ c.T - np.outer(u["sy"], d) - np.outer(d, u["sy"]) + c @ np.outer(u["sz"], d) + np.outer(d, u["sz"]) @ c.T + u["m"] * np.outer(d, d)

    def mstep(self, s: np.ndarray) -> LinearDynamicalSystem:
        """x0, p0, (a, b), q and, for Gaussian observations, (c, d), r, where fitted."""
        u, st, ob, fit = self.unpack(s), self.state, self.obs, self.fit_parts
        n = self.latent_dim
        x0 = u["z1"] / u["n0"] if fit[0] and u["n0"] > 0 else st.x0
        p0 = st.p0
        if fit[1] and u["n0"] > 0:
            spread = _sym(u["zz1"] - np.outer(u["z1"], x0) - np.outer(x0, u["z1"]) + u["n0"] * np.outer(x0, x0))
            p0 = stabilize_covariance(iw_map(st.p0_prior.psi, st.p0_prior.nu, spread, u["n0"]) if st.p0_prior else spread / u["n0"])
        a, b, q = st.a, st.b, st.q
        if fit[2] and u["n"] > 0:
            szz = np.block([[u["s00"], u["mu0"][:, None]], [u["mu0"][None, :], u["n"].reshape(1, 1)]])
            ab = np.linalg.lstsq(szz, np.hstack([u["s10"], u["mu1"][:, None]]).T, rcond=None)[0].T
            a, b = ab[:, :n], ab[:, n]
        if fit[3] and u["n"] > 0:
            scatter = _sym(self._scatter_state(u, a, b))
            q = stabilize_covariance(iw_map(st.q_prior.psi, st.q_prior.nu, scatter, u["n"]) if st.q_prior else scatter / u["n"])
        if not self.poisson:
            c, d, r = ob.c, ob.d, ob.r
            if fit[4]:
                szz = np.block([[u["szz"], u["sz"][:, None]], [u["sz"][None, :], u["m"].reshape(1, 1)]])
                cd = np.linalg.lstsq(szz, np.hstack([u["syz"], u["sy"][:, None]]).T, rcond=None)[0].T
                c, d = cd[:, :n], cd[:, n]
            if fit[5]:
                scatter = _sym(self._scatter_obs(u, c, d))
                r = stabilize_covariance(iw_map(ob.r_prior.psi, ob.r_prior.nu, scatter, u["m"]) if ob.r_prior else scatter / u["m"])
            ob = replace(ob, c=c, d=d, r=r)
        return replace(self, state=replace(st, a=a, b=b, q=q, x0=x0, p0=p0), obs=ob)

    def expected_state(self, s: np.ndarray) -> float:
        """Expected log-density of the latent paths, without 2 pi."""
        u, st = self.unpack(s), self.state
        first = _sym(u["zz1"] - np.outer(u["z1"], st.x0) - np.outer(st.x0, u["z1"]) + u["n0"] * np.outer(st.x0, st.x0))
        ld = lambda m: np.linalg.slogdet(m)[1]
        return -0.5 * float(u["n0"] * ld(st.p0) + np.trace(np.linalg.solve(st.p0, first)) + u["n"] * ld(st.q) + np.trace(np.linalg.solve(st.q, self._scatter_state(u, st.a, st.b))))

    def expected_obs(self, s: np.ndarray) -> float:
        """Expected log-density of Gaussian observations."""
        u, o = self.unpack(s), self.obs
        return -0.5 * float(u["m"] * (np.linalg.slogdet(o.r)[1] + self.obs_dim * math.log(2 * math.pi)) + np.trace(np.linalg.solve(o.r, self._scatter_obs(u, o.c, o.d))))

    def log_priors(self) -> float:
        st, out = self.state, 0.0
        for cov, prior in ((st.q, st.q_prior), (st.p0, st.p0_prior), *([] if self.poisson else [(self.obs.r, self.obs.r_prior)])):
            if prior is not None:
                out += iw_log_prior(cov, prior.psi, prior.nu)
        return out

    def elbo(self, s: np.ndarray, expected_poisson: float = 0.0, compat: bool = False) -> float:
        """Expected log-density plus entropy plus priors. ``compat`` leaves 2 pi out of the state's part and subtracts the entropy."""
        u = self.unpack(s)
        obs = expected_poisson if self.poisson else self.expected_obs(s)
        if compat:
            return self.expected_state(s) + obs + self.log_priors() - float(u["entropy"])
        two_pi = -0.5 * float(u["n0"] + u["n"]) * self.latent_dim * math.log(2 * math.pi)
        return self.expected_state(s) + two_pi + obs + self.log_priors() + float(u["entropy"])

    # Tables

    def smooth(self, obs: DataFrame, stretch: int | None = None) -> DataFrame:
        """(trial_id, t, x, p, p_lag, entropy); matrices are flat, row by row, entropy is the trial's.

        With ``stretch`` trials of Gaussian observations are cut into stretches of so many steps, for those too long for one task.
        """
        model = self
        if stretch:
            return self._smooth_stretches(obs, stretch)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            factors: dict = {}
            for some in trials(batches):
                yield pd.concat([_smoothed(p, *model.smooth_trial(matrix(p, "y"), factors=factors)) for p in some], ignore_index=True)

        return numbers(by_trial(obs.select("trial_id", "t", "y")).mapInPandas(run, "trial_id long, t int, x array<double>, p array<double>, p_lag array<double>, entropy double"))

    def marginal_loglik(self, obs: DataFrame, draws: int = 200, seed: int = 0) -> DataFrame:
        """(trial_id, n, loglik, laplace, effective): log-likelihood of each trial's observations with the path integrated out; see ``marginal_trial``.

        A trial with an observation that is not finite has NaN. A trial has its own generator, so results do not depend on partitioning. Effective draws far below ``draws`` call for more of them.
        """

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for some in trials(batches):
                found = []
                for p in some:
                    rng = np.random.Generator(np.random.Philox(key=[seed, int(p["trial_id"].iat[0]) & ((1 << 63) - 1)]))
                    y = matrix(p, "y")
                    values = self.marginal_trial(y, rng, draws) if np.isfinite(y).all() else (math.nan,) * 3
                    found.append((p["trial_id"].iat[0], len(p), *values))
                yield pd.DataFrame(found, columns=["trial_id", "n", "loglik", "laplace", "effective"])

        return numbers(by_trial(obs.select("trial_id", "t", "y")).mapInPandas(run, "trial_id long, n int, loglik double, laplace double, effective double"))

    def _smooth_stretches(self, obs: DataFrame, stretch: int) -> DataFrame:
        if self.poisson:
            raise TypeError("only Gaussian observations are smoothed by stretches")
        from .stretches import gaussian, scan

        found = scan(obs.select("trial_id", "t", "y"), stretch, gaussian(self), "trial_id long, t int, x array<double>, p array<double>, p_lag array<double>, log_det double")
        lengths = obs.groupBy("trial_id").agg(F.max("t").alias("steps"))
        entropy = 0.5 * F.col("steps") * self.latent_dim * (1 + math.log(2 * math.pi)) - 0.5 * F.col("log_det")
        return found.join(lengths, "trial_id").select("trial_id", "t", "x", "p", "p_lag", entropy.alias("entropy"))

    def _estep(self, arranged: DataFrame, check: bool = True) -> np.ndarray:
        model, width = self, self.width() - 2
        factors: dict = {}

        def statistics(p: pd.DataFrame) -> np.ndarray:
            y, w = matrix(p, "y"), p["w"].to_numpy(float)
            x, cov, lag, entropy = model.smooth_trial(y, factors=factors)
            return np.concatenate([model.sums(x, cov, lag, y, w), [entropy, 1.0]])

        return summed(arranged, statistics, width + 2, check)

    def fit(self, obs: DataFrame, max_iters: int = 100, tol: float = 1e-6, strict: bool = True) -> tuple[LinearDynamicalSystem, list[float], list[float]]:
        """EM over all trials: (model, ELBO before each M-step, size of each step's change of parameters).

        An observation that is not finite is an error, or with ``strict=False`` makes every parameter NaN, as sums over it are.
        """
        if not strict and not finite(obs, "y"):
            return undefined(self), [math.nan] * max_iters, [math.nan] * max_iters
        # About the means of the data, so that covariances keep their digits.
        means = np.zeros(self.obs_dim) if self.poisson else E.weighted_means(obs, E.elements(F.col("y"), self.obs_dim), F.lit(1.0))
        y = F.col("y") if self.poisson else F.zip_with("y", E.lit_array(means), lambda a, b: a - b)
        arranged = by_trial(obs.select("trial_id", "t", y.alias("y"), "w")).persist()
        model, history, moved = self._moved(-means), [], []
        paths = None
        try:
            if model.poisson:
                refuse_faults(arranged)
            for i in range(max_iters):
                if model.poisson:
                    new, value, later = model._poisson_step(arranged if paths is None else paths, i)
                    if paths is not None:
                        paths.unpersist()
                    paths = later
                else:
                    s = model._estep(arranged, i == 0)
                    new, value = model.mstep(s), model.elbo(s)
                history.append(value)
                moved.append(float(np.linalg.norm(new.parameters() - model.parameters())))
                model = new
                if len(history) > 1 and abs(history[-1] - history[-2]) < tol:
                    break
        finally:
            arranged.unpersist()
            if paths is not None:
                paths.unpersist()
        return model._moved(means), history, moved

    def _moved(self, by: np.ndarray) -> LinearDynamicalSystem:
        """The same system of Gaussian observations that are moved by ``by``."""
        return self if self.poisson else replace(self, obs=replace(self.obs, d=self.obs.d + by))

    def _poisson_step(self, before: DataFrame, i: int) -> tuple[LinearDynamicalSystem, float, DataFrame]:
        """The next model, the ELBO, and the persisted paths, from where the Newton steps of the next iteration start."""
        model = self
        n, width = self.latent_dim, self.width()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for some in trials(batches):
                parts = []
                for p in some:
                    y = matrix(p, "y")
                    out = _smoothed(p, *model.smooth_trial(y, start=matrix(p, "x") if "x" in p else None))
                    out["y"], out["w"] = list(y), p["w"].to_numpy(float)
                    parts.append(out)
                yield pd.concat(parts, ignore_index=True)

        schema = "trial_id long, t int, x array<double>, p array<double>, p_lag array<double>, entropy double, y array<double>, w double"
        paths = kept(before.mapInPandas(run, schema), i)

        def statistics(p: pd.DataFrame) -> np.ndarray:
            x, y, w = matrix(p, "x"), matrix(p, "y"), p["w"].to_numpy(float)
            cov, lag = matrix(p, "p").reshape(-1, n, n), matrix(p, "p_lag").reshape(-1, n, n)
            return np.concatenate([model.sums(x, cov, lag, y, w), [p["entropy"].iat[0], 1.0]])

        s = summed(paths, statistics, width)
        value = self.elbo(s, -_poisson_objective(paths, self.obs.c, self.obs.log_d)[0])
        new = self.mstep(s)
        if self.fit_parts[4]:
            c, log_d = minimise_poisson(lambda c, log_d: _poisson_objective(paths, c, log_d), self.obs.c, self.obs.log_d, curvature=_poisson_curvature(paths, self.obs.c, self.obs.log_d))
            new = replace(new, obs=PoissonObservation(c, log_d))
        return new, value, paths

    # Sampling

    def sample_trial(self, rng: np.random.Generator, steps: int) -> tuple[np.ndarray, np.ndarray]:
        s, o = self.state, self.obs
        x = np.empty((steps, self.latent_dim))
        x[0] = rng.multivariate_normal(s.x0, s.p0, method="cholesky")
        noise = rng.standard_normal((steps, self.latent_dim)) @ np.linalg.cholesky(s.q).T
        for t in range(1, steps):
            x[t] = s.a @ x[t - 1] + s.b + noise[t]
        h = x @ o.c.T + o.d
        y = rng.poisson(np.exp(h)).astype(float) if self.poisson else h + rng.standard_normal(h.shape) @ np.linalg.cholesky(o.r).T
        return x, y

    def sample(self, spark: SparkSession, n_trials: int, steps: int, seed: int = 0) -> DataFrame:
        """(trial_id, t, x, y, w), a generator for each trial."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in pdf["id"]:
                    x, y = self.sample_trial(np.random.Generator(np.random.Philox(key=[seed, int(i)])), steps)
                    yield pd.DataFrame({"trial_id": i, "t": np.arange(1, steps + 1, dtype=np.int32), "x": list(x), "y": list(y), "w": 1.0})

        return spark.range(n_trials).mapInPandas(run, "trial_id long, t int, x array<double>, y array<double>, w double")


def _sym(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def _smoothed(p: pd.DataFrame, x, cov, lag, entropy) -> pd.DataFrame:
    flat = lambda a: list(a.reshape(len(a), -1))
    return pd.DataFrame({"trial_id": p["trial_id"].to_numpy(), "t": p["t"].to_numpy(), "x": list(x), "p": flat(cov), "p_lag": flat(lag), "entropy": entropy})


def poisson_terms(x, cov, y, w, c, log_d) -> np.ndarray:
    """Minus the expected Poisson log-likelihood of a trial (without ln y!), and its derivatives by c and log_d, flat."""
    d = np.exp(log_d)
    h = x @ c.T + d
    cp = np.einsum("pi,tij->tpj", c, cov)
    rate = np.exp(h + 0.5 * np.einsum("tpj,pj->tp", cp, c))
    value = float((w[:, None] * (y * h - rate)).sum())
    gc = ((y * w[:, None]).T @ x) - np.einsum("tp,tpj->pj", rate * w[:, None], x[:, None, :] + cp)
    gd = (w[:, None] * (y - rate)).sum(axis=0) * d
    return -np.concatenate([[value], gc.ravel(), gd])


def poisson_curvature(x, cov, w, c, log_d) -> np.ndarray:
    """Second derivatives of ``poisson_terms`` by each output's (row of c, log_d), without the part that the gradient's d brings; flat blocks."""
    d = np.exp(log_d)
    cp = np.einsum("pi,tij->tpj", c, cov)
    rate = np.exp(x @ c.T + d + 0.5 * np.einsum("tpj,pj->tp", cp, c)) * w[:, None]
    v = np.concatenate([x[:, None, :] + cp, np.broadcast_to(d[None, :, None], (*rate.shape, 1))], axis=2)
    out = np.einsum("tp,tpi,tpj->pij", rate, v, v)
    out[:, :-1, :-1] += np.einsum("tp,tij->pij", rate, cov)
    return out.ravel()


def _poisson_curvature(paths: DataFrame, c: np.ndarray, log_d: np.ndarray, weights=lambda p: p["w"].to_numpy(float)) -> np.ndarray:
    """The matrix over (c, log_d) in the order of ``minimise_poisson``, from one pass."""
    k, n = c.shape

    def statistics(p: pd.DataFrame) -> np.ndarray:
        return poisson_curvature(matrix(p, "x"), matrix(p, "p").reshape(-1, n, n), weights(p), c, log_d)

    blocks = summed(paths.select("trial_id", "t", "x", "p", "w"), statistics, k * (n + 1) ** 2).reshape(k, n + 1, n + 1)
    out = np.zeros((k * (n + 1),) * 2)
    for i, block in enumerate(blocks):
        at = [*range(i * n, (i + 1) * n), k * n + i]
        out[np.ix_(at, at)] = block
    return out


def _poisson_objective(paths: DataFrame, c: np.ndarray, log_d: np.ndarray) -> tuple[float, np.ndarray]:
    n = c.shape[1]

    def statistics(p: pd.DataFrame) -> np.ndarray:
        return poisson_terms(matrix(p, "x"), matrix(p, "p").reshape(-1, n, n), matrix(p, "y"), p["w"].to_numpy(float), c, log_d)

    out = summed(paths.select("trial_id", "t", "x", "p", "y", "w"), statistics, 1 + c.size + len(log_d))
    return float(out[0]), out[1:]


def minimise_poisson(objective: Callable, c: np.ndarray, log_d: np.ndarray, iterations: int = 1000, tolerance: float = 1e-6, curvature: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """BFGS over c and log_d from the inverse of ``curvature``, if given; each evaluation is one pass over the smoothed paths."""
    split = lambda v: (v[: c.size].reshape(c.shape), v[c.size :])
    x = np.concatenate([c.ravel(), log_d])
    value, g = objective(*split(x))
    inverse = np.eye(len(x)) / max(1.0, np.linalg.norm(g))
    if curvature is not None and np.isfinite(curvature).all():
        inverse = np.linalg.inv(make_posdef(curvature, 1e-9 * max(1.0, float(np.abs(curvature).max()))))
    for _ in range(iterations):
        if np.abs(g).max() <= tolerance * max(1.0, abs(value)):
            break
        step = -inverse @ g
        slope = float(g @ step)
        if slope >= 0:
            inverse, step = np.eye(len(x)) / max(1.0, np.linalg.norm(g)), -g / max(1.0, np.linalg.norm(g))
            slope = float(g @ step)
        size = 1.0
        while True:
            with np.errstate(over="ignore", invalid="ignore"):
                then, g2 = objective(*split(x + size * step))
            if math.isfinite(then) and then <= value + 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        if not (math.isfinite(then) and then < value):
            break
        s, r = size * step, g2 - g
        if (rho := float(s @ r)) > 1e-12:
            v = np.eye(len(x)) - np.outer(s, r) / rho
            inverse = v @ inverse @ v.T + np.outer(s, s) / rho
        x, value, g = x + s, then, g2
    return split(x)


# Complete-data likelihood as a plan, for tables that hold the latent path


def complete_loglik(df: DataFrame, model: LinearDynamicalSystem, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` (trial_id, t, x, y) with ``ll``, each step's complete-data log-density without normalisers."""
    s, o, n, p = model.state, model.obs, model.latent_dim, model.obs_dim
    before = F.lag(x).over(Window.partitionBy("trial_id").orderBy("t"))
    df = df.withColumn("_before", before)
    xs, bs, ys = E.elements(F.col(x), n), E.elements(F.col("_before"), n), E.elements(F.col(y), p)
    start = E.quadratic([a - float(v) for a, v in zip(xs, s.x0, strict=True)], np.linalg.inv(s.p0))
    move = E.quadratic([xs[i] - E.linear(bs, s.a[i]) - float(s.b[i]) for i in range(n)], np.linalg.inv(s.q))
    hs = [E.linear(xs, o.c[i]) + float(o.d[i]) for i in range(p)]
    obs: Column = E.total([a * h - F.exp(h) for a, h in zip(ys, hs, strict=True)]) if model.poisson else -0.5 * E.quadratic([a - h for a, h in zip(ys, hs, strict=True)], np.linalg.inv(o.r))
    return df.withColumn("ll", -0.5 * F.when(F.col("_before").isNull(), start).otherwise(move) + obs).drop("_before")


def trial_logliks(df: DataFrame, model: LinearDynamicalSystem, x: str = "x", y: str = "y") -> DataFrame:
    """(trial_id, ll): the steps of ``complete_loglik`` added up; a sum over trials is that of the whole table."""
    return complete_loglik(df, model, x, y).groupBy("trial_id").agg(F.sum("ll").alias("ll"))
