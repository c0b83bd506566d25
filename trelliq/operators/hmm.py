"""Hidden Markov models over collections of trials.

The E-step runs where a trial's rows are: trials are padded to chunks, so a recursion over time is a loop of array operations
over all trials of a chunk. Closed-form emissions send back one vector of sums per task; others persist the posteriors and fit by
aggregations. The driver holds parameters only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.linalg import log_sum_exp, make_posdef, undefined
from ..sources.obs import FAULTS, VECTOR, added, by_trial, finite, matrix, numbers, refuse, sound, trials, vector_batch
from .emissions import AutoRegressionEmission, GaussianEmission
from .families import MarkovFamily
from .glm import fit_by_ascent, fit_weighted


def _log(a) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.asarray(a, float))


def pad(lls: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(trials, longest, K) log-likelihoods, zero beyond each trial's length, and the lengths."""
    lengths = np.array([len(x) for x in lls])
    out = np.zeros((len(lls), lengths.max(), lls[0].shape[1]))
    for i, x in enumerate(lls):
        out[i, : len(x)] = x
    return out, lengths


def forward(ll: np.ndarray, log_a: np.ndarray, log_pi: np.ndarray) -> np.ndarray:
    alpha = np.empty_like(ll)
    alpha[:, 0] = log_pi + ll[:, 0]
    for t in range(1, ll.shape[1]):
        alpha[:, t] = ll[:, t] + log_sum_exp(alpha[:, t - 1, :, None] + log_a, axis=1)
    return alpha


def backward(ll: np.ndarray, lengths: np.ndarray, log_a: np.ndarray) -> np.ndarray:
    beta = np.zeros_like(ll)
    for t in range(ll.shape[1] - 2, -1, -1):
        step = log_sum_exp(log_a + (ll[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        beta[:, t] = np.where((t < lengths - 1)[:, None], step, 0.0)
    return beta


def trial_loglik(alpha: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return log_sum_exp(alpha[np.arange(len(lengths)), lengths - 1], axis=1)


def _posterior_log(ll: np.ndarray, lengths: np.ndarray, log_a: np.ndarray, log_pi: np.ndarray):
    """As :func:`posterior`, in logarithms throughout: slower, but no probability is too small."""
    alpha, beta = forward(ll, log_a, log_pi), backward(ll, lengths, log_a)
    loglik = trial_loglik(alpha, lengths)
    joint = alpha + beta
    gamma = np.exp(joint - log_sum_exp(joint, axis=2)[:, :, None])
    inside = np.arange(ll.shape[1])[None, :] < lengths[:, None]
    gamma = np.where(inside[:, :, None], gamma, 0.0)
    xi = np.zeros((len(lengths), *log_a.shape))
    for t in range(ll.shape[1] - 1):
        live = t < lengths - 1
        if live.any():
            pair = alpha[live, t, :, None] + log_a + (ll[live, t + 1] + beta[live, t + 1])[:, None, :]
            m = log_sum_exp(pair.reshape(len(pair), -1), axis=1)[:, None, None]
            never = np.isneginf(m)
            xi[live] += np.where(never, 0.0, np.exp(pair - np.where(never, 0.0, m)))
    return gamma, xi, loglik


#: Of fewer trials than this all steps are worked on at once, if their transition products have at most so many numbers.
FEW_TRIALS, PRODUCTS = 48, 1 << 24

#: Sums of scaled probabilities below this have lost digits; the recursion in logarithms takes over.
TINY = 1e-250


def _walk(e: np.ndarray, moves: np.ndarray, a: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward messages and the forward scales, a step after the other for all trials."""
    n, steps, k = e.shape
    alpha, beta, norm = np.empty_like(e), np.empty_like(e), np.empty((n, steps))
    all_move = moves.all(axis=0)
    v = np.broadcast_to(pi, (n, k))
    for t in range(steps):
        new = v @ a
        if not all_move[t]:
            new = np.where(moves[:, t, None], new, v)
        v = new * e[:, t]
        norm[:, t] = v.sum(axis=1)
        v = v / norm[:, t, None]
        alpha[:, t] = v
    v, at = np.ones((n, k)), a.T.copy()
    for t in range(steps - 1, -1, -1):
        beta[:, t] = v
        w = v * e[:, t]
        new = w @ at
        if not all_move[t]:
            new = np.where(moves[:, t, None], new, w)
        v = new / new.max(axis=1, keepdims=True)
    return alpha, beta, norm


def _tree(e: np.ndarray, moves: np.ndarray, a: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_walk`, over a binary tree of transition products: few array operations, however long a trial is.

    Going up, the product of each pair of neighbours; going down, the messages that enter and leave each part.
    """
    n, steps, k = e.shape
    size = 1 << (steps - 1).bit_length()
    leaf = np.empty((n, size, k, k))
    leaf[:, :steps] = np.where(moves[:, :, None, None], a, np.eye(k)) * e[:, :, None, :]
    leaf[:, steps:] = np.eye(k)
    levels = [leaf]
    while levels[-1].shape[1] > 1:
        product = levels[-1][:, 0::2] @ levels[-1][:, 1::2]
        levels.append(product / product.max(axis=(2, 3), keepdims=True))
    enter, leave = np.broadcast_to(np.reshape(pi, (-1, 1, k)), (n, 1, k)), np.ones((n, 1, k))
    for level in reversed(levels[:-1]):
        into, out = np.empty((n, level.shape[1], k)), np.empty((n, level.shape[1], k))
        into[:, 0::2], out[:, 1::2] = enter, leave
        v = (enter[:, :, None, :] @ level[:, 0::2])[:, :, 0]
        into[:, 1::2] = v / v.sum(axis=2, keepdims=True)
        w = (level[:, 1::2] @ leave[:, :, :, None])[..., 0]
        out[:, 0::2] = w / w.max(axis=2, keepdims=True)
        enter, leave = into, out
    alpha = (enter[:, :steps, None, :] @ leaf[:, :steps])[:, :, 0]
    norm = alpha.sum(axis=2)
    return alpha / norm[:, :, None], leave[:, :steps], norm


def posterior(ll: np.ndarray, lengths: np.ndarray, log_a: np.ndarray, log_pi: np.ndarray):
    """gamma (probabilities, zero beyond the end), xi summed over time, and log-likelihood of each trial; ``log_pi`` is one for all, or one each.

    Works with scaled probabilities, step by step for many trials and over a tree for few. For the trials in which one comes near
    underflow, the recursion in logarithms takes over.
    """
    n, steps, k = ll.shape
    a, pi = np.exp(log_a), np.exp(log_pi)
    inside = np.arange(steps)[None, :] < lengths[:, None]
    top = ll.max(axis=2)
    with np.errstate(all="ignore"):
        e = np.where(inside[:, :, None], np.exp(ll - top[:, :, None]), 1.0)
        # Step 0 has no transition into it, and steps beyond a trial's end change nothing.
        moves = inside.copy()
        moves[:, 0] = False
        alpha, beta, norm = (_tree if n < FEW_TRIALS and steps >= 16 and n * steps * k * k <= PRODUCTS else _walk)(e, moves, a, pi)
        loglik = np.where(inside, np.log(norm) + top, 0.0).sum(axis=1)
        joint = alpha * beta
        whole = joint.sum(axis=2, keepdims=True)
        gamma = np.where(inside[:, :, None], joint / whole, 0.0)
        after = e[:, 1:] * beta[:, 1:]
        z = ((alpha[:, :-1] @ a) * after).sum(axis=2, keepdims=True)
        weighted = np.where(inside[:, 1:, None], alpha[:, :-1] / z, 0.0)
        xi = a * (weighted.transpose(0, 2, 1) @ after)
        safe = ((whole[:, :, 0] >= TINY) | ~inside).all(axis=1) & ((z[:, :, 0] >= TINY) | ~inside[:, 1:]).all(axis=1) & np.isfinite(loglik) & np.isfinite(xi).all(axis=(1, 2))
    if not safe.all():
        bad = np.flatnonzero(~safe)
        longest = lengths[bad].max()
        some = _posterior_log(ll[bad, :longest], lengths[bad], log_a, np.broadcast_to(log_pi, (n, k))[bad])
        gamma[bad], xi[bad], loglik[bad] = 0.0, some[1], some[2]
        gamma[bad, :longest] = some[0]
    return gamma, xi, loglik


def likelihood(ll: np.ndarray, lengths: np.ndarray, log_a: np.ndarray, log_pi: np.ndarray) -> np.ndarray:
    """Log-likelihood of each trial: the forward pass alone, in scaled probabilities, or in logarithms for the trials that need them."""
    n, steps, k = ll.shape
    a = np.exp(log_a)
    top = ll.max(axis=2)
    v, out, least = np.broadcast_to(np.exp(log_pi), (n, k)), np.zeros(n), np.full(n, np.inf)
    with np.errstate(all="ignore"):
        e = np.exp(ll - top[:, :, None])
        for t in range(steps):
            new = (v if t == 0 else v @ a) * e[:, t]
            norm = new.sum(axis=1)
            live = t < lengths
            out += np.where(live, np.log(norm) + top[:, t], 0.0)
            least = np.where(live, np.minimum(least, norm), least)
            v = np.where(live[:, None], new / norm[:, None], v)
    bad = np.flatnonzero(~(least >= TINY) | ~np.isfinite(out))
    if len(bad):
        longest = lengths[bad].max()
        out[bad] = trial_loglik(forward(ll[bad, :longest], log_a, log_pi), lengths[bad])
    return out


def viterbi_path(ll: np.ndarray, lengths: np.ndarray, log_a: np.ndarray, log_pi: np.ndarray) -> np.ndarray:
    """Most probable states, from 0; of equal ones the first."""
    n, steps, k = ll.shape
    v, back = log_pi + ll[:, 0], np.zeros((n, steps, k), np.int32)
    best = np.array(v)
    for t in range(1, steps):
        scores = v[:, :, None] + log_a
        back[:, t] = scores.argmax(axis=1)
        v = scores.max(axis=1) + ll[:, t]
        best = np.where((t < lengths)[:, None], v, best)
    path = np.zeros((n, steps), np.int32)
    state = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        state = np.where(t < lengths - 1, back[np.arange(n), min(t + 1, steps - 1), state], state)
        path[:, t] = state
    return path


@dataclass(frozen=True, repr=False)
class HiddenMarkovModel(MarkovFamily):
    """Transition matrix ``a`` (rows sum to 1), initial distribution ``pi`` and one emission for each state."""

    a: np.ndarray
    pi: np.ndarray
    emissions: tuple

    def __post_init__(self):
        object.__setattr__(self, "a", np.array(self.a, float))
        object.__setattr__(self, "pi", np.array(self.pi, float))
        object.__setattr__(self, "emissions", tuple(self.emissions))
        k = len(self.pi)
        if self.a.shape != (k, k) or len(self.emissions) != k:
            raise ValueError("a, pi and emissions disagree about the number of states")
        if not np.allclose(self.a.sum(axis=1), 1, atol=1e-6) or (self.a < 0).any() or abs(self.pi.sum() - 1) > 1e-6 or (self.pi < 0).any():
            raise ValueError("a needs stochastic rows and pi must sum to 1")

    @property
    def k(self) -> int:
        return len(self.pi)

    def __repr__(self) -> str:
        shown = ", ".join(type(e).__name__ for e in self.emissions[:3]) + (", ..." if self.k > 4 else "")
        return f"HiddenMarkovModel(k={self.k}, emissions=[{shown}])"

    @staticmethod
    def random(emissions, rng: np.random.Generator) -> HiddenMarkovModel:
        k = len(emissions)
        return HiddenMarkovModel(rng.dirichlet(np.ones(k), size=k), rng.dirichlet(np.ones(k)), tuple(emissions))

    def permuted(self, order) -> HiddenMarkovModel:
        order = list(order)
        return HiddenMarkovModel(self.a[np.ix_(order, order)], self.pi[order], tuple(self.emissions[i] for i in order))

    # Kernels

    def emission_loglikelihoods(self, y: np.ndarray, u: np.ndarray | None) -> np.ndarray:
        """(T, K); an observation or input that is not finite has no density, and makes its step NaN in all states."""
        ll = np.stack([e.logpdf(y, u) for e in self.emissions], axis=1)
        if not np.isfinite(ll.sum()):
            for x in (y, u):
                if x is not None:
                    ll[~np.isfinite(x).all(axis=1)] = math.nan
        return ll

    def _chunk(self, some: list[pd.DataFrame]):
        ys, us = [matrix(p, "y") for p in some], [matrix(p, "u") for p in some]
        ll, lengths = pad([self.emission_loglikelihoods(y, u) for y, u in zip(ys, us, strict=True)])
        return ys, us, ll, lengths

    def _map(self, obs: DataFrame, kernel, schema: str, arranged: bool = False) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for some in trials(batches):
                yield kernel(some, *self._chunk(some))

        return (obs if arranged else by_trial(obs.select("trial_id", "t", "y", "u", "w"))).mapInPandas(run, schema)

    def _weighted(self, arranged: DataFrame) -> DataFrame:
        """Rows (y, u, w, gamma) of a table from ``by_trial``; nothing is shuffled."""

        def kernel(some, ys, us, ll, lengths):
            gamma, _, _ = posterior(ll, lengths, _log(self.a), _log(self.pi))
            rows = pd.concat([p[["y", "u", "w"]] for p in some], ignore_index=True)
            rows["gamma"] = [g for i, n in enumerate(lengths) for g in gamma[i, :n]]
            return rows

        return self._map(arranged, kernel, "y array<double>, u array<double>, w double, gamma array<double>", arranged=True)

    # Inference

    def loglikelihood(self, obs: DataFrame) -> DataFrame:
        """(trial_id, loglik): the forward pass only."""

        def kernel(some, ys, us, ll, lengths):
            found = likelihood(ll, lengths, _log(self.a), _log(self.pi))
            return pd.DataFrame({"trial_id": [p["trial_id"].iat[0] for p in some], "loglik": found})

        return numbers(self._map(obs, kernel, "trial_id long, loglik double"))

    def class_probabilities(self, obs: DataFrame, stretch: int | None = None) -> DataFrame:
        """(trial_id, t, gamma): posterior state probabilities. With ``stretch`` trials are cut into stretches of so many steps."""
        if stretch:
            from .stretches import markov, scan

            return scan(obs.select("trial_id", "t", "y", "u"), stretch, markov(self), "trial_id long, t int, gamma array<double>")

        def kernel(some, ys, us, ll, lengths):
            gamma, _, _ = posterior(ll, lengths, _log(self.a), _log(self.pi))
            return pd.concat([pd.DataFrame({"trial_id": p["trial_id"].to_numpy(), "t": p["t"].to_numpy(), "gamma": list(gamma[i, : len(p)])}) for i, p in enumerate(some)], ignore_index=True)

        return numbers(self._map(obs, kernel, "trial_id long, t int, gamma array<double>"))

    def viterbi(self, obs: DataFrame, stretch: int | None = None) -> DataFrame:
        """(trial_id, t, state), states from 1. With ``stretch`` trials are cut into stretches of so many steps; of equal paths it gives any."""
        if stretch:
            from .stretches import markov, scan

            return scan(obs.select("trial_id", "t", "y", "u"), stretch, markov(self, best=True), "trial_id long, t int, state int")

        def kernel(some, ys, us, ll, lengths):
            path = viterbi_path(ll, lengths, _log(self.a), _log(self.pi)) + 1
            return pd.concat([pd.DataFrame({"trial_id": p["trial_id"].to_numpy(), "t": p["t"].to_numpy(), "state": path[i, : len(p)]}) for i, p in enumerate(some)], ignore_index=True)

        return self._map(obs, kernel, "trial_id long, t int, state int")

    def chunked_loglikelihood(self, obs: DataFrame, steps: int = 4096) -> DataFrame:
        """(trial_id, loglik) for trials too long for one task: products of transition matrices of stretches, combined level by level."""
        from .stretches import log_evidence, markov, totals

        return totals(obs.select("trial_id", "t", "y", "u"), steps, markov(self), log_evidence(self), "loglik")

    # Learning

    def _sums(self, arranged: DataFrame, emissions: bool, check: bool = True) -> np.ndarray:
        """Trials, log-likelihood, first-step gamma, xi, gamma before the last step, and each emission's statistics, summed; see ``summed``."""
        faulty, width = len(FAULTS), self._width(emissions)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, out = np.zeros(faulty), np.zeros(width)
            for some in trials((b.to_pandas() for b in batches), counts=counts):
                if check and not (some := sound(some, counts)):
                    continue
                out += self._statistics(some, emissions)
            yield vector_batch(np.concatenate([counts, out]))

        found = added(arranged.mapInArrow(run, VECTOR), faulty + width)
        refuse(found[:faulty])
        return found[faulty:]

    def _width(self, emissions: bool) -> int:
        return 2 + 2 * self.k + self.k**2 + (sum(e.width() for e in self.emissions) if emissions else 0)

    def _mstep(self, s: np.ndarray) -> HiddenMarkovModel:
        """The next model, from the sums of closed-form emissions."""
        a, pi = self._mstep_chain(s)
        at, emissions = 2 + 2 * self.k + self.k**2, []
        for e in self.emissions:
            emissions.append(e.mstep(s[at : at + e.width()]))
            at += e.width()
        return HiddenMarkovModel(a, pi, tuple(emissions))

    def _statistics(self, some: list[pd.DataFrame], emissions: bool) -> np.ndarray:
        """What ``_sums`` adds up, of a chunk of trials."""
        ys, us, ll, lengths = self._chunk(some)
        gamma, xi, loglik = posterior(ll, lengths, _log(self.a), _log(self.pi))
        ends = gamma[np.arange(len(lengths)), lengths - 1]
        parts = [[len(some), loglik.sum()], gamma[:, 0].sum(axis=0), xi.sum(axis=0).ravel(), gamma.sum(axis=(0, 1)) - ends.sum(axis=0)]
        if emissions:
            y = np.concatenate(ys)
            u = None if us[0] is None else np.concatenate(us)
            w = np.concatenate([p["w"].to_numpy() for p in some])
            g = np.concatenate([gamma[i, :n] for i, n in enumerate(lengths)])
            parts += [e.statistics(y, u, g[:, i] * w) for i, e in enumerate(self.emissions)]
        return np.concatenate(parts)

    def _mstep_chain(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.k
        pi, xi, gone = s[2 : 2 + k] / max(s[0], 1), s[2 + k : 2 + k + k * k].reshape(k, k), s[2 + k + k * k : 2 + 2 * k + k * k]
        rows = xi.sum(axis=1, keepdims=True)
        a = np.where(rows > 0, xi / np.where(rows > 0, rows, 1), self.a)
        return a, pi / pi.sum() if pi.sum() > 0 else self.pi

    def fit(self, obs: DataFrame, max_iters: int = 100, tol: float = 1e-6, strict: bool = True) -> tuple[HiddenMarkovModel, list[float]]:
        """EM over all trials; stops when the log-likelihood changes by less than ``tol``. Returns the model and its history.

        An observation or input that is not finite is an error, or with ``strict=False`` makes every parameter NaN, as sums over it are.
        """
        if not strict and not finite(obs, "y", "u"):
            return undefined(self), [math.nan] * max_iters
        closed = all(getattr(e, "closed_form", False) for e in self.emissions)
        # About the means of the data, so that covariances keep their digits.
        y, u = self._centre(obs)
        moved = lambda c, by: F.zip_with(c, E.lit_array(by), lambda a, b: a - b) if by is not None and len(by) else F.col(c)
        arranged = by_trial(obs.select("trial_id", "t", moved("y", y).alias("y"), moved("u", u).alias("u"), "w")).persist()
        model, history = self if y is None else self._moved(-y, None if u is None else -u), []
        try:
            for i in range(max_iters):
                s = model._sums(arranged, closed, i == 0)
                history.append(float(s[1]))
                if len(history) > 1 and abs(history[-1] - history[-2]) < tol:
                    break
                if closed:
                    model = model._mstep(s)
                    continue
                a, pi = model._mstep_chain(s)
                weights = [F.get("gamma", F.lit(i)) * F.col("w") for i in range(self.k)]
                fitted = fit_weighted if all(hasattr(e, "family") for e in model.emissions) else fit_by_ascent
                model = HiddenMarkovModel(a, pi, tuple(fitted(list(model.emissions), model._weighted(arranged), "y", "u", weights)))
        finally:
            arranged.unpersist()
        return model if y is None else model._moved(y, u), history

    @staticmethod
    def fit_many(models: list[HiddenMarkovModel], obs: DataFrame, max_iters: int = 100, tol: float = 1e-6, held_out: list[int | None] | None = None) -> list[tuple[HiddenMarkovModel, list[float]]]:
        """Fits of several models of closed-form emissions in the same passes: (model, history) of each, as ``fit`` gives it alone.

        Every trial is read once an iteration, by all models that have not converged yet. With ``held_out`` model i leaves out the steps
        whose ``fold`` (an int column of ``obs``) is the i-th number; what is left of a trial is joined together.
        """
        if not all(getattr(e, "closed_form", False) for m in models for e in m.emissions):
            raise TypeError("only closed-form emissions are fitted together")
        held_out = held_out or [None] * len(models)
        columns = ["trial_id", "t", "y", "u", "w", *(["fold"] if any(f is not None for f in held_out) else [])]
        y, u = models[0]._centre(obs)
        moved = lambda c, by: F.zip_with(c, E.lit_array(by), lambda a, b: a - b) if by is not None and len(by) else F.col(c)
        arranged = by_trial(obs.select(*columns).withColumns({"y": moved("y", y), "u": moved("u", u)})).persist()
        now = [m if y is None else m._moved(-y, None if u is None else -u) for m in models]
        histories: list[list[float]] = [[] for _ in models]
        live, faulty = list(range(len(models))), len(FAULTS)
        try:
            for i in range(max_iters):
                if not live:
                    break
                ends = np.cumsum([faulty, *[now[j]._width(True) for j in live]])
                jobs = [(now[j], held_out[j]) for j in live]

                def run(batches: Iterator[pa.RecordBatch], jobs=jobs, ends=ends, check=i == 0) -> Iterator[pa.RecordBatch]:
                    out = np.zeros(ends[-1])
                    for some in trials((b.to_pandas() for b in batches), counts=out[:faulty]):
                        some = sound(some, out[:faulty]) if check else some
                        left: dict[int | None, list[pd.DataFrame]] = {None: some}
                        for (model, fold), a, b in zip(jobs, ends[:-1], ends[1:], strict=True):
                            if fold not in left:
                                left[fold] = [q for p in some if len(q := p[(p["fold"] != fold).to_numpy()])]
                            if left[fold]:
                                out[a:b] += model._statistics(left[fold], True)
                    yield vector_batch(out)

                s = added(arranged.mapInArrow(run, VECTOR), int(ends[-1]))
                refuse(s[:faulty])
                for j, a, b in zip(list(live), ends[:-1], ends[1:], strict=True):
                    histories[j].append(float(s[a + 1]))
                    if len(histories[j]) > 1 and abs(histories[j][-1] - histories[j][-2]) < tol:
                        live.remove(j)
                    else:
                        now[j] = now[j]._mstep(s[a:b])
        finally:
            arranged.unpersist()
        return [(m if y is None else m._moved(y, u), h) for m, h in zip(now, histories, strict=True)]

    @staticmethod
    def score_folds(models: list[HiddenMarkovModel], obs: DataFrame, folds: list[int]) -> list[float]:
        """Log-likelihood a step of fold ``folds[i]`` under model i, all in one pass over ``obs`` (with its ``fold``); NaN for an empty fold."""
        arranged, faulty = by_trial(obs.select("trial_id", "t", "y", "u", "w", "fold")), len(FAULTS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(faulty + 2 * len(models))
            for some in trials((b.to_pandas() for b in batches), counts=out[:faulty]):
                some = sound(some, out[:faulty])
                for i, (model, fold) in enumerate(zip(models, folds, strict=True)):
                    if part := [q for p in some if len(q := p[(p["fold"] == fold).to_numpy()])]:
                        _, _, ll, lengths = model._chunk(part)
                        out[faulty + 2 * i :][:2] += likelihood(ll, lengths, _log(model.a), _log(model.pi)).sum(), lengths.sum()
            yield vector_batch(out)

        s = added(arranged.mapInArrow(run, VECTOR), faulty + 2 * len(models))
        refuse(s[:faulty])
        return [float(v / n) if n else math.nan for v, n in s[faulty:].reshape(-1, 2)]

    def _moved(self, y: np.ndarray, u: np.ndarray | None) -> HiddenMarkovModel:
        return HiddenMarkovModel(self.a, self.pi, tuple(e.moved(y, u) for e in self.emissions))

    def _centre(self, obs: DataFrame) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Means of y and u to fit about; None if an emission cannot be moved (no intercept, counts, one of the user's own)."""
        first = self.emissions[0]
        u = np.zeros(first.input_dim) if hasattr(first, "input_dim") else None
        if not all(getattr(e, "closed_form", False) and hasattr(e, "moved") and e.moved(np.zeros(e.output_dim), u) is not None for e in self.emissions):
            return None, None
        cols = [*E.elements(F.col("y"), first.output_dim), *(E.elements(F.col("u"), len(u)) if u is not None else [])]
        means = E.weighted_means(obs, cols, F.lit(1.0))
        return means[: first.output_dim], None if u is None else means[first.output_dim :]

    def kmeans_init(self, obs: DataFrame, seed: int = 0) -> HiddenMarkovModel:
        """Gaussian emissions from the means and sample covariances of k-means clusters."""
        from .kmeans import assign, kmeans

        d = self.emissions[0].output_dim
        points = obs.select(F.col("y").alias("x"))
        labelled = assign(points, kmeans(points, self.k, d, seed=seed).centroids)
        emissions = list(self.emissions)
        for label, (n, s, q) in enumerate(E.grouped_moments(labelled, "x", "label", d, self.k)):
            if n:
                mean = s / n
                cov = (q - n * np.outer(mean, mean)) / (n - 1) if n > 1 else np.eye(d)
                emissions[label] = GaussianEmission(mean, make_posdef(cov))
        return HiddenMarkovModel(self.a, self.pi, tuple(emissions))

    # Sampling

    def sample_trial(self, rng: np.random.Generator, steps: int, u: np.ndarray | None = None, past: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        z = np.empty(steps, int)
        ys = []
        auto = isinstance(self.emissions[0], AutoRegressionEmission)
        history = list(past) if past is not None else [np.zeros(self.emissions[0].output_dim)] * (self.emissions[0].order if auto else 0)
        for t in range(steps):
            z[t] = rng.choice(self.k, p=self.pi if t == 0 else self.a[z[t - 1]])
            e = self.emissions[z[t]]
            y = e.sample_next(rng, np.array(history)) if auto else e.sample(rng, 1, None if u is None else u[t : t + 1])[0]
            history.append(y)
            ys.append(np.atleast_1d(y))
        return z + 1, np.array(ys)

    def sample(self, spark: SparkSession, n_trials: int, steps: int, seed: int = 0, inputs=None) -> DataFrame:
        """(trial_id, t, state, y, u, w); each trial has its own generator, so results do not depend on partitioning.

        ``inputs(rng, steps)`` makes a trial's covariates for regression emissions.
        """

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in pdf["id"]:
                    rng = np.random.Generator(np.random.Philox(key=[seed, int(i)]))
                    u = inputs(rng, steps) if inputs else None
                    z, y = self.sample_trial(rng, steps, u)
                    yield pd.DataFrame({"trial_id": i, "t": np.arange(1, steps + 1, dtype=np.int32), "state": z.astype(np.int32), "y": list(y), "u": list(u) if u is not None else None, "w": 1.0})

        return spark.range(n_trials).mapInPandas(run, "trial_id long, t int, state int, y array<double>, u array<double>, w double")
