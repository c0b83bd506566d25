"""Filters over streams: the state of each trial is the distribution of its latent state after the steps seen so far.

Steps may come in any order and in any number of batches. A step that comes before its turn waits; one whose turn has passed (a repeat, or a step
from before the trial was first seen to be complete) is given back as ``late`` and changes nothing. So whatever the batches, the rows that are
not late are those of one pass over the whole trial.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.linalg import log_sum_exp
from ..sources.obs import by_trial, numbers, trials
from .hmm import HiddenMarkovModel, _log, pad

SCHEMA = "trial_id long, t int, filtered array<double>, loglik double, late boolean"


class ChainFilter:
    """Probabilities of a hidden Markov model's states given the steps so far, and the log-likelihood of these."""

    def __init__(self, model: HiddenMarkovModel):
        self.model, self.log_a, self.log_pi = model, _log(model.a), _log(model.pi)

    def start(self) -> tuple[np.ndarray, float]:
        return self.log_pi, 0.0

    def step(self, state: np.ndarray, t: int, y: np.ndarray, u: np.ndarray | None) -> tuple[np.ndarray, float]:
        moved = state if t == 1 else log_sum_exp(state[:, None] + self.log_a, axis=0)
        joint = moved + self.model.emission_loglikelihoods(y[None], None if u is None else u[None])[0]
        z = float(log_sum_exp(joint))
        return joint - z if np.isfinite(z) else joint, z

    def shown(self, state: np.ndarray) -> list[float]:
        return np.exp(state).tolist()


class LinearFilter:
    """Mean and covariance (flat, after the mean) of a Gaussian linear system's state given the steps so far, and the log-likelihood of these."""

    def __init__(self, model):
        if model.poisson:
            raise TypeError("only Gaussian observations have an exact filter")
        self.model = model

    def start(self) -> tuple[np.ndarray, float]:
        s = self.model.state
        return np.concatenate([s.x0, s.p0.ravel()]), 0.0

    def step(self, state: np.ndarray, t: int, y: np.ndarray, u: np.ndarray | None) -> tuple[np.ndarray, float]:
        s, o, d = self.model.state, self.model.obs, self.model.latent_dim
        m, p = state[:d], state[d:].reshape(d, d)
        if t > 1:
            m, p = s.a @ m + s.b, s.a @ p @ s.a.T + s.q
        spread, miss = o.c @ p @ o.c.T + o.r, y - o.c @ m - o.d
        gain = np.linalg.solve(spread, o.c @ p).T
        rest = np.eye(d) - gain @ o.c
        m, p = m + gain @ miss, rest @ p @ rest.T + gain @ o.r @ gain.T
        ll = -0.5 * (miss @ np.linalg.solve(spread, miss) + np.linalg.slogdet(spread)[1] + len(y) * np.log(2 * np.pi))
        return np.concatenate([m, (p + p.T).ravel() / 2]), float(ll)

    def shown(self, state: np.ndarray) -> list[float]:
        return state.tolist()


class _Steps(StatefulProcessor):
    def __init__(self, kernel):
        self.kernel = kernel

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "t int, state array<double>, loglik double")
        self.waiting = handle.getMapState("waiting", "t int", "y array<double>, u array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.now.exists():
            t, state, loglik = self.now.get()
            state = np.array(state, float)
        else:
            (state, loglik), t = self.kernel.start(), 0
        new = pd.concat(list(rows), ignore_index=True).sort_values("t", kind="stable")
        out = []
        for step, y, u in zip(new["t"].tolist(), new["y"], new["u"], strict=True):
            if step <= t or self.waiting.containsKey((step,)):
                out.append((key[0], step, None, None, True))
                continue
            if step > t + 1:
                self.waiting.updateValue((step,), (list(y), None if u is None else list(u)))
                continue
            while y is not None:
                state, more = self.kernel.step(state, step, np.array(y, float), None if u is None else np.array(u, float))
                t, loglik = step, loglik + more
                out.append((key[0], t, self.kernel.shown(state), loglik, False))
                step, y = t + 1, None
                if self.waiting.containsKey((step,)):
                    y, u = self.waiting.getValue((step,))
                    self.waiting.removeKey((step,))
        self.now.update((t, state.tolist(), loglik))
        yield pd.DataFrame(out, columns=["trial_id", "t", "filtered", "loglik", "late"])

    def close(self) -> None:
        pass


def _whole(kernel, p: pd.DataFrame) -> pd.DataFrame:
    """One trial in order, from step 1 up to its first gap; repeated steps are late, and what is beyond a gap waits for ever."""
    (state, loglik), t, out = kernel.start(), 0, []
    for trial, step, y, u in zip(p["trial_id"].tolist(), p["t"].tolist(), p["y"], p["u"], strict=True):
        if step == t + 1:
            state, more = kernel.step(state, step, np.array(y, float), None if u is None else np.array(u, float))
            t, loglik = step, loglik + more
            out.append((trial, t, kernel.shown(state), loglik, False))
        elif step <= t:
            out.append((trial, step, None, None, True))
    return pd.DataFrame(out, columns=["trial_id", "t", "filtered", "loglik", "late"])


def _chains(kernel: ChainFilter, some: list[pd.DataFrame]) -> pd.DataFrame:
    """As ``_whole`` of each trial, a step of all of them at a time."""
    ids, ts, lates, lls = [], [], [], []
    for p in some:
        t = p["t"].to_numpy()
        first = np.append(True, np.diff(t) > 0) & (t > 0)
        n = int((t[first] == np.arange(1, first.sum() + 1)).cumprod().sum())
        now, late = first & (t <= n), ~first & (t <= n)
        ids.append(np.full(now.sum(), p["trial_id"].iat[0]))
        ts.append(t[now])
        if late.any():
            lates.append(pd.DataFrame({"trial_id": p["trial_id"].to_numpy()[late], "t": t[late], "filtered": None, "loglik": None, "late": True}))
        if n:
            u = None if p["u"].isna().any() else np.stack(p["u"].to_numpy()[now]).astype(float)
            lls.append(kernel.model.emission_loglikelihoods(np.stack(p["y"].to_numpy()[now]).astype(float), u))
    if not lls:
        return pd.concat([pd.DataFrame(columns=["trial_id", "t", "filtered", "loglik", "late"]), *lates])
    ll, lengths = pad(lls)
    states, zs, state = np.empty_like(ll), np.empty(ll.shape[:2]), kernel.log_pi
    for t in range(ll.shape[1]):
        joint = (state if t == 0 else log_sum_exp(state[:, :, None] + kernel.log_a, axis=1)) + ll[:, t]
        z = log_sum_exp(joint, axis=1)
        state = joint - np.where(np.isfinite(z), z, 0.0)[:, None]
        states[:, t], zs[:, t] = state, z
    inside = np.arange(ll.shape[1])[None, :] < lengths[:, None]
    out = pd.DataFrame({"trial_id": np.concatenate(ids), "t": np.concatenate(ts), "filtered": list(np.exp(states[inside])), "loglik": zs.cumsum(axis=1)[inside], "late": False})
    return pd.concat([out, *lates]) if lates else out


def filtered(stream: DataFrame, model) -> DataFrame:
    """(trial_id, t, filtered, loglik, late) of observations (trial_id, t, y, u) under a hidden Markov or Gaussian linear model.

    ``loglik`` is that of all steps up to t. Of a stream, state is kept by trial in the session's state store (RocksDB is needed) and does
    not expire; it is one distribution a trial, and the steps that wait for one before them. A table is gone through trial by trial.
    Rows without trial_id, t or y are left out.
    """
    kernel = ChainFilter(model) if isinstance(model, HiddenMarkovModel) else LinearFilter(model)
    rows = stream.select("trial_id", "t", "y", "u").filter("trial_id is not null and t is not null and y is not null")
    if stream.isStreaming:
        return numbers(rows.groupBy("trial_id").transformWithStateInPandas(_Steps(kernel), SCHEMA, "Append", "None"), ~F.col("late"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in trials(batches):
            yield _chains(kernel, some) if isinstance(kernel, ChainFilter) else pd.concat([_whole(kernel, p) for p in some], ignore_index=True)

    return numbers(by_trial(rows).mapInPandas(run, SCHEMA), ~F.col("late"))
