"""Small dense linear algebra on the driver and inside kernels (NumPy only)."""

from __future__ import annotations

import copy
import math
from dataclasses import fields, is_dataclass

import numpy as np


def log_sum_exp(a: np.ndarray, axis: int | None = None) -> np.ndarray:
    m = np.max(a, axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(a - m).sum(axis=axis, keepdims=True)) + m
    return out.reshape(()) if axis is None else np.squeeze(out, axis)


def undefined(model):
    """``model`` with NaN for every number in its arrays: what sums over observations that are not finite make of it."""
    if isinstance(model, np.ndarray):
        return np.full_like(model, math.nan) if model.dtype.kind == "f" else model
    if isinstance(model, tuple):
        return tuple(undefined(v) for v in model)
    if not is_dataclass(model):
        return model
    # Not by its constructor, which refuses what is no distribution.
    out = copy.copy(model)
    for f in fields(model):
        object.__setattr__(out, f.name, undefined(getattr(model, f.name)))
    return out


def make_posdef(a, min_eigenvalue: float = 1e-6) -> np.ndarray:
    """Symmetric part of ``a`` with eigenvalues raised to ``min_eigenvalue``."""
    a = np.asarray(a, float)
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    if values.min() >= min_eigenvalue:
        return (a + a.T) / 2
    out = (vectors * np.maximum(values, min_eigenvalue)) @ vectors.T
    return (out + out.T) / 2


def is_posdef(a) -> bool:
    try:
        np.linalg.cholesky(a)
        return True
    except np.linalg.LinAlgError:
        return False


def stabilize_covariance(a) -> np.ndarray:
    """Symmetric part of ``a``, with 1e-12 added to the diagonal if it is not positive definite, and eigenvalues raised if that is not enough."""
    a = (np.asarray(a, float) + np.asarray(a, float).T) / 2
    if is_posdef(a):
        return a
    a = a + 1e-12 * np.eye(len(a))
    return a if is_posdef(a) else make_posdef(a, 1e-12 * max(1.0, float(np.abs(a).max())))


def valid_covariance(a) -> bool:
    a = np.asarray(a, float)
    return a.ndim == 2 and a.shape[0] == a.shape[1] and np.allclose(a, a.T, rtol=0, atol=1e-12 * max(1.0, np.abs(a).max())) and is_posdef(a)


def is_probvec(v) -> bool:
    v = np.asarray(v, float)
    return bool(abs(v.sum() - 1) <= 1e-10 and (v >= 0).all() and (v <= 1).all())


def random_rotation(n: int, rng: np.random.Generator) -> np.ndarray:
    return np.linalg.qr(rng.standard_normal((n, n)))[0]


def gaussian_entropy(neg_hessian) -> float:
    """Entropy of a Gaussian whose log-density has Hessian ``-neg_hessian``."""
    low = np.linalg.cholesky(neg_hessian)
    return 0.5 * len(low) * (1 + math.log(2 * math.pi)) - float(np.log(np.diag(low)).sum())


def iw_map(psi, nu: float, scatter, n: float) -> np.ndarray:
    """Mode of an inverse-Wishart posterior from the scatter of n observations."""
    d = len(psi)
    return (np.asarray(psi) + scatter) / (nu + n + d + 1)


def iw_log_prior(cov, psi, nu: float) -> float:
    d = len(cov)
    return -0.5 * ((nu + d + 1) * np.linalg.slogdet(cov)[1] + float(np.trace(np.linalg.solve(cov, psi))))


def block_tridiagonal(main, upper, lower) -> np.ndarray:
    """Dense matrix of the blocks (T, D, D), (T-1, D, D), (T-1, D, D); kernels keep the blocks apart."""
    t, d = len(main), main[0].shape[0]
    out = np.zeros((t * d, t * d))
    for i in range(t):
        out[i * d : (i + 1) * d, i * d : (i + 1) * d] = main[i]
        if i + 1 < t:
            out[i * d : (i + 1) * d, (i + 1) * d : (i + 2) * d] = upper[i]
            out[(i + 1) * d : (i + 2) * d, i * d : (i + 1) * d] = lower[i]
    return out


class BlockTridiagonal:
    """Factor of a symmetric positive definite block-tridiagonal matrix with ``sub[i]`` below ``main[i]``.

    Its Schur complements give solves, the log-determinant, and the blocks of the inverse on the diagonal and below it, all
    in O(T D^3).
    """

    def __init__(self, main: np.ndarray, sub: np.ndarray):
        t, d, _ = main.shape
        self.schur = np.empty_like(main)
        self.gain = np.empty((max(t - 1, 0), d, d))
        self.schur[0] = main[0]
        # While the blocks repeat, the Schur complements settle; from there to the end of the run they are copied.
        repeats = np.zeros(t, bool)
        if t > 2:
            repeats[2:] = (main[2:] == main[1:-1]).all(axis=(1, 2)) & (sub[1:] == sub[:-1]).all(axis=(1, 2))
        self.runs = _run_ends(repeats)
        i = 1
        while i < t:
            self.gain[i - 1] = np.linalg.solve(self.schur[i - 1], sub[i - 1].T).T
            s = main[i] - self.gain[i - 1] @ sub[i - 1].T
            self.schur[i] = (s + s.T) / 2
            i += 1
            if i < t and repeats[i] and repeats[i - 1] and _settled(self.schur[i - 1], self.schur[i - 2]):
                end = self.runs[i]
                self.schur[i:end] = self.schur[i - 1]
                self.gain[i - 1 : end - 1] = np.linalg.solve(self.schur[i - 1], sub[i - 1].T).T
                i = end
        self.low = np.linalg.cholesky(self.schur)
        self.inv = np.linalg.inv(self.schur)

    def log_det(self) -> float:
        return 2 * float(np.log(np.diagonal(self.low, axis1=1, axis2=2)).sum())

    def solve(self, b: np.ndarray) -> np.ndarray:
        y, gain = b.copy(), self.gain
        for i in range(len(gain)):
            y[i + 1] -= gain[i] @ y[i]
        x = np.einsum("tij,tj->ti", self.inv, y)
        back = gain.transpose(0, 2, 1)
        for i in range(len(gain) - 1, -1, -1):
            x[i] -= back[i] @ x[i + 1]
        return x

    def draws(self, z: np.ndarray) -> np.ndarray:
        """Draws with mean zero and this matrix as precision, from standard normal ``z`` (draws, T, D)."""
        x = np.linalg.solve(np.broadcast_to(self.low.transpose(0, 2, 1), (len(z), *self.low.shape)), z[..., None])[..., 0]
        for i in range(len(self.gain) - 1, -1, -1):
            x[:, i] -= x[:, i + 1] @ self.gain[i]
        return x

    def selected_inverse(self) -> tuple[np.ndarray, np.ndarray]:
        """Diagonal blocks, and blocks (i, i-1) with zeros at i = 0."""
        t, _, _ = self.schur.shape
        inv, gain = self.inv, self.gain
        diag, lag = np.empty_like(inv), np.zeros_like(inv)
        diag[-1] = inv[-1]
        same = np.zeros(t, bool)
        if t > 2:
            same[:-2] = (inv[:-2] == inv[1:-1]).all(axis=(1, 2)) & (gain[:-1] == gain[1:]).all(axis=(1, 2))
        starts = t - _run_ends(same[::-1])
        i = t - 2
        while i >= 0:
            lag[i + 1] = -diag[i + 1] @ gain[i]
            v = inv[i] - gain[i].T @ lag[i + 1]
            diag[i] = (v + v.T) / 2
            i -= 1
            if i >= 0 and same[i] and same[i + 1] and _settled(diag[i + 1], diag[i + 2]):
                start = starts[t - 1 - i]
                diag[start : i + 1] = diag[i + 1]
                lag[start + 1 : i + 2] = -diag[i + 1] @ gain[i]
                i = start - 1
        return diag, lag


def _run_ends(flags: np.ndarray) -> np.ndarray:
    """For each index the end of the run of true flags that it stands in."""
    ends = np.arange(1, len(flags) + 1)
    stop = np.flatnonzero(np.append(~flags, True))
    return np.where(flags, stop[np.searchsorted(stop, np.arange(len(flags)))], ends)


def _settled(a: np.ndarray, b: np.ndarray) -> bool:
    return bool(np.abs(a - b).max() <= 4e-16 * np.abs(a).max())


def newton(value, gradient_hessian, x: np.ndarray, iterations: int = 100, tolerance: float = 1e-10) -> np.ndarray:
    """Minimise a convex function by Newton steps with halving; ``gradient_hessian(x)`` gives both at once."""
    now = value(x)
    for _ in range(iterations):
        g, h = gradient_hessian(x)
        try:
            step = np.linalg.solve(h, g)
        except np.linalg.LinAlgError:
            step = np.linalg.lstsq(h, g, rcond=None)[0]
        size, slope = 1.0, float(g @ step)
        while True:
            new = x - size * step
            then = value(new)
            if then <= now - 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        moved = np.abs(size * step).max(initial=0.0)
        if then > now:
            break
        x, now = new, then
        if moved <= tolerance * (1 + np.abs(x).max(initial=0.0)):
            break
    return x


def lbfgs(objective, x: np.ndarray, memory: int = 10, iterations: int = 500, tolerance: float = 1e-8) -> np.ndarray:
    """Minimise a smooth function from its value and gradient, ``objective(x)``, with the last ``memory`` changes of the gradient for a Hessian.

    Steps meet the Wolfe conditions by bracketing. Ends when the gradient is below ``tolerance`` times the size of the value, or where no
    step goes further down.
    """
    x = np.array(x, float)
    value, g = objective(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(iterations):
        if np.abs(g).max(initial=0.0) <= tolerance * max(1.0, abs(value)):
            break
        q, weights = g.copy(), []
        for s, r, rho in reversed(pairs):
            weights.append(rho * (s @ q))
            q -= weights[-1] * r
        q *= 1 / (pairs[-1][2] * (pairs[-1][1] @ pairs[-1][1])) if pairs else 1 / max(1.0, np.linalg.norm(g))
        for (s, r, rho), a in zip(pairs, reversed(weights), strict=True):
            q += (a - rho * (r @ q)) * s
        slope = -float(g @ q)
        if not slope < 0:
            pairs, q, slope = [], g / max(1.0, np.linalg.norm(g)), -float(g @ g) / max(1.0, np.linalg.norm(g))
        low, high, size, best = 0.0, np.inf, 1.0, None
        for _ in range(40):
            with np.errstate(over="ignore", invalid="ignore"):
                then, g2 = objective(x - size * q)
            if not (np.isfinite(then) and np.isfinite(g2).all() and then <= value + 1e-4 * size * slope):
                high = size
            else:
                best = (size, then, g2)
                if -float(g2 @ q) >= 0.9 * slope:
                    break
                low = size
            size = (low + high) / 2 if np.isfinite(high) else 2 * low
            if best is not None and high - low <= 1e-3 * low:
                break
        if best is None or not best[1] < value:
            break
        size, then, g2 = best
        s, r = -size * q, g2 - g
        if (curve := float(s @ r)) > 1e-14 * float(r @ r):
            pairs = [*pairs[1 - memory :], (s, r, 1 / curve)] if memory > 1 else [(s, r, 1 / curve)]
        x, value, g = x + s, then, g2
    return x


def assignment(cost) -> np.ndarray:
    """For each column of a square matrix its row, so that the sum of the chosen entries is smallest; of equal choices the first in dictionary order.

    Columns get rows one after the other along shortest augmenting paths, O(k^3). All best choices then use only entries that the dual
    variables make tight, and each column in turn takes its first row from which the others can still be completed.
    """
    cost = np.asarray(cost, float).T
    k = len(cost)
    u, v = np.zeros(k + 1), np.zeros(k + 1)
    owner = np.zeros(k + 1, int)  # line of each place, from 1; place 0 is where a path starts
    for i in range(1, k + 1):
        owner[0], j = i, 0
        least, way, used = np.full(k + 1, np.inf), np.zeros(k + 1, int), np.zeros(k + 1, bool)
        while owner[j]:
            used[j] = True
            reduced = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            better = np.flatnonzero(~used[1:] & (reduced < least[1:])) + 1
            least[better], way[better] = reduced[better - 1], j
            free = np.flatnonzero(~used)
            nearest = free[least[free].argmin()]
            step = least[nearest]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j = nearest
        while j:
            owner[j], j = owner[way[j]], way[j]
    place = np.empty(k, int)
    place[owner[1:] - 1] = np.arange(k)
    tight = np.abs(cost - u[1:, None] - v[None, 1:]) <= 1e-12 * max(1.0, np.abs(cost).max(initial=0.0))
    at = np.empty(k, int)
    at[place] = np.arange(k)
    for line in range(k):
        for other in np.flatnonzero(tight[line, : place[line]]):
            # ``other`` is now another line's place; that line and those it drives out must end at the place given up here.
            if at[other] < line:
                continue
            came: dict[int, int] = {int(other): -1}
            queue = [int(other)]
            while queue and place[line] not in came:
                j = queue.pop()
                for to in np.flatnonzero(tight[at[j]]).tolist():
                    if to not in came and at[to] >= line:
                        came[to] = j
                        queue.append(to)
            if place[line] not in came:
                continue
            j, moves = int(place[line]), []
            while came[j] >= 0:
                moves.append((at[came[j]], j))
                j = came[j]
            for who, to in [*moves, (line, int(other))]:
                place[who], at[to] = to, who
            break
    return place
