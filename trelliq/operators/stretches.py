"""Recursions along trials that are too long for one task: a scan over stretches of steps.

Up: what a stretch does to a message is an element of fixed size (a matrix of transition products, or a Gaussian potential over the
states at its two ends), and elements of ``FAN`` neighbours are combined, level by level, until a trial has one. Down: the messages that
enter and leave a node become those of its parts, until each stretch has its own. Each stretch is then finished by itself. A trial of T
steps takes log(T / steps) / log(FAN) shuffles of elements each way, and its observations are shuffled once. A task holds a batch of
whole stretches, or of ``FAN`` elements each, and a step of all of them is one array operation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import BlockTridiagonal, log_sum_exp
from ..sources.obs import FAULTS, ObservationError, matrix, numbers
from .hmm import _log, posterior, viterbi_path

#: Elements that are combined at once.
FAN = 64

#: Numbers of elements, padded, that are worked on at once.
NUMBERS = 1 << 21

#: Of fewer stretches than this each is smoothed by itself, as the factor of a long one settles.
FEW = 8


@dataclass(frozen=True)
class Kernel:
    """How a recursion goes over stretches; elements and messages are flat vectors, ``width`` numbers each.

    Every function works on n groups at once, whose rows follow one another, ``lengths`` each: ``element(p, lengths, first)`` of the rows
    of stretches, ``combine(elements, lengths)`` of neighbours, ``root(elements)`` the messages for whole trials, ``down(elements,
    lengths, messages, first)`` the messages of all parts, and ``finish(p, lengths, messages, first)`` the result's columns beside
    trial_id and t. ``first`` says of each group that it begins its trial.
    """

    width: int
    element: Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray]
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray]
    root: Callable[[np.ndarray], np.ndarray]
    down: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], dict]


def _padded(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, longest, ...) of the rows of n groups, zero beyond each group's length, and which of them are inside."""
    inside = np.arange(lengths.max())[None, :] < lengths[:, None]
    out = np.zeros((*inside.shape, *flat.shape[1:]))
    out[inside] = flat
    return out, inside


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _check(p: pd.DataFrame, lengths: np.ndarray, nodes: np.ndarray, steps: int) -> pd.DataFrame:
    """Stretches in order; one with missing or repeated steps is an error (its trial's last may be short)."""
    wanted = np.repeat(nodes * steps + 1 - _starts(lengths), lengths) + np.arange(len(p))
    bad = np.flatnonzero(p["t"].to_numpy() != wanted)
    if len(bad):
        i = bad[0]
        raise ObservationError(f"steps of trial {p['trial_id'].iat[i]} from {(wanted[i] - 1) // steps * steps + 1} on are not one after the other")
    return p


def _cut(obs: DataFrame, steps: int) -> tuple[DataFrame, int]:
    """Rows with ``node``, their stretch, and the number of levels above the stretches."""
    longest, nameless = obs.agg(F.max("t"), F.count_if(F.col("trial_id").isNull())).first()
    if nameless:
        raise ObservationError(f"{nameless} {FAULTS[0]}")
    count, levels = -(-(longest or 1) // steps), 0
    while count > 1:
        count, levels = -(-count // FAN), levels + 1
    return obs.withColumn("node", F.floor((F.col("t") - 1) / steps).cast("long")), levels


_ELEMENT = "trial_id long, node long, v array<double>"


def _groups(df: DataFrame, group: str, order: str, kernel: Callable[[pd.DataFrame, np.ndarray], dict], width: int, schema: str) -> DataFrame:
    """The kernel's columns for all rows of many (trial_id, group) at once, whole and in order: one shuffle, and no call for a group."""

    def done(p: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, groups = p["trial_id"].to_numpy(), p[group].to_numpy()
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (groups[1:] != groups[:-1])) + 1).tolist(), len(p)]
        i, longest = 0, 0
        for j in range(1, len(cuts)):
            # Groups from i on, as many as fit when they are as long as their longest; one at least.
            longest = max(longest, cuts[j] - cuts[j - 1])
            if j - i > 1 and (j - i) * longest * width > NUMBERS:
                yield pd.DataFrame(kernel(p.iloc[cuts[i] : cuts[j - 1]], np.diff(cuts[i:j])))
                i, longest = j - 1, cuts[j] - cuts[j - 1]
        yield pd.DataFrame(kernel(p.iloc[cuts[i] :], np.diff(cuts[i:])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last group, which may go on
        for batch in batches:
            if batch.empty:
                continue
            ids, groups = batch["trial_id"].to_numpy(), batch[group].to_numpy()
            other = np.flatnonzero((ids != ids[-1]) | (groups != groups[-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            if last or (held and (held[-1]["trial_id"].iat[-1], held[-1][group].iat[-1]) != (ids[0], groups[0])):
                if whole := [*held, batch.iloc[:last]]:
                    yield from done(pd.concat(whole, ignore_index=True))
                held = []
            held.append(batch.iloc[last:])
        if held:
            yield from done(pd.concat(held, ignore_index=True))

    return df.repartition("trial_id", group).sortWithinPartitions("trial_id", group, order).mapInPandas(run, schema)


def _up(rows: DataFrame, levels: int, steps: int, kernel: Kernel) -> list[DataFrame]:
    """Elements of the stretches and of each level above them."""

    def element(p: pd.DataFrame, lengths: np.ndarray) -> dict:
        at = _starts(lengths)
        node = p["node"].to_numpy()[at]
        return {"trial_id": p["trial_id"].to_numpy()[at], "node": node, "v": list(kernel.element(_check(p, lengths, node, steps), lengths, node == 0))}

    def combine(p: pd.DataFrame, lengths: np.ndarray) -> dict:
        at = _starts(lengths)
        parent, ids = p["parent"].to_numpy()[at], p["trial_id"].to_numpy()
        bad = np.flatnonzero(p["node"].to_numpy() != np.repeat(parent * FAN - at, lengths) + np.arange(len(p)))
        if len(bad):
            raise ObservationError(f"trial {ids[bad[0]]} lacks whole stretches of {steps} steps")
        return {"trial_id": ids[at], "node": parent, "v": list(kernel.combine(np.stack(p["v"]), lengths))}

    out = [_groups(rows, "node", "t", element, kernel.width, _ELEMENT)]
    for _ in range(levels):
        out.append(_groups(out[-1].withColumn("parent", F.floor(F.col("node") / FAN).cast("long")), "parent", "node", combine, kernel.width, _ELEMENT))
    return out


def _parted(p: pd.DataFrame, lengths: np.ndarray, message: str) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows of groups without the message that comes before them in each, their lengths, and the messages."""
    at = _starts(lengths)
    if (lengths < 2).any():
        raise ObservationError(f"trial {p['trial_id'].iat[at[lengths.argmin()]]} lacks steps")
    parts = np.ones(len(p), bool)
    parts[at] = False
    return p[parts], lengths - 1, np.stack(p[message].to_numpy()[at])


def scan(obs: DataFrame, steps: int, kernel: Kernel, schema: str) -> DataFrame:
    """The kernel's result for every row of ``obs`` (trial_id, t, y, ...), whose steps are 1..T in each trial.

    A node's message comes to its parts as one more row, before theirs.
    """
    rows, levels = _cut(obs, steps)
    elements = _up(rows, levels, steps, kernel)

    def root(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                yield pd.DataFrame({"trial_id": p["trial_id"], "node": p["node"], "v": list(kernel.root(np.stack(p["v"])))})

    def down(p: pd.DataFrame, lengths: np.ndarray) -> dict:
        first = p["parent"].to_numpy()[_starts(lengths)] == 0
        parts, lengths, messages = _parted(p, lengths, "v")
        return {"trial_id": parts["trial_id"].to_numpy(), "node": parts["node"].to_numpy(), "v": list(kernel.down(np.stack(parts["v"]), lengths, messages, first))}

    def finish(p: pd.DataFrame, lengths: np.ndarray) -> dict:
        node = p["node"].to_numpy()[_starts(lengths)]
        parts, lengths, messages = _parted(p, lengths, "message")
        _check(parts, lengths, node, steps)
        return {"trial_id": parts["trial_id"].to_numpy(), "t": parts["t"].to_numpy(), **kernel.finish(parts, lengths, messages, node == 0)}

    messages = elements[-1].mapInPandas(root, _ELEMENT)
    for level in range(levels - 1, -1, -1):
        parts = elements[level].select("trial_id", F.floor(F.col("node") / FAN).cast("long").alias("parent"), "node", "v")
        above = messages.select("trial_id", F.col("node").alias("parent"), F.lit(-1).cast("long").alias("node"), "v")
        messages = _groups(parts.union(above), "parent", "node", down, kernel.width, _ELEMENT)
    above = messages.select("trial_id", "node", F.lit(0).alias("t"), F.col("v").alias("message"))
    return numbers(_groups(rows.unionByName(above, allowMissingColumns=True), "node", "t", finish, kernel.width, schema))


def totals(obs: DataFrame, steps: int, kernel: Kernel, value: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """(trial_id, ``name``) from the elements of whole trials: the way up only."""
    rows, levels = _cut(obs, steps)
    top = _up(rows, levels, steps, kernel)[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                yield pd.DataFrame({"trial_id": p["trial_id"], name: value(np.stack(p["v"]))})

    return numbers(top.mapInPandas(run, f"trial_id long, {name} double"))


# Hidden Markov models: elements are k x k matrices in logarithms


def _times(a: np.ndarray, b: np.ndarray, best: bool) -> np.ndarray:
    """Products of matrices in logarithms, (n, k, k) each; with ``best`` the most probable path instead of all."""
    out, k = np.empty_like(a), a.shape[-1]
    some = max(1, (1 << 22) // k**3)
    for i in range(0, len(a), some):
        pair = a[i : i + some, :, :, None] + b[i : i + some, None, :, :]
        out[i : i + some] = pair.max(axis=2) if best else log_sum_exp(pair, axis=2)
    if best:
        # All paths tie from a step without density on, and the first state is taken: such a part has its scores up to there, and NaN for other states.
        over = np.isnan(a).any(axis=(1, 2))
        out[over] = a[over]
    return out


def _product(parts: np.ndarray, lengths: np.ndarray, best: bool) -> np.ndarray:
    """Products in order, pair by pair, of the first ``lengths`` of (n, longest, k, k) matrices."""
    while parts.shape[1] > 1:
        out = parts[:, 0::2].copy()
        both = 2 * np.arange(out.shape[1])[None, :] + 1 < lengths[:, None]
        at = np.nonzero(both)
        out[at] = _times(parts[at[0], 2 * at[1]], parts[at[0], 2 * at[1] + 1], best)
        parts, lengths = out, (lengths + 1) // 2
    return parts[:, 0]


def markov(model, best: bool = False) -> Kernel:
    """Posterior state probabilities of a hidden Markov model (``gamma``), or with ``best`` the most probable path (``state``, from 1)."""
    log_a, log_pi, k = _log(model.a), _log(model.pi), model.k
    square = lambda v: np.reshape(v, (-1, k, k))
    through = lambda v, m: (v[:, :, None] + m).max(axis=1) if best else log_sum_exp(v[:, :, None] + m, axis=1)
    back = lambda m, v: log_sum_exp(m + v[:, None, :], axis=2)

    def level(v: np.ndarray) -> np.ndarray:
        top = v.max(axis=1, keepdims=True)
        return v - np.where(np.isfinite(top), top, 0.0)

    def scores(p: pd.DataFrame, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if "u" in p and 0 < p["u"].isna().sum() < len(p):  # stretches without inputs beside others with them
            ends = np.cumsum(lengths)
            parts = [p.iloc[i:j] for i, j in zip(ends - lengths, ends, strict=True)]
        else:
            parts = [p]
        return _padded(np.concatenate([model.emission_loglikelihoods(matrix(x, "y"), matrix(x, "u") if "u" in x else None) for x in parts]), lengths)

    def element(p, lengths, first):
        ll, inside = scores(p, lengths)
        if best:
            ll[np.isnan(ll).any(axis=2), 0] = 0.0
        moves = log_a + ll[:, :, None, :]
        moves[first, 0] = np.where(np.eye(k, dtype=bool), 0.0, -math.inf) + ll[first, 0, None, :]
        return _product(moves, lengths, best).reshape(len(lengths), -1)

    def combine(parts, lengths):
        return _product(_padded(square(parts), lengths)[0], lengths, best).reshape(len(lengths), -1)

    def root(v):
        start = np.broadcast_to(log_pi, (len(v), k))
        if not best:
            return np.concatenate([start, np.zeros((len(v), k))], axis=1)
        end = through(start, square(v))
        return np.column_stack([start, np.where(np.isnan(end).any(axis=1), 0, end.argmax(axis=1))])

    def down(parts, lengths, messages, first):
        ms, inside = _padded(square(parts), lengths)
        n, longest = inside.shape
        enter, rows = np.empty((n, longest, k)), np.arange(n)
        v = enter[:, 0] = messages[:, :k]
        for i in range(1, longest):
            m = ms[:, i - 1]
            v = level(through(v, m))
            if best:
                v[np.isnan(m).any(axis=(1, 2))] = math.nan
            enter[:, i] = v
        leave = np.empty((n, longest, 1 if best else k))
        w = messages[:, k:]
        for i in range(longest - 1, 0, -1):
            leave[:, i] = w
            if best:
                before = (enter[:, i] + ms[rows, i, :, w[:, 0].astype(int)]).argmax(axis=1)[:, None]
            else:
                before = level(back(ms[:, i], w))
            w = np.where(inside[:, i, None], before, w)
        leave[:, 0] = w
        return np.concatenate([enter, leave], axis=2)[inside]

    def finish(p, lengths, messages, first):
        ll, inside = scores(p, lengths)
        start, rows = np.where(first[:, None], messages[:, :k], level(through(messages[:, :k], log_a))), np.arange(len(lengths))
        if best:
            last = np.full((len(lengths), k), -math.inf)
            last[rows, messages[:, k].astype(int)] = 0.0
            ll[rows, lengths - 1] += last
            return {"state": viterbi_path(ll, lengths, log_a, start)[inside] + 1}
        ll[rows, lengths - 1] += messages[:, k:]
        return {"gamma": list(posterior(ll, lengths, log_a, start)[0][inside])}

    return Kernel(k * k, element, combine, root, down, finish)


def log_evidence(model) -> Callable[[np.ndarray], np.ndarray]:
    """Trials' log-likelihoods from their elements."""
    return lambda v: log_sum_exp((_log(model.pi)[:, None] + np.reshape(v, (-1, model.k, model.k))).reshape(len(v), -1), axis=1)


# Linear dynamical systems: elements are Gaussian potentials over the states before and at the end of a stretch


def _turned(a: np.ndarray) -> np.ndarray:
    return a.swapaxes(-1, -2)


def _smoothed(main: np.ndarray, sub: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n block-tridiagonal systems (n, T, D, D), (n, T - 1, D, D), (n, T, D) the solutions and the inverses' blocks on the diagonal and below it."""
    if len(main) < FEW:
        found = [(s.solve(b), *s.selected_inverse()) for s, b in zip(map(BlockTridiagonal, main, sub), h, strict=True)]
        return tuple(np.stack(x) for x in zip(*found, strict=True))
    steps = main.shape[1]
    schur, gain, x = main.copy(), np.empty_like(sub), h.copy()
    for i in range(1, steps):
        gain[:, i - 1] = _turned(np.linalg.solve(schur[:, i - 1], _turned(sub[:, i - 1])))
        s = main[:, i] - gain[:, i - 1] @ _turned(sub[:, i - 1])
        schur[:, i] = (s + _turned(s)) / 2
        x[:, i] -= (gain[:, i - 1] @ x[:, i - 1, :, None])[..., 0]
    diag, lag = np.linalg.inv(schur), np.zeros_like(main)
    x = (diag @ x[..., None])[..., 0]
    for i in range(steps - 2, -1, -1):
        back = _turned(gain[:, i])
        x[:, i] -= (back @ x[:, i + 1, :, None])[..., 0]
        lag[:, i + 1] = -diag[:, i + 1] @ gain[:, i]
        v = diag[:, i] - back @ lag[:, i + 1]
        diag[:, i] = (v + _turned(v)) / 2
    return x, diag, lag


def gaussian(model) -> Kernel:
    """Smoothed path, covariances and entropy of a linear dynamical system with Gaussian observations.

    A potential over (before, last) is a precision, a linear term, and the log-determinant of what was integrated out. The state before
    the first stretch does not exist, and its blocks are zero throughout.
    """
    s, o, d = model.state, model.obs, model.latent_dim
    qi, ri = np.linalg.inv(s.q), np.linalg.inv(o.r)
    at, lo, hi = s.a.T @ qi, slice(0, d), slice(d, 2 * d)

    def pack(j, h, det) -> np.ndarray:
        return np.concatenate([j.reshape(len(j), -1), h, det[:, None]], axis=1)

    def unpack(v) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return v[..., : 4 * d * d].reshape(*v.shape[:-1], 2 * d, 2 * d), v[..., 4 * d * d : -1], v[..., -1]

    def solved(m: np.ndarray, sides: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gain = np.linalg.solve(m, np.concatenate([sides, h[..., None]], axis=-1))
        return gain[..., :-1], gain[..., -1:]

    def terms(p, lengths, first) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Blocks on and below the diagonal and the linear terms of stretches' states, after that of the one before; zeros for none."""
        y = matrix(p, "y")
        y[~np.isfinite(y)] = math.nan
        seen, inside = _padded((y - o.d) @ ri @ o.c, lengths)
        n, longest = inside.shape
        main, h = np.zeros((n, longest + 1, d, d)), np.zeros((n, longest + 1, d))
        main[:, 1:][inside] = o.c.T @ ri @ o.c + qi
        h[:, 1:] = seen
        sub = np.zeros((n, longest, d, d))
        sub[inside] = -qi @ s.a
        main[:, :-1][inside] += at @ s.a
        h[:, 1:][inside] += qi @ s.b
        h[:, :-1][inside] -= at @ s.b
        # the first state starts and does not move
        main[first, 0], h[first, 0], sub[first, 0] = 0, 0, 0
        main[first, 1] += np.linalg.inv(s.p0) - qi
        h[first, 1] += np.linalg.solve(s.p0, s.x0) - qi @ s.b
        return main, sub, h, inside

    def join(j1, h1, j2, h2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of potentials that share a state, which is integrated out."""
        mid = j1[:, hi, hi] + j2[:, lo, lo]
        sides = np.concatenate([j1[:, lo, hi], j2[:, hi, lo]], axis=1)
        gain, shift = solved(mid, _turned(sides), h1[:, hi] + h2[:, lo])
        j = -sides @ gain
        j[:, lo, lo] += j1[:, lo, lo]
        j[:, hi, hi] += j2[:, hi, hi]
        h = np.concatenate([h1[:, lo], h2[:, hi]], axis=1) - (sides @ shift)[..., 0]
        return (j + _turned(j)) / 2, h, np.linalg.slogdet(mid)[1]

    def joined(j, h, det, part, lengths) -> np.ndarray:
        """``part(i, live)``, the i-th potentials of the groups that have one, joined from left to right to the first."""
        for i in range(1, lengths.max()):
            live = i < lengths
            j2, h2, det2 = part(i, live)
            j[live], h[live], more = join(j[live], h[live], j2, h2)
            det[live] += det2 + more
        return pack(j, h, det)

    def element(p, lengths, first):
        main, sub, h, _ = terms(p, lengths, first)

        def step(i, live):
            j, b = np.zeros((live.sum(), 2 * d, 2 * d)), np.zeros((live.sum(), 2 * d))
            j[:, lo, hi], j[:, hi, lo], j[:, hi, hi], b[:, hi] = _turned(sub[live, i]), sub[live, i], main[live, i + 1], h[live, i + 1]
            return j, b, 0.0

        j, b, _ = step(0, np.ones(len(lengths), bool))
        j[:, lo, lo], b[:, lo] = main[:, 0], h[:, 0]
        return joined(j, b, np.zeros(len(lengths)), step, lengths)

    def combine(parts, lengths):
        js, hs, dets = unpack(_padded(parts, lengths)[0])
        return joined(js[:, 0].copy(), hs[:, 0].copy(), dets[:, 0].copy(), lambda i, live: (js[live, i], hs[live, i], dets[live, i]), lengths)

    size = d * d + d

    def root(v):
        j, _, det = unpack(v)
        return np.column_stack([np.zeros((len(v), 2 * size)), det + np.linalg.slogdet(j[:, hi, hi])[1]])

    def side(v) -> tuple[np.ndarray, np.ndarray]:
        return v[:, : d * d].reshape(-1, d, d), v[:, d * d :]

    def passed(j, h, message, a, b) -> np.ndarray:
        """What potentials make of messages about their end ``a`` for their end ``b``."""
        je, he = side(message)
        mid = j[:, a, a] + je
        mid[~mid.any(axis=(1, 2))] = np.eye(d)  # no state before the first, or no potential at all
        gain, shift = solved(mid, j[:, a, b], h[:, a] + he)
        return np.concatenate([(j[:, b, b] - j[:, b, a] @ gain).reshape(len(j), -1), h[:, b] - (j[:, b, a] @ shift)[..., 0]], axis=1)

    def down(parts, lengths, messages, first):
        flat, inside = _padded(parts, lengths)
        (js, hs, _), (n, longest) = unpack(flat), inside.shape
        out = np.empty((n, longest, 2 * size + 1))
        out[:, :, -1] = messages[:, -1:]
        v, w = messages[:, :size], messages[:, size : 2 * size]
        for i in range(longest):
            out[:, i, :size] = v
            if i + 1 < longest:
                v = passed(js[:, i], hs[:, i], v, lo, hi)
        for i in range(longest - 1, -1, -1):
            out[:, i, size : 2 * size] = w
            if i:
                w = np.where(inside[:, i, None], passed(js[:, i], hs[:, i], w, hi, lo), w)
        return out[inside]

    def finish(p, lengths, messages, first):
        main, sub, h, inside = terms(p, lengths, first)
        (je, he), (jl, hl), rows = side(messages[:, :size]), side(messages[:, size : 2 * size]), np.arange(len(lengths))
        main[:, 0] += je
        h[:, 0] += he
        main[rows, lengths] += jl
        h[rows, lengths] += hl
        # States that do not exist stand by themselves.
        main[first, 0] = np.eye(d)
        main[:, 1:][~inside] = np.eye(d)
        flat = lambda a: list(a[:, 1:][inside].reshape(len(p), -1))
        x, diag, lag = _smoothed(main, sub, h)
        # A trial's last stretch whose last step alone is not finite; what goes back from it to the stretches before is NaN.
        y, ends = matrix(p, "y"), np.cumsum(lengths)
        for i in np.flatnonzero(~jl.any(axis=(1, 2)) & ~np.isfinite(y[ends - 1]).all(axis=1) & np.isfinite(he).all(axis=1)):
            n = lengths[i]
            if np.isfinite(y[ends[i] - n : ends[i] - 1]).all():
                x[i, 1 : n + 1] = model.ended(y[ends[i] - 1], diag[i, 1 : n + 1], lag[i, 1 : n + 1])
        x, diag, lag = map(flat, (x, diag, lag))
        # The log-determinant is the whole trial's; so is the entropy, which every stretch works out from the trial's length.
        return {"x": x, "p": diag, "p_lag": lag, "log_det": np.repeat(messages[:, -1], lengths)}

    return Kernel(4 * d * d, element, combine, root, down, finish)
