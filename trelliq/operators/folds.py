"""HMM recursions as array folds in Catalyst, for few states and trials of moderate length; no Python runs on the executors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E


def _ln(p: float) -> float:
    return math.log(p) if p > 0 else -math.inf


def gathered(scored: DataFrame) -> DataFrame:
    """(trial_id, lls): each trial's arrays of state log-likelihoods in order of t. ``scored`` has trial_id, t, ll."""
    return scored.groupBy("trial_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "ll"))), lambda s: s["ll"]).alias("lls"))


def _step(v: Column, ll: Column, a: np.ndarray) -> Column:
    k = len(a)
    return F.array(*[F.get(ll, F.lit(j)) + E.log_sum_exp([F.get(v, F.lit(i)) + _ln(a[i, j]) for i in range(k)]) for j in range(k)])


def _start(lls: Column, pi: np.ndarray) -> Column:
    return F.array(*[F.get(F.get(lls, F.lit(0)), F.lit(k)) + _ln(p) for k, p in enumerate(pi)])


#: Steps whose results are gathered before they join those of the steps before: an array is copied whole whenever it grows.
PIECE = 64


def _grown(values: Column, start: Column, step) -> Column:
    """start, step(start, values[0]), step(that, values[1]), ... as an array, of any elements.

    Results are gathered in pieces and the pieces flattened, so a trial of T steps copies T * PIECE + (T / PIECE)^2 references and not T^2.
    """
    count = F.ceil(F.size(values) / PIECE).cast("int")
    pieces = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(values, i * PIECE + 1, F.lit(PIECE)))).otherwise(F.slice(F.array(values), F.lit(1), F.lit(0)))
    inside = lambda last, piece: F.aggregate(piece, F.array(last), lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), v))))

    def grow(acc: Column, piece: Column) -> Column:
        made = inside(F.element_at(F.element_at(acc, -1), -1), piece)
        return F.concat(acc, F.array(F.slice(made, F.lit(2), F.size(piece))))

    return F.flatten(F.aggregate(pieces, F.array(F.array(start)), grow))


def forward_loglik(grouped: DataFrame, a, pi) -> DataFrame:
    """(trial_id, n, loglik)."""
    a, pi = np.asarray(a, float), np.asarray(pi, float)
    rest = F.slice("lls", F.lit(2), F.greatest(F.size("lls") - 1, F.lit(0)))
    alpha = F.aggregate(rest, _start(F.col("lls"), pi), lambda v, ll: _step(v, ll, a))
    return grouped.select("trial_id", F.size("lls").alias("n"), alpha.alias("alpha")).select("trial_id", "n", E.log_sum_exp([F.get("alpha", F.lit(k)) for k in range(len(pi))]).alias("loglik"))


def alphas(grouped: DataFrame, a, pi) -> DataFrame:
    """``grouped`` with ``alphas``, the forward variables of all steps."""
    a, pi = np.asarray(a, float), np.asarray(pi, float)
    rest = F.slice("lls", F.lit(2), F.greatest(F.size("lls") - 1, F.lit(0)))
    return grouped.withColumn("alphas", _grown(rest, _start(F.col("lls"), pi), lambda v, ll: _step(v, ll, a)))


def betas(grouped: DataFrame, a) -> DataFrame:
    """``grouped`` with ``betas``, the backward variables of all steps."""
    a = np.asarray(a, float)
    k = len(a)

    def back(b: Column, ll: Column) -> Column:
        return F.array(*[E.log_sum_exp([F.get(ll, F.lit(j)) + F.get(b, F.lit(j)) + _ln(a[i, j]) for j in range(k)]) for i in range(k)])

    later = F.reverse(F.slice("lls", F.lit(2), F.greatest(F.size("lls") - 1, F.lit(0))))
    return grouped.withColumn("betas", F.reverse(_grown(later, F.array(*[F.lit(0.0)] * k), back)))


def posteriors(grouped: DataFrame, a, pi) -> DataFrame:
    """(trial_id, t, ll, alpha, beta, gamma) rows; gamma are probabilities."""
    k = len(pi)
    both = betas(alphas(grouped, a, pi), a)
    rows = both.select("trial_id", F.posexplode(F.arrays_zip("lls", "alphas", "betas")).alias("i", "s")).select(
        "trial_id", (F.col("i") + 1).alias("t"), F.col("s.lls").alias("ll"), F.col("s.alphas").alias("alpha"), F.col("s.betas").alias("beta")
    )
    joint = [F.get("alpha", F.lit(i)) + F.get("beta", F.lit(i)) for i in range(k)]
    return rows.withColumn("gamma", F.array(*[F.exp(c) for c in E.log_softmax(joint)]))


def transition_counts(rows: DataFrame, a) -> DataFrame:
    """(i, j, xi): expected transitions from state i to state j (from 1) over all trials. ``rows`` as from :func:`posteriors`."""
    from pyspark.sql.window import Window

    a = np.asarray(a, float)
    k = len(a)
    w = Window.partitionBy("trial_id").orderBy("t")
    nxt = rows.withColumns({"ll2": F.lead("ll").over(w), "beta2": F.lead("beta").over(w)}).filter("ll2 is not null")
    pair = [F.get("alpha", F.lit(i)) + F.get("ll2", F.lit(j)) + F.get("beta2", F.lit(j)) + _ln(a[i, j]) for i in range(k) for j in range(k)]
    sums = nxt.agg(*[F.sum(F.exp(c)).alias(f"x{n}") for n, c in enumerate(E.log_softmax(pair))])
    cells = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), F.col(f"x{i * k + j}").alias("xi")) for i in range(k) for j in range(k)])
    return sums.select(F.explode(cells).alias("c")).select("c.i", "c.j", "c.xi")


def viterbi(grouped: DataFrame, a, pi) -> DataFrame:
    """(trial_id, t, state) of the most probable path, states from 1, of equal ones the first."""
    a, pi = np.asarray(a, float), np.asarray(pi, float)
    k = len(pi)

    def first_best(scores: list[Column]) -> Column:
        s = F.array(*scores)
        return F.array_position(s, F.array_max(s)).cast("int")

    def move(last: Column, ll: Column) -> Column:
        v = last["v"]
        into = [[F.get(v, F.lit(i)) + _ln(a[i, j]) for i in range(k)] for j in range(k)]
        return F.struct(
            F.array(*[F.get(ll, F.lit(j)) + (F.greatest(*into[j]) if k > 1 else into[j][0]) for j in range(k)]).alias("v"),
            F.array(*[first_best(s) for s in into]).alias("back"),
        )

    rest = F.slice("lls", F.lit(2), F.greatest(F.size("lls") - 1, F.lit(0)))
    start = F.struct(_start(F.col("lls"), pi).alias("v"), F.array(*[F.lit(0)] * k).alias("back"))
    found = grouped.select("trial_id", _grown(rest, start, move).alias("f"))
    v = F.element_at("f", -1)["v"]
    backs = F.slice(F.reverse(F.transform("f", lambda s: s["back"])), F.lit(1), F.size("f") - 1)
    path = F.reverse(_grown(backs, F.array_position(v, F.array_max(v)).cast("int"), lambda state, back: F.get(back, state - 1)))
    return found.select("trial_id", F.posexplode(path).alias("i", "state")).select("trial_id", (F.col("i") + 1).alias("t"), "state")
