"""Model selection, alignment and table reports."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expr as E
from ..functions.linalg import assignment
from ..sources.obs import finite
from .emissions import GaussianEmission
from .hmm import HiddenMarkovModel
from .lds import LinearDynamicalSystem, complete_loglik
from .ppca import Moments, ProbabilisticPCA


# Information criteria


def aic_bic(loglik: float, parameters: int, n: float) -> tuple[float, float]:
    return -2 * loglik + 2 * parameters, -2 * loglik + parameters * math.log(n)


def hmm_parameters(model: HiddenMarkovModel) -> int:
    k, d = model.k, model.emissions[0].output_dim
    return k * (k - 1) + (k - 1) + k * d + k * d * (d + 1) // 2


def poisson_mixture_parameters(k: int) -> int:
    return 2 * k - 1


def ppca_parameters(d: int, k: int) -> int:
    return d * k + d + 1


# Cross-validation


def with_folds(obs: DataFrame, n_folds: int) -> DataFrame:
    """``obs`` with ``fold`` from 0: contiguous stretches of each trial's steps; the last takes what is left over."""
    n = F.max("t").over(Window.partitionBy("trial_id"))
    size = F.greatest(F.floor(n / n_folds), F.lit(1))
    return obs.withColumn("fold", F.least(F.floor((F.col("t") - 1) / size), F.lit(n_folds - 1)).cast("int"))


def cross_validate(obs: DataFrame, n_folds: int, fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], float]) -> list[float]:
    """Score of each held-out fold per step; training joins the stretches before and after it."""
    folded, out = with_folds(obs, n_folds).persist(), []
    renumber = F.row_number().over(Window.partitionBy("trial_id").orderBy("t")).cast("int")
    try:
        for i in range(n_folds):
            train = folded.filter(F.col("fold") != i).withColumn("t", renumber).drop("fold")
            test = folded.filter(F.col("fold") == i).withColumn("t", renumber).drop("fold").persist()
            n = test.count()
            out.append(score(fit(train), test) / n if n else math.nan)
            test.unpersist()
    finally:
        folded.unpersist()
    return out


def random_hmm(points: DataFrame, k: int, d: int, seed: int = 0) -> HiddenMarkovModel:
    """A sticky start: random data points as means, half the identity as covariances."""
    from .kmeans import weighted_choice

    means = [weighted_choice(points.select("y"), F.lit(1.0), F.xxhash64(F.lit(seed), F.lit(i), "y")).first()[0] for i in range(k)]
    a = np.full((k, k), 0.1 / max(k - 1, 1))
    np.fill_diagonal(a, 0.9 if k > 1 else 1.0)
    return HiddenMarkovModel(a, np.full(k, 1 / k), tuple(GaussianEmission(m, 0.5 * np.eye(d)) for m in means))


def cross_validate_lds(obs: DataFrame, n_folds: int, start: LinearDynamicalSystem, max_iters: int = 100, tol: float = 1e-6) -> list[float]:
    """Log-likelihood a step of each held-out fold under the system fitted to the others.

    For Gaussian observations the ELBO of a fit's first iteration is taken, which is the log-likelihood; for counts ``marginal_loglik``. Observations
    of a Poisson system that are no counts are a TypeError.
    """
    if start.poisson:
        if not obs.filter(F.exists("y", lambda v: (v < 0) | (v != F.floor(v)))).isEmpty():
            raise TypeError("a Poisson system needs counts")
        scored = lambda m, test: m.marginal_loglik(test).agg(F.sum("loglik")).first()[0]
        return cross_validate(obs, n_folds, lambda train: start.fit(train, max_iters, tol)[0], scored)
    return cross_validate(obs, n_folds, lambda train: start.fit(train, max_iters, tol)[0], lambda m, test: m.fit(test, max_iters=1)[1][0])


def multi_start(obs: DataFrame, k: int, d: int, starts: int, max_iters: int = 100, tol: float = 1e-6, seed: int = 0) -> list[tuple[HiddenMarkovModel, list[float]]]:
    """Fits from several random starts with their histories, the best last likelihood first; all read the trials together."""
    points = obs.select("trial_id", "t", "y", "u", "w").persist()
    try:
        fits = HiddenMarkovModel.fit_many([random_hmm(points, k, d, seed + i) for i in range(starts)], points, max_iters, tol)
    finally:
        points.unpersist()
    return sorted(fits, key=lambda f: -f[1][-1])


def cross_validate_starts(obs: DataFrame, n_folds: int, starts: Sequence[HiddenMarkovModel], max_iters: int = 100, tol: float = 1e-6, strict: bool = True) -> np.ndarray:
    """(starts, folds) log-likelihoods a step of held-out folds, of models that may differ in their number of states.

    One pass an iteration for all starts and folds, and one for the scores; as ``cross_validate`` gives them one by one.
    An observation that is not finite is an error, or with ``strict=False`` makes all scores NaN: every fold is scored or fitted with it.
    """
    if not strict and not finite(obs, "y", "u"):
        return np.full((len(starts), n_folds), np.nan)
    folded = with_folds(obs.select("trial_id", "t", "y", "u", "w"), n_folds).persist()
    try:
        folds = [f for _ in starts for f in range(n_folds)]
        fits = HiddenMarkovModel.fit_many([m for m in starts for _ in range(n_folds)], folded, max_iters, tol, folds)
        scores = HiddenMarkovModel.score_folds([m for m, _ in fits], folded, folds)
    finally:
        folded.unpersist()
    return np.array(scores).reshape(len(starts), n_folds)


# Alignment of labels


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def best_permutation(table: DataFrame, k: int) -> tuple[tuple[int, ...], float]:
    """Relabelling of predictions (from 1) with the largest accuracy, of equal ones the first, and that accuracy."""
    counts = np.zeros((k, k))
    for r in table.collect():
        counts[r.truth - 1, r.predicted - 1] = r.n
    best = assignment(-counts)
    return tuple(int(v) + 1 for v in best), float(sum(counts[best[j], j] for j in range(k)) / max(counts.sum(), 1))


def best_order_by_means(model: HiddenMarkovModel, target: np.ndarray) -> tuple[int, ...]:
    """Order of states whose means are nearest to the target's rows in all, of equal ones the first."""
    means = np.array([e.mean for e in model.emissions])
    return tuple(int(v) for v in assignment(((means[:, None, :] - np.asarray(target)[None]) ** 2).sum(axis=2)))


# Identifiability of linear systems


def is_orthogonal(r: np.ndarray, atol: float = 1e-8) -> bool:
    return bool(np.allclose(r.T @ r, np.eye(len(r)), atol=atol))


def subspace_angles(c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """Principal angles between column spaces, in degrees, ascending."""
    q1, q2 = np.linalg.qr(c1)[0], np.linalg.qr(c2)[0]
    return np.degrees(np.arccos(np.clip(np.linalg.svd(q1.T @ q2)[1], -1, 1)))


def procrustes(df: DataFrame, x: str, y: str, d: int, proper: bool = False) -> np.ndarray:
    """Orthogonal r with r x nearest to y in least squares, from one aggregation of y x'."""
    if d <= E.WIDE:
        sums = [F.sum(F.get(y, F.lit(i)) * F.get(x, F.lit(j))).alias(f"s{i}_{j}") for i in range(d) for j in range(d)]
        cross = np.array(df.agg(*sums).first(), float).reshape(d, d)
    else:
        both = [*E.elements(F.col(y), d), *E.elements(F.col(x), d)]
        cross = E.summed_rows(df, both, lambda v: (v[:, :d].T @ v[:, d:]).ravel(), d * d).reshape(d, d)
    u, _, vt = np.linalg.svd(cross)
    if proper and np.linalg.det(u @ vt) < 0:
        u[:, -1] *= -1
    return u @ vt


def invariants(model: LinearDynamicalSystem) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the dynamics and their time scales, -1/ln of the moduli."""
    values = np.linalg.eigvals(model.state.a)
    with np.errstate(divide="ignore"):
        return values, -1 / np.log(np.abs(values))


@dataclass(frozen=True)
class RotationReport:
    """How a system in other latent coordinates r x compares with the one that it comes from."""

    name: str
    loglik_change: float  # sum over steps of the absolute change of the complete-data log-density
    condition: float  # of r
    orthogonal: bool
    largest_angle: float  # between the column spaces of c, in degrees
    procrustes_error: float  # of the smoothed paths after alignment, relative to the first ones


def rotation_report(model: LinearDynamicalSystem, r: np.ndarray, obs: DataFrame, name: str = "") -> RotationReport:
    """Smooths ``obs`` (trial_id, t, y) under both systems; sums only reach the driver."""
    n, other = model.latent_dim, model.rotated(r)
    steps = obs.select("trial_id", "t", "y")
    both = steps
    for m, at in ((model, "1"), (other, "2")):
        paths = m.smooth(steps).select("trial_id", "t", F.col("x").alias("x"))
        scored = complete_loglik(steps.join(paths, ["trial_id", "t"]), m)
        both = both.join(scored.select("trial_id", "t", F.col("x").alias(f"x{at}"), F.col("ll").alias(f"ll{at}")), ["trial_id", "t"])
    both = both.persist()
    try:
        turn = procrustes(both, "x2", "x1", n)
        back = [E.linear(E.elements(F.col("x2"), n), row) for row in turn]
        first = E.elements(F.col("x1"), n)
        far = E.total([(a - b) * (a - b) for a, b in zip(back, first, strict=True)])
        row = both.agg(F.sum(F.abs(F.col("ll1") - F.col("ll2"))).alias("change"), F.sum(far).alias("far"), F.sum(E.total([a * a for a in first])).alias("size")).first()
    finally:
        both.unpersist()
    error = math.sqrt(row.far or 0.0) / max(math.sqrt(row.size or 0.0), np.finfo(float).eps)
    return RotationReport(name, float(row.change or 0.0), float(np.linalg.cond(r)), is_orthogonal(r), float(subspace_angles(model.obs.c, other.obs.c).max()), error)


# Reports


def segments(path: DataFrame) -> DataFrame:
    """(trial_id, segment, state, first, last): maximal runs of one state."""
    w = Window.partitionBy("trial_id").orderBy("t")
    change = F.when(F.lag("state").over(w) == F.col("state"), 0).otherwise(1)
    runs = path.withColumn("segment", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("trial_id", "segment").agg(F.min("state").alias("state"), F.min("t").alias("first"), F.max("t").alias("last"))


def trial_accuracy(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(trial_id, accuracy) of two tables (trial_id, t, state)."""
    both = truth.select("trial_id", "t", F.col("state").alias("a")).join(predicted.select("trial_id", "t", F.col("state").alias("b")), ["trial_id", "t"])
    return both.groupBy("trial_id").agg(F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)).alias("accuracy"))


def mean_squared_error(df: DataFrame, y: str, predicted: str) -> Column:
    """Aggregate: mean over rows and entries of the squared difference of two array columns."""
    sq = F.aggregate(F.zip_with(y, predicted, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return df.agg((F.sum(sq) / F.sum(F.size(y))).alias("mse"))


def compare_errors(df: DataFrame, y: str, predicted: dict[str, str]) -> DataFrame:
    """(model, mse) of several models' predictions of one column, from one aggregation; ``predicted`` maps names to columns."""
    sq = lambda p: F.aggregate(F.zip_with(y, p, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    sums = df.agg(F.sum(F.size(y)).alias("n"), *[F.sum(sq(p)).alias(f"s{i}") for i, p in enumerate(predicted.values())])
    pairs = [F.struct(F.lit(name).alias("model"), (F.col(f"s{i}") / F.col("n")).alias("mse")) for i, name in enumerate(predicted)]
    return sums.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def variance_explained(mo: Moments, model: ProbabilisticPCA) -> tuple[float, float]:
    """Share of the total variance in the k largest eigenvalues of the data's covariance, and in W W' of the model."""
    k = model.w.shape[1]
    values = np.linalg.eigvalsh(mo.scatter(mo.mean) / max(mo.n - 1, 1))[::-1]
    fitted = float(np.trace(model.w @ model.w.T))
    return float(values[:k].sum() / values.sum()), fitted / (fitted + model.s2 * len(model.mu))


def medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median of a column per group; NaN rows are left out."""
    return df.filter(~F.isnan(value)).groupBy(*keys).agg(F.median(value).alias("median"))


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def extrema(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
