"""k-means on an array column ``x``, seeded by k-means++ or, for many clusters, in a few oversampled rounds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E


@dataclass(frozen=True)
class KMeansResult:
    centroids: np.ndarray  # (k, d)
    iterations: int


def _distances(xs: list[Column], centroids) -> list[Column]:
    return [E.total([(x - float(c)) * (x - float(c)) for x, c in zip(xs, row, strict=True)]) for row in np.asarray(centroids, float)]


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids]).argmin(axis=0)


def assign(df: DataFrame, centroids, x: str = "x") -> DataFrame:
    """``df`` with ``label``, the nearest centroid from 1, of equal ones the first."""
    centroids = np.asarray(centroids, float)
    if centroids.shape[1] > E.WIDE:
        return df.withColumn("label", E.rows_apply(E.elements(F.col(x), centroids.shape[1]), lambda v: _nearest(v, centroids) + 1, "int"))
    d = F.array(*_distances(E.elements(F.col(x), centroids.shape[1]), centroids))
    return df.withColumn("label", F.array_position(d, F.array_min(d)).cast("int"))


def weighted_choices(df: DataFrame, weight: Column, key: Column, n: int) -> DataFrame:
    """``n`` rows picked with odds proportional to ``weight``, none twice: the largest of ln(uniform)/weight, with a uniform from ``key``'s hash."""
    uniform = (F.pmod(key, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return df.withColumn("_score", F.when(weight > 0, F.ln(uniform) / weight)).filter("_score is not null").orderBy(F.desc("_score")).limit(n).drop("_score")


def weighted_choice(df: DataFrame, weight: Column, key: Column) -> DataFrame:
    return weighted_choices(df, weight, key, 1)


def plus_plus(df: DataFrame, k: int, d: int, x: str = "x", seed: int = 0) -> np.ndarray:
    """k seeds, each picked with odds proportional to the squared distance to the nearest before it."""
    xs = E.elements(F.col(x), d)
    chosen: list[list[float]] = []

    def distance() -> Column:
        if d > E.WIDE:
            near = np.array(chosen)
            return E.rows_apply(xs, lambda v: _squared(v, near))
        each = _distances(xs, chosen)
        return F.least(*each) if len(each) > 1 else each[0]

    for i in range(k):
        weight = distance() if chosen else F.lit(1.0)
        row = weighted_choice(df.select(x), weight, F.xxhash64(F.lit(seed), F.lit(i), F.col(x))).first()
        if row is None:
            row = weighted_choice(df.select(x), F.lit(1.0), F.xxhash64(F.lit(seed), F.lit(i), F.col(x))).first()
        if row is None:
            raise ValueError("no points")
        chosen.append([float(v) for v in row[0]])
    return np.array(chosen)


def _squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each row to its nearest centroid, by differences (products would lose the digits of small ones)."""
    out = np.full(len(v), np.inf)
    for c in centroids:
        np.minimum(out, ((v - c) ** 2).sum(axis=1), out=out)
    return out


def parallel_seeds(df: DataFrame, k: int, d: int, x: str = "x", seed: int = 0, rounds: int = 5, oversampling: int = 2) -> np.ndarray:
    """k seeds from ``rounds`` scans, however many they are.

    Each round adds ``oversampling`` times k points, picked at once with odds proportional to the squared distance to the nearest candidate
    so far. Candidates are then weighted by the points nearest to them, in one more scan, and k-means++ runs on them on the driver,
    which holds rounds times oversampling times k points at most.
    """
    points, xs = df.select(x), E.elements(F.col(x), d)
    first = weighted_choice(points, F.lit(1.0), F.xxhash64(F.lit(seed), F.lit(0), F.col(x))).first()
    if first is None:
        raise ValueError("no points")
    found = [list(map(float, first[0]))]
    for i in range(rounds):
        near = np.array(found)
        scored = points.withColumn("_d", E.rows_apply(xs, lambda v, near=near: _squared(v, near)))
        found += [list(map(float, r[0])) for r in weighted_choices(scored, F.col("_d"), F.xxhash64(F.lit(seed), F.lit(i + 1), F.col(x)), oversampling * k).select(x).collect()]
    candidates = np.unique(np.array(found), axis=0)
    weights = E.summed_rows(points, xs, lambda v: np.bincount(_nearest(v, candidates), minlength=len(candidates)).astype(float), len(candidates))
    rng = np.random.Generator(np.random.Philox(key=[seed, k]))
    chosen = [candidates[rng.choice(len(candidates), p=weights / weights.sum())]]
    while len(chosen) < k:
        odds = weights * _squared(candidates, np.array(chosen))
        # Fewer different points than clusters: the rest fall on points that there are.
        odds = odds if odds.sum() > 0 else weights
        # Of a few draws the one that helps most, as in greedy k-means++.
        draws = rng.choice(len(candidates), size=2 + int(np.log(k)), p=odds / odds.sum())
        costs = [(weights * _squared(candidates, np.array([*chosen, candidates[j]]))).sum() for j in draws]
        chosen.append(candidates[draws[int(np.argmin(costs))]])
    return np.array(chosen)


#: Up to so many seeds are found one after the other, a scan each.
FEW_SEEDS = 8


def seeds(df: DataFrame, k: int, d: int, x: str = "x", seed: int = 0) -> np.ndarray:
    return (plus_plus if k <= FEW_SEEDS else parallel_seeds)(df, k, d, x, seed)


def step(df: DataFrame, centroids: np.ndarray, x: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """Means of the clusters around ``centroids`` and their sizes, in one aggregation."""
    k, d = centroids.shape
    xs = E.elements(F.col(x), d)
    if d > E.WIDE:

        def kernel(v: np.ndarray) -> np.ndarray:
            one = _nearest(v, centroids)[:, None] == np.arange(k)
            return np.hstack([one.sum(axis=0)[:, None], one.T.astype(float) @ v]).ravel()

        sums = E.summed_rows(df, xs, kernel, k * (1 + d)).reshape(k, 1 + d)
        sizes = sums[:, 0].astype(int)
        return np.where(sizes[:, None] > 0, sums[:, 1:] / np.maximum(sizes, 1)[:, None], np.nan), sizes
    rows = assign(df, centroids, x).groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(xs)]).collect()
    means, sizes = np.full((k, d), np.nan), np.zeros(k, int)
    for r in rows:
        sizes[r.label - 1] = r.n
        means[r.label - 1] = [r[f"m{i}"] for i in range(d)]
    return means, sizes


def kmeans(df: DataFrame, k: int, d: int, max_iters: int = 100, tol: float = 1e-6, x: str = "x", seed: int = 0, start=None) -> KMeansResult:
    """Lloyd's iterations until no centroid moves by ``tol``; an empty cluster starts anew at a random point."""
    points = df.select(x).persist()
    try:
        centroids = seeds(points, k, d, x, seed) if start is None else np.array(start, float)
        for it in range(1, max_iters + 1):
            new, sizes = step(points, centroids, x)
            for j in np.flatnonzero(sizes == 0):
                new[j] = weighted_choice(points, F.lit(1.0), F.xxhash64(F.lit(seed), F.lit(1000 + it), F.lit(int(j)), F.col(x))).first()[0]
            moved = np.abs(new - centroids).max()
            centroids = new
            if moved < tol:
                break
    finally:
        points.unpersist()
    return KMeansResult(centroids, it)
