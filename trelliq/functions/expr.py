"""Column expressions over numbers and flat arrays of doubles; parameters are literals, so Catalyst folds them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.obs import VECTOR, added, vector_batch


def ln(x: Column) -> Column:
    """Natural logarithm by IEEE 754 and as in DuckDB: -inf of 0 and NaN below, where Spark's own gives null."""
    return F.when(x > 0, F.ln(x)).when(x == 0, -math.inf).when(x < 0, math.nan)


def lit_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in np.ravel(values)])


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def elements(array: Column, n: int) -> list[Column]:
    return [F.get(array, F.lit(i)).cast("double") for i in range(n)]


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def linear(xs: Sequence[Column], weights) -> Column:
    """sum_i weights[i] * xs[i] for literal weights."""
    return total([x * float(w) for x, w in zip(xs, weights, strict=True)])


def second_moments(df: DataFrame, xs: Sequence[Column], w: Column, centre: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums of w, w (x - centre) and w (x - centre)(x - centre)', in one aggregation. Rows with a null or NaN are left out."""
    d, centre = len(xs), np.asarray(centre, float)
    if d <= WIDE:
        moved = [x - float(c) for x, c in zip(xs, centre, strict=True)]
        known = df.select(w.alias("w"), *[x.alias(f"x{i}") for i, x in enumerate(moved)]).dropna()
        cols = [F.col(f"x{i}") for i in range(d)]
        sums = [F.sum("w")] + [F.sum(F.col("w") * a) for a in cols] + [F.sum(F.col("w") * cols[i] * cols[j]) for i in range(d) for j in range(i, d)]
        row = np.array([v or 0.0 for v in known.agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)]).first()])
        q = np.zeros((d, d))
        q[np.triu_indices(d)] = row[1 + d :]
        return float(row[0]), row[1 : 1 + d], q + np.triu(q, 1).T

    def kernel(v: np.ndarray) -> np.ndarray:
        x, weight = v[:, :d] - centre, v[:, d]
        return np.concatenate([[weight.sum()], weight @ x, ((x * weight[:, None]).T @ x).ravel()])

    out = summed_rows(df, [*xs, w.cast("double")], kernel, 1 + d + d * d)
    return float(out[0]), out[1 : 1 + d], out[1 + d :].reshape(d, d)


def weighted_means(df: DataFrame, xs: Sequence[Column], w: Column) -> np.ndarray:
    """Weighted mean of each column over the rows without nulls, NaN and infinities; 0 where there is nothing."""
    known = df.select(w.cast("double").alias("w"), *[x.cast("double").alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    known = known.filter(reduce(lambda a, b: a & b, [F.abs(c) < math.inf for c in known.columns]))
    row = known.agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col(f"x{i}")).alias(f"m{i}") for i in range(len(xs))]).first()
    return np.array([(v or 0.0) / row[0] if row[0] else 0.0 for v in row[1:]])


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)) that overflows for no x."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softplus(x: Column) -> Column:
    """ln(1 + exp(x))."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_sum_exp(xs: Sequence[Column]) -> Column:
    """ln sum exp of columns; all -inf stays -inf."""
    m = F.greatest(*xs) if len(xs) > 1 else xs[0]
    return F.when(m == -math.inf, m).otherwise(m + F.ln(total([F.exp(x - m) for x in xs])))


def log_factorial(n: Column) -> Column:
    """ln n! of a non-negative integer column, exactly summed."""
    n = n.cast("int")
    return F.when(n < 2, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + F.ln(i.cast("double"))))


def normal_logpdf(x: Column, mean: float, variance: float) -> Column:
    return F.lit(-0.5 * math.log(2 * math.pi * variance)) - (x - float(mean)) * (x - float(mean)) / float(2 * variance)


#: Quadratic forms in more columns than this are matrix products in Arrow batches: as expressions they outgrow what can be compiled.
WIDE = 24


def rows_apply(xs: Sequence[Column], kernel: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> Column:
    """A number for each row from the (n, d) matrix of some columns, none of them null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(kernel(np.stack(values.to_numpy()).astype(float)) if len(values) else np.empty(0))

    return run(F.array(*xs))


def summed_rows(df: DataFrame, xs: Sequence[Column], kernel: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over all rows without nulls and NaN of a vector of statistics of (n, d) matrices: summed in each task, then across tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                out += kernel(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        yield vector_batch(out)

    known = df.select(F.array(*[x.cast("double") for x in xs]).alias("x")).filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    return added(known.mapInArrow(run, VECTOR), width)


def grouped_moments(df: DataFrame, x: str, label: str, d: int, k: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For labels 1 to k: how many rows they have, and the sums of an array column and of its outer products, in one pass."""

    def kernel(v: np.ndarray) -> np.ndarray:
        parts = [v[v[:, d] == j + 1, :d] for j in range(k)]
        return np.concatenate([np.concatenate([[len(p)], p.sum(axis=0), (p.T @ p).ravel()]) for p in parts])

    # About the mean of all, so that the products keep their digits.
    centre = weighted_means(df, elements(F.col(x), d), F.lit(1.0))
    moved = [c - float(m) for c, m in zip(elements(F.col(x), d), centre, strict=True)]
    out = summed_rows(df, [*moved, F.col(label).cast("double")], kernel, k * (1 + d + d * d)).reshape(k, -1)
    found = []
    for n, s, q in ((r[0], r[1 : 1 + d], r[1 + d :].reshape(d, d)) for r in out):
        whole = s + n * centre
        found.append((float(n), whole, q + np.outer(s, centre) + np.outer(centre, s) + n * np.outer(centre, centre)))
    return found


def mvn_logpdf(xs: Sequence[Column], mean, cov) -> Column:
    """Multivariate normal log-density of columns, by the inverse Cholesky factor."""
    mean, cov = np.asarray(mean, float), np.asarray(cov, float)
    low = np.linalg.cholesky(cov)
    inv = np.linalg.inv(low)
    const = -0.5 * len(mean) * math.log(2 * math.pi) - float(np.log(np.diag(low)).sum())
    if len(mean) > WIDE:
        return rows_apply(xs, lambda x: const - 0.5 * (((x - mean) @ inv.T) ** 2).sum(axis=1))
    centred = [x - float(m) for x, m in zip(xs, mean, strict=True)]
    rows = [linear(centred[: i + 1], inv[i, : i + 1]) for i in range(len(mean))]
    return F.lit(const) - 0.5 * total([r * r for r in rows])


def quadratic(xs: Sequence[Column], matrix) -> Column:
    """x' M x for a literal symmetric matrix."""
    m = np.asarray(matrix, float)
    return total([xs[i] * xs[j] * float(m[i, j] + (m[j, i] if i != j else 0)) for i in range(len(xs)) for j in range(i, len(xs))])


def poisson_logpmf(n: Column, rate: float) -> Column:
    return n * math.log(rate) - float(rate) - log_factorial(n)


def log_softmax(xs: Sequence[Column]) -> list[Column]:
    z = log_sum_exp(xs)
    return [x - z for x in xs]
