"""Probabilistic PCA. The posterior is linear, so all of EM runs on the moments of one scan."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.display import Described


@dataclass(frozen=True)
class Moments:
    n: int
    mean: np.ndarray
    second: np.ndarray  # mean of (x - shift)(x - shift)'
    shift: np.ndarray | float = 0.0

    def scatter(self, mu: np.ndarray) -> np.ndarray:
        """Sum of (x - mu)(x - mu)'."""
        m, to = self.mean - self.shift, mu - self.shift
        return self.n * (self.second - np.outer(m, to) - np.outer(to, m) + np.outer(to, to))


def moments(df: DataFrame, d: int, x: str = "x") -> Moments:
    """Count, mean and second moments of an array column, about a first row's value so that they keep their digits."""
    head = df.select(x).filter(F.col(x).isNotNull()).first()
    if head is None:
        return Moments(0, np.zeros(d), np.zeros((d, d)))
    shift = np.array([float(v) for v in head[0][:d]])
    n, s, q = E.second_moments(df, E.elements(F.col(x), d), F.lit(1.0), shift)
    return Moments(int(n), s / n + shift, q / n, shift)


@dataclass(frozen=True, repr=False)
class ProbabilisticPCA(Described):
    """x ~ N(W z + mu, s2 I), z ~ N(0, I); W is (d, k)."""

    w: np.ndarray
    s2: float
    mu: np.ndarray

    def __post_init__(self):
        object.__setattr__(self, "w", np.array(self.w, float))
        object.__setattr__(self, "mu", np.array(self.mu, float))

    def _inverse(self) -> np.ndarray:
        return np.linalg.inv(self.w.T @ self.w + self.s2 * np.eye(self.w.shape[1]))

    def posterior(self, df: DataFrame, x: str = "x") -> DataFrame:
        """``df`` with ``z``, the latent's posterior mean."""
        m = self._inverse() @ self.w.T
        xs = [c - float(v) for c, v in zip(E.elements(F.col(x), len(self.mu)), self.mu, strict=True)]
        return df.withColumn("z", F.array(*[E.linear(xs, row) for row in m]))

    def reconstruct(self, df: DataFrame, z: str = "z") -> DataFrame:
        """``df`` with ``x_hat`` = W z + mu."""
        zs = E.elements(F.col(z), self.w.shape[1])
        return df.withColumn("x_hat", F.array(*[E.linear(zs, row) + float(m) for row, m in zip(self.w, self.mu, strict=True)]))

    def estep_sums(self, mo: Moments) -> tuple[np.ndarray, np.ndarray]:
        """Sums of (x - mu) E[z]' and of E[z z']."""
        s, inv = mo.scatter(self.mu), self._inverse()
        a = s @ self.w @ inv
        return a, mo.n * self.s2 * inv + inv @ self.w.T @ a

    def mstep(self, mo: Moments) -> ProbabilisticPCA:
        """New W; the noise is estimated with the W of the E-step."""
        a, b = self.estep_sums(mo)
        d = len(self.mu)
        s2 = (np.trace(mo.scatter(self.mu)) - 2 * np.trace(self.w.T @ a) + np.trace(b @ self.w.T @ self.w)) / (mo.n * d)
        return ProbabilisticPCA(np.linalg.solve(b.T, a.T).T, float(s2), self.mu)

    def loglikelihood(self, mo: Moments) -> float:
        c = self.w @ self.w.T + self.s2 * np.eye(len(self.mu))
        try:
            low = np.linalg.cholesky(c)
        except np.linalg.LinAlgError:
            return -math.inf
        return float(-0.5 * mo.n * (len(self.mu) * math.log(2 * math.pi) + 2 * np.log(np.diag(low)).sum()) - 0.5 * np.trace(np.linalg.solve(c, mo.scatter(self.mu))))

    def fit(self, df: DataFrame, max_iters: int = 100, tol: float = 1e-6, x: str = "x") -> tuple[ProbabilisticPCA, list[float]]:
        """EM after one scan; mu is the data's mean if it is all zeros."""
        mo = moments(df, len(self.mu), x)
        model, history = ProbabilisticPCA(self.w, self.s2, mo.mean if not self.mu.any() else self.mu), []
        for _ in range(max_iters):
            model = model.mstep(mo)
            history.append(model.loglikelihood(mo))
            if len(history) > 1 and abs(history[-1] - history[-2]) < tol:
                break
        return model, history

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """(id, z, x)."""
        d, k = self.w.shape
        base = spark.range(n).withColumns({f"_z{i}": F.randn(seed + i) for i in range(k)} | {f"_e{i}": F.randn(seed + k + i) for i in range(d)})
        zs = [F.col(f"_z{i}") for i in range(k)]
        xs = [E.linear(zs, row) + float(m) + F.col(f"_e{i}") * math.sqrt(self.s2) for i, (row, m) in enumerate(zip(self.w, self.mu, strict=True))]
        return base.select("id", F.array(*zs).alias("z"), F.array(*xs).alias("x"))
