"""Long trials, wide rows, many states and missing weights, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import evaluation as V
from ..operators import kmeans
from ..operators.emissions import BernoulliRegressionEmission, GaussianEmission
from ..operators.glm import gradient_sums
from ..operators.hmm import HiddenMarkovModel
from ..operators.mixture import GaussianMixture
from ..operators.online import filtered
from . import queries_dims, queries_series
from .queries_rows import rounded, rows, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Trials cut into stretches of 8 steps; what comes out is what whole trials give


@query(queries_series.ORACLE_SQL["hmm_class_probabilities"])
def hmm_stretch_gamma(spark, sf_dir):
    out = queries_series.HMM.class_probabilities(queries_series.observations(spark, sf_dir), stretch=8)
    return rounded(out.select("trial_id", "t", F.get("gamma", F.lit(0)).alias("g1"), F.get("gamma", F.lit(1)).alias("g2")), 5)


@query(queries_dims.ORACLE_SQL["hmm3_viterbi"])
def hmm3_stretch_viterbi(spark, sf_dir):
    return queries_dims.HMM3.viterbi(queries_dims.observations(spark, sf_dir), stretch=8)


@query(queries_dims.ORACLE_SQL["lds2_smoother"])
def lds2_stretch_smoother(spark, sf_dir):
    out = queries_dims.LDS2.smooth(queries_dims.observations(spark, sf_dir), stretch=8)
    xs = [F.get("x", F.lit(i)).alias(f"x{i + 1}") for i in (0, 1)]
    return rounded(out.select("trial_id", "t", *xs, *[F.get("p", F.lit(i)).alias(n) for i, n in ((0, "p11"), (1, "p12"), (3, "p22"))]), 5)


# Rows without a weight


@query(
    "WITH l AS (SELECT l_extendedprice AS x, l_quantity AS y, l_discount AS w FROM lineitem WHERE l_linenumber <> 3), m AS (SELECT sum(w) AS n, sum(w * x) / sum(w) AS m1, sum(w * y) / sum(w) AS m2 FROM l) "
    "SELECT round(any_value(m1), 4) AS m1, round(any_value(m2), 6) AS m2, round(sum(w * (x - m1) * (x - m1)) / any_value(n) / 1e6, 4) AS v11, round(sum(w * (x - m1) * (y - m2)) / any_value(n) / 1e3, 4) AS v12, "
    "round(sum(w * (y - m2) * (y - m2)) / any_value(n), 6) AS v22 FROM l, m"
)
def null_weight_fit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.array("l_extendedprice", "l_quantity").alias("y"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("w")
    )
    e = GaussianEmission([0.0, 0.0], np.eye(2)).fit(lines, w="w")
    found = tuple(round(float(v), n) for v, n in ((e.mean[0], 4), (e.mean[1], 6), (e.cov[0, 0] / 1e6, 4), (e.cov[0, 1] / 1e3, 4), (e.cov[1, 1], 6)))
    return rows(spark, [found], "m1 double, m2 double, v11 double, v12 double, v22 double")


# Wide rows: the 64 elements of the embeddings

WIDTH = 64
_CENTRES = np.stack([0.12 * np.sin(np.arange(WIDTH) * (k + 1)) for k in range(3)])
_WEIGHTS = (0.2, 0.3, 0.5)
_ELEMENTS = "pts AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), one AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM pts)"
_CENTRE_ROWS = "c AS (SELECT * FROM (VALUES " + ", ".join(f"({k + 1}, {i + 1}, {float(_CENTRES[k, i])!r}::DOUBLE, {_WEIGHTS[k]}::DOUBLE)" for k in range(3) for i in range(WIDTH)) + ") t(k, i, m, w))"
_WIDE_STEP = (
    f"WITH {_ELEMENTS}, {_CENTRE_ROWS}, j AS (SELECT vec_id, k, ln(any_value(w)) - 0.5 * sum((v - m) * (v - m)) / 0.05 AS l FROM one JOIN c USING (i) GROUP BY vec_id, k), "
    "t AS (SELECT vec_id, max(l) AS top FROM j GROUP BY vec_id), z AS (SELECT vec_id, any_value(top) + ln(sum(exp(l - top))) AS z FROM j JOIN t USING (vec_id) GROUP BY vec_id), "
    "g AS MATERIALIZED (SELECT vec_id, k, exp(l - z) AS g FROM j JOIN z USING (vec_id)), n AS (SELECT k, sum(g) AS n FROM g GROUP BY k), "
    "m AS MATERIALIZED (SELECT k, i, sum(g * v) / any_value(n) AS mean, any_value(n) AS n FROM g JOIN one USING (vec_id) JOIN n USING (k) GROUP BY k, i)"
)


def _mixture() -> GaussianMixture:
    return GaussianMixture(_WEIGHTS, _CENTRES, [0.05 * np.eye(WIDTH)] * 3)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@query(f"{_WIDE_STEP} SELECT k, i::INT AS i, round(n / (SELECT count(*) FROM pts), 5) AS weight, round(mean, 5) AS mean FROM m")
def wide_mixture_means(spark, sf_dir):
    m = _mixture().step(_vectors(spark, sf_dir))
    found = [(k + 1, i + 1, float(m.weights[k]), float(m.means[k, i])) for k in range(3) for i in range(WIDTH)]
    return rounded(rows(spark, found, "k int, i int, weight double, mean double"), 5)


@query(
    f"{_WIDE_STEP}, d AS (SELECT vec_id, k, i, v - mean AS e FROM one JOIN m USING (i)) SELECT a.k, a.i::INT AS i, b.i::INT AS j, round(sum(g * a.e * b.e) / (any_value(n) + 1e-6) + CASE WHEN a.i = b.i THEN 1e-6 ELSE 0 END, 5) AS cov "
    "FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.k = b.k AND a.i <= b.i JOIN g ON g.vec_id = a.vec_id AND g.k = a.k JOIN n ON n.k = a.k GROUP BY a.k, a.i, b.i"
)
def wide_mixture_covariances(spark, sf_dir):
    m = _mixture().step(_vectors(spark, sf_dir))
    found = [(k + 1, i + 1, j + 1, float(m.covs[k, i, j])) for k in range(3) for i in range(WIDTH) for j in range(i, WIDTH)]
    return rounded(rows(spark, found, "k int, i int, j int, cov double"), 5)


_BETA = 0.3 * np.cos(np.arange(WIDTH + 1))
_ETA = f"e AS (SELECT vec_id, any_value(label) AS label, {float(_BETA[0])!r} + sum(v * b) AS eta FROM one JOIN embeddings USING (vec_id) JOIN beta USING (i) GROUP BY vec_id)"
_BETA_ROWS = "beta AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {float(_BETA[i])!r}::DOUBLE)" for i in range(1, WIDTH + 1)) + ") t(i, b))"


@query(
    f"WITH {_ELEMENTS}, {_BETA_ROWS}, {_ETA}, r AS (SELECT vec_id, 1 / (1 + exp(-eta)) - (label < 3)::INT AS r FROM e) "
    "SELECT 0 AS i, round(sum(r), 5) AS gradient FROM r UNION ALL SELECT i::INT, round(sum(r * v), 5) FROM r JOIN one USING (vec_id) GROUP BY i"
)
def wide_regression_gradient(spark, sf_dir):
    """What a quasi-Newton step reads: one pass over 64 inputs and the intercept."""
    columns = [F.lit(1.0), *E.elements(F.col("x"), WIDTH), (F.col("label") < 3).cast("double")]
    p = WIDTH + 1
    s = E.summed_rows(_vectors(spark, sf_dir), columns, lambda v: gradient_sums("bernoulli", v[:, :p], v[:, p], np.ones((len(v), 1)), _BETA[:, None]), 1 + p)
    return rounded(rows(spark, [(i, float(v)) for i, v in enumerate(s[1:])], "i int, gradient double"), 5)


@query()
def wide_regression_fit(spark, sf_dir):
    """The minimum has no closed form; tests hold it against Newton's method and look at the gradient there."""
    labelled = _vectors(spark, sf_dir).select(F.array((F.col("label") < 3).cast("double")).alias("y"), F.col("x").alias("u"))
    fitted = BernoulliRegressionEmission(np.zeros(WIDTH + 1), True, 1.0).fit(labelled)
    return rounded(rows(spark, [(i, float(v)) for i, v in enumerate(fitted.beta[:, 0])], "i int, beta double"), 4)


# Ten labels, ten clusters

_TEN = np.stack([0.2 * np.cos(np.arange(WIDTH) * (k + 0.5)) for k in range(10)])


def _subset_sums() -> str:
    """CTEs a0..a10: the best count of matches for each set of truths that the first j predictions may take."""
    out = ["a0 AS (SELECT 0 AS taken, 0::BIGINT AS best)"]
    for j in range(10):
        out.append(f"a{j + 1} AS (SELECT taken | (1 << i) AS taken, max(best + coalesce(n, 0)) AS best FROM a{j} JOIN range(10) r(i) ON taken & (1 << i) = 0 LEFT JOIN counts ON truth = i AND predicted = {j} GROUP BY 1)")
    return ", ".join(out)


_NEAREST = "near AS (SELECT vec_id, arg_min(k, (d, k)) AS k FROM (SELECT vec_id, k, sum((v - m) * (v - m)) AS d FROM one JOIN ten USING (i) GROUP BY vec_id, k) GROUP BY vec_id)"
_TEN_ROWS = "ten AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {i + 1}, {float(_TEN[k, i])!r}::DOUBLE)" for k in range(10) for i in range(WIDTH)) + ") t(k, i, m))"


@query(
    f"WITH {_ELEMENTS}, {_TEN_ROWS}, {_NEAREST}, counts AS (SELECT label AS truth, k AS predicted, count(*) AS n FROM near JOIN embeddings USING (vec_id) GROUP BY 1, 2), {_subset_sums()} "
    "SELECT best AS matches, round(best / (SELECT count(*) FROM embeddings), 6) AS accuracy FROM a10"
)
def ten_label_alignment(spark, sf_dir):
    labelled = kmeans.assign(_vectors(spark, sf_dir).select((F.col("label") + 1).alias("truth"), "x"), _TEN)
    counted = V.confusion(labelled, "truth", "label")
    n = labelled.count()
    _, accuracy = V.best_permutation(counted, 10)
    return rows(spark, [(round(accuracy * n), round(accuracy, 6))], "matches long, accuracy double")


@query()
def parallel_seeds(spark, sf_dir):
    """Twenty seeds in five rounds; random, so tests compare their cost with that of seeds found one by one."""
    found = kmeans.parallel_seeds(_vectors(spark, sf_dir), 20, WIDTH, seed=7)
    return rounded(rows(spark, [(i + 1, [float(v) for v in c]) for i, c in enumerate(found)], "seed int, x array<double>"))


# Filters


@query(f"WITH RECURSIVE {queries_series._FWD} SELECT trial_id, t, round(1 / (1 + exp(a2 - a1)), 6) AS p1, round(greatest(a1, a2) + ln(1 + exp(-abs(a1 - a2))), 5) AS loglik FROM f")
def hmm_filtered(spark, sf_dir):
    """What the filter of a stream gives, over a table."""
    out = filtered(queries_series.observations(spark, sf_dir), queries_series.HMM).filter("not late")
    return out.select("trial_id", "t", F.round(F.get("filtered", F.lit(0)), 6).alias("p1"), F.round("loglik", 5).alias("loglik"))


@query()
def plds_marginal(spark, sf_dir):
    """Likelihoods of counts have no closed form; tests hold them against quadrature."""
    out = queries_series.PLDS.marginal_loglik(queries_series._paths(spark, sf_dir).select("trial_id", "t", F.col("k").alias("y")), draws=64)
    return out.select("trial_id", "n", F.round("loglik", 2).alias("loglik"), F.round("laplace", 4).alias("laplace"))


@query()
def hmm_folds(spark, sf_dir):
    """Two and three states, two folds each, held out; one pass an iteration for all four fits."""
    obs = queries_series.observations(spark, sf_dir)
    starts = [HiddenMarkovModel(np.full((k, k), 0.1 / (k - 1)) + np.eye(k) * (0.9 - 0.1 / (k - 1)), np.full(k, 1 / k), [GaussianEmission([1.0 + 4.0 * i / k], [[1.0]]) for i in range(k)]) for k in (2, 3)]
    scores = V.cross_validate_starts(obs, 2, starts, max_iters=3, tol=0.0, strict=False)
    return rounded(rows(spark, [(k, f, float(scores[i, f])) for i, k in enumerate((2, 3)) for f in range(2)], "states int, fold int, score double"), 5)
