"""Many elements, inputs, states and clusters: the wide paths against the narrow ones and against NumPy."""

import itertools

import numpy as np
import pytest

from trelliq.functions import expr as E
from trelliq.functions.linalg import BlockTridiagonal, assignment, lbfgs
from trelliq.operators import evaluation, kmeans
from trelliq.operators.emissions import BernoulliRegressionEmission, GaussianEmission, PoissonRegressionEmission
from trelliq.operators.hmm import HiddenMarkovModel
from trelliq.operators.mixture import GaussianMixture
from trelliq.sources import obs as sources


def vectors(spark, x, **more):
    rows = [(list(map(float, v)), *[float(c[i]) for c in more.values()]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["x array<double>", *[f"{n} double" for n in more]])).repartition(3)


@pytest.mark.parametrize("narrow", [1 << 16, 7])
def test_wide_mixture_steps(spark, monkeypatch, narrow):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(sources, "NARROW", narrow)
    x = rng.standard_normal((200, 3)) + rng.integers(0, 2, (200, 1)) * 3
    m = GaussianMixture([0.5, 0.5], rng.standard_normal((2, 3)), [np.eye(3)] * 2)
    a, history = m.fit(vectors(spark, x), max_iters=4, tol=0)
    monkeypatch.setattr(E, "WIDE", 2)
    b, same = m.fit(vectors(spark, x), max_iters=4, tol=0)
    np.testing.assert_allclose(same, history, rtol=1e-10)
    for n in ("weights", "means", "covs"):
        np.testing.assert_allclose(getattr(b, n), getattr(a, n), atol=1e-9)


def test_mixture_of_64_elements(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((3, 64)) * 2
    x = centres[rng.integers(0, 3, 600)] + rng.standard_normal((600, 64))
    m, history = GaussianMixture(np.full(3, 1 / 3), centres + 0.1, [np.eye(64)] * 3).fit(vectors(spark, x), max_iters=3)
    assert history == sorted(history)
    assert np.abs(np.sort(m.means, axis=0) - np.sort(centres, axis=0)).max() < 0.6


@pytest.mark.parametrize("emission", [BernoulliRegressionEmission, PoissonRegressionEmission])
def test_gradient_and_newton_agree(spark, monkeypatch, emission):
    rng = np.random.default_rng(2)
    u = rng.standard_normal((400, 4))
    eta = 0.3 + u @ [0.5, -0.4, 0.2, 0.0]
    y = (rng.random(400) < 1 / (1 + np.exp(-eta))).astype(float) if emission is BernoulliRegressionEmission else rng.poisson(np.exp(eta)).astype(float)
    df = vectors(spark, u, y=y, w=rng.random(400)).selectExpr("x AS u", "array(y) AS y", "w")
    for l2, intercept in ((0.0, True), (2.0, False)):
        start = emission(np.zeros(4 + intercept), intercept, l2)
        a = start.fit(df, w="w")
        with monkeypatch.context() as m:
            m.setattr(E, "WIDE", 2)
            b = start.fit(df, w="w")
        np.testing.assert_allclose(b.beta, a.beta, atol=1e-5)


def test_regression_on_2000_inputs(spark):
    rng = np.random.default_rng(3)
    u = rng.standard_normal((300, 2000)) * 0.05
    y = (rng.random(300) < 0.5).astype(float)
    fit = BernoulliRegressionEmission(np.zeros(2001), True, 0.1).fit(vectors(spark, u, y=y).selectExpr("x AS u", "array(y) AS y"))
    x = np.hstack([np.ones((300, 1)), u])
    mean = 1 / (1 + np.exp(-(x @ fit.beta)[:, 0]))
    penalty = np.r_[0, np.full(2000, 0.1)]
    assert np.abs(x.T @ (mean - y) + penalty * fit.beta[:, 0]).max() < 1e-5


def test_lbfgs_on_a_curved_valley():
    def valley(x):
        g = np.zeros_like(x)
        g[:-1] = -400 * x[:-1] * (x[1:] - x[:-1] ** 2) - 2 * (1 - x[:-1])
        g[1:] += 200 * (x[1:] - x[:-1] ** 2)
        return float((100 * (x[1:] - x[:-1] ** 2) ** 2 + (1 - x[:-1]) ** 2).sum()), g

    np.testing.assert_allclose(lbfgs(valley, np.zeros(40), iterations=2000), 1, atol=1e-6)
    assert lbfgs(lambda x: (0.0, np.zeros(2)), np.array([3.0, 4.0])).tolist() == [3.0, 4.0]


def test_assignment_against_enumeration():
    rng = np.random.default_rng(4)
    for k, top in itertools.product(range(1, 7), (2, 4, 1000)):
        for _ in range(8):
            c = rng.integers(0, top, (k, k)).astype(float)
            best = min(itertools.permutations(range(k)), key=lambda p: (sum(c[p[j], j] for j in range(k)), p))  # noqa: B023
            assert tuple(assignment(c).tolist()) == best
    p = rng.permutation(200)
    hidden = np.ones((200, 200))
    hidden[p, np.arange(200)] = 0
    assert (assignment(hidden) == p).all()


def test_relabelling_many_states(spark):
    rng = np.random.default_rng(5)
    order = rng.permutation(30)
    truth = rng.integers(0, 30, 3000)
    guess = np.where(rng.random(3000) < 0.2, rng.integers(0, 30, 3000), np.argsort(order)[truth])
    df = spark.createDataFrame([(int(a) + 1, int(b) + 1) for a, b in zip(truth, guess, strict=True)], "a int, b int")
    best, accuracy = evaluation.best_permutation(evaluation.confusion(df, "a", "b"), 30)
    assert tuple(order + 1) == best and accuracy > 0.75
    means = rng.standard_normal((30, 2))
    model = HiddenMarkovModel(np.full((30, 30), 1 / 30), np.full(30, 1 / 30), [GaussianEmission(means[i], np.eye(2)) for i in order])
    assert [order[i] for i in evaluation.best_order_by_means(model, means)] == list(range(30))


def test_parallel_seeds(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 30)) * 10
    df = vectors(spark, centres[rng.integers(0, 20, 1500)] + rng.standard_normal((1500, 30)))
    x = np.array([r.x for r in df.collect()])
    cost = lambda c: min(((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum() for _ in (0,))
    fast, slow = kmeans.parallel_seeds(df, 20, 30, seed=1), kmeans.plus_plus(df, 20, 30, seed=1)
    assert cost(fast) <= 1.05 * cost(slow)
    assert (fast == kmeans.parallel_seeds(df.repartition(7), 20, 30, seed=1)).all()
    # Fewer different points than clusters, and no points at all.
    few = vectors(spark, np.repeat([[0.0, 1.0], [2.0, 3.0]], 5, axis=0))
    assert kmeans.parallel_seeds(few, 5, 2).shape == (5, 2)
    with pytest.raises(ValueError, match="no points"):
        kmeans.parallel_seeds(few.limit(0), 3, 2)


def test_clusters_for_many_elements(spark, monkeypatch):
    rng = np.random.default_rng(7)
    d = 30
    centres = np.stack([np.full(d, -4.0), np.full(d, 4.0)])
    x = centres[rng.integers(0, 2, 300)] + rng.standard_normal((300, d))
    obs = vectors(spark, x).selectExpr("0L AS trial_id", "1 AS t", "x AS y", "CAST(null AS array<double>) AS u", "1D AS w")
    start = HiddenMarkovModel([[0.5, 0.5], [0.5, 0.5]], [0.5, 0.5], [GaussianEmission(np.zeros(d), np.eye(d))] * 2)
    found = start.kmeans_init(obs, seed=1)
    order = evaluation.best_order_by_means(found, centres)
    for i, sign in zip(order, (-1, 1), strict=True):
        mine = x[np.sign(x.mean(axis=1)) == sign]
        np.testing.assert_allclose(found.emissions[i].mean, mine.mean(axis=0), atol=1e-9)
        np.testing.assert_allclose(found.emissions[i].cov, np.cov(mine.T), atol=1e-8)


def test_procrustes_for_many_elements(spark):
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    x = rng.standard_normal((100, 30))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, x @ turn.T, strict=True)], "a array<double>, b array<double>")
    np.testing.assert_allclose(evaluation.procrustes(df, "a", "b", 30), turn, atol=1e-9)


def test_draws_have_the_precision():
    rng = np.random.default_rng(9)
    main, sub = np.stack([np.eye(2) * 3] * 4), rng.standard_normal((3, 2, 2)) * 0.5
    dense = np.zeros((8, 8))
    for i in range(4):
        dense[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] = main[i]
        if i < 3:
            dense[2 * i + 2 : 2 * i + 4, 2 * i : 2 * i + 2], dense[2 * i : 2 * i + 2, 2 * i + 2 : 2 * i + 4] = sub[i], sub[i].T
    # Applied to unit vectors, the draws are a square root of the inverse.
    root = BlockTridiagonal(main, sub).draws(np.eye(8).reshape(8, 4, 2)).reshape(8, 8)
    np.testing.assert_allclose(root.T @ root, np.linalg.inv(dense), atol=1e-12)
