"""Kernels and fits against enumeration, dense algebra, finite differences and published values."""

import itertools
import math

import numpy as np
import pytest

from trelliq.functions import linalg as L
from trelliq.operators import evaluation as V
from trelliq.operators import hmm as H
from trelliq.operators.emissions import AutoRegressionEmission, BernoulliRegressionEmission, GaussianEmission, GaussianRegressionEmission, PoissonRegressionEmission, lagged
from trelliq.operators.kmeans import kmeans
from trelliq.operators.lds import GaussianObservation, GaussianState, IWPrior, LinearDynamicalSystem, PoissonObservation, minimise_poisson, poisson_terms
from trelliq.operators.mixture import GaussianMixture, PoissonMixture
from trelliq.operators.ppca import ProbabilisticPCA, moments
from trelliq.operators.slds import SLDS, sample_posterior, sample_posteriors

rng = np.random.default_rng(11)
A = np.array([[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.3, 0.3, 0.4]])
PI = np.array([0.5, 0.3, 0.2])


def test_hmm_by_enumeration():
    lls = [rng.normal(size=(t, 3)) for t in (1, 4, 6)]
    ll, lengths = H.pad(lls)
    gamma, xi, loglik = H.posterior(ll, lengths, np.log(A), np.log(PI))
    path = H.viterbi_path(ll, lengths, np.log(A), np.log(PI))
    for i, x in enumerate(lls):
        t = len(x)
        scores = {z: math.log(PI[z[0]]) + sum(math.log(A[a, b]) for a, b in itertools.pairwise(z)) + sum(x[s, z[s]] for s in range(t)) for z in itertools.product(range(3), repeat=t)}
        total = L.log_sum_exp(np.array(list(scores.values())))
        assert loglik[i] == pytest.approx(float(total))
        assert tuple(path[i, :t]) == max(scores, key=scores.get)
        for s in range(t):
            for k in range(3):
                assert gamma[i, s, k] == pytest.approx(sum(math.exp(v - total) for z, v in scores.items() if z[s] == k), abs=1e-12)
        pairs = np.zeros((3, 3))
        for z, v in scores.items():
            for a, b in itertools.pairwise(z):
                pairs[a, b] += math.exp(v - total)
        np.testing.assert_allclose(xi[i], pairs, atol=1e-12)


@pytest.mark.parametrize(("n", "steps"), [(1, 1000), (3, 137), (60, 70), (2, 1)])
def test_scaled_recursions_equal_logarithms(n, steps):
    lls = [rng.normal(size=(steps if i == 0 else int(rng.integers(1, steps + 1)), 3)) * 4 for i in range(n)]
    for a, pi in ((A, PI), (np.array([[0.5, 0.5, 0], [0, 0.5, 0.5], [0, 0, 1.0]]), np.array([1.0, 0, 0]))):
        args = (*H.pad(lls), H._log(a), H._log(pi))
        for x, y in zip(H.posterior(*args), H._posterior_log(*args), strict=True):
            np.testing.assert_allclose(x, y, rtol=1e-8, atol=1e-9)


def test_impossible_states_stay_impossible():
    ll = np.array([[[0.0, -math.inf], [-math.inf, 0.0]]])
    alpha = H.forward(ll, np.log([[0.5, 0.5], [0.5, 0.5]]), np.log([0.5, 0.5]))
    assert alpha[0, 1, 0] == -math.inf and np.isfinite(alpha[0, 1, 1])


def test_block_tridiagonal_against_dense():
    t, d = 6, 3
    sub = rng.normal(size=(t - 1, d, d)) * 0.3
    main = np.stack([np.eye(d) * 4 + (lambda m: m @ m.T)(rng.normal(size=(d, d)) * 0.3) for _ in range(t)])
    dense = L.block_tridiagonal(main, sub.transpose(0, 2, 1), sub)
    f = L.BlockTridiagonal(main, sub)
    inv = np.linalg.inv(dense)
    diag, lag = f.selected_inverse()
    for i in range(t):
        np.testing.assert_allclose(diag[i], inv[i * d : (i + 1) * d, i * d : (i + 1) * d], atol=1e-10)
        if i:
            np.testing.assert_allclose(lag[i], inv[i * d : (i + 1) * d, (i - 1) * d : i * d], atol=1e-10)
    b = rng.normal(size=(t, d))
    np.testing.assert_allclose(f.solve(b).ravel(), np.linalg.solve(dense, b.ravel()), atol=1e-10)
    assert f.log_det() == pytest.approx(np.linalg.slogdet(dense)[1])
    assert L.gaussian_entropy(dense) == pytest.approx(0.5 * t * d * (1 + math.log(2 * math.pi)) - 0.5 * np.linalg.slogdet(dense)[1])


def _gaussian(d=2, p=3):
    a = 0.9 * L.random_rotation(d, rng)
    return LinearDynamicalSystem(GaussianState(a, 0.2 * np.eye(d), rng.normal(size=d) * 0.1, rng.normal(size=d), 0.5 * np.eye(d)), GaussianObservation(rng.normal(size=(p, d)), 0.3 * np.eye(p), rng.normal(size=p)))


def _poisson(d=2, p=3):
    a = 0.8 * L.random_rotation(d, rng)
    return LinearDynamicalSystem(GaussianState(a, 0.1 * np.eye(d), rng.normal(size=d) * 0.2, rng.normal(size=d), 0.3 * np.eye(d)), PoissonObservation(rng.normal(size=(p, d)) * 0.5, rng.normal(size=p) * 0.3))


def test_smoother_against_dense_conditioning():
    m = _gaussian()
    s, o, t, d = m.state, m.obs, 7, 2
    _, y = m.sample_trial(rng, t)
    mean, cov = np.zeros((t, d)), np.zeros((t * d, t * d))
    mean[0], block = s.x0, s.p0
    covs = [block]
    for i in range(1, t):
        mean[i] = s.a @ mean[i - 1] + s.b
        covs.append(s.a @ covs[-1] @ s.a.T + s.q)
    for i in range(t):
        for j in range(t):
            c = covs[min(i, j)]
            for _ in range(abs(i - j)):
                c = s.a @ c if i > j else c @ s.a.T
            cov[i * d : (i + 1) * d, j * d : (j + 1) * d] = c
    big = np.kron(np.eye(t), o.c)
    noise = np.kron(np.eye(t), o.r)
    gain = cov @ big.T @ np.linalg.inv(big @ cov @ big.T + noise)
    want = mean.ravel() + gain @ (y.ravel() - (mean @ o.c.T + o.d).ravel())
    post = cov - gain @ big @ cov
    x, diag, lag, entropy = m.smooth_trial(y)
    np.testing.assert_allclose(x.ravel(), want, atol=1e-8)
    for i in range(t):
        np.testing.assert_allclose(diag[i], post[i * d : (i + 1) * d, i * d : (i + 1) * d], atol=1e-8)
        if i:
            np.testing.assert_allclose(lag[i], post[i * d : (i + 1) * d, (i - 1) * d : i * d], atol=1e-8)
    assert entropy == pytest.approx(0.5 * t * d * (1 + math.log(2 * math.pi)) + 0.5 * np.linalg.slogdet(post)[1])
    # the ELBO of the exact posterior is the likelihood
    z = y.ravel() - (mean @ o.c.T + o.d).ravel()
    full = big @ cov @ big.T + noise
    exact = -0.5 * (z @ np.linalg.solve(full, z) + np.linalg.slogdet(full)[1] + len(z) * math.log(2 * math.pi))
    sums = np.concatenate([m.sums(x, diag, lag, y, np.ones(t)), [entropy, 1.0]])
    assert m.elbo(sums) == pytest.approx(exact)


@pytest.mark.parametrize("make", [_gaussian, _poisson])
@pytest.mark.parametrize("steps", [1, 5])
def test_derivatives_by_differences(make, steps):
    m, other = make(), make()
    _, y = m.sample_trial(rng, steps)
    x, w, h = rng.normal(size=(steps, 2)), rng.uniform(0.2, 2, size=(2, steps)), 1e-5
    both = SLDS([[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5], (m, other))
    for value, grad, hess in (
        (lambda v: m.loglik(v, y, w[0]).sum(), m.gradient(x, y, w[0]), m.neg_hessian(x, w[0])),
        (lambda v: both.loglik(v, y, w), both.gradient(x, y, w), both.neg_hessian(x, w)),
    ):
        g = np.zeros(x.size)
        for i in range(x.size):
            e = np.zeros(x.size)
            e[i] = h
            g[i] = (value(x + e.reshape(x.shape)) - value(x - e.reshape(x.shape))) / (2 * h)
        np.testing.assert_allclose(grad.ravel(), g, atol=1e-5, rtol=1e-5)
        dense = L.block_tridiagonal(hess[0], hess[1].transpose(0, 2, 1), hess[1])
        num = np.zeros((x.size, x.size))
        for i in range(x.size):
            e = np.zeros(x.size)
            e[i] = 1e-4
            e = e.reshape(x.shape)
            up = m.gradient(x + e, y, w[0]) if value(x) == m.loglik(x, y, w[0]).sum() else both.gradient(x + e, y, w)
            down = m.gradient(x - e, y, w[0]) if value(x) == m.loglik(x, y, w[0]).sum() else both.gradient(x - e, y, w)
            num[:, i] = -((up - down) / 2e-4).ravel()
        np.testing.assert_allclose(dense, num, atol=1e-4, rtol=1e-4)


def test_smoother_is_stationary():
    m = _poisson()
    _, y = m.sample_trial(rng, 40)
    x, *_ = m.smooth_trial(y)
    assert np.abs(m.gradient(x, y)).max() < 1e-6


def test_mstep_is_optimal():
    m = _gaussian()
    y = m.sample_trial(rng, 60)[1]
    x, cov, lag, entropy = m.smooth_trial(y)
    s = np.concatenate([m.sums(x, cov, lag, y, np.ones(60)), [entropy, 1.0]])
    best = m.mstep(s)
    base = best.elbo(s)
    from dataclasses import replace

    for name in ("a", "b"):
        for _ in range(5):
            v = getattr(best.state, name)
            assert replace(best, state=replace(best.state, **{name: v + 1e-3 * rng.normal(size=v.shape)})).elbo(s) <= base + 1e-9
    for name in ("c", "d"):
        v = getattr(best.obs, name)
        assert replace(best, obs=replace(best.obs, **{name: v + 1e-3 * rng.normal(size=v.shape)})).elbo(s) <= base + 1e-9


def test_inverse_wishart_map_and_flags():
    m = _gaussian()
    prior = IWPrior(0.01 * np.eye(2), 5.0)
    from dataclasses import replace

    withp = LinearDynamicalSystem(replace(m.state, q_prior=prior), m.obs, (True, False, True, True, False, False))
    y = m.sample_trial(rng, 50)[1]
    x, cov, lag, entropy = m.smooth_trial(y)
    s = np.concatenate([m.sums(x, cov, lag, y, np.ones(50)), [entropy, 1.0]])
    got, plain = withp.mstep(s), m.mstep(s)
    np.testing.assert_allclose(got.state.q, (prior.psi + plain.state.q * 49) / (5.0 + 49 + 3), atol=1e-10)
    assert (got.state.p0 == m.state.p0).all() and (got.obs.c == m.obs.c).all() and (got.obs.r == m.obs.r).all()


def test_poisson_observation_update():
    m = _poisson()
    x, y = m.sample_trial(rng, 80)
    cov, w = np.stack([0.05 * np.eye(2)] * 80), np.ones(80)
    f = lambda c, d: (lambda v: (float(v[0]), v[1:]))(poisson_terms(x, cov, y, w, c, d))
    c0, d0 = m.obs.c, m.obs.log_d
    value, g = f(c0, d0)
    for i in range(c0.size):
        e = np.zeros(c0.size)
        e[i] = 1e-6
        assert (f(c0 + e.reshape(c0.shape), d0)[0] - f(c0 - e.reshape(c0.shape), d0)[0]) / 2e-6 == pytest.approx(g[i], rel=1e-4, abs=1e-4)
    c, d = minimise_poisson(f, c0, d0, iterations=60)
    assert f(c, d)[0] < value and np.abs(f(c, d)[1]).max() < 0.05


def test_slds_reduces_to_one_system():
    m = _gaussian()
    y = m.sample_trial(rng, 20)[1]
    both = SLDS([[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5], (m, m))
    w = rng.uniform(size=20)
    for weights in (np.stack([w, 1 - w]), np.stack([np.ones(20), np.zeros(20)])):
        for a, b in zip(both.smooth_trial(y, weights), m.smooth_trial(y), strict=True):
            np.testing.assert_allclose(a, b, atol=1e-7)
    with pytest.raises(TypeError):
        SLDS([[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5], (m, _poisson()))
    with pytest.raises(ValueError):
        SLDS([[0.9, 0.2], [0.2, 0.8]], [0.5, 0.5], (m, m))
    x, e = sample_posterior(rng, np.zeros((3, 2)), np.stack([np.eye(2)] * 3))
    assert x.shape == (3, 2) and e == pytest.approx(3 * (1 + math.log(2 * math.pi)))


# Fits on tables

GOLDEN = [  # family, x, y, l2, weighted, coefficients
    ("gaussian", (1, 2, 3, 4.1), (0.5, 0.9, 0.99, 1.4), 0, False, (0.2623, 0.2713)),
    ("gaussian", (1, 2, 3, 4.1), (0.5, 0.9, 0.99, 1.4), 1, False, (0.3709, 0.2283)),
    ("gaussian", (1, 2, 3, 4.1), (0.5, 0.9, 0.99, 1.4), 0, True, (0.2941, 0.2524)),
    ("gaussian", (1, 2, 3, 4.1), (0.5, 0.9, 0.99, 1.4), 1, True, (0.4464, 0.1787)),
    ("bernoulli", (1, 2.1, 3, 4), (0, 1, 0, 1), 0, False, (-2.522, 0.9965)),
    ("bernoulli", (1, 2.1, 3, 4), (0, 1, 0, 1), 1, False, (-1.2169, 0.4816)),
    ("bernoulli", (1, 2.1, 3, 4), (0, 1, 0, 1), 0, True, (-1.366, 0.3599)),
    ("bernoulli", (1, 2.1, 3, 4), (0, 1, 0, 1), 1, True, (-0.8623, 0.1253)),
    ("poisson", (1, 2, 3, 4.1), (0, 0, 2, 1), 0, False, (-2.405, 0.7125)),
    ("poisson", (1, 2, 3, 4.1), (0, 0, 2, 1), 0, True, (-3.8794, 1.3505)),
    ("poisson", (1, 2, 3, 4.1), (0, 0, 2, 1), 4.0, False, (-1.1618, 0.3195)),
    ("poisson", (1, 2, 3, 4.1), (0, 0, 2, 1), 3.1, True, (-1.3611, 0.4338)),
]


@pytest.mark.parametrize(("family", "x", "y", "l2", "weighted", "want"), GOLDEN)
def test_regressions_on_four_rows(spark, family, x, y, l2, weighted, want):
    w = (1.0, 1.0, 1.0, 0.1) if weighted else (1.0,) * 4
    df = spark.createDataFrame([([float(a)], [float(b)], c) for a, b, c in zip(x, y, w, strict=True)], "u array<double>, y array<double>, w double")
    kind = {"gaussian": GaussianRegressionEmission, "bernoulli": BernoulliRegressionEmission, "poisson": PoissonRegressionEmission}[family]
    np.testing.assert_allclose(kind(np.zeros((2, 1)), l2=l2).fit(df, w="w").beta[:, 0], want, atol=1e-3)


def test_hmm_recovers_parameters(spark):
    true = H.HiddenMarkovModel([[0.95, 0.05], [0.1, 0.9]], [0.5, 0.5], (GaussianEmission([0.0, 0.0], 0.1 * np.eye(2)), GaussianEmission([2.0, 1.0], 0.2 * np.eye(2))))
    obs = true.sample(spark, 20, 200, seed=5).persist()
    start = H.HiddenMarkovModel([[0.6, 0.4], [0.4, 0.6]], [0.5, 0.5], (GaussianEmission([0.5, -0.2], np.eye(2)), GaussianEmission([1.5, 1.2], np.eye(2))))
    got, history = start.kmeans_init(obs, seed=1).fit(obs, max_iters=15, tol=1e-4)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(history))
    got = got.permuted(V.best_order_by_means(got, np.array([[0, 0], [2, 1]])))
    np.testing.assert_allclose(got.a, true.a, atol=0.05)
    np.testing.assert_allclose(got.emissions[1].mean, [2, 1], atol=0.1)
    truth = obs.select("trial_id", "t", "state")
    joined = truth.withColumnRenamed("state", "truth").join(got.viterbi(obs), ["trial_id", "t"])
    assert V.best_permutation(V.confusion(joined, "truth", "state"), 2)[1] > 0.99


@pytest.mark.parametrize("family", ["bernoulli", "poisson", "gaussian"])
def test_glm_hmm_learns(spark, family):
    kind = {"gaussian": GaussianRegressionEmission, "bernoulli": BernoulliRegressionEmission, "poisson": PoissonRegressionEmission}[family]
    betas = ([[1.0], [2.0]], [[-1.0], [-2.0]]) if family != "poisson" else ([[1.5], [0.5]], [[0.2], [-0.8]])
    true = H.HiddenMarkovModel([[0.95, 0.05], [0.05, 0.95]], [0.5, 0.5], tuple(kind(b) for b in betas))
    obs = true.sample(spark, 8, 250, seed=2, inputs=lambda r, n: r.normal(size=(n, 1))).persist()
    start = H.HiddenMarkovModel([[0.8, 0.2], [0.2, 0.8]], [0.5, 0.5], tuple(kind(np.array(b) * 0.6) for b in betas))
    got, history = start.fit(obs, max_iters=6, tol=1e-3)
    assert history[-1] > history[0] and all(b >= a - 1e-3 for a, b in itertools.pairwise(history))
    np.testing.assert_allclose(got.emissions[0].beta, betas[0], atol=0.5)


def test_autoregression(spark):
    e = AutoRegressionEmission([[0.1, 0.0], [0.8, -0.3], [0.3, 0.8]], cov=0.05 * np.eye(2), order=1)
    m = H.HiddenMarkovModel([[1.0]], [1.0], (e,))
    obs = m.sample(spark, 4, 400, seed=1)
    got = AutoRegressionEmission(np.zeros((3, 2)), order=1).fit(lagged(obs, 1))
    np.testing.assert_allclose(got.beta, e.beta, atol=0.06)
    with pytest.raises(ValueError):
        AutoRegressionEmission(np.zeros((3, 2)), order=2)


def test_lds_fits_climb(spark):
    m = _gaussian()
    obs = m.sample(spark, 6, 40, seed=1).persist()
    start = LinearDynamicalSystem(GaussianState(np.eye(2) * 0.5, np.eye(2), np.zeros(2), np.zeros(2), np.eye(2)), GaussianObservation(rng.normal(size=(3, 2)), np.eye(3), np.zeros(3)))
    _, history, moved = start.fit(obs, max_iters=6)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(history)) and len(moved) == len(history)
    both = SLDS([[0.9, 0.1], [0.1, 0.9]], [0.5, 0.5], (m, m))
    got, elbo = both.fit(obs, max_iters=2)
    assert len(elbo) == 2 and np.isfinite(elbo).all()
    assert sample_posteriors(m.smooth(obs), 2, seed=1).count() == 480


def test_mixtures_kmeans_ppca(spark):
    g = GaussianMixture([0.3, 0.7], [[0.0, 0.0], [5.0, 4.0]], [np.eye(2), 0.5 * np.eye(2)])
    df = g.sample(spark, 2000, seed=4).persist()
    got, history = GaussianMixture.fresh(2, 2, np.random.default_rng(0)).fit(df, initialize_kmeans=True, seed=3)
    assert all(b >= a - 1e-2 for a, b in itertools.pairwise(history))
    order = np.argsort(got.means[:, 0])
    np.testing.assert_allclose(got.means[order], g.means, atol=0.2)
    np.testing.assert_allclose(np.sort(kmeans(df, 2, 2, seed=2).centroids[:, 0]), [0, 5], atol=0.2)
    p = PoissonMixture([0.5, 0.5], [2.0, 12.0])
    found, _ = PoissonMixture.fresh(2).fit(p.sample(spark, 3000, seed=1), initialize_kmeans=True, seed=1, max_iters=30)
    np.testing.assert_allclose(np.sort(found.rates), [2, 12], atol=0.5)
    q = ProbabilisticPCA(rng.normal(size=(3, 2)), 0.5, np.zeros(3))
    sample = q.sample(spark, 3000, seed=2).persist()
    fit, lls = ProbabilisticPCA(rng.normal(size=(3, 2)), 1.0, np.zeros(3)).fit(sample)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(lls)) and fit.s2 == pytest.approx(0.5, abs=0.1)
    x = np.array([r.x for r in sample.collect()])
    mo, now = moments(sample, 3, "x"), q
    for _ in range(3):  # row by row
        inv = np.linalg.inv(now.w.T @ now.w + now.s2 * np.eye(2))
        ez = x @ now.w @ inv
        ezz = len(x) * now.s2 * inv + ez.T @ ez
        w = x.T @ ez @ np.linalg.inv(ezz)
        s2 = ((x**2).sum() - 2 * (ez * (x @ now.w)).sum() + np.trace(ezz @ now.w.T @ now.w)) / x.size
        mine = now.mstep(mo)
        np.testing.assert_allclose(mine.w, w, atol=1e-8)
        assert mine.s2 == pytest.approx(s2)
        now = mine


def test_small_helpers():
    assert L.is_probvec([0.2, 0.8]) and not L.is_probvec([0.5, 0.6])
    assert not L.valid_covariance([[1.0, 2.0], [2.0, 1.0]]) and L.is_posdef(L.make_posdef([[1.0, 2.0], [2.0, 1.0]]))
    r = L.random_rotation(4, rng)
    assert V.is_orthogonal(r)
    m = _gaussian()
    np.testing.assert_allclose(np.sort(np.abs(V.invariants(m)[0])), np.sort(np.abs(V.invariants(m.rotated(L.random_rotation(2, rng)))[0])), atol=1e-8)
    np.testing.assert_allclose(V.subspace_angles(m.obs.c, m.obs.c @ np.array([[2.0, 1.0], [0.0, 1.0]])), 0, atol=1e-4)
    assert "HiddenMarkovModel" in repr(H.HiddenMarkovModel.random([GaussianEmission([0.0], [[1.0]])] * 5, rng)) and "LinearDynamicalSystem" in repr(m)
    with pytest.raises(ValueError):
        LinearDynamicalSystem(GaussianState(np.eye(2), -np.eye(2), np.zeros(2), np.zeros(2), np.eye(2)), m.obs)
    with pytest.raises(ValueError):
        H.HiddenMarkovModel([[0.5, 0.4], [0.5, 0.5]], [0.5, 0.5], [None, None])


def test_tables(spark, tmp_path):
    from trelliq.sources.obs import append_rows, check_obs, read_csv, write_csv

    df = spark.createDataFrame([(1, 1, [0.5], None, 1.0), (1, 2, [float("nan")], None, 1.0)], "trial_id long, t int, y array<double>, u array<double>, w double")
    with pytest.raises(ValueError):
        check_obs(df)
    with pytest.raises(ValueError):
        check_obs(df.filter("t = 1").withColumn("t", df.t + 1))
    table = append_rows(spark.createDataFrame([(1, 2.0)], "a int, b double"), [(2, 3.5)])
    write_csv(table, str(tmp_path / "t"))
    assert sorted(read_csv(spark, str(tmp_path / "t"), "a int, b double").collect()) == [(1, 2.0), (2, 3.5)]
    r = L.random_rotation(3, rng)
    xs = rng.normal(size=(50, 3))
    pairs = spark.createDataFrame([(x.tolist(), (r @ x).tolist()) for x in xs], "x array<double>, y array<double>")
    np.testing.assert_allclose(V.procrustes(pairs, "x", "y", 3), r, atol=1e-8)
    obs = _gaussian().sample(spark, 2, 20, seed=1)
    scores = V.cross_validate(obs, 4, lambda d: d.count(), lambda m, d: float(m))
    assert len(scores) == 4 and scores[0] == pytest.approx(30 / 10)


def test_far_from_zero(spark):
    from pyspark.sql import functions as F

    from trelliq.operators.emissions import GaussianEmission, GaussianRegressionEmission
    from trelliq.operators.hmm import HiddenMarkovModel
    from trelliq.operators.lds import GaussianObservation, GaussianState, LinearDynamicalSystem

    far = 1e8
    obs = spark.range(20000).select((F.col("id") / 200).cast("long").alias("trial_id"), (F.col("id") % 200 + 1).cast("int").alias("t"), F.randn(1).alias("e"), F.rand(2).alias("x"))
    obs = obs.select("trial_id", "t", F.array(F.col("e") + far).alias("y"), F.array(F.col("x") + far).alias("u"), F.lit(1.0).alias("w")).persist()
    assert GaussianEmission([0.0], [[1.0]]).fit(obs).cov[0, 0] == pytest.approx(1, rel=0.02)
    assert GaussianRegressionEmission(np.zeros((2, 1))).fit(obs).cov[0, 0] == pytest.approx(1, rel=0.02)
    m, history = HiddenMarkovModel([[0.5, 0.5], [0.5, 0.5]], [0.5, 0.5], (GaussianEmission([far - 0.1], [[1.0]]), GaussianEmission([far + 0.1], [[1.0]]))).fit(obs, max_iters=2)
    assert all(0.9 < e.cov[0, 0] < 1.1 and abs(e.mean[0] - far) < 0.5 for e in m.emissions) and history[1] > history[0]
    lds = LinearDynamicalSystem(GaussianState([[0.5]], [[0.5]], [0.0], [0.0], [[1.0]]), GaussianObservation([[1.0]], [[0.5]], [far]))
    new, elbo, _ = lds.fit(obs, max_iters=3)
    assert elbo == sorted(elbo) and abs(new.obs.d[0] - far) < 1 and 0 < new.obs.r[0, 0] < 1.5


def test_wide_vectors(spark):
    from trelliq.functions import expr as E
    from trelliq.operators.emissions import GaussianEmission
    from trelliq.operators.kmeans import kmeans, step
    from trelliq.operators.ppca import moments

    rng = np.random.default_rng(0)
    d = E.WIDE + 6
    x = rng.standard_normal((300, d)) @ rng.standard_normal((d, d)) + 5
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())] + [(300, None)], "id long, x array<double>")
    whole = df.filter("x is not null")
    g = GaussianEmission(np.zeros(d), np.eye(d)).fit(whole, "x")
    np.testing.assert_allclose(g.mean, x.mean(axis=0))
    np.testing.assert_allclose(g.cov, np.cov(x.T, bias=True), atol=1e-9)
    mo = moments(df, d)
    np.testing.assert_allclose(mo.scatter(mo.mean) / mo.n, np.cov(x.T, bias=True), atol=1e-9)
    means, sizes = step(whole, x[:4])
    label = ((x[:, None] - x[None, :4]) ** 2).sum(axis=2).argmin(axis=1)
    assert sizes.tolist() == np.bincount(label, minlength=4).tolist()
    np.testing.assert_allclose(means, [x[label == k].mean(axis=0) for k in range(4)])
    assert kmeans(whole, 3, d, max_iters=3).centroids.shape == (3, d)


def test_one_long_trial_among_short_ones():
    import pandas as pd

    from trelliq.sources.obs import trials

    frames = [pd.DataFrame({"trial_id": i, "t": range(1, n + 1)}) for i, n in enumerate([3] * 255 + [5000] + [3] * 300)]
    whole = pd.concat(frames, ignore_index=True)
    batches = [whole.iloc[a : a + 1000] for a in range(0, len(whole), 1000)]
    found = list(trials(iter(batches), cells=10_000))
    assert [p["trial_id"].iat[0] for some in found for p in some] == list(range(556)) and sum(len(p) for some in found for p in some) == len(whole)
    assert all(len(some) <= 256 and len(some) * max(map(len, some)) <= 10_000 for some in found)


def test_null_observations_are_named(spark):
    from trelliq.operators.hmm import HiddenMarkovModel

    obs = spark.createDataFrame([(1, 1, [0.0], None, 1.0), (1, 2, None, None, 1.0)], "trial_id long, t int, y array<double>, u array<double>, w double")
    m = HiddenMarkovModel([[1.0]], [1.0], (GaussianEmission([0.0], [[1.0]]),))
    with pytest.raises(Exception, match="null y in trial 1 at step 2"):
        m.loglikelihood(obs).collect()
