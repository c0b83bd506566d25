"""Trials cut into stretches give what whole trials give."""

import numpy as np
import pandas as pd
import pytest

from trelliq.operators import stretches
from trelliq.operators.emissions import GaussianEmission, PoissonRegressionEmission
from trelliq.operators.hmm import HiddenMarkovModel
from trelliq.operators.lds import GaussianObservation, GaussianState, LinearDynamicalSystem, PoissonObservation
from trelliq.sources.obs import ObservationError

HMM = HiddenMarkovModel([[0.8, 0.15, 0.05], [0.1, 0.7, 0.2], [0.25, 0.05, 0.7]], [0.5, 0.3, 0.2], [GaussianEmission([m, -m], [[1.0, 0.3], [0.3, 0.8]]) for m in (0.0, 1.0, 2.5)])
LDS = LinearDynamicalSystem(
    GaussianState([[0.7, 0.2], [-0.1, 0.8]], [[0.3, 0.05], [0.05, 0.2]], [0.4, 0.5], [3.0, 2.0], [[1.0, 0.2], [0.2, 0.8]]),
    GaussianObservation([[1.0, 0.1], [0.3, 0.9]], [[0.9, 0.2], [0.2, 0.7]], [0.1, -0.2]),
)


def observations(spark, lengths, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, t, [float(v) for v in rng.standard_normal(2) * 2], None, 1.0) for i, n in enumerate(lengths) for t in range(1, n + 1)]
    return spark.createDataFrame(rows, "trial_id long, t int, y array<double>, u array<double>, w double")


def table(df, column):
    rows = sorted(df.collect(), key=lambda r: (r.trial_id, r.t))
    return [(r.trial_id, r.t) for r in rows], np.array([r[column] for r in rows], float)


@pytest.fixture(params=[(8, 64), (7, 3)], ids=["one level", "many levels"])
def cut(request, monkeypatch):
    """Steps of a stretch; few elements at once make many levels."""
    monkeypatch.setattr(stretches, "FAN", request.param[1])
    return request.param[0]


LENGTHS = (400, 1, 8, 7, 9, 56, 57)


def test_posteriors(spark, cut):
    obs = observations(spark, LENGTHS)
    (keys, whole), (same, parts) = table(HMM.class_probabilities(obs), "gamma"), table(HMM.class_probabilities(obs, stretch=cut), "gamma")
    assert keys == same
    np.testing.assert_allclose(parts, whole, atol=1e-12)


def test_paths(spark, cut):
    obs = observations(spark, LENGTHS)
    (keys, whole), (same, parts) = table(HMM.viterbi(obs), "state"), table(HMM.viterbi(obs, stretch=cut), "state")
    assert keys == same and (whole == parts).all()


def test_likelihoods(spark, cut):
    obs = observations(spark, LENGTHS)
    whole = {r.trial_id: r.loglik for r in HMM.loglikelihood(obs).collect()}
    parts = {r.trial_id: r.loglik for r in HMM.chunked_loglikelihood(obs, cut).collect()}
    assert whole.keys() == parts.keys()
    np.testing.assert_allclose([parts[k] for k in whole], list(whole.values()), rtol=1e-12)


def test_smoother(spark, cut):
    obs = observations(spark, LENGTHS)
    whole, parts = LDS.smooth(obs), LDS.smooth(obs, stretch=cut)
    for column in ("x", "p", "p_lag", "entropy"):
        (keys, a), (same, b) = table(whole, column), table(parts, column)
        assert keys == same
        np.testing.assert_allclose(b, a, atol=1e-9, err_msg=column)


@pytest.mark.parametrize("kernel", [stretches.markov(HMM), stretches.markov(HMM, best=True), stretches.gaussian(LDS)], ids=["posteriors", "paths", "smoother"])
def test_many_stretches_at_once(kernel, monkeypatch):
    """A batch's stretches are worked on together, whatever their lengths, and give what each gives by itself."""
    rng = np.random.default_rng(5)
    lengths = np.array([8, 3, 1, 8, 8, 5, 8, 2, 7, 8] * 20)
    first, at = rng.random(len(lengths)) < 0.3, np.append(0, np.cumsum(lengths))
    y = rng.standard_normal((lengths.sum(), 2)) * 2
    y[[4, 40, 300]] = -np.inf
    p = pd.DataFrame({"trial_id": 1, "t": 1, "y": list(y)})
    parts = [p.iloc[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
    one = lambda f, *args: np.concatenate([f(x, lengths[i : i + 1], *(a[i : i + 1] for a in args)) for i, x in enumerate(parts)])
    with np.errstate(all="ignore"):
        elements = kernel.element(p, lengths, first)
        np.testing.assert_allclose(elements, one(kernel.element, first), rtol=1e-9, atol=1e-12)
        groups = np.array([10, 1, 64, 25, 100])
        ends, begins = np.append(0, np.cumsum(groups)), np.array([True, False, True, True, False])
        # Only the first part of a trial has no state before it.
        elements = kernel.element(p, lengths, np.isin(np.arange(len(lengths)), ends[:-1][begins]))
        tops = kernel.combine(elements, groups)
        messages = kernel.root(tops)
        down = kernel.down(elements, groups, messages, begins)
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            np.testing.assert_allclose(tops[i : i + 1], kernel.combine(elements[a:b], groups[i : i + 1]), rtol=1e-9, atol=1e-12)
            np.testing.assert_allclose(down[a:b], kernel.down(elements[a:b], groups[i : i + 1], messages[i : i + 1], begins[i : i + 1]), rtol=1e-9, atol=1e-12)
        calls = []
        for name in ("posterior", "viterbi_path", "_smoothed"):
            old = getattr(stretches, name)
            monkeypatch.setattr(stretches, name, lambda *args, old=old: calls.append(1) or old(*args))
        begins = np.isin(np.arange(len(lengths)), ends[:-1][begins])
        found = kernel.finish(p, lengths, down, begins)
        assert len(calls) == 1
        for column, values in found.items():
            alone = one(lambda x, n, m, f, column=column: np.stack(kernel.finish(x, n, m, f)[column]), down, begins)
            np.testing.assert_allclose(np.stack(values), alone, rtol=1e-8, atol=1e-10)


def test_groups_over_batches(spark, monkeypatch):
    """Batches end inside stretches, and what is worked on at once is small."""
    monkeypatch.setattr(stretches, "NUMBERS", 200)
    obs, key = observations(spark, LENGTHS), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "5")
    try:
        for whole, parts, column in (
            (HMM.class_probabilities(obs), HMM.class_probabilities(obs, stretch=8), "gamma"),
            (HMM.viterbi(obs), HMM.viterbi(obs, stretch=8), "state"),
            (LDS.smooth(obs), LDS.smooth(obs, stretch=8), "x"),
        ):
            (keys, a), (same, b) = table(whole, column), table(parts, column)
            assert keys == same
            np.testing.assert_allclose(b, a, atol=1e-9)
    finally:
        spark.conf.set(key, before)


def test_a_fault_names_its_trial():
    p = pd.DataFrame({"trial_id": [1, 1, 2, 2], "t": [1, 2, 1, 2], "y": [[0.0, 1.0], [0.0, 1.0], [0.0, 1.0], [np.nan, 1.0]]})
    with pytest.raises(ObservationError, match="NaN y in trial 2 at step 2"):
        stretches.markov(HMM).element(p, np.array([2, 2]), np.array([True, True]))


def test_impossible_and_far(spark, cut):
    """Transitions and starts of probability zero, and observations that no state explains well."""
    model = HiddenMarkovModel([[0.5, 0.5, 0], [0, 0.5, 0.5], [0, 0, 1]], [1, 0, 0], HMM.emissions)
    obs = observations(spark, (60, 30)).selectExpr("trial_id", "t", "transform(y, v -> v * if(t % 11 = 0, 40, 1)) AS y", "u", "w")
    (_, whole), (_, parts) = table(model.class_probabilities(obs), "gamma"), table(model.class_probabilities(obs, stretch=cut), "gamma")
    np.testing.assert_allclose(parts, whole, atol=1e-9)
    (_, whole), (_, parts) = table(model.viterbi(obs), "state"), table(model.viterbi(obs, stretch=cut), "state")
    assert (whole == parts).all()


def test_inputs_and_what_is_refused(spark):
    from pyspark.errors import PythonException
    from pyspark.sql import functions as F

    counts = HiddenMarkovModel([[0.9, 0.1], [0.1, 0.9]], [0.5, 0.5], [PoissonRegressionEmission([0.1, 0.1]), PoissonRegressionEmission([1.0, 0.1])])
    obs = observations(spark, (40,)).selectExpr("trial_id", "t", "array(double(t % 5)) AS y", "array(y[0]) AS u", "w")
    (_, whole), (_, parts) = table(counts.class_probabilities(obs), "gamma"), table(counts.class_probabilities(obs, stretch=9), "gamma")
    np.testing.assert_allclose(parts, whole, atol=1e-12)
    for gap in (F.col("t") != 12, ~F.col("t").between(9, 16)):
        with pytest.raises(PythonException, match="one after the other|lacks whole stretches"):
            HMM.class_probabilities(observations(spark, (40,)).filter(gap), stretch=8).collect()
    assert HMM.viterbi(observations(spark, (5,)).limit(0), stretch=8).count() == 0
    with pytest.raises(TypeError, match="Gaussian"):
        LinearDynamicalSystem(LDS.state, PoissonObservation(LDS.obs.c, [0.0, 0.0])).smooth(obs, stretch=8)
    assert issubclass(ObservationError, ValueError)


def test_only_the_trials_that_need_logarithms_take_them(monkeypatch):
    from trelliq.operators import hmm

    rng = np.random.default_rng(4)
    log_a, log_pi = np.log([[0.99, 0.01], [1e-300, 1.0]]), np.log([0.5, 0.5])
    ll, lengths = rng.standard_normal((6, 30, 2)), np.array([30, 3, 30, 17, 1, 29])
    # One state explains steps 5 to 9 of trial 2 by e^-900 less, and from step 10 on the other one by as much.
    ll[2, 5:10, 0] -= 900
    ll[2, 10:, 1] -= 900
    for i, n in enumerate(lengths):
        ll[i, n:] = 0
    taken = []
    old = hmm._posterior_log
    monkeypatch.setattr(hmm, "_posterior_log", lambda x, n, *rest: taken.append(len(n)) or old(x, n, *rest))
    gamma, xi, loglik = hmm.posterior(ll, lengths, log_a, log_pi)
    want = old(ll, lengths, log_a, log_pi)
    assert taken == [1]
    for a, b in zip((gamma, xi, loglik), want, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-9)
    np.testing.assert_allclose(hmm.likelihood(ll, lengths, log_a, log_pi), want[2], rtol=1e-12)
    never = hmm.likelihood(ll, lengths, np.log([[0.0, 1.0], [1.0, 0.0]] + np.zeros((2, 2))), np.array([0.0, -np.inf]))
    assert np.isfinite(never).all()
