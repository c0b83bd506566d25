"""Several fits in the same passes, emissions of the user's own, records of models, and likelihoods of counts."""

import itertools
import json
import math
import sys
from dataclasses import dataclass, fields, is_dataclass

import numpy as np
import pytest
from pyspark import cloudpickle

from trelliq.operators import evaluation
from trelliq.operators.emissions import AutoRegressionEmission, BernoulliRegressionEmission, GaussianEmission, GaussianRegressionEmission, PoissonRegressionEmission
from trelliq.operators.glm import differences
from trelliq.operators.hmm import HiddenMarkovModel
from trelliq.operators.kmeans import KMeansResult
from trelliq.operators.lds import GaussianObservation, GaussianState, IWPrior, LinearDynamicalSystem, PoissonObservation
from trelliq.operators.mixture import GaussianMixture, PoissonMixture
from trelliq.operators.ppca import ProbabilisticPCA
from trelliq.operators.slds import SLDS
from trelliq.sources import models

EYE = np.eye(1)

# The emissions below live in this file, which workers cannot import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def trials(spark, n=12, steps=40, seed=0):
    truth = HiddenMarkovModel([[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5], [GaussianEmission([0.0], EYE), GaussianEmission([4.0], 0.5 * EYE)])
    rows = []
    for i in range(n):
        _, y = truth.sample_trial(np.random.default_rng([seed, i]), steps + i)
        rows += [(i, t + 1, [float(v) for v in y[t]], None, 1.0 + t % 2) for t in range(len(y))]
    return spark.createDataFrame(rows, "trial_id long, t int, y array<double>, u array<double>, w double").repartition(3)


def same(a, b, atol=1e-8):
    np.testing.assert_allclose(a.a, b.a, atol=atol)
    np.testing.assert_allclose(a.pi, b.pi, atol=atol)
    for e, f in zip(a.emissions, b.emissions, strict=True):
        np.testing.assert_allclose(e.mean, f.mean, atol=atol)
        np.testing.assert_allclose(e.cov, f.cov, atol=atol)


def test_several_starts_equal_single_fits(spark):
    obs = trials(spark)
    starts = [evaluation.random_hmm(obs, k, 1, seed) for k, seed in ((1, 0), (2, 1), (2, 2), (3, 3))]
    for (model, history), start in zip(HiddenMarkovModel.fit_many(starts, obs, 8, 1e-3), starts, strict=True):
        alone, same_history = start.fit(obs, 8, 1e-3)
        np.testing.assert_allclose(history, same_history, rtol=1e-9)
        same(model, alone)


def test_folds_together_equal_folds_one_by_one(spark):
    obs = trials(spark, 5, 17)
    starts = [evaluation.random_hmm(obs, k, 1, k) for k in (1, 2)]
    found = evaluation.cross_validate_starts(obs, 3, starts, 4, 0.0)
    score = lambda m, test: m.loglikelihood(test).selectExpr("sum(loglik) AS s").first().s
    for i, start in enumerate(starts):
        alone = evaluation.cross_validate(obs, 3, lambda train: start.fit(train, 4, 0.0)[0], score)  # noqa: B023
        np.testing.assert_allclose(found[i], alone, rtol=1e-8)


def test_only_closed_forms_are_fitted_together(spark):
    model = HiddenMarkovModel([[1.0]], [1.0], [PoissonRegressionEmission([0.0])])
    with pytest.raises(TypeError, match="closed-form"):
        HiddenMarkovModel.fit_many([model], trials(spark, 2, 5))


@models.register
@dataclass(frozen=True)
class Student:
    """Student's t with fixed degrees of freedom; an emission of a user's own."""

    at: float
    log_scale: float
    degrees: float = 4.0
    closed_form = False
    output_dim = 1

    def parameters(self):
        return np.array([self.at, self.log_scale])

    def with_parameters(self, v):
        return Student(float(v[0]), float(v[1]), self.degrees)

    def logpdf(self, y, u=None):
        n, z = self.degrees, (y[:, 0] - self.at) / math.exp(self.log_scale)
        return math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - 0.5 * math.log(n * math.pi) - self.log_scale - (n + 1) / 2 * np.log1p(z * z / n)

    def sample(self, rng, n, u=None):
        return self.at + math.exp(self.log_scale) * rng.standard_t(self.degrees, (n, 1))


class Scored(Student):
    def with_parameters(self, v):
        return Scored(float(v[0]), float(v[1]), self.degrees)

    def score(self, y, u=None):
        n, s = self.degrees, math.exp(self.log_scale)
        z = (y[:, 0] - self.at) / s
        bend = (n + 1) * z / (n + z * z)
        return np.stack([bend / s, bend * z - 1], axis=1)


def test_emissions_of_the_users_own(spark):
    rng, a = np.random.default_rng(3), np.array([[0.95, 0.05], [0.1, 0.9]])
    truth = HiddenMarkovModel(a, [0.5, 0.5], [Student(-3.0, 0.0), Student(3.0, -0.5)])
    rows = [(i, t + 1, [float(v[0])], None, 1.0) for i in range(12) for t, v in enumerate(truth.sample_trial(rng, 100)[1])]
    obs = spark.createDataFrame(rows, "trial_id long, t int, y array<double>, u array<double>, w double")
    y = np.array([[1.0], [-40.0], [3.5]])
    np.testing.assert_allclose(differences(Scored(0.3, 0.2), y, None), Scored(0.3, 0.2).score(y), atol=1e-7)
    fits = []
    for kind in (Student, Scored):
        fitted, history = HiddenMarkovModel([[0.8, 0.2], [0.2, 0.8]], [0.5, 0.5], [kind(-1.0, 0.5), kind(1.0, 0.5)]).fit(obs, max_iters=7)
        assert (np.diff(history) > -1e-6 * abs(history[0])).all()
        fits.append(np.concatenate([e.parameters() for e in fitted.emissions]))
        np.testing.assert_allclose(fitted.a, a, atol=0.08)
    np.testing.assert_allclose(fits[0], [-3.0, 0.0, 3.0, -0.5], atol=0.25)
    np.testing.assert_allclose(fits[0], fits[1], atol=1e-4)


# Records

STATE = GaussianState([[0.1 + 0.2]], [[0.3]], [1 / 3], [0.0], [[1.0]], IWPrior(EYE, 5.0))
COUNTS = LinearDynamicalSystem(STATE, PoissonObservation([[0.5]], [-0.1]))
MODELS = {
    "hmm": HiddenMarkovModel([[0.9, 0.1], [0.1, 0.9]], [0.3, 0.7], [GaussianEmission([math.pi], EYE), GaussianEmission([5e-324], EYE)]),
    "glm": HiddenMarkovModel([[1.0]], [1.0], [BernoulliRegressionEmission([0.1, -0.0], False, 2.0)]),
    "mixed": HiddenMarkovModel([[0.5, 0.5], [0.5, 0.5]], [0.5, 0.5], [GaussianRegressionEmission([0.1, 0.7], True, 0.5, [[2.0]], False), AutoRegressionEmission([[0.1], [0.2]], True, 0.0, [[1.0]], True, 1)]),
    "poisson": PoissonRegressionEmission([1e300, 1 / 7]),
    "lds": LinearDynamicalSystem(STATE, GaussianObservation([[1.0]], [[2.0]], [0.1], IWPrior(EYE, 3.0)), (True, False, True, False, True, True)),
    "plds": COUNTS,
    "slds": SLDS([[0.9, 0.1], [0.2, 0.8]], [1.0, 0.0], [COUNTS, COUNTS]),
    "gmm": GaussianMixture([0.4, 0.6], [[1.0, 2.0], [3.0, 4.0]], [np.eye(2), 2 * np.eye(2)]),
    "pmm": PoissonMixture([0.5, 0.5], [1.0, 9.0]),
    "ppca": ProbabilisticPCA([[1.0], [2.0]], 0.5, [0.0, 1.0]),
    "kmeans": KMeansResult(np.array([[1.0, 2.0]]), 3),
    "own": Student(1.0, 0.1),
}


def equal(a, b):
    if is_dataclass(a):
        return type(a) is type(b) and all(equal(getattr(a, f.name), getattr(b, f.name)) for f in fields(a))
    if isinstance(a, tuple):
        return isinstance(b, tuple) and len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, np.ndarray):
        return a.shape == b.shape and a.tobytes() == b.tobytes()
    return type(a) is type(b) and (a == b or a != a and b != b)


def test_models_come_back_equal(spark, tmp_path):
    for name, model in MODELS.items():
        assert equal(models.from_json(models.to_json(model)), model), name
    path = str(tmp_path / "models")
    models.model_table(spark, MODELS).repartition(3).write.parquet(path)
    table = spark.read.parquet(path)
    found = models.models_of(table)
    assert found.keys() == MODELS.keys() and all(equal(found[n], m) for n, m in MODELS.items())
    assert list(models.models_of(table, "gmm")) == ["gmm"]
    with pytest.raises(ValueError, match="no model named nobody"):
        models.models_of(table, "nobody")
    with pytest.raises(ValueError, match="twice"):
        models.models_of(table.union(table), "gmm")


def test_records_of_other_versions():
    record = json.loads(models.to_json(COUNTS))
    old = json.loads(json.dumps(record))
    old["version"] = 1
    part = old["model"]["fields"]["obs"]["fields"]
    part["d"] = {"shape": [1], "values": [math.exp(-0.1)]}
    del part["log_d"], old["model"]["fields"]["fit_parts"]
    back = models.from_record(old)
    np.testing.assert_allclose(back.obs.log_d, [-0.1], rtol=1e-15)
    assert back.fit_parts == (True,) * 5
    for change, message in (({"version": 3}, "version 3"), ({"version": None}, "version None"), ({"model": {"kind": "Nothing", "fields": {}}}, "unknown kind")):
        with pytest.raises(ValueError, match=message):
            models.from_record(record | change)
    for alter, message in ((lambda f: f.pop("state"), "lacks state"), (lambda f: f.update(more=1), "has no more")):
        bad = json.loads(json.dumps(record))
        alter(bad["model"]["fields"])
        with pytest.raises(ValueError, match=message):
            models.from_record(bad)
    with pytest.raises(TypeError, match="not registered"):
        models.to_json(Scored(0.0, 0.0))


# Likelihoods of counts


def test_marginal_against_quadrature():
    from scipy_free import grid_likelihood

    model = LinearDynamicalSystem(GaussianState([[0.8]], [[0.3]], [0.1], [0.2], [[0.5]]), PoissonObservation([[0.7]], [-0.3]))
    rng = np.random.default_rng(4)
    for steps in (1, 2, 5):
        y = model.sample_trial(rng, steps)[1]
        found, laplace, effective = model.marginal_trial(y, np.random.default_rng(1), 4000)
        exact = grid_likelihood(model, y)
        assert abs(found - exact) < 0.01 and abs(laplace - exact) < 0.2 and effective > 2000


def test_marginal_of_gaussian_systems_is_the_likelihood(spark):
    model = LinearDynamicalSystem(STATE, GaussianObservation([[1.0]], [[2.0]], [0.1]))
    y = np.random.default_rng(5).standard_normal((6, 1))
    cov = np.zeros((6, 6))
    mean, m, p = np.zeros(6), model.state.x0[0], model.state.p0[0, 0]
    for i in range(6):
        mean[i] = m + 0.1
        v = p
        for j in range(i, 6):
            cov[i, j] = cov[j, i] = v + (2.0 if i == j else 0)
            v *= model.state.a[0, 0]
        m, p = model.state.a[0, 0] * m + model.state.b[0], model.state.a[0, 0] ** 2 * p + model.state.q[0, 0]
    r = y[:, 0] - mean
    exact = -0.5 * (r @ np.linalg.solve(cov, r) + np.linalg.slogdet(cov)[1] + 6 * math.log(2 * math.pi))
    np.testing.assert_allclose(model.marginal_trial(y, np.random.default_rng(0), 10)[0], exact, rtol=1e-10)
    obs = spark.createDataFrame([(1, t + 1, [float(v)]) for t, v in enumerate(y[:, 0])], "trial_id long, t int, y array<double>")
    np.testing.assert_allclose(model.marginal_loglik(obs).first().loglik, exact, rtol=1e-10)


def test_held_out_counts(spark):
    model = LinearDynamicalSystem(GaussianState([[0.9]], [[0.1]], [0.0], [0.0], [[0.5]]), PoissonObservation([[1.0]], [-1.0]))
    rng = np.random.default_rng(6)
    rows = [(i, t + 1, [float(v[0])], None, 1.0) for i in range(6) for t, v in enumerate(model.sample_trial(rng, 30)[1])]
    obs = spark.createDataFrame(rows, "trial_id long, t int, y array<double>, u array<double>, w double")
    good = evaluation.cross_validate_lds(obs, 2, model, max_iters=2)
    flat = evaluation.cross_validate_lds(obs, 2, LinearDynamicalSystem(model.state, PoissonObservation([[0.0]], [3.0]), (False,) * 5), max_iters=1)
    assert np.isfinite(good).all() and sum(good) > sum(flat)


def test_enumeration_helper_is_right():
    """The quadrature of these tests against a plain product grid at two steps."""
    from scipy_free import grid_likelihood

    model = LinearDynamicalSystem(GaussianState([[0.8]], [[0.3]], [0.1], [0.2], [[0.5]]), PoissonObservation([[0.7]], [-0.3]))
    y = np.array([[2.0], [0.0]])
    g = np.linspace(-6, 6, 401)
    total = 0.0
    for a, b in itertools.product(g, g[::4]):
        total += math.exp(model.loglik(np.array([[a], [b]]), y, normalized=True).sum()) * (g[1] - g[0]) * (g[4] - g[0])
    assert abs(math.log(total) - grid_likelihood(model, y)) < 1e-3


# What all members of a family can do


def test_labels_predictions_and_totals(spark):
    df = spark.createDataFrame([([-2.0],), ([5.0],), ([0.5],)], "x array<double>")
    found = [r.label for r in GaussianMixture([0.5, 0.5], [[0.0], [4.0]], [EYE, EYE]).labels(df).collect()]
    assert found == [1, 2, 1]
    counts = spark.createDataFrame([(0,), (30,)], "x long")
    assert [r.label for r in PoissonMixture([0.5, 0.5], [1.0, 20.0]).labels(counts).collect()] == [1, 2]
    inputs = df.selectExpr("x AS u")
    eta = 0.3 + 0.5 * np.array([-2.0, 5.0, 0.5])
    for emission, want in ((GaussianRegressionEmission([0.3, 0.5]), eta), (BernoulliRegressionEmission([0.3, 0.5]), 1 / (1 + np.exp(-eta))), (PoissonRegressionEmission([0.3, 0.5]), np.exp(eta))):
        np.testing.assert_allclose([r["mean"][0] for r in emission.predict(inputs).collect()], want)
    obs = trials(spark, 3, 5)
    model = MODELS["hmm"]
    np.testing.assert_allclose(HiddenMarkovModel(model.a, model.pi, [GaussianEmission([0.0], EYE)] * 2).total_loglik(obs), sum(-0.5 * (r.y[0] ** 2 + math.log(2 * math.pi)) for r in obs.collect()))
    assert model.total_loglik(obs.limit(0)) == 0.0
