"""Fits with counts, displays, samplers of single emissions, and the reports that compare fits."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trelliq.functions.display import Described
from trelliq.operators import emissions as EM
from trelliq.operators import evaluation as V
from trelliq.operators import families
from trelliq.operators.hmm import HiddenMarkovModel
from trelliq.operators.lds import GaussianObservation, GaussianState, LinearDynamicalSystem, PoissonObservation, poisson_curvature, poisson_terms, trial_logliks
from trelliq.operators.mixture import GaussianMixture, PoissonMixture
from trelliq.operators.ppca import ProbabilisticPCA, moments
from trelliq.operators.slds import SLDS
from trelliq.sources.obs import same_type

STATE = GaussianState([[0.8, 0.1], [-0.2, 0.7]], [[0.1, 0.02], [0.02, 0.2]], [0.1, 0.0], [0.5, -0.5], 0.3 * np.eye(2))
COUNTS = LinearDynamicalSystem(STATE, PoissonObservation([[0.5, 0.1], [-0.2, 0.6], [0.3, 0.3]], [0.1, 0.2, -0.3]))
GAUSS = LinearDynamicalSystem(STATE, GaussianObservation([[1.0, 0.2], [-0.4, 0.9], [0.5, 0.5]], [[0.3, 0.05, 0], [0.05, 0.4, 0], [0, 0, 0.2]], [0.1, 0.2, 0.3]))


def test_poisson_systems_climb_and_recover(spark):
    obs = COUNTS.sample(spark, 12, 60, seed=2).persist()
    start = LinearDynamicalSystem(GaussianState(0.5 * np.eye(2), 0.3 * np.eye(2), np.zeros(2), np.zeros(2), np.eye(2)), PoissonObservation(0.8 * COUNTS.obs.c, [0.0, 0.0, 0.0]))
    got, history, moved = start.fit(obs, max_iters=4)
    # Laplace approximations may lose a little, but not the climb
    assert history[-1] > history[0] and all(b >= a - 0.01 * abs(a) for a, b in itertools.pairwise(history)) and len(moved) == 4
    rate = lambda m: np.exp(m.obs.c @ np.linalg.solve(np.eye(2) - m.state.a, m.state.b) + m.obs.d)
    seen = np.array(obs.agg(*[F.avg(F.get("y", F.lit(i))) for i in range(3)]).first())
    assert np.abs(rate(got) / seen - 1).max() < 0.6
    again = LinearDynamicalSystem(got.state, got.obs).fit(obs, max_iters=1)[1]
    assert again[0] >= history[-1] - 0.01 * abs(history[-1])


def test_warm_start_finds_the_same_mode():
    rng = np.random.default_rng(4)
    _, y = COUNTS.sample_trial(rng, 50)
    cold = COUNTS.smooth_trial(y)
    warm = COUNTS.smooth_trial(y, start=cold[0] + rng.normal(size=cold[0].shape))
    for a, b in zip(cold, warm, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-6)
    assert np.abs(COUNTS.gradient(cold[0], y)).max() < 1e-5


def test_poisson_curvature_by_differences():
    rng = np.random.default_rng(5)
    x, y = COUNTS.sample_trial(rng, 30)
    cov, w = np.stack([0.1 * np.eye(2) + 0.02] * 30), rng.uniform(0.5, 1.5, 30)
    c, log_d = COUNTS.obs.c, COUNTS.obs.log_d
    blocks = poisson_curvature(x, cov, w, c, log_d).reshape(3, 3, 3)
    gradient = lambda c, d: poisson_terms(x, cov, y, w, c, d)[1:]
    for p, j in itertools.product(range(3), range(2)):
        e = np.zeros_like(c)
        e[p, j] = 1e-6
        column = (gradient(c + e, log_d) - gradient(c - e, log_d)) / 2e-6
        np.testing.assert_allclose(blocks[p, :, j], [column[2 * p], column[2 * p + 1], column[6 + p]], rtol=1e-4, atol=1e-4)
        others = [i for q in range(3) if q != p for i in (2 * q, 2 * q + 1, 6 + q)]
        np.testing.assert_allclose(column[others], 0, atol=1e-6)


def test_switching_counts(spark):
    other = LinearDynamicalSystem(STATE, PoissonObservation([[0.2, 0.0], [0.0, 0.2], [0.1, 0.1]], [0.8, 0.9, 0.7]))
    model = SLDS([[0.95, 0.05], [0.1, 0.9]], [0.5, 0.5], (COUNTS, other))
    obs = model.sample(spark, 6, 40, seed=3).select("trial_id", "t", "y").persist()
    got, history = model.fit(obs, max_iters=2)
    assert len(history) == 2 and np.isfinite(history).all() and got.systems[0].poisson
    np.testing.assert_allclose(got.a.sum(axis=1), 1)
    smoothed = model.smooth(obs).filter("trial_id = 0").orderBy("t").toPandas()
    y = np.array([r.y for r in obs.filter("trial_id = 0").orderBy("t").collect()])
    x = np.stack(smoothed["x"])
    assert np.abs(model.gradient(x, y, np.full((2, 40), 0.5))).max() < 1e-5


def test_rounds_survive_without_what_came_before(spark):
    obs = GAUSS.sample(spark, 4, 20, seed=1).select("trial_id", "t", "y").persist()
    model = SLDS([[0.9, 0.1], [0.1, 0.9]], [0.5, 0.5], (GAUSS, GAUSS))
    got, history = model.fit(obs, max_iters=6)  # passes a checkpoint
    again, same = model.fit(obs, max_iters=6)
    np.testing.assert_allclose(history, same)
    assert len(history) == 6


def test_trial_logliks(spark):
    rows, want = [], []
    rng = np.random.default_rng(6)
    for i, model in enumerate((COUNTS, COUNTS)):
        x, y = model.sample_trial(rng, 10 + i)
        want.append(model.loglik(x, y).sum())
        rows += [(i, t + 1, x[t].tolist(), y[t].tolist()) for t in range(len(x))]
    df = spark.createDataFrame(rows, "trial_id long, t int, x array<double>, y array<double>")
    np.testing.assert_allclose([r.ll for r in trial_logliks(df, COUNTS).orderBy("trial_id").collect()], want)


EVERY = [
    EM.GaussianEmission([1.0, -1.0], [[1.0, 0.3], [0.3, 0.5]]),
    EM.GaussianRegressionEmission([[1.0], [2.0], [-0.5]], cov=[[0.25]]),
    EM.AutoRegressionEmission([[0.1], [0.5]], cov=[[0.5]], order=1),
    EM.BernoulliRegressionEmission([[0.2], [1.0]]),
    EM.PoissonRegressionEmission([[0.3], [0.4]]),
]


@pytest.mark.parametrize("emission", EVERY, ids=lambda e: type(e).__name__)
def test_samples_fit_back(spark, emission):
    df = EM.sample_rows(emission, spark, 6000, seed=7).persist()
    assert df.count() == 6000 and df.select("id").distinct().count() == 6000
    one = {r.id: (r.u, r.y) for r in df.filter("id < 50 or id between 4090 and 4100").collect()}
    other = EM.sample_rows(emission, spark.newSession(), 6000, seed=7).repartition(3).filter("id < 50 or id between 4090 and 4100").collect()
    assert one == {r.id: (r.u, r.y) for r in other}
    got = emission.fit(df)
    if isinstance(emission, EM.GaussianEmission):
        np.testing.assert_allclose(got.mean, emission.mean, atol=0.06)
        np.testing.assert_allclose(got.cov, emission.cov, atol=0.06)
    else:
        np.testing.assert_allclose(got.beta, emission.beta, atol=0.15)
    assert EM.sample_rows(emission, spark, 0).count() == 0


def test_displays():
    many = HiddenMarkovModel(np.full((6, 6), 1 / 6), np.full(6, 1 / 6), tuple(EM.GaussianEmission([float(i)] * 5, np.eye(5)) for i in range(6)))
    short, full = many.describe(), many.describe(full=True)
    assert "... and 3 more" in short and "emissions[4]" not in short and "emissions[6]" in full
    assert "mean: array of 5" in short and "mean: [5., 5., 5., 5., 5.]" in full and "array of" not in full
    shown = [*EVERY, STATE, GAUSS.obs, COUNTS.obs, GAUSS, COUNTS, SLDS([[1.0]], [1.0], (GAUSS,)), GaussianMixture([1.0], [[0.0]], [[[1.0]]]), PoissonMixture([1.0], [2.0]), ProbabilisticPCA([[1.0], [0.5]], 0.1, [0.0, 0.0])]
    for model in shown:
        assert isinstance(model, Described) and type(model).__name__ in repr(model) and "\n" not in repr(model)
        assert model.describe().startswith(type(model).__name__) and len(model.describe(full=True)) >= len(model.describe())
    assert isinstance(EVERY[3], families.RegressionFamily) and isinstance(GAUSS, families.DynamicalFamily) and isinstance(many, families.MarkovFamily)
    assert isinstance(STATE, families.StateFamily) and isinstance(COUNTS.obs, families.ObservationFamily) and isinstance(PoissonMixture([1.0], [2.0]), families.MixtureFamily)


def test_rotations(spark):
    obs = GAUSS.sample(spark, 3, 30, seed=5).select("trial_id", "t", "y").persist()
    angle = 0.7
    turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
    report = V.rotation_report(GAUSS, turn, obs, "turn")
    assert report.orthogonal and report.condition == pytest.approx(1) and report.loglik_change < 1e-6
    assert report.largest_angle < 1e-3 and report.procrustes_error < 1e-8 and report.name == "turn"
    skew = V.rotation_report(GAUSS, np.array([[2.0, 1.0], [0.0, 0.5]]), obs)
    assert not skew.orthogonal and skew.condition > 4 and skew.loglik_change < 1e-6 and skew.largest_angle < 1e-3 and skew.procrustes_error > 0.05


def test_several_starts(spark):
    model = HiddenMarkovModel([[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5], (EM.GaussianEmission([0.0], [[0.5]]), EM.GaussianEmission([4.0], [[0.5]])))
    obs = model.sample(spark, 5, 60, seed=1).persist()
    fits = V.multi_start(obs, 2, 1, starts=3, max_iters=30, seed=4)
    ends = [h[-1] for _, h in fits]
    assert len(fits) == 3 and ends == sorted(ends, reverse=True)
    np.testing.assert_allclose(np.sort([e.mean[0] for e in fits[0][0].emissions]), [0, 4], atol=0.4)


def test_held_out_systems(spark):
    obs = GAUSS.sample(spark, 3, 40, seed=9).select("trial_id", "t", "y", "w").persist()
    scores = V.cross_validate_lds(obs, 4, GAUSS, max_iters=2)
    poor = LinearDynamicalSystem(GaussianState(0.1 * np.eye(2), np.eye(2), np.zeros(2), np.zeros(2), np.eye(2)), GaussianObservation(np.zeros((3, 2)), 9 * np.eye(3), np.zeros(3)), (False,) * 6)
    assert len(scores) == 4 and np.mean(scores) > np.mean(V.cross_validate_lds(obs, 4, poor, max_iters=1))
    with pytest.raises(TypeError):
        V.cross_validate_lds(obs, 4, COUNTS)


def test_errors_and_variance(spark):
    rng = np.random.default_rng(8)
    y, a = rng.normal(size=(40, 3)), rng.normal(size=(40, 3))
    df = spark.createDataFrame([(v.tolist(), w.tolist()) for v, w in zip(y, a, strict=True)], "y array<double>, a array<double>").withColumn("b", F.col("y"))
    found = {r.model: r.mse for r in V.compare_errors(df, "y", {"one": "a", "two": "b"}).collect()}
    assert found["one"] == pytest.approx(((y - a) ** 2).mean()) and found["two"] == 0
    model = ProbabilisticPCA([[1.0], [0.5], [0.2]], 0.1, [0.0, 0.0, 0.0])
    data, implied = V.variance_explained(moments(df, 3, "y"), model)
    values = np.sort(np.linalg.eigvalsh(np.cov(y.T)))[::-1]
    assert data == pytest.approx(values[0] / values.sum()) and implied == pytest.approx(1.29 / 1.59)


def test_types(spark):
    df = spark.createDataFrame([], "a array<double>, b double, c float, d array<array<float>>")
    assert same_type(df, "a", "b") and same_type(df, "c", "d") and not same_type(df, "a", "c") and same_type(df)
