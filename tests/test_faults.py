"""Fits of observations with nulls, NaN and gaps: an error that counts them, never other sums."""

import numpy as np
import pytest

from trelliq.operators.emissions import BernoulliRegressionEmission, GaussianEmission, GaussianRegressionEmission, PoissonRegressionEmission
from trelliq.operators.hmm import HiddenMarkovModel
from trelliq.operators.lds import GaussianObservation, GaussianState, LinearDynamicalSystem, PoissonObservation
from trelliq.operators.mixture import GaussianMixture
from trelliq.operators.slds import SLDS
from trelliq.sources.obs import VECTOR, ObservationError, added, by_trial, summed, vector_batch

EYE = np.eye(1)
STATE = GaussianState(0.9 * EYE, 0.1 * EYE, [0.0], [0.0], EYE)
LDS = LinearDynamicalSystem(STATE, GaussianObservation(EYE, EYE, [0.0]))
COUNTS = LinearDynamicalSystem(STATE, PoissonObservation(0.3 * EYE, [0.0]))
CHAIN = ([[0.9, 0.1], [0.1, 0.9]], [0.5, 0.5])
MODELS = {
    "hmm": HiddenMarkovModel(*CHAIN, (GaussianEmission([0.0], EYE), GaussianEmission([3.0], EYE))),
    "glm_hmm": HiddenMarkovModel(*CHAIN, (PoissonRegressionEmission([0.1, 0.1]), PoissonRegressionEmission([1.0, 0.1]))),
    "lds": LDS,
    "plds": COUNTS,
    "slds": SLDS(*CHAIN, (LDS, LDS)),
}


def observations(spark, change=lambda rows: rows, trials=6, steps=20):
    rng = np.random.default_rng(1)
    rows = [[i, t, [float(rng.poisson(3))], [float(rng.standard_normal())], 1.0] for i in range(trials) for t in range(1, steps + 1)]
    return spark.createDataFrame([tuple(r) for r in change(rows)], "trial_id long, t int, y array<double>, u array<double>, w double").repartition(3)


def put(column, value, at=(27, 63)):
    def change(rows):
        for i in at:
            rows[i][column] = value
        return rows

    return change


FAULTY = {
    "null y": (put(2, None), "2 steps with a null or NaN observation"),
    "null inside y": (put(2, [None]), "2 steps with a null or NaN observation"),
    "NaN y": (put(2, [float("nan")]), "2 steps with a null or NaN observation"),
    "infinite y": (put(2, [float("inf")]), "2 steps with a null or NaN observation"),
    "null trial": (put(0, None), "2 rows without trial_id"),
    "gap": (put(1, 1000), "steps that do not follow"),
    "null w": (put(4, None), "2 steps with a null, NaN or negative weight"),
    "negative w": (put(4, -1.0), "2 steps with a null, NaN or negative weight"),
    "NaN w": (put(4, float("nan")), "2 steps with a null, NaN or negative weight"),
    "null u": (put(3, None), "2 steps with some null or NaN inputs"),
    "NaN u": (put(3, [float("nan")]), "2 steps with some null or NaN inputs"),
}


@pytest.mark.parametrize("name", MODELS)
def test_faulty_observations_are_counted(spark, name):
    for what, (change, message) in FAULTY.items():
        # Only the models that read a column mind it.
        if what.endswith(" w") and name == "slds" or what.endswith(" u") and name != "glm_hmm":
            continue
        with pytest.raises(ObservationError, match=message):
            MODELS[name].fit(observations(spark, change), max_iters=2)
            print(name, what)


def test_sound_trials_still_fit(spark):
    for name, model in MODELS.items():
        fitted = model.fit(observations(spark), max_iters=2)
        assert np.isfinite(fitted[1]).all(), name


def test_inference_names_the_step(spark):
    from pyspark.errors import PythonException

    for change in (put(2, [float("nan")], (27,)), put(0, None)):
        with pytest.raises(PythonException, match="in trial 1 at step 8|rows without trial_id"):
            MODELS["hmm"].class_probabilities(observations(spark, change)).collect()


def test_sums_keep_what_is_not_a_number(spark):
    def tasks(batches):
        for _ in batches:
            pass
        yield vector_batch(np.array([1.0, float("nan"), float("inf")]))

    out = added(spark.range(10).repartition(4).mapInArrow(tasks, VECTOR), 3)
    assert out[0] == 4 and np.isnan(out[1]) and out[2] == np.inf
    # Statistics that are not finite reach the driver as they are.
    out = summed(by_trial(observations(spark)), lambda p: np.array([float("nan") if p["trial_id"].iat[0] == 2 else 1.0]), 1)
    assert np.isnan(out[0])


def test_rows_with_nulls_say_nothing(spark):
    """Fits over rows, not trials: a null leaves its row out of every sum alike."""
    rng = np.random.default_rng(2)
    rows = [([float(x)], [float(x + rng.standard_normal())], float(w)) for x, w in zip(rng.standard_normal(60), rng.random(60) + 0.5, strict=True)]
    schema = "y array<double>, u array<double>, w double"
    odd = [(None, [1.0], 1.0), ([1.0], None, 1.0), ([1.0], [1.0], None), ([None], [1.0], 1.0), ([1.0], [None], 1.0)]
    clean, dirty = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + odd, schema)
    a, b = (GaussianRegressionEmission([0.0, 0.0]).fit(df, w="w") for df in (clean, dirty))
    np.testing.assert_allclose(a.beta, b.beta, rtol=1e-12)
    a, b = (GaussianEmission([0.0], EYE).fit(df.filter("u is not null"), w="w") for df in (clean, dirty.filter("y is null or w is null or u is null or y[0] is null or u[0] = 2 or true")))
    kept = spark.createDataFrame([r for r in rows + odd if r[0] is not None and r[0][0] is not None and r[2] is not None and r[1] is not None], schema)
    np.testing.assert_allclose(GaussianEmission([0.0], EYE).fit(kept, w="w").mean, b.mean, rtol=1e-12)
    binary = lambda df: df.selectExpr("transform(y, v -> double(v > 0)) AS y", "u", "w")
    a, b = (BernoulliRegressionEmission([0.0, 0.0]).fit(binary(df), w="w") for df in (clean, dirty))
    np.testing.assert_allclose(a.beta, b.beta, rtol=1e-9)
    for bad in (([float("nan")], [1.0], 1.0), ([1.0], [float("nan")], 1.0), ([1.0], [1.0], float("nan"))):
        with pytest.raises(ObservationError, match="NaN"):
            PoissonRegressionEmission([0.0, 0.0]).fit(spark.createDataFrame([*rows, bad], schema).selectExpr("transform(y, v -> abs(v)) AS y", "u", "w"), w="w")
    assert np.isfinite(GaussianMixture.fresh(2, 1, rng).fit(clean.selectExpr("y AS x"), max_iters=2)[1]).all()
