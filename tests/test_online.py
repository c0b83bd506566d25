"""Filters over streams in any batches give what one pass over whole trials gives."""

import math

import numpy as np
import pytest

from trelliq.operators.emissions import GaussianEmission
from trelliq.operators.hmm import HiddenMarkovModel, forward, _log
from trelliq.operators.lds import GaussianObservation, GaussianState, LinearDynamicalSystem, PoissonObservation
from trelliq.operators.online import LinearFilter, filtered

HMM = HiddenMarkovModel([[0.9, 0.1], [0.2, 0.8]], [0.6, 0.4], [GaussianEmission([0.0], [[1.0]]), GaussianEmission([3.0], [[0.5]])])
LDS = LinearDynamicalSystem(GaussianState([[0.9]], [[0.3]], [0.1], [0.0], [[1.0]]), GaussianObservation([[1.0]], [[0.5]], [0.2]))
OBS = "trial_id long, t int, y array<double>, u array<double>"


def rows(trials=5, steps=12):
    rng = np.random.default_rng(0)
    return [(i, t, [float(rng.standard_normal() * 2 + 1)], None) for i in range(trials) for t in range(1, steps + 1)]


def streamed(spark, tmp_path, batches, model):
    """The result rows of a stream that gets its rows in these batches."""
    source, out = tmp_path / "in", []
    source.mkdir()
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, OBS).coalesce(1).write.mode("append").parquet(str(source / f"part={i}"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = filtered(spark.readStream.schema(OBS + ", part int").option("maxFilesPerTrigger", 1).parquet(str(source)).select("trial_id", "t", "y", "u"), model)
        run = query.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        run.awaitTermination(300)
        assert run.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return out


def whole(data):
    """Filtered probabilities and running log-likelihoods of a hidden Markov model, trial by trial."""
    found = {}
    for i in {r[0] for r in data}:
        y = np.array([r[2] for r in sorted(r for r in data if r[0] == i)])
        alpha = forward(HMM.emission_loglikelihoods(y, None)[None], _log(HMM.a), _log(HMM.pi))[0]
        z = np.log(np.exp(alpha).sum(axis=1))
        for t in range(len(y)):
            found[i, t + 1] = (*np.exp(alpha[t] - z[t]), z[t])
    return found


def test_any_batches_give_one_result(spark, tmp_path):
    data = rows()
    mixed = [data[i] for i in np.random.default_rng(1).permutation(len(data))]
    cuts = [mixed[:7], mixed[7:30], [*mixed[30:], mixed[2], mixed[40]], [mixed[0]]]
    got = streamed(spark, tmp_path, cuts, HMM)
    want = whole(data)
    assert sum(r.late for r in got) == 3 and len(got) == len(data) + 3
    on_time = {(r.trial_id, r.t): (*r.filtered, r.loglik) for r in got if not r.late}
    assert on_time.keys() == want.keys()
    table = {(r.trial_id, r.t): r for r in filtered(spark.createDataFrame(mixed, OBS), HMM).collect()}
    assert table.keys() == want.keys()
    for k, v in want.items():
        np.testing.assert_allclose((*table[k].filtered, table[k].loglik), v, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(on_time[k], v, rtol=1e-9, atol=1e-12)


def test_linear_filter_ends_where_the_smoother_does(spark, tmp_path):
    data = rows(3, 10)
    got = streamed(spark, tmp_path, [data[:13], data[13:]], LDS)
    for i in range(3):
        y = np.array([r[2] for r in data if r[0] == i])
        x, cov, _, _ = LDS.smooth_trial(y)
        last = next(r for r in got if r.trial_id == i and r.t == 10)
        np.testing.assert_allclose(last.filtered, [x[-1, 0], cov[-1, 0, 0]], rtol=1e-9)
        np.testing.assert_allclose(last.loglik, LDS.marginal_trial(y, np.random.default_rng(0), 0)[0], rtol=1e-9)


def test_only_gaussian_systems_have_a_filter():
    with pytest.raises(TypeError, match="exact filter"):
        LinearFilter(LinearDynamicalSystem(LDS.state, PoissonObservation([[1.0]], [math.log(2)])))
