"""Queries over logarithms where a value is 0: they do not fail, and give what their SQL gives, with its NaN and infinities."""

import duckdb
import numpy as np
import pytest
from conftest import TINY
from test_queries import same

from trelliq.plans.registry import ORACLE_SQL, QUERIES

#: The trial's step whose value is 0: inside a stretch of 8, where a stretch begins, the first, and the last.
ZEROS = {0: 21, 1: 33, 2: 1, 3: -1}
NAMES = """
far_hmm_mstep far_lds_mstep glm_hmm_loglik hmm3_gamma hmm3_loglik hmm3_stretch_viterbi hmm3_viterbi hmm_class_probabilities hmm_chunked_loglik hmm_fit hmm_kernel_loglik
hmm_kernel_viterbi hmm_stretch_gamma hmm_mstep lds_fit lds_smoother lds_mstep lds_sufficient_statistics path_segments ar_features ar_fit gmm3_fit gmm_em_3iter gmm_loglik gmm_mstep
hmm_backward hmm_emission_ll slds_weighted_ll hmm_gamma hmm_viterbi hmm_xi lds2_complete_ll lds_complete_ll hmm_filtered gmm_estep gmm3_estep hmm_forward_loglik trial_accuracies
plds_complete_ll plds_trial_ll prediction_errors lds2_smoother lds2_stretch_smoother
""".split()


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Events with four zeros, and a connection to them."""
    folder = tmp_path_factory.mktemp("zeros")
    con = duckdb.connect()
    at = " OR ".join(f"(trial = {trial} AND {'t' if t > 0 else 'r'} = {abs(t)})" for trial, t in ZEROS.items())
    con.execute(
        "COPY (SELECT event_id, ts, user_id, event_type, CASE WHEN " + at + " THEN 0.0 ELSE value END AS value, props FROM (SELECT *, dense_rank() OVER (ORDER BY user_id) - 1 AS trial, "
        f"row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM '{TINY}/events.parquet')) TO '{folder}/events.parquet'"
    )
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert con.execute("SELECT count(*) FROM events WHERE value = 0").fetchone()[0] == len(ZEROS)
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_zeros_give_what_sql_gives(spark, zeros, name):
    folder, con = zeros
    found, expected = QUERIES[name](spark, folder).toPandas(), con.execute(ORACLE_SQL[name]).df()
    if name in ("lds2_smoother", "lds2_stretch_smoother"):
        # Of a zero in the last step SQL has an infinite path in one of the two dimensions, and the smoother NaN in both.
        last = con.execute("SELECT user_id FROM (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 1 OFFSET 3)").fetchone()[0]
        assert found.loc[found["trial_id"] == last, ["x1", "x2"]].isna().all(axis=None)
        found, expected = (x[x["trial_id"] != last] for x in (found, expected))
    same(found, expected)


def test_queries_without_sql_do_not_fail(spark, zeros):
    for name in ("plds_fit", "slds_fit", "hmm_folds"):
        assert np.isnan(QUERIES[name](spark, zeros[0]).toPandas().select_dtypes("float")).all(axis=None), name
    marginal = QUERIES["plds_marginal"](spark, zeros[0]).toPandas()
    assert np.isnan(marginal["loglik"]).sum() == len(ZEROS) and len(marginal) == 15
    # Without zeros nothing changes.
    assert np.isfinite(QUERIES["hmm_folds"](spark, TINY).toPandas()["score"]).all()
