"""Trials whose last value alone is 0: smoothed paths have the infinities of their SQL, not NaN in all dimensions."""

import duckdb
import numpy as np
import pytest
from conftest import TINY

from trelliq.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def ended(tmp_path_factory):
    """Events whose first four trials end in a zero after 0, 7, 8 and all their other steps, and a connection to them."""
    folder = tmp_path_factory.mktemp("ended")
    con = duckdb.connect()
    con.execute(
        "COPY (SELECT event_id, ts, user_id, event_type, CASE WHEN trial < 4 AND t = n THEN 0.0 ELSE value END AS value, props FROM "
        "(SELECT *, CASE trial WHEN 0 THEN 1 WHEN 1 THEN 8 WHEN 2 THEN 9 ELSE max(t) OVER (PARTITION BY trial) END AS n FROM (SELECT *, dense_rank() OVER (ORDER BY user_id) - 1 AS trial, "
        f"row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM '{TINY}/events.parquet')) WHERE t <= n) TO '{folder}/events.parquet'"
    )
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert con.execute("SELECT count(*) FROM events WHERE value = 0").fetchone()[0] == 4
    return str(folder), con


@pytest.mark.parametrize("name", ["lds2_smoother", "lds2_stretch_smoother", "lds_smoother", "lds_sufficient_statistics"])
def test_infinite_steps_are_those_of_sql(spark, ended, name):
    folder, con = ended
    keys = ["trial_id", "t"]
    found, expected = (x.sort_values(keys).reset_index(drop=True) for x in (QUERIES[name](spark, folder).toPandas(), con.execute(ORACLE_SQL[name]).df()))
    assert (found[keys] == expected[keys]).all(axis=None)
    a, b = (x[list(found.columns[2:])].to_numpy(float) for x in (found, expected))
    np.testing.assert_allclose(a, b, atol=1.1e-5)
    assert np.isneginf(a[:, 0]).sum() >= 4
