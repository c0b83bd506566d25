"""Every registered query against its SQL on the smallest tables."""

import numpy as np
import pytest
from conftest import TINY

from trelliq.plans.registry import ORACLE_SQL, QUERIES


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        x, y = a[c].to_numpy(), b[c].to_numpy()
        if x.dtype.kind == "f" or y.dtype.kind == "f":
            np.testing.assert_allclose(x.astype(float), y.astype(float), atol=1.1e-3 if len(a) == 1 else 1.1e-5, rtol=1e-6)
        else:
            assert (x == y).all(), c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    same(QUERIES[name](spark, TINY).toPandas(), duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, TINY).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["trial_id", "n", "loglik"]
