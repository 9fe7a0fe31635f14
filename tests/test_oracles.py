"""Every query with SQL is compared with it; the others must return rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import connect, difference

ORACLES = entry.oracle_sql()
# Trained models are covered by test_training.
QUERIES = [name for name in entry.queries() if name not in ("gbt_metrics", "tree_contributions", "model_checks")]


# The SQL of the drift tests covers references of more than 1000 rows.
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, folder):
    folder = LARGER if name.startswith("drift") else folder
    duck = connect(folder)
    frame = entry.queries()[name](spark, folder)
    assert "CartesianProduct" not in frame._jdf.queryExecution().executedPlan().toString()
    if name in ORACLES:
        assert difference(frame, duck, ORACLES[name]) is None
    else:
        assert frame.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
