"""Every registered query against its DuckDB oracle (sf0.001 by default,
``ORACLE_SF_DIR=/root/testdata/sf0.1`` for another scale); queries without
an oracle must at least run and return rows."""

import os

import pytest
from compare import compare, duck
from paths import SMALL

from tidepool.plans.catalog import REGISTRY

NAMES = sorted(REGISTRY)
SF_DIR = os.environ.get("ORACLE_SF_DIR", SMALL)


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    q = REGISTRY[name]
    df = q.run(spark, SF_DIR)
    if q.sql is None:
        assert df.count() > 0
        return
    ok, msg = compare(df, con, q.sql)
    assert ok, msg


def test_every_query_has_a_survey_id():
    for q in REGISTRY.values():
        assert q.covers.strip(), q.name


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(REGISTRY) <= set(e.queries())
    flagship = e.entry(spark)
    assert flagship.columns == ["topic", "n", "rmse"]
    assert flagship.count() == 5
