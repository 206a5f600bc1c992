"""Every query of the catalogue against its oracle on the smallest tables."""

import pytest

import __spark_entry__
from tests.oracle import compare
from usagemill.plans import catalog, source_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    compare(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
