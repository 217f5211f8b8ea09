"""Every query that SQL can express equals its DuckDB SQL; the others give rows."""

import os

import pytest
from comptoir import catalog
from parity import differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    assert not differences(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF)


@pytest.mark.parametrize("name", ["dbscan_labels", "forecast_comparison", "forecast_chart_rows"])
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
