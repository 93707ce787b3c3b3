"""Every registered query that has a DuckDB text against it, on the smallest tables."""

import os

import pytest

import oracle
from gaugeline.plans import load_all
from gaugeline.plans.registry import ORACLES, QUERIES

SF = os.environ.get("SF", "/root/testdata/sf0.001")
load_all()
NAMES = sorted(ORACLES)


@pytest.fixture(scope="module")
def tables():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    assert oracle.compare(QUERIES[name](spark, SF), tables, ORACLES[name]) == ""


def test_every_text_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
