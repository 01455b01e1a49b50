"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from actlens.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r.bucket for r in rows} == {"av_sft", "ar_sft", "rl"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None
