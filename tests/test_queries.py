"""Every registered query against its SQL twin."""

from __future__ import annotations

import functools

import pytest
from oracle import connect, duck_digest, spark_digest

import __spark_entry__ as entry
from tickloom.plans.catalogue import all_queries
from tickloom.plans.oracles import all_oracles

SF = "/root/testdata/sf0.001"
QUERIES = all_queries()
ORACLES = all_oracles()


@functools.cache
def _connection():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_the_contract_has_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert spark_digest(QUERIES[name](spark, SF)) == duck_digest(_connection(), ORACLES[name])
