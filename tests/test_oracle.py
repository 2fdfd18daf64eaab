"""Every registered query with an SQL equivalent gives the same cells."""

import compare
import pytest

from millrace.plans import oracle
from millrace.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle.QUERIES))
def test_matches_sql(spark, sf_dir, duck, name):
    found = REGISTRY[name](spark, sf_dir)
    assert compare.difference(found, duck, oracle.statement(name)) is None


def test_every_statement_has_a_query():
    assert set(oracle.QUERIES) <= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(oracle.QUERIES)))
def test_queries_without_sql_run(spark, sf_dir, name):
    assert REGISTRY[name](spark, sf_dir).count() > 0
