"""What is registered, and the queries that have SQL against it."""

import re

import pytest

from sojourn.llm import queries

SF = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries()) <= names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    from check_oracle import compare

    r = compare(spark, duck(SF), name, queries.queries()[name], queries.oracle_sql()[name], SF)
    assert r["cols_equal"] and r["types_equal"] and r["values_equal"], r
