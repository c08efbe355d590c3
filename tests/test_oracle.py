"""Registered queries against their DuckDB oracle SQL (subset; the full run
is ``python tools/check_oracle.py``)."""

import pytest

from conftest import SF01

FAST = ["task_event_counts", "task_lifecycle", "job_lifecycle_meta", "job_meta_join", "size_histogram",
        "heavy_users", "arrival_process", "service_process", "normalized_arrivals", "sliding_sum",
        "mgf_single_lag", "mgf_curve_service", "linearity_span", "envelope_fit", "heavy_users_ranked", "trace_profile",
        "files_profile", "lag_sums", "arrival_autocorr", "crossing_theta_slope"]


@pytest.fixture(scope="module")
def con(duck):
    return duck(SF01)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    import sys
    import os

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    import __spark_entry__ as E
    from check_oracle import compare

    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF01)
    assert r["cols_equal"] and r["types_equal"], r
    assert r["spark_rows"] == r["duck_rows"], r
    assert r["values_equal"], r


def test_every_query_has_an_oracle():
    from sojourn.plans import registry

    assert set(registry.queries()) == set(registry.oracle_sql())
