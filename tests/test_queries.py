import duckdb
import pytest

import __spark_entry__ as contract
from quaymark.plans import catalog
from tests.oracle import bags


def test_contract_names():
    q, o = contract.queries(), contract.oracle_sql()
    assert set(o) <= set(q)
    assert set(catalog.queries()) <= set(q)


def test_entry(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, tiny, name):
    got, want = bags(catalog.queries()[name](spark, tiny), catalog.oracle_sql()[name], tiny)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, tiny, name):
    d = catalog.queries()[name](spark, tiny)
    assert len(d.collect()) > 0 and d.columns


def test_arrivals_of_zero(spark, tmp_path):
    signups = ["(1, 1, 0.0)", "(2, 1, '-0.0')", "(3, 1, 2.0)", "(4, 2, 0.0)", "(5, 3, 0.0)", "(6, 4, 0.0)", "(7, 1, 'nan')", "(8, 1, NULL)", "(9, 1, NULL)", "(9, 1, 5.0)", "(10, NULL, 0.0)"]
    views = ["(20, 1, 4.0)", "(21, 3, 0.0)", "(22, 4, -4.0)", "(23, 1, 3.0)"]
    rows = " UNION ALL ".join(f"SELECT a::bigint AS event_id, TIMESTAMP '2024-01-01 12:00:00' AS ts, b::bigint AS user_id, '{t}' AS event_type, c::double AS value FROM (VALUES {r}) v(a, b, c)" for t, l in (("signup", signups), ("view", views)) for r in l)
    duckdb.connect().sql(f"COPY ({rows}) TO '{tmp_path}/events.parquet'")
    got, want = bags(catalog.queries()["vwap_vs_arrival"](spark, str(tmp_path)), catalog.oracle_sql()["vwap_vs_arrival"], str(tmp_path))
    assert got == want
    # Arrival, event, average, number and shortfall of events 1, 2, 5 and 6: an arrival of 0 has an infinite shortfall, or none that is a number
    assert {("0", "1", "3.5", "2", "inf"), ("-0", "2", "3.5", "2", "-inf"), ("0", "5", "0", "1", "nan"), ("0", "6", "-4", "1", "-inf")} <= set(got)
