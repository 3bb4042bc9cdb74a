"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
correctness gate), plus the entry smoke check."""
import pytest

import oracle_harness as H
import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
_con = None


def con():
    global _con
    if _con is None:
        _con = H.duck(SF)
    return _con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "link_url" in df.columns


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, name):
    r = H.check(spark, name, E.queries()[name], E.oracle_sql()[name], SF, con(), verbose=True)
    assert r["cols"] and r["match"], r
