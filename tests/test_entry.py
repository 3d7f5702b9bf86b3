"""Driver contract: entry smoke, query/oracle keys, and the oracle match on a
few keys at sf0.001 (scripts/check_oracle.py runs all of them)."""

from __future__ import annotations

import duckdb
import pytest
from compare import assert_same, spark_rows

import __spark_entry__ as entry_mod

SF = "/root/testdata/sf0.001"
VIEWS = "region nation customer supplier part orders lineitem events".split()


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["hotelId", "hotel_name", "total_revenue", "num_reservations"]


def test_every_query_has_an_oracle():
    own = {k for k in entry_mod.queries() if not k.startswith("op") and k != "pipeline"}
    assert own <= set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for v in VIEWS:
        c.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{SF}/{v}.parquet')")
    return c


@pytest.mark.parametrize("key", ["q2_revenue_by_hotel", "q5_room_type_performance", "s1_search_guest",
                                 "b4_orphans", "f10_report_value_vs_score"])
def test_oracle_matches(spark, con, key):
    df = entry_mod.queries()[key](spark, SF)
    assert_same(spark_rows(df), (lambda r: ([c[0] for c in r.description], r.fetchall()))(
        con.execute(entry_mod.oracle_sql()[key])))
