"""Plan shape on the Parquet-backed driver tables (sf0.001)."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from innsight.operators import operations, revenue, search
from innsight.sources.derived import hotel_tables

SF = "/root/testdata/sf0.001"


def plan(df, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.fixture(scope="module")
def tt(spark):
    return hotel_tables(spark, SF)


def test_no_cartesian_product_anywhere(spark):
    from __spark_entry__ import queries

    for key, fn in queries().items():
        p = plan(fn(spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, key


@pytest.mark.parametrize("name", ["q6", "q8", "s3"])
def test_two_distinct_counts_need_no_expand(tt, name):
    df = {
        "q6": lambda: operations.occupancy_by_hotel(tt, "1997-01-01", "1997-04-01"),
        "q8": lambda: operations.staff_workload(tt),
        "s3": lambda: operations.search_staff(tt, "user 1"),
    }[name]()
    assert "Expand" not in plan(df)
    # the literal form does need it, which is what the rewrite removes
    literal = {
        "q6": lambda: operations.occupancy_by_hotel(tt, "1997-01-01", "1997-04-01", literal=True),
        "q8": lambda: operations.staff_workload(tt, literal=True),
        "s3": lambda: operations.search_staff(tt, "user 1", literal=True),
    }[name]()
    assert "Expand" in plan(literal)


def test_window_filter_reaches_the_scan(tt):
    p = plan(operations.occupancy_by_hotel(tt, "1997-01-01", "1997-04-01"))
    scans = [s for s in p.split("\n\n") if "lineitem.parquet" in s]
    pushed = " ".join(re.findall(r"PushedFilters: \[(.*)\]", " ".join(scans)))
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_shipdate" in pushed
    assert "EqualTo(l_returnflag,R)" in pushed


def test_scans_read_only_needed_columns(tt):
    p = plan(revenue.revenue_by_charge_type(tt))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    li = [s for s in schemas if "l_extendedprice" in s]
    assert li and all("l_quantity" not in s and "l_shipdate" not in s for s in li)


def test_search_term_becomes_a_literal_contains(tt):
    p = plan(search.search_guest(tt, "build"), "extended")
    assert "build" in p and "%build%" in p.replace("\\", "")


def test_partial_aggregation_before_every_shuffle_of_charges(tt):
    p = plan(revenue.revenue_by_hotel(tt))
    assert "partial_sum" in p and "partial_count" in p


def test_small_dimensions_are_broadcast(tt):
    p = plan(revenue.revenue_by_hotel(tt))
    assert "BroadcastHashJoin" in p and "BroadcastExchange" in p
