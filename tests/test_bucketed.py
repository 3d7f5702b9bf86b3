"""Facts stored by reservation are read in place; references are checked in one pass."""

from __future__ import annotations

import re
import tempfile

import pytest
from compare import assert_same, spark_rows

from innsight.operators import quality, revenue, search
from innsight.sources import bucketed
from innsight.sources.derived import hotel_tables

SF = "/root/testdata/sf0.001"
QUERIES = {
    "q2": lambda t: revenue.revenue_by_hotel(t),
    "q5": lambda t: revenue.room_type_performance(t),
    "s1": lambda t: search.search_guest(t, "a"),
    "s2": lambda t: search.search_hotel(t, "a"),
}


@pytest.fixture(scope="module")
def stored(spark):
    t, root = hotel_tables(spark, SF), tempfile.mkdtemp(prefix="facts-", dir="/tmp")
    bucketed.write_facts(spark, t, root, 4)
    return t, bucketed.load(spark, root, {n: t[n] for n in t if n not in bucketed.FACTS})


def _moved_by_reservation(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(reservationId[^)]*\)", plan)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_fact_is_shuffled(spark, stored, name):
    t, facts = stored
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")  # hotels only, as for facts and rooms of any size
    try:
        assert _moved_by_reservation(QUERIES[name](t))
        moved = _moved_by_reservation(QUERIES[name](facts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The matching reservations are no stored fact by then, they come from the party join
    assert len(moved) == (1 if name == "s1" else 0)
    assert_same(spark_rows(QUERIES[name](facts)), spark_rows(QUERIES[name](t)))


def test_references_are_checked_in_one_pass(spark):
    t = hotel_tables(spark, SF)
    df = quality.orphan_report(t)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(domain#\d+, value#\d+", plan)) == 1
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert sum("l_orderkey" in s for s in scans) == 2  # charge and stay, once each


def test_planted_orphans_are_counted_per_edge(spark):
    make = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    t = {"room": make([(1, 7, 1, 1, 1), (2, 8, 1, 1, 2), (None, 7, 1, 1, 1)], ["roomId", "wingId", "roomTypeId", "floorId", "statusId"]),
         "wing": make([(7, 1), (9, 1)], ["wingId", "buildingId"]),
         "room_adjacency": make([(1, 2), (1, 3), (3, 3), (2, None)], ["roomId", "adjacentRoomId"])}
    got = {(r.child_table, r.fk_column): r.orphan_rows for r in quality.orphan_report(t).collect()}
    assert got == {("room", "wingId"): 1, ("room_adjacency", "roomId"): 1, ("room_adjacency", "adjacentRoomId"): 2}
