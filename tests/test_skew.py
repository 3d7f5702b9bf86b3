"""Hot keys: one room, reservation, party and staff member holding a large
share of the rows.  Results must stay exact, and with broadcasts off (as for
large dimensions) AQE must split the hot partition of the raw stay-to-room
join instead of sending it whole to one task."""

from __future__ import annotations

import datetime as dt

import pytest
from compare import assert_same, duck_rows, spark_rows
from fixture import duck_tables, make_rows, spark_tables

from innsight import oracle
from innsight.operators import operations, revenue, search

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module")
def skewed_rows():
    rows = make_rows(seed=5, orphans=False)
    base = 100000
    n = 1500
    for i in range(n):
        res = base + i
        # hot party 1 books a third of everything, all in hot room 1
        rows["reservation"].append((res, 1, dt.datetime(2025, 1, 5)))
        rows["stay"].append((res, res, 1, dt.datetime(2025, 1, 5, 15), dt.datetime(2025, 1, 8, 11)))
        rows["charge"].append((res, res, 1 + i % 2, None, 10.0 + i % 7, dt.datetime(2025, 1, 5), None, 0))
    # hot reservation 1: many charges and several stays
    for i in range(n):
        rows["charge"].append((base + n + i, 1, 1, None, 1.25, dt.datetime(2025, 2, 1), None, 0))
    for j in range(3):
        rows["stay"].append((base + 2 * n + j, 1, 2 + j, dt.datetime(2025, 2, 1), dt.datetime(2025, 2, 2)))
    # hot staff member 2
    last = max(r[0] for r in rows["task"])
    rows["task"] += [(last + 1 + i, 1, 2, 1) for i in range(n)]
    return rows


@pytest.fixture
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


CASES = {
    "q2": (lambda t, lit: revenue.revenue_by_hotel(t, literal=lit), oracle.body_revenue_by_hotel()),
    "q3": (lambda t, lit: revenue.top_customers(t, literal=lit), oracle.body_top_customers()),
    "q5": (lambda t, lit: revenue.room_type_performance(t, literal=lit), oracle.body_room_type_performance()),
    "q6": (lambda t, lit: operations.occupancy_by_hotel(t, "2025-01-01", "2025-04-01", literal=lit),
           oracle.body_occupancy_by_hotel("2025-01-01", "2025-04-01")),
    "q7": (lambda t, lit: revenue.value_by_score(t, literal=lit), oracle.body_value_by_score()),
    "q8": (lambda t, lit: operations.staff_workload(t, literal=lit), oracle.body_staff_workload()),
    "s1": (lambda t, lit: search.search_guest(t, "a", literal=lit), oracle.body_search_guest("a")),
    "s2": (lambda t, lit: search.search_hotel(t, "e", literal=lit), oracle.body_search_hotel("e")),
    "s3": (lambda t, lit: operations.search_staff(t, "a", literal=lit), oracle.body_search_staff("a")),
}


@pytest.mark.parametrize("key", list(CASES))
def test_exact_under_skew(spark, skew_conf, skewed_rows, key):
    t = spark_tables(spark, skewed_rows)
    fn, sql = CASES[key]
    got = spark_rows(fn(t, False))
    assert_same(got, duck_rows(duck_tables(skewed_rows), sql))
    assert_same(got, spark_rows(fn(t, True)))


def test_hot_room_partition_is_split(spark, skew_conf, skewed_rows):
    t = spark_tables(spark, skewed_rows)
    df = revenue.revenue_by_hotel(t)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in final


def _shuffled_rows(spark, df) -> int:
    """Most rows that one shuffle of the finished plan has written."""
    df.collect()
    seen, most = [df._jdf.queryExecution().executedPlan()], 0
    while seen:
        node = seen.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            seen.append(node.executedPlan())
        elif kind == "ShuffleQueryStageExec":
            seen.append(node.plan())
        elif kind == "BroadcastQueryStageExec":
            seen.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
            kids = node.children()
            seen += [kids.apply(i) for i in range(kids.size())]
    return most


@pytest.mark.parametrize("key", ["s1", "s3"])
def test_hot_details_are_collapsed_before_any_shuffle(spark, skewed_rows, key):
    """In a session without special settings: 1,500 more rows of one hot key add
    no more shuffled rows than there are map tasks."""
    fn = CASES[key][0]
    table, row = {"s1": ("charge", lambda i: (900000 + i, 1, 1, None, 1.0, dt.datetime(2025, 2, 1), None, 0)),
                  "s3": ("task", lambda i: (900000 + i, 1, 2, 1))}[key]
    before = _shuffled_rows(spark, fn(spark_tables(spark, skewed_rows), False))
    more = dict(skewed_rows) | {table: [*skewed_rows[table], *(row(i) for i in range(1500))]}
    after = _shuffled_rows(spark, fn(spark_tables(spark, more), False))
    assert after <= before + 64
