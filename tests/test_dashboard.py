"""Mart refresh (M1) and report projections."""

from __future__ import annotations

import tempfile

from compare import assert_same, spark_rows

from innsight.plans.dashboard import DASHBOARD_KEYS, dashboard, refresh_dashboard
from innsight.plans.reports import SPECS, report


def test_refresh_writes_every_result_once(spark, t):
    out = tempfile.mkdtemp(prefix="marts-", dir="/tmp")
    paths = refresh_dashboard(spark, t, out, window=("2025-01-01", "2025-04-01"))
    assert tuple(paths) == DASHBOARD_KEYS
    direct = dashboard(t, window=("2025-01-01", "2025-04-01"))
    for key, path in paths.items():
        back = spark.read.parquet(path)
        assert_same(spark_rows(back), spark_rows(direct[key]))


def test_reports_keep_order_and_format(t):
    df = dashboard(t)["revenue_by_charge_type"]
    rep = report(df, "revenue_by_charge_type")
    assert rep.columns == [c for c, _ in SPECS["revenue_by_charge_type"]]
    src, out = df.collect(), rep.collect()
    assert [r.charge_type for r in out] == [r.charge_type for r in src]
    for a, b in zip(src, out):
        assert b.total_revenue == "$%.2f" % a.total_revenue
        assert b.avg_charge == "$%.2f" % a.avg_charge_amount


def test_every_result_has_a_report_spec(t):
    from innsight.operators import operations, search

    results = dict(dashboard(t))
    results["search_guest"] = search.search_guest(t, "hart")
    results["search_hotel"] = search.search_hotel(t, "hotel")
    results["search_staff"] = operations.search_staff(t, "o")
    assert set(results) == set(SPECS)
    for name, df in results.items():
        report(df, name).collect()
