"""The command line over declared Parquet tables."""

from __future__ import annotations

import os
import tempfile

from compare import assert_same, spark_rows

from innsight import cli
from innsight.operators import search
from innsight.plans.dashboard import DASHBOARD_KEYS
from innsight.sources.tables import write


def test_cli_round_trip(spark, t, capsys):
    root = tempfile.mkdtemp(prefix="cli-", dir="/tmp")
    tables = os.path.join(root, "tables")
    for name, df in t.items():
        write(df, tables, name, mode="overwrite")

    out = os.path.join(root, "marts")
    assert cli.main(["dashboard", "--tables", tables, "--out", out]) == 0
    assert sorted(os.listdir(out)) == sorted(DASHBOARD_KEYS)

    found = os.path.join(root, "found")
    assert cli.main(["search", "--tables", tables, "--kind", "guest", "--q", " hart ", "--out", found,
                     "--show", "3"]) == 0
    assert "total_revenue" in capsys.readouterr().out
    assert_same(spark_rows(spark.read.parquet(found)), spark_rows(search.search_guest(t, "hart")))

    checks = os.path.join(root, "checks")
    assert cli.main(["check", "--tables", tables, "--out", checks]) == 0
    orphans = spark.read.parquet(os.path.join(checks, "orphans"))
    assert orphans.where("orphan_rows > 0").count() > 0  # the fixture plants some
