"""Data-quality jobs (B1-B4) on planted violations, and ingest (A3, A4)."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from fixture import make_rows, spark_tables

from innsight.operators import quality
from innsight.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, TABLES
from innsight.sources.tables import apply_defaults, ingest, load, read_raw, write


def test_clean_data_reports_nothing(spark):
    t = spark_tables(spark, make_rows(seed=11, orphans=False))
    bad_nulls = [r for r in quality.null_report(t).collect() if r.null_rows and r.table_name != "charge"]
    assert bad_nulls == []
    assert all(r.duplicate_keys == 0 for r in quality.key_report(t).collect())
    assert all(r.orphan_rows == 0 for r in quality.orphan_report(t).collect())


def test_planted_violations_are_found(spark):
    rows = make_rows(seed=11, orphans=False)
    rows["hotel"].append((1, None, "dup key and null name"))             # duplicate key + NULL
    rows["room_bed"] = [(1, 1, 1), (1, 1, 2), (2, 1, 1)]                  # composite duplicate
    rows["bed_type"] = [(1, "Queen")]
    rows["stay"].append((99999, 12345, 1, dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)))  # orphan
    rows["task"].append((99999, 1, None, 1))                               # NULL reference: not an orphan
    t = spark_tables(spark, rows)

    nulls = {(r.table_name, r.column_name): r.null_rows for r in quality.null_report(t).collect()}
    assert nulls[("hotel", "name")] == 1 and nulls[("task", "staffId")] == 1
    assert ("party", "email") not in nulls  # nullable columns are not checked

    keys = {r.table_name: r for r in quality.key_report(t).collect()}
    assert (keys["hotel"].duplicate_keys, keys["hotel"].duplicate_rows) == (1, 2)
    assert keys["room_bed"].duplicate_keys == 1 and keys["room_bed"].key_columns == "roomId,bedId"
    assert {r.table_name for r in quality.key_report(t, composite=True).collect()} == {
        n for n, k in PRIMARY_KEYS.items() if len(k) > 1}

    orphans = {(r.child_table, r.fk_column): r.orphan_rows for r in quality.orphan_report(t).collect()}
    assert orphans[("stay", "reservationId")] == 1
    assert orphans[("task", "staffId")] == 0
    assert len(orphans) == len(FOREIGN_KEYS)  # every declared edge is checked

    offending = quality.orphans(t["stay"], "reservationId", t["reservation"], "reservationId").collect()
    assert [r.stayId for r in offending] == [99999]
    assert quality.duplicate_keys(t["hotel"], ["hotelId"]).collect()[0].rows == 2
    assert [r.hotelId for r in quality.null_violations(t["hotel"], ["name"]).collect()] == [1]


def test_ingest_csv_defaults_and_bad_dates(spark):
    d = tempfile.mkdtemp(prefix="ingest-", dir="/tmp")
    path = os.path.join(d, "charge.csv")
    with open(path, "w") as f:
        f.write("chargeId,reservationId,chargeTypeId,description,cost,dateTime\n")
        f.write("1,10,1,Room night,960.00,2025-01-16 15:00:00\n")
        f.write("2,10,2,,75.00,not a date\n")
    raw = read_raw(spark, path, "charge", fmt="csv")
    df = ingest(raw, "charge")
    assert df.schema == apply_defaults(df, "charge").schema
    out = df.orderBy("chargeId").collect()
    assert [c.name for c in TABLES["charge"]] == df.columns
    assert out[0].dateTime == dt.datetime(2025, 1, 16, 15) and out[0].splitCharge == 0 and out[0].time is None
    assert out[1].dateTime is None and out[1].cost == 75.0
    # round trip through the Parquet sink and the declared-schema scan
    root = os.path.join(d, "tables")
    write(df, root, "charge", mode="overwrite")
    back = load(spark, root, ["charge"])["charge"].orderBy("chargeId").collect()
    assert back == out


def test_defaults_fill_absent_columns_only(spark):
    df = spark.createDataFrame([(1, 2, "North"), (2, 2, None)], "wingId long, buildingId long, name string")
    out = apply_defaults(df, "wing").collect()
    assert [(r.nearPool, r.nearParking, r.handicapAccessible) for r in out] == [(0, 0, 0), (0, 0, 0)]
    assert out[1].name is None  # an explicit NULL stays NULL
