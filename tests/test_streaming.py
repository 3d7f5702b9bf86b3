"""Incremental file ingest: each file lands once, also across restarts."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from innsight.streaming.ingest import ingest_files

COLS = ["chargeId", "reservationId", "chargeTypeId", "description", "cost", "dateTime"]


def _csv(path, rows):
    with open(path, "w") as f:
        f.write(",".join(COLS) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def test_ingest_is_incremental_and_restartable(spark):
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src, dst, ckpt = (os.path.join(base, x) for x in ("src", "dst", "ckpt"))
    os.makedirs(src)
    _csv(os.path.join(src, "a.csv"), [("1", "10", "1", "Room night", "960.00", "2025-01-16 15:00:00"),
                                      ("2", "10", "2", "", "75.00", "2025-01-16 15:05:00")])
    q = ingest_files(spark, src, "charge", dst, checkpoint=ckpt, columns=COLS)
    q.awaitTermination(120)
    assert spark.read.parquet(os.path.join(dst, "charge")).count() == 2

    # a new file after a restart: only it is loaded, the first one is not again
    _csv(os.path.join(src, "b.csv"), [("3", "11", "1", "Room night", "540.00", "bad date")])
    q = ingest_files(spark, src, "charge", dst, checkpoint=ckpt, columns=COLS)
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(dst, "charge")).orderBy("chargeId").collect()
    assert [r.chargeId for r in out] == [1, 2, 3]
    assert out[0].dateTime == dt.datetime(2025, 1, 16, 15) and out[2].dateTime is None
    assert all(r.splitCharge == 0 and r.time is None for r in out)
    assert out[1].description is None  # empty CSV field reads as NULL


def test_parquet_ingest_fills_defaults(spark):
    base = tempfile.mkdtemp(prefix="stream-pq-", dir="/tmp")
    src, dst, ckpt = (os.path.join(base, x) for x in ("src", "dst", "ckpt"))
    cols = ["wingId", "buildingId", "name"]
    spark.createDataFrame([(1, 2, "North"), (2, 2, "South")], "wingId long, buildingId long, name string") \
        .write.parquet(src)
    q = ingest_files(spark, src, "wing", dst, fmt="parquet", checkpoint=ckpt, columns=cols)
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(dst, "wing")).orderBy("wingId").collect()
    assert [(r.wingId, r.nearPool, r.nearParking, r.handicapAccessible) for r in out] == [(1, 0, 0, 0), (2, 0, 0, 0)]


def _all(spark, dst):
    from innsight.sources.tables import load

    return sorted(r.chargeId for r in load(spark, dst, ["charge"])["charge"].collect())


def test_second_target_second_source_and_batch_rows_add_up(spark):
    from innsight.sources.tables import apply_defaults, write

    base = tempfile.mkdtemp(prefix="stream-two-", dir="/tmp")
    a, b, d1, d2 = (os.path.join(base, x) for x in ("a", "b", "d1", "d2"))
    os.makedirs(a), os.makedirs(b)
    _csv(os.path.join(a, "x.csv"), [("1", "10", "1", "", "1.00", "2025-01-16 15:00:00")])
    _csv(os.path.join(b, "y.csv"), [("2", "10", "1", "", "1.00", "2025-01-16 15:00:00")])
    extra = apply_defaults(spark.createDataFrame([(3, 10, 1, 2.0)], "chargeId long, reservationId long, chargeTypeId long, cost double"), "charge")
    write(extra, d1, "charge")
    for src, dst in ((a, d1), (a, d2), (b, d1)):
        ingest_files(spark, src, "charge", dst, columns=COLS).awaitTermination(120)
    assert _all(spark, d1) == [1, 2, 3] and _all(spark, d2) == [1]
    write(extra, d1, "charge")
    assert _all(spark, d1) == [1, 2, 3, 3]


def test_a_header_in_another_order_fails(spark):
    import pytest

    base = tempfile.mkdtemp(prefix="stream-head-", dir="/tmp")
    src = os.path.join(base, "src")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("name,hotelId,brand\nSea,7,B\n")
    with pytest.raises(Exception, match="header|CSV"):
        ingest_files(spark, src, "hotel", os.path.join(base, "dst")).awaitTermination(120)


def _load_again(spark, src, dst, **how):
    ingest_files(spark, src, "charge", dst, columns=COLS, **how).awaitTermination(120)


def test_a_new_application_loads_only_what_is_new(spark):
    """Without a checkpoint of the earlier application: every row once, also after the source was archived."""
    base = tempfile.mkdtemp(prefix="stream-app-", dir="/tmp")
    src, later, dst = (os.path.join(base, x) for x in ("src", "later", "dst"))
    os.makedirs(src), os.makedirs(later)
    row = lambda i: (str(i), "10", "1", "", "1.00", "2025-01-16 15:00:00")
    _csv(os.path.join(src, "a.csv"), [row(1)])
    _load_again(spark, src, dst, checkpoint=os.path.join(base, "c1"))
    _csv(os.path.join(src, "b.csv"), [row(2)])
    _load_again(spark, src, dst, checkpoint=os.path.join(base, "c1"))
    assert _all(spark, dst) == [1, 2]
    _load_again(spark, src, dst, checkpoint=os.path.join(base, "c2"))  # another application, nothing new
    assert _all(spark, dst) == [1, 2]
    _csv(os.path.join(later, "c.csv"), [row(3)])  # the archive keeps a and b; only row 3 is there now
    _load_again(spark, later, dst, checkpoint=os.path.join(base, "c3"))
    assert _all(spark, dst) == [1, 2, 3]
    _load_again(spark, src, dst)  # the default folder beside the tables
    _load_again(spark, src, dst)
    assert _all(spark, dst) == [1, 2, 3]


def test_a_load_that_died_before_its_commit_is_not_seen(spark, monkeypatch):
    import pytest

    from innsight.sources import ledger

    base = tempfile.mkdtemp(prefix="stream-died-", dir="/tmp")
    src, dst = os.path.join(base, "src"), os.path.join(base, "dst")
    os.makedirs(src)
    _csv(os.path.join(src, "a.csv"), [("1", "10", "1", "", "1.00", "2025-01-16 15:00:00")])
    whole = ledger.commit

    def dies(*args, **kw):
        raise RuntimeError("lost before the commit")

    monkeypatch.setattr(ledger, "commit", dies)
    with pytest.raises(Exception, match="lost before"):
        _load_again(spark, src, dst, checkpoint=os.path.join(base, "c1"))
    assert _all(spark, dst) == []
    monkeypatch.setattr(ledger, "commit", whole)
    _load_again(spark, src, dst, checkpoint=os.path.join(base, "c2"))
    assert _all(spark, dst) == [1]


def test_rows_at_the_root_of_a_table_stay(spark):
    from innsight.sources.tables import apply_defaults, load, write

    base = tempfile.mkdtemp(prefix="root-rows-", dir="/tmp")
    make = lambda i: apply_defaults(spark.createDataFrame([(i, 2, "North")], "wingId long, buildingId long, name string"), "wing")
    wings = lambda: sorted(r.wingId for r in load(spark, base, ["wing"])["wing"].collect())
    make(1).write.parquet(os.path.join(base, "wing"))
    assert wings() == [1]
    write(make(2), base, "wing")
    write(make(3), base, "wing", load_id="three")
    write(make(4), base, "wing", load_id="three")  # a load tried again
    assert wings() == [1, 2, 4]
    write(make(5), base, "wing", mode="overwrite")
    assert wings() == [5]
    write(make(6), base, "wing")
    assert wings() == [5, 6]


def test_loads_from_before_the_ledger_are_entered(spark):
    from innsight.sources.tables import apply_defaults, load, write

    base = tempfile.mkdtemp(prefix="old-loads-", dir="/tmp")
    make = lambda i: apply_defaults(spark.createDataFrame([(i, 2, "North")], "wingId long, buildingId long, name string"), "wing")
    make(1).write.parquet(os.path.join(base, "wing", "load_id=old"))
    write(make(2), base, "wing")
    assert sorted(r.wingId for r in load(spark, base, ["wing"])["wing"].collect()) == [1, 2]


def test_rows_that_do_not_parse_are_set_aside(spark):
    import json

    from innsight.streaming.ingest import rejected

    base = tempfile.mkdtemp(prefix="rejects-", dir="/tmp")
    src, dst = os.path.join(base, "src"), os.path.join(base, "dst")
    os.makedirs(src)
    _csv(os.path.join(src, "a.csv"), [("1", "10", "1", "", "1.00", "2025-01-16 15:00:00"), ("2", "x", "1", "", "1.00", "bad date"), ("3", "10", "1", "", "", "2025-01-16 15:00:00")])
    _load_again(spark, src, dst, rejects=True)
    _load_again(spark, src, dst, rejects=True, checkpoint=os.path.join(base, "again"))
    assert _all(spark, dst) == [1, 3]
    (bad,) = rejected(spark, dst, "charge").collect()
    assert sorted(bad.reason) == ["dateTime", "reservationId"] and json.loads(bad.row)["chargeId"] == "2" and bad.path.endswith("a.csv")


def test_rows_meet_a_short_list_of_files_and_loads(spark, monkeypatch):
    """No row is shuffled for the name of its file or load, and the source is read for its files once."""
    import contextlib
    import io

    from innsight.streaming import ingest

    def plan(df) -> str:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("formatted")
        return out.getvalue()

    base = tempfile.mkdtemp(prefix="short-list-", dir="/tmp")
    src, dst = os.path.join(base, "src"), os.path.join(base, "dst")
    os.makedirs(src)
    _csv(os.path.join(src, "a.csv"), [("1", "10", "1", "", "1.00", "2025-01-16 15:00:00"), ("2", "10", "1", "", "1.00", "bad date")])
    kept, land = [], ingest._land_new
    monkeypatch.setattr(ingest, "_land_new", lambda batch, new, *rest: (kept.append(new.is_cached), land(batch, new, *rest)))
    _load_again(spark, src, dst, rejects=True)
    assert kept == [True]
    # what a load left that was never entered is not seen
    spark.read.parquet(os.path.join(dst, "_rejects", "charge")).drop("load_id").write.parquet(os.path.join(dst, "_rejects", "charge", "load_id=lost"))
    bad = ingest.rejected(spark, dst, "charge")
    assert [r.reason for r in bad.collect()] == [["dateTime"]]
    assert "Exchange" not in plan(bad) and "Join" not in plan(bad)


def test_plain_and_other_date_times_follow_one_rule(spark):
    from datetime import datetime

    from innsight.functions.timeparts import parse_datetime

    day = datetime(2024, 2, 29)
    wanted = {"2024-02-29": day, "2024-02-29 00:00:00": day, "2024-02-29\n": day, "2024-02-29T00:00": day, "2024-02-28 23:59:60": day,
              "2023-02-29": None, "2024-02-29 24:00:00": None, "2024-02-29 00:60:00": None, "2024-2-29": None}
    df = spark.createDataFrame([(s,) for s in wanted], "s string")
    assert {r.s: r.ts for r in df.select("s", parse_datetime(df.s).alias("ts")).collect()} == wanted
