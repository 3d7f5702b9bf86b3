"""Refresh from totals kept per load, publication as a whole, keys kept per load."""

from __future__ import annotations

import tempfile

import pytest
from compare import assert_same, spark_rows
from pyspark.sql import functions as F

from innsight.operators.preagg import charge_totals
from innsight.plans import dashboard as plans
from innsight.plans import incremental
from innsight.plans.dashboard import DASHBOARD_KEYS, dashboard
from innsight.sources.perload import keep, key_rows, repeated_keys
from innsight.sources.tables import load, write

WINDOW = ("2025-01-01", "2025-04-01")


def _same_as_full(spark, root, mart, t):
    full = dashboard(t | load(spark, root, ["charge"]), window=WINDOW)
    for key, rows in incremental.published(spark, mart).items():
        assert_same(spark_rows(rows), spark_rows(full[key]))


def _totals_are_whole(spark, root, mart, new):
    """The kept totals are those of all charges; only the loads ``new`` were read, and nothing outside the mart is summed."""
    kept = incremental.kept_totals(spark, root, mart)
    assert kept.new == new and all("/mart/" in f for f in kept.rows.inputFiles())
    assert_same(spark_rows(kept.rows), spark_rows(charge_totals(load(spark, root, ["charge"])["charge"])))


def test_refresh_reads_new_loads_only_and_equals_a_full_one(spark, t):
    top = tempfile.mkdtemp(prefix="incremental-", dir="/tmp")
    root, mart = f"{top}/tables", f"{top}/mart"
    with pytest.raises(LookupError):
        incremental.published(spark, mart)
    for n, name in enumerate(("first", "second")):
        write(t["charge"].where(F.pmod("chargeId", F.lit(2)) == n), root, "charge", load_id=name)
        assert incremental.refresh(spark, root, mart, t, window=WINDOW) == [name]
    _same_as_full(spark, root, mart, t)


def test_kept_totals_move_once(spark, t):
    """The sums over loads are dealt by reservation, as the refresh stages them: one exchange, not one for each."""
    import contextlib
    import io

    top = tempfile.mkdtemp(prefix="incremental-", dir="/tmp")
    write(t["charge"], f"{top}/tables", "charge", load_id="all")
    rows = incremental.kept_totals(spark, f"{top}/tables", f"{top}/mart").rows
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "reservationId").explain()
    assert out.getvalue().count("Exchange") == 1


def test_totals_by_reservation_stand_in_for_all(t):
    totals = charge_totals(t["charge"])
    by_reservation = totals.groupBy("reservationId").agg(F.sum("revenue").alias("revenue"), F.sum("n_charges").alias("n_charges"))
    full = dashboard(t, totals=totals, window=WINDOW)
    for key, rows in dashboard(t, totals=totals, per_reservation=by_reservation, window=WINDOW).items():
        assert_same(spark_rows(rows), spark_rows(full[key]))


def test_totals_follow_the_loads(spark, t):
    top = tempfile.mkdtemp(prefix="incremental-", dir="/tmp")
    root, mart = f"{top}/tables", f"{top}/mart"
    part = F.pmod("chargeId", F.lit(4))
    assert incremental.kept_totals(spark, root, mart).rows.isEmpty()
    t["charge"].where(part == 0).write.parquet(f"{root}/charge")  # files at the root are a load
    write(t["charge"].where(part == 1), root, "charge", load_id="late")
    _totals_are_whole(spark, root, mart, ["late", "root"])
    _totals_are_whole(spark, root, mart, [])
    # a load repeated with other rows is read again, the other one is not
    write(t["charge"].where(part == 2), root, "charge", load_id="late")
    _totals_are_whole(spark, root, mart, ["late"])
    # a replacing load hides the earlier ones
    write(t["charge"].where(part == 3), root, "charge", mode="overwrite", load_id="anew")
    _totals_are_whole(spark, root, mart, ["anew"])


def test_a_failed_refresh_leaves_the_published_results(spark, t, monkeypatch):
    top = tempfile.mkdtemp(prefix="incremental-", dir="/tmp")
    root, mart = f"{top}/tables", f"{top}/mart"
    write(t["charge"].where("chargeId % 2 = 0"), root, "charge", load_id="first")
    incremental.refresh(spark, root, mart, t, window=WINDOW)
    before = {k: spark_rows(v) for k, v in incremental.published(spark, mart).items()}
    write(t["charge"].where("chargeId % 2 = 1"), root, "charge", load_id="second")
    with monkeypatch.context() as m:  # the last of the eight results fails while it runs
        m.setattr(plans, "staff_workload", lambda t: t["staff"].select(F.raise_error(F.lit("lost")).alias("x")))
        with pytest.raises(Exception, match="lost"):
            incremental.refresh(spark, root, mart, t, window=WINDOW, parallelism=1)
    assert set(before) == set(DASHBOARD_KEYS)
    for key, rows in incremental.published(spark, mart).items():
        assert_same(spark_rows(rows), before[key])
    _totals_are_whole(spark, root, mart, [])  # its totals were kept


def test_repeated_keys_across_loads(spark, t):
    top = tempfile.mkdtemp(prefix="incremental-", dir="/tmp")
    rows = t["reservation"]
    ids = sorted(r[0] for r in rows.select("reservationId").collect())
    write(rows.where(F.col("reservationId") <= ids[5]), top, "reservation", load_id="a")
    write(rows.where(F.col("reservationId") > ids[5]).unionByName(rows.where(F.col("reservationId") == ids[8])), top, "reservation", load_id="b")
    assert [tuple(r) for r in repeated_keys(spark, top, "reservation", f"{top}/state").collect()] == [(ids[8], 2, 1)]
    nothing = rows.limit(1).withColumn("reservationId", F.lit(None).cast("long"))
    write(rows.where(F.col("reservationId").isin(ids[2], ids[8])).unionByName(nothing).unionByName(nothing), top, "reservation", load_id="c d")
    # only the new load is read: the keys of the others are kept
    assert keep(spark, top, "reservation", f"{top}/state", "reservation_keys", key_rows("reservation")).new == ["c d"]
    found = {tuple(r) for r in repeated_keys(spark, top, "reservation", f"{top}/state", load_id="c d").collect()}
    assert found == {(ids[2], 2, 2), (ids[8], 3, 2)}
    assert repeated_keys(spark, top, "reservation", f"{top}/state", load_id="a").count() == 1
