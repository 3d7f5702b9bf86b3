"""Dashboard refresh that reads new loads only, published as a whole (M1).

The charges of a load are totalled once, when the load is first met
(:func:`innsight.sources.perload.keep`); a refresh adds up the totals of all
committed loads and derives the eight results from the sums.  Totals are whole
cents and counts, so adding them up gives exactly what reading all charges gives.

The results of a refresh lie in a folder of their own; one ledger entry,
written when all of them are whole, makes them the published ones.  A refresh that
fails leaves the published results as they were, and readers never see results
of two refreshes side by side.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.operators.preagg import charge_totals
from innsight.plans.dashboard import DASHBOARD_KEYS, refresh_dashboard
from innsight.sources import ledger
from innsight.sources.perload import Kept, keep
from innsight.sources.tables import load

GROUP = ("reservationId", "chargeTypeId", "revenue_year", "revenue_month")
SUMS = ("revenue", "n_charges", "n_rows")
RESULTS = "results"


def kept_totals(spark: SparkSession, root: str, mart: str) -> Kept:
    """:func:`charge_totals` of all committed loads of ``root/charge``; reads the charges of new loads only."""
    kept = keep(spark, root, "charge", mart, "charge_totals", charge_totals)
    # a load's totals hold a group once: they move as they are, once for the sums and for the buckets that the refresh stages
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return Kept(kept.rows.repartition(n, "reservationId").groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS]), kept.new)


def refresh(spark: SparkSession, root: str, mart: str, tables: dict[str, DataFrame] | None = None, **kwargs) -> list[str]:
    """Publish the dashboard of the tables under ``root``; returns the charge loads that were read.

    ``tables`` stands in for the tables other than ``charge``; the other
    arguments are those of :func:`refresh_dashboard`.
    """
    t = tables if tables is not None else load(spark, root)
    totals = kept_totals(spark, root, mart)
    ledger.open_ledger(spark, mart, RESULTS)
    name = uuid.uuid4().hex
    refresh_dashboard(spark, t, f"{mart.rstrip('/')}/{RESULTS}/load_id={name}", totals=totals.rows, **kwargs)
    ledger.commit(spark, mart, RESULTS, name, replaces=True)
    return totals.new


def published(spark: SparkSession, mart: str) -> dict[str, DataFrame]:
    """The results of the last refresh that became whole, all of the same refresh."""
    paths = ledger.committed_paths(spark, mart, RESULTS) if ledger._found(spark, f"{mart.rstrip('/')}/_ledger/{RESULTS}") else []
    if not paths:
        raise LookupError(f"nothing is published under {mart}")
    return {key: spark.read.parquet(f"{paths[-1]}/{key}") for key in DASHBOARD_KEYS}
