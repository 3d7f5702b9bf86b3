"""Report projections (F6-F10): the columns each result shows, in order.

A report keeps the row order of its result, drops ids (except the
reservation id of the guest search), joins first and last names for display,
and turns money into ``$1234.50`` text and ratios into ``2.67`` text (NULL
shown as zero).  A missing check-in or check-out shows as an em dash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.functions.money import money_text, ratio_text
from innsight.functions.text import dash_if_blank, full_name
from innsight.functions.timeparts import datetime_text

Spec = list[tuple[str, Callable[[], Column]]]

SPECS: dict[str, Spec] = {
    "monthly_revenue": [
        ("year", lambda: F.col("revenue_year")),
        ("month", lambda: F.col("revenue_month")),
        ("total_revenue", lambda: money_text("total_revenue")),
    ],
    "revenue_by_hotel": [
        ("hotel", lambda: F.col("hotel_name")),
        ("total_revenue", lambda: money_text("total_revenue")),
        ("reservations", lambda: F.col("num_reservations")),
    ],
    "top_customers": [
        ("customer", lambda: full_name("firstName", "lastName")),
        ("total_revenue", lambda: money_text("total_revenue")),
        ("reservations", lambda: F.col("num_reservations")),
    ],
    "revenue_by_charge_type": [
        ("charge_type", lambda: F.col("charge_type")),
        ("total_revenue", lambda: money_text("total_revenue")),
        ("charges", lambda: F.col("num_charges")),
        ("avg_charge", lambda: money_text("avg_charge_amount")),
    ],
    "room_type_perf": [
        ("room_type", lambda: F.col("room_type")),
        ("stays", lambda: F.col("num_stays")),
        ("total_revenue", lambda: money_text("total_revenue")),
        ("avg_revenue_per_stay", lambda: money_text("avg_revenue_per_stay")),
    ],
    "occupancy_by_hotel": [
        ("hotel", lambda: F.col("hotel_name")),
        ("stays", lambda: F.col("num_stays")),
        ("rooms", lambda: F.col("total_rooms")),
        ("stays_per_room", lambda: ratio_text("stays_per_room_ratio")),
    ],
    "value_vs_score": [
        ("qualification_score", lambda: F.col("qualification_score")),
        ("customers", lambda: F.col("num_customers")),
        ("total_revenue", lambda: money_text("total_revenue")),
        ("avg_revenue_per_customer", lambda: money_text("avg_revenue_per_customer")),
    ],
    "staff_workload": [
        ("staff", lambda: full_name("firstName", "lastName")),
        ("role", lambda: F.col("occupation")),
        ("tasks", lambda: F.col("num_tasks")),
        ("events_supported", lambda: F.col("num_events_supported")),
    ],
    "search_guest": [
        ("reservation_id", lambda: F.col("reservationId")),
        ("guest", lambda: F.col("customer_name")),
        ("email", lambda: F.col("email")),
        ("check_in", lambda: dash_if_blank(datetime_text(F.col("check_in")))),
        ("check_out", lambda: dash_if_blank(datetime_text(F.col("check_out")))),
        ("total_revenue", lambda: money_text("total_revenue")),
    ],
    "search_hotel": [
        ("hotel", lambda: F.col("hotel_name")),
        ("year_month", lambda: F.col("year_month")),
        ("total_revenue", lambda: money_text("total_revenue")),
    ],
    "search_staff": [
        ("staff", lambda: F.col("staff_name")),
        ("role", lambda: F.col("occupation")),
        ("tasks", lambda: F.col("num_tasks")),
        ("events_supported", lambda: F.col("num_events_supported")),
    ],
}


def report(df: DataFrame, name: str) -> DataFrame:
    """Project the result ``df`` of kind ``name`` into its report columns.

    A narrow ``select``: it keeps the partitioning and the sort of ``df``.
    """
    spec = SPECS[name]
    return df.select(*[expr().alias(col) for col, expr in spec])
