"""Operations queries: occupancy by hotel (Q6) and staff workload (Q8).

Both use two distinct counts over outer joins in the reference.  The default
forms count each side on its own and join the counts (no ``Expand``, no
task x event product per staff member); ``literal=True`` keeps the reference's
join shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions.text import full_name, name_matches
from innsight.functions.timeparts import ts_literal
from innsight.operators.preagg import room_hotels

# Check-in window of the reference dashboard, half-open [start, end).
WINDOW_START = "2025-01-01"
WINDOW_END = "2025-04-01"


def _rooms_with_hotel(t: dict[str, DataFrame]) -> DataFrame:
    return room_hotels(t, t["hotel"].select("hotelId", F.col("name").alias("hotel_name")))


def occupancy_by_hotel(t: dict[str, DataFrame], start: str = WINDOW_START, end: str = WINDOW_END,
                       literal: bool = False) -> DataFrame:
    """Q6: ``hotelId, hotel_name, num_stays, total_rooms,
    stays_per_room_ratio`` for check-ins in ``[start, end)``.

    Hotels and rooms without stays are kept (rooms inner-joined up to the
    hotel, stays outer-joined).  The window filter is applied to ``stay``
    before the outer join, which is the same as the reference's ON clause and
    lets the range reach the Parquet scan.
    """
    in_window = (F.col("checkInTime") >= ts_literal(start)) & (F.col("checkInTime") < ts_literal(end))
    stays = t["stay"].where(in_window)
    rooms = _rooms_with_hotel(t)
    if literal:
        per_hotel = (
            rooms.join(stays.select("stayId", "roomId"), "roomId", "left")
            .groupBy("hotelId", "hotel_name")
            .agg(F.count_distinct("stayId").alias("num_stays"),
                 F.count_distinct("roomId").alias("total_rooms"))
        )
    else:
        # stays per room (map-side partial counts absorb a hot room), then one
        # row per room on both sides of the outer join.  stayId is the key
        # (unique, not NULL), so counting rows counts distinct stays.
        per_room = stays.groupBy("roomId").agg(F.count(F.lit(1)).alias("k"))
        per_hotel = (
            rooms.join(per_room, "roomId", "left")
            .groupBy("hotelId", "hotel_name")
            .agg(F.coalesce(F.sum("k"), F.lit(0)).alias("num_stays"),
                 F.count("roomId").alias("total_rooms"))
        )
    return (
        per_hotel.select(
            "hotelId", "hotel_name",
            F.col("num_stays").cast("long").alias("num_stays"),
            F.col("total_rooms").cast("long").alias("total_rooms"),
            (F.col("num_stays").cast("double") / F.col("total_rooms").cast("double")).alias("stays_per_room_ratio"),
        )
        .orderBy(F.desc_nulls_last("stays_per_room_ratio"), F.asc_nulls_first("hotelId"))
    )


def _workload(staff: DataFrame, t: dict[str, DataFrame], literal: bool) -> DataFrame:
    """Staff rows plus ``num_tasks`` and ``num_events_supported``.

    The detail tables are counted per staff member before they meet ``staff``,
    also for a narrow search: a busy staff member is one row per map task.
    """
    if literal:
        keys = staff.columns
        return (
            staff.join(t["task"].select("staffId", "taskId"), "staffId", "left")
            .join(t["staff_event"].select("staffId", "eventId"), "staffId", "left")
            .groupBy(*keys)
            .agg(F.count_distinct("taskId").alias("num_tasks"),
                 F.count_distinct("eventId").alias("num_events_supported"))
        )
    task = t["task"].select("staffId", "taskId")
    staff_event = t["staff_event"].select("staffId", "eventId")
    # taskId and (staffId, eventId) are keys, so a row count per staff member
    # is the distinct count; partial counts are taken before the shuffle.
    tasks = task.groupBy("staffId").agg(F.count("taskId").alias("num_tasks"))
    events = staff_event.groupBy("staffId").agg(F.count("eventId").alias("num_events_supported"))
    return (
        staff.join(tasks, "staffId", "left")
        .join(events, "staffId", "left")
        .withColumn("num_tasks", F.coalesce("num_tasks", F.lit(0)))
        .withColumn("num_events_supported", F.coalesce("num_events_supported", F.lit(0)))
    )


def staff_workload(t: dict[str, DataFrame], literal: bool = False) -> DataFrame:
    """Q8: ``staffId, firstName, lastName, occupation, num_tasks,
    num_events_supported``; staff without tasks or events are kept."""
    staff = t["staff"].select("staffId", "firstName", "lastName", "occupation")
    return (
        _workload(staff, t, literal)
        .select("staffId", "firstName", "lastName", "occupation",
                F.col("num_tasks").cast("long").alias("num_tasks"),
                F.col("num_events_supported").cast("long").alias("num_events_supported"))
        .orderBy(F.desc_nulls_last("num_tasks"), F.desc_nulls_last("num_events_supported"), F.asc_nulls_first("staffId"))
    )


def search_staff(t: dict[str, DataFrame], term: str, literal: bool = False) -> DataFrame:
    """S3: staff whose first, last or full name contains ``term``
    (case-insensitive): ``staffId, staff_name, occupation, num_tasks,
    num_events_supported``."""
    staff = (
        t["staff"].where(name_matches("firstName", "lastName", term))
        .select("staffId", full_name("firstName", "lastName").alias("staff_name"), "occupation")
    )
    return (
        _workload(staff, t, literal)
        .select("staffId", "staff_name", "occupation",
                F.col("num_tasks").cast("long").alias("num_tasks"),
                F.col("num_events_supported").cast("long").alias("num_events_supported"))
        .orderBy(F.desc_nulls_last("num_tasks"), F.desc_nulls_last("num_events_supported"), F.asc_nulls_first("staffId"))
    )
