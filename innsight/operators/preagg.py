"""Pre-aggregates shared by the revenue queries.

The reference joins charges and stays through the reservation, so a
reservation with *k* stays counts each of its charges *k* times (the fan-out
is part of the answer).  Rather than materialise that product, the queries
aggregate each side to one row per reservation first and multiply:

    sum over joined (charge, stay) rows of cost == sum over reservations of
        (sum of the reservation's costs) * (number of its stays in the group)

This relies on primary keys being unique (reservationId, stayId, roomId, ...),
which the declared model guarantees and :mod:`innsight.operators.quality`
checks.  Partial (map-side) aggregation collapses a hot reservation or room
before any shuffle, so one key holding a large share of rows never lands whole
in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions.money import money_sum
from innsight.functions.timeparts import month_int, year_int


def shared(t: dict[str, DataFrame], key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a sub-plan across queries over the same tables.

    Catalogue objects (``HotelTables``) carry a ``shared`` dict; a plain dict
    of tables just builds the plan.  Only the immutable logical plan is
    shared: every query still plans and executes it on its own.
    """
    memo = getattr(t, "shared", None)
    if memo is None:
        return build()
    if key not in memo:
        memo[key] = build()
    return memo[key]


def charge_totals(charge: DataFrame) -> DataFrame:
    """Cost total and charge count per (reservation, charge type, calendar
    month of the charge).

    The one shared pre-aggregate of the dashboard: all six revenue results
    (monthly trend, by hotel, top customers, by charge type, room types,
    value by score) can be answered from it, so a refresh reads the charges
    once.
    """
    when = F.col("dateTime")
    return charge.groupBy(
        "reservationId", "chargeTypeId",
        year_int(when).alias("revenue_year"), month_int(when).alias("revenue_month"),
    ).agg(
        money_sum("cost").alias("revenue"),
        F.count("cost").alias("n_charges"),  # costs, for means
        F.count("*").alias("n_rows"),
    )


def revenue_per_reservation(
    t: dict[str, DataFrame],
    charge_type_id: int | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """``reservationId, revenue (cents), n_charges`` over charges, optionally
    of one type; from the shared ``totals`` when given."""
    if totals is not None:
        src = totals
        if charge_type_id is not None:
            src = src.where(F.col("chargeTypeId") == charge_type_id)
        return src.groupBy("reservationId").agg(
            F.sum("revenue").alias("revenue"), F.sum("n_charges").alias("n_charges")
        )

    def build() -> DataFrame:
        charge = t["charge"]
        if charge_type_id is not None:
            charge = charge.where(F.col("chargeTypeId") == charge_type_id)
        return charge.groupBy("reservationId").agg(
            money_sum("cost").alias("revenue"), F.count("cost").alias("n_charges")
        )

    return shared(t, ("revenue_per_reservation", charge_type_id), build)


def existing_reservations(t: dict[str, DataFrame]) -> DataFrame:
    """Reservation keys; joining on them keeps the reference's inner join to
    ``reservation`` (a charge or stay of an unknown reservation drops out)."""
    return shared(t, ("reservation_ids",), lambda: t["reservation"].select("reservationId"))


def room_hotels(t: dict[str, DataFrame], hotels: DataFrame | None = None) -> DataFrame:
    """``roomId`` plus the columns of ``hotels`` (default: ``hotelId``) through
    room -> wing -> building -> hotel.

    Dimension-sized; the planner broadcasts each side whose measured size is
    under the broadcast threshold and shuffles it otherwise.
    """
    if hotels is None:
        return shared(t, ("room_hotels",), lambda: room_hotels(t, t["hotel"].select("hotelId")))
    return (
        room_buildings(t)
        .join(t["building"].select("buildingId", "hotelId"), "buildingId")
        .join(hotels, "hotelId")
        .select("roomId", *hotels.columns)
    )


def room_buildings(t: dict[str, DataFrame]) -> DataFrame:
    """``roomId, buildingId`` through room -> wing."""
    return shared(t, ("room_buildings",), lambda: (
        t["room"].select("roomId", "wingId")
        .join(t["wing"].select("wingId", "buildingId"), "wingId")
        .select("roomId", "buildingId")
    ))


def weighted(revenue: str, k: str) -> F.Column:
    """``revenue * k``: cents times the fan-out of the reservation."""
    return F.col(revenue) * F.col(k)


#: Columns that a stored stay may carry beside its declared ones (``sources.bucketed``): what its room leads to.
PLACE = {"stayHotelId": "hotelId", "stayRoomTypeId": "roomTypeId"}


def stay_hotels(t: dict[str, DataFrame], hotels: DataFrame | None = None) -> DataFrame:
    """``reservationId`` of every stay and ``hotelId`` (or the columns of ``hotels``) of its room."""
    stay = t["stay"]
    if "stayHotelId" not in stay.columns:
        return stay.select("reservationId", "roomId").join(room_hotels(t, hotels), "roomId").drop("roomId")
    placed = stay.where(F.col("stayHotelId").isNotNull()).select("reservationId", F.col("stayHotelId").alias("hotelId"))
    return placed if hotels is None else placed.join(hotels, "hotelId")


def stay_room_types(t: dict[str, DataFrame]) -> DataFrame:
    """``reservationId`` of every stay and ``roomTypeId`` of its room."""
    stay = t["stay"]
    if "stayRoomTypeId" not in stay.columns:
        return stay.select("reservationId", "roomId").join(t["room"].select("roomId", "roomTypeId"), "roomId").drop("roomId")
    return stay.where(F.col("stayRoomTypeId").isNotNull()).select("reservationId", F.col("stayRoomTypeId").alias("roomTypeId"))


def placed_stays(t: dict[str, DataFrame]) -> DataFrame:
    """The stays with the columns of :data:`PLACE`: NULL where the room, or a step from it to its hotel, is not there."""
    hotels = room_hotels(t).select(F.col("roomId").alias("__h"), F.col("hotelId").alias("stayHotelId"))
    types = t["room"].select(F.col("roomId").alias("__r"), F.col("roomTypeId").alias("stayRoomTypeId"))
    return (t["stay"].join(hotels, F.col("roomId") == F.col("__h"), "left")
            .join(types, F.col("roomId") == F.col("__r"), "left").drop("__h", "__r"))
