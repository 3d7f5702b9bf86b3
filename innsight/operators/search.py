"""Parameterised searches (S1-S3) and their dispatch (M2).

The term enters the plan as a literal pattern, never by splicing it into SQL
text.  Matching is case-insensitive substring matching; ``%`` and ``_`` in the
term act as wildcards (see :func:`innsight.functions.text.like_pattern`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions.money import money_sum, to_money
from innsight.functions.text import contains_ci, full_name, name_matches
from innsight.functions.timeparts import month_int, month_key_text, year_int, year_month_text
from innsight.operators.operations import search_staff
from innsight.operators.preagg import existing_reservations, stay_hotels, weighted

KINDS = ("guest", "hotel", "staff")


def search_guest(t: dict[str, DataFrame], term: str, literal: bool = False) -> DataFrame:
    """Reservations of parties whose name contains ``term``:
    ``reservationId, customer_name, email, check_in, check_out,
    total_revenue``, newest first (no stay sorts last).

    Stays and charges are outer-joined, so the revenue counts each charge once
    per stay of the reservation (once if it has none) and is NULL without
    charges, as in the reference.  Reads ``party``, not ``guest``.
    """
    party = (
        t["party"].where(name_matches("firstName", "lastName", term))
        .select("partyId", full_name("firstName", "lastName").alias("customer_name"), "email")
    )
    matched = t["reservation"].select("reservationId", "partyId").join(party, "partyId")
    if literal:
        out = (
            matched
            .join(t["stay"].select("reservationId", "checkInTime", "checkoutTime"), "reservationId", "left")
            .join(t["charge"].select("reservationId", "cost"), "reservationId", "left")
            .groupBy("reservationId", "customer_name", "email")
            .agg(F.min("checkInTime").alias("check_in"), F.max("checkoutTime").alias("check_out"),
                 money_sum("cost").alias("rev"))
        )
    else:
        # both sides collapse to one row per reservation where they are read,
        # so a reservation that holds a large share of them is never moved whole
        stays = (
            t["stay"].groupBy("reservationId")
            .agg(F.min("checkInTime").alias("check_in"), F.max("checkoutTime").alias("check_out"),
                 F.count(F.lit(1)).alias("k"))
        )
        charges = t["charge"].groupBy("reservationId").agg(money_sum("cost").alias("revenue"))
        out = (
            matched.join(stays, "reservationId", "left")
            .join(charges, "reservationId", "left")
            .withColumn("k", F.coalesce("k", F.lit(1)))
            .withColumn("rev", weighted("revenue", "k"))
        )
    return (
        out.select("reservationId", "customer_name", "email", "check_in", "check_out",
                   to_money(F.col("rev")).alias("total_revenue"))
        .orderBy(F.desc_nulls_last("check_in"), F.asc_nulls_first("reservationId"))
    )


def search_hotel(t: dict[str, DataFrame], term: str, literal: bool = False,
                 trust_references: bool = False) -> DataFrame:
    """Monthly revenue of hotels whose name contains ``term``:
    ``hotel_name, year_month, total_revenue`` by month.

    Groups by hotel *name*, so hotels that share a name are merged (as in the
    reference).  Same fan-out rule as the revenue-by-hotel query.
    """
    hotels = t["hotel"].where(contains_ci(F.col("name"), term)).select(
        "hotelId", F.col("name").alias("hotel_name"))
    if literal:
        out = (
            t["charge"]
            .join(t["reservation"].select("reservationId"), "reservationId")
            .join(t["stay"].select("reservationId", "roomId"), "reservationId")
            .join(t["room"].select("roomId", "wingId"), "roomId")
            .join(t["wing"].select("wingId", "buildingId"), "wingId")
            .join(t["building"].select("buildingId", "hotelId"), "buildingId")
            .join(hotels, "hotelId")
            .groupBy("hotel_name", year_month_text(F.col("dateTime")).alias("year_month"))
            .agg(money_sum("cost").alias("rev"))
        )
    else:
        # k = stays of each reservation in hotels of each matching name; one
        # row per (reservation, name), checked against existing reservations
        # on this (small) side.  Charges meet it as one row per reservation
        # and month, summed where they are read: a hot reservation is collapsed
        # before any shuffle.
        hs = (
            stay_hotels(t, hotels)
            .groupBy("reservationId", "hotel_name")
            .agg(F.count(F.lit(1)).alias("k"))
        )
        if not trust_references:  # see revenue.revenue_by_hotel
            hs = hs.join(existing_reservations(t), "reservationId")
        when = F.col("dateTime")
        out = (
            t["charge"]
            .groupBy("reservationId", year_int(when).alias("y"), month_int(when).alias("m"))
            .agg(money_sum("cost").alias("revenue"))
            .join(hs, "reservationId")
            .groupBy("hotel_name", "y", "m")  # integer keys; text only on result rows
            .agg(F.sum(weighted("revenue", "k")).alias("rev"))
            .select("hotel_name", month_key_text(F.col("y"), F.col("m")).alias("year_month"), "rev")
        )
    return (
        out.select("hotel_name", "year_month", to_money(F.col("rev")).alias("total_revenue"))
        .orderBy(F.asc_nulls_first("year_month"), F.asc_nulls_first("hotel_name"))
    )


_SEARCHES = {"guest": search_guest, "hotel": search_hotel, "staff": search_staff}


def search(t: dict[str, DataFrame], kind: str = "guest", q: str = "", literal: bool = False) -> DataFrame:
    """M2: run the search of ``kind`` for the trimmed term ``q``.

    An empty or blank term, or an unknown kind, gives no rows: the result
    then has the guest-search shape and an empty plan (no table is read).
    """
    term = (q or "").strip()
    fn = _SEARCHES.get(kind)
    if fn is None:
        return search_guest(t, "").where(F.lit(False))
    if not term:
        return fn(t, "").where(F.lit(False))
    return fn(t, term, literal=literal)
