"""Revenue queries: monthly trend, by hotel, top customers, by charge type,
room-type performance, value by qualification score (Q1-Q5, Q7).

Each query has two forms with the same result:

* default: aggregate to one row per reservation before any fan-out join
  (see :mod:`innsight.operators.preagg`);
* ``literal=True``: the join chain exactly as the reference writes it, kept
  for equality tests and for timing the difference.

Money is summed as integer cents and returned as double; means are total / rows.
Every sort gets the group key as a last tie-breaker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions.money import mean, money_sum, to_money
from innsight.functions.timeparts import month_int, year_int
from innsight.operators.preagg import (
    existing_reservations,
    revenue_per_reservation,
    stay_hotels,
    stay_room_types,
    weighted,
)

ROOM_NIGHT = 1  # charge type of room-night charges


def _monthly(t: dict[str, DataFrame], text: bool, totals: DataFrame | None) -> DataFrame:
    # Group on integer calendar parts (cheap keys); the text form is a
    # one-to-one rendering applied to the few result rows only.
    if totals is not None:
        per_month = totals.groupBy("revenue_year", "revenue_month").agg(F.sum("revenue").alias("rev"))
    else:
        when = F.col("dateTime")
        per_month = t["charge"].groupBy(
            year_int(when).alias("revenue_year"), month_int(when).alias("revenue_month")
        ).agg(money_sum("cost").alias("rev"))
    y, m = F.col("revenue_year"), F.col("revenue_month")
    if text:
        y, m = F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0")
    return (
        per_month.select(y.alias("revenue_year"), m.alias("revenue_month"),
                         to_money(F.col("rev")).alias("total_revenue"))
        .orderBy(F.asc_nulls_first("revenue_year"), F.asc_nulls_first("revenue_month"))
    )


def monthly_revenue(t: dict[str, DataFrame], totals: DataFrame | None = None) -> DataFrame:
    """``revenue_year int, revenue_month int, total_revenue``."""
    return _monthly(t, False, totals)


def monthly_revenue_text(t: dict[str, DataFrame], totals: DataFrame | None = None) -> DataFrame:
    """As Q1a with text parts ``'2025'``, ``'01'``."""
    return _monthly(t, True, totals)


def revenue_by_hotel(t: dict[str, DataFrame], literal: bool = False, totals: DataFrame | None = None,
                     trust_references: bool = False) -> DataFrame:
    """Q2: ``hotelId, hotel_name, total_revenue, num_reservations``.

    ``trust_references`` drops the join to ``reservation`` whose only effect
    is to drop charges and stays of unknown reservations: valid, and one
    shuffle of reservation keys cheaper, once the orphan check (B4) reports
    none for them.  Off by default.
    """
    hotel = t["hotel"].select("hotelId", F.col("name").alias("hotel_name"))
    if literal:
        per_hotel = (
            t["charge"]
            .join(t["reservation"], "reservationId")
            .join(t["stay"].select("reservationId", "roomId"), "reservationId")
            .join(t["room"].select("roomId", "wingId"), "roomId")
            .join(t["wing"].select("wingId", "buildingId"), "wingId")
            .join(t["building"].select("buildingId", "hotelId"), "buildingId")
            .join(hotel, "hotelId")
            .groupBy("hotelId", "hotel_name")
            .agg(money_sum("cost").alias("rev"),
                 F.count_distinct("reservationId").alias("num_reservations"))
        )
    else:
        rc = revenue_per_reservation(t, totals=totals)
        # k = stays of the reservation in each hotel
        hs = (
            stay_hotels(t)
            .groupBy("reservationId", "hotelId")
            .agg(F.count(F.lit(1)).alias("k"))
        )
        if not trust_references:
            rc = rc.join(existing_reservations(t), "reservationId")
        per_hotel = (
            rc.join(hs, "reservationId")
            .groupBy("hotelId")
            .agg(F.sum(weighted("revenue", "k")).alias("rev"),
                 F.count(F.lit(1)).alias("num_reservations"))
            .join(hotel, "hotelId")
        )
    return per_hotel.select(
        "hotelId", "hotel_name", to_money(F.col("rev")).alias("total_revenue"), "num_reservations"
    ).orderBy(F.desc_nulls_last("total_revenue"), F.asc_nulls_first("hotelId"))


def top_customers(t: dict[str, DataFrame], n: int = 10, literal: bool = False,
                  totals: DataFrame | None = None) -> DataFrame:
    """Q3: the ``n`` parties with most revenue:
    ``partyId, firstName, lastName, total_revenue, num_reservations``."""
    party = t["party"].select("partyId", "firstName", "lastName")
    if literal:
        per_party = (
            party.join(t["reservation"], "partyId")
            .join(t["charge"], "reservationId")
            .groupBy("partyId", "firstName", "lastName")
            .agg(money_sum("cost").alias("rev"),
                 F.count_distinct("reservationId").alias("num_reservations"))
        )
    else:
        per_party = (
            t["reservation"].select("reservationId", "partyId")
            .join(revenue_per_reservation(t, totals=totals), "reservationId")
            .groupBy("partyId")
            .agg(F.sum("revenue").alias("rev"), F.count(F.lit(1)).alias("num_reservations"))
            .join(t["party"].select("partyId"), "partyId", "left_semi")
        )
    order = [F.desc_nulls_last("total_revenue"), F.asc_nulls_first("partyId")]
    top = per_party.withColumn("total_revenue", to_money(F.col("rev"))).drop("rev").orderBy(*order).limit(n)
    if not literal:  # keys are checked before the cut, names join the n rows that are left
        top = top.join(party, "partyId")
    return top.select("partyId", "firstName", "lastName", "total_revenue", "num_reservations").orderBy(*order)


def revenue_by_charge_type(t: dict[str, DataFrame], totals: DataFrame | None = None) -> DataFrame:
    """Q4: ``chargeTypeId, charge_type, total_revenue, num_charges,
    avg_charge_amount``; types without charges drop out.

    Aggregates charges by type first (partial aggregation, no charge row is
    shuffled), then joins the small type table.
    """
    if totals is not None:
        per_type = totals.groupBy("chargeTypeId").agg(
            F.sum("revenue").alias("rev"), F.sum("n_charges").alias("n"), F.sum("n_rows").alias("rows"))
    else:
        per_type = t["charge"].groupBy("chargeTypeId").agg(
            money_sum("cost").alias("rev"), F.count("cost").alias("n"), F.count("*").alias("rows"))
    return (
        per_type.join(t["charge_type"].select("chargeTypeId", F.col("name").alias("charge_type")), "chargeTypeId")
        .select(
            "chargeTypeId", "charge_type",
            to_money(F.col("rev")).alias("total_revenue"),
            F.col("rows").cast("long").alias("num_charges"),
            mean(F.col("rev"), F.col("n")).alias("avg_charge_amount"),
        )
        .orderBy(F.desc_nulls_last("total_revenue"), F.asc_nulls_first("chargeTypeId"))
    )


def room_type_performance(t: dict[str, DataFrame], charge_type_id: int = ROOM_NIGHT, literal: bool = False,
                          totals: DataFrame | None = None, trust_references: bool = False) -> DataFrame:
    """Q5: per room type, charges of one type only:
    ``roomTypeId, room_type, num_stays, total_revenue, avg_revenue_per_stay``.

    The mean is over joined charge rows (a charge counts once per stay of its
    reservation), as in the reference.  ``trust_references`` as in
    :func:`revenue_by_hotel`.
    """
    room_type = t["room_type"].select("roomTypeId", F.col("name").alias("room_type"))
    if literal:
        per_type = (
            room_type.join(t["room"].select("roomId", "roomTypeId"), "roomTypeId")
            .join(t["stay"].select("stayId", "reservationId", "roomId"), "roomId")
            .join(t["reservation"], "reservationId")
            .join(t["charge"].where(F.col("chargeTypeId") == charge_type_id), "reservationId")
            .groupBy("roomTypeId", "room_type")
            .agg(F.count_distinct("stayId").alias("num_stays"),
                 money_sum("cost").alias("rev"), F.count("cost").alias("n"))
        )
    else:
        rc = revenue_per_reservation(t, charge_type_id=charge_type_id, totals=totals)
        hs = (
            stay_room_types(t)
            .groupBy("reservationId", "roomTypeId")
            .agg(F.count(F.lit(1)).alias("k"))
        )
        if not trust_references:
            rc = rc.join(existing_reservations(t), "reservationId")
        per_type = (
            hs.join(rc, "reservationId")
            .groupBy("roomTypeId")
            .agg(F.sum("k").alias("num_stays"),
                 F.sum(weighted("revenue", "k")).alias("rev"),
                 F.sum(F.col("n_charges") * F.col("k")).alias("n"))
            .join(room_type, "roomTypeId")
        )
    return (
        per_type.select(
            "roomTypeId", "room_type",
            F.col("num_stays").cast("long").alias("num_stays"),
            to_money(F.col("rev")).alias("total_revenue"),
            mean(F.col("rev"), F.col("n")).alias("avg_revenue_per_stay"),
        )
        .orderBy(F.desc_nulls_last("total_revenue"), F.asc_nulls_first("roomTypeId"))
    )


def value_by_score(t: dict[str, DataFrame], literal: bool = False, totals: DataFrame | None = None,
                   trust_references: bool = False) -> DataFrame:
    """Q7: ``qualification_score, num_customers, total_revenue,
    avg_revenue_per_customer``; the mean is over joined charge rows.

    A party with several qualification rows counts under each of them.
    ``trust_references`` drops the existence join to ``party`` (valid once
    B4 finds no orphan qualification or reservation rows).
    """
    cq = t["customer_qualification"].select("partyId", F.col("score").alias("qualification_score"))
    if literal:
        per_score = (
            cq.join(t["party"].select("partyId"), "partyId")
            .join(t["reservation"], "partyId")
            .join(t["charge"], "reservationId")
            .groupBy("qualification_score")
            .agg(F.count_distinct("partyId").alias("num_customers"),
                 money_sum("cost").alias("rev"), F.count("cost").alias("n"))
        )
    else:
        per_party = (
            t["reservation"].select("reservationId", "partyId")
            .join(revenue_per_reservation(t, totals=totals), "reservationId")
            .groupBy("partyId")
            .agg(F.sum("revenue").alias("rev"), F.sum("n_charges").alias("n"))
        )
        if not trust_references:
            per_party = per_party.join(t["party"].select("partyId"), "partyId")
        per_score = (
            cq.join(per_party, "partyId")
            .groupBy("qualification_score")
            .agg(F.count_distinct("partyId").alias("num_customers"),
                 F.sum("rev").alias("rev"), F.sum("n").alias("n"))
        )
    return (
        per_score.select(
            "qualification_score", "num_customers",
            to_money(F.col("rev")).alias("total_revenue"),
            mean(F.col("rev"), F.col("n")).alias("avg_revenue_per_customer"),
        )
        .orderBy(F.desc_nulls_last("qualification_score"))
    )
