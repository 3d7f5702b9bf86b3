"""Declared data model: 28 typed tables, their keys, foreign keys and defaults.

Integers are 64-bit (``LongType``); 0/1 flags stay longs.  Money columns are
``DoubleType`` at rest holding whole cents and are summed as integer cents
(see :mod:`innsight.functions.money`).  Date-times are ``TimestampNTZType``;
``charge.time`` is free text that is never filled and stays a string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    DataType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

L, S, D, TS = LongType(), StringType(), DoubleType(), TimestampNTZType()


@dataclass(frozen=True)
class Col:
    name: str
    dtype: DataType
    nullable: bool = False
    default: object = None  # declared DEFAULT, used when the column is absent


# table -> columns, in declared order.  `nullable=True` marks the seven
# columns declared without NOT NULL.
TABLES: dict[str, tuple[Col, ...]] = {
    "hotel": (Col("hotelId", L), Col("name", S), Col("brand", S)),
    "building": (Col("buildingId", L), Col("hotelId", L), Col("name", S)),
    "wing": (
        Col("wingId", L), Col("buildingId", L), Col("name", S),
        Col("nearPool", L, default=0), Col("nearParking", L, default=0),
        Col("handicapAccessible", L, default=0),
    ),
    "floor": (Col("floorId", L), Col("wingId", L), Col("smokingPolicy", S), Col("level", L)),
    "room_type": (Col("roomTypeId", L), Col("name", S)),
    "status_type": (Col("statusId", L), Col("name", S)),
    "amenity": (Col("amenityId", L), Col("name", S)),
    "bed_type": (Col("bedId", L), Col("name", S)),
    "room": (
        Col("roomId", L), Col("wingId", L), Col("roomTypeId", L), Col("floorId", L),
        Col("statusId", L), Col("roomNumber", S), Col("baseDailyRate", D), Col("maxOccupancy", L),
    ),
    "room_bed": (Col("roomId", L), Col("bedId", L), Col("count", L, default=1)),
    "room_amenity": (Col("roomId", L), Col("amenityId", L), Col("count", L, default=1)),
    "room_adjacency": (Col("roomId", L), Col("adjacentRoomId", L), Col("adjacencyType", S)),
    "party": (
        Col("partyId", L), Col("firstName", S), Col("lastName", S),
        Col("phone", S, nullable=True), Col("email", S, nullable=True),
    ),
    "organization": (Col("orgId", L), Col("partyId", L), Col("name", S)),
    "customer_qualification": (
        Col("qualificationId", L), Col("partyId", L), Col("score", L), Col("notes", S, nullable=True),
    ),
    "guest": (Col("guestId", L), Col("partyId", L), Col("firstName", S), Col("lastName", S)),
    "reservation": (Col("reservationId", L), Col("partyId", L), Col("dateTime", TS)),
    "reservation_guest": (Col("reservationId", L), Col("guestId", L), Col("role", S, nullable=True)),
    "charge_type": (Col("chargeTypeId", L), Col("name", S)),
    "charge": (
        Col("chargeId", L), Col("reservationId", L), Col("chargeTypeId", L),
        Col("description", S, nullable=True), Col("cost", D), Col("dateTime", TS),
        Col("time", S, nullable=True), Col("splitCharge", L, default=0),
    ),
    "stay": (
        Col("stayId", L), Col("reservationId", L), Col("roomId", L),
        Col("checkInTime", TS), Col("checkoutTime", TS),
    ),
    "event": (Col("eventId", L), Col("reservationId", L), Col("roomId", L), Col("guestCount", L, nullable=True)),
    "staff": (Col("staffId", L), Col("firstName", S), Col("lastName", S), Col("occupation", S)),
    "task_type": (Col("taskTypeId", L), Col("name", S)),
    "task": (Col("taskId", L), Col("roomId", L), Col("staffId", L), Col("taskTypeId", L)),
    "staff_event": (Col("staffId", L), Col("eventId", L)),
    "guest_card": (Col("cardId", L), Col("guestId", L), Col("roomId", L), Col("pin", S)),
    "message": (Col("messageId", L), Col("guestId", L), Col("message", S)),
}

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "hotel": ("hotelId",),
    "building": ("buildingId",),
    "wing": ("wingId",),
    "floor": ("floorId",),
    "room_type": ("roomTypeId",),
    "status_type": ("statusId",),
    "amenity": ("amenityId",),
    "bed_type": ("bedId",),
    "room": ("roomId",),
    "room_bed": ("roomId", "bedId"),
    "room_amenity": ("roomId", "amenityId"),
    "room_adjacency": ("roomId", "adjacentRoomId"),
    "party": ("partyId",),
    "organization": ("orgId",),
    "customer_qualification": ("qualificationId",),
    "guest": ("guestId",),
    "reservation": ("reservationId",),
    "reservation_guest": ("reservationId", "guestId"),
    "charge_type": ("chargeTypeId",),
    "charge": ("chargeId",),
    "stay": ("stayId",),
    "event": ("eventId",),
    "staff": ("staffId",),
    "task_type": ("taskTypeId",),
    "task": ("taskId",),
    "staff_event": ("staffId", "eventId"),
    "guest_card": ("cardId",),
    "message": ("messageId",),
}

# (child table, child column, parent table, parent column), in DDL order.
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("building", "hotelId", "hotel", "hotelId"),
    ("wing", "buildingId", "building", "buildingId"),
    ("floor", "wingId", "wing", "wingId"),
    ("room", "wingId", "wing", "wingId"),
    ("room", "roomTypeId", "room_type", "roomTypeId"),
    ("room", "floorId", "floor", "floorId"),
    ("room", "statusId", "status_type", "statusId"),
    ("room_bed", "roomId", "room", "roomId"),
    ("room_bed", "bedId", "bed_type", "bedId"),
    ("room_amenity", "roomId", "room", "roomId"),
    ("room_amenity", "amenityId", "amenity", "amenityId"),
    ("room_adjacency", "roomId", "room", "roomId"),
    ("room_adjacency", "adjacentRoomId", "room", "roomId"),
    ("organization", "partyId", "party", "partyId"),
    ("customer_qualification", "partyId", "party", "partyId"),
    ("guest", "partyId", "party", "partyId"),
    ("reservation", "partyId", "party", "partyId"),
    ("reservation_guest", "reservationId", "reservation", "reservationId"),
    ("reservation_guest", "guestId", "guest", "guestId"),
    ("charge", "reservationId", "reservation", "reservationId"),
    ("charge", "chargeTypeId", "charge_type", "chargeTypeId"),
    ("stay", "reservationId", "reservation", "reservationId"),
    ("stay", "roomId", "room", "roomId"),
    ("event", "reservationId", "reservation", "reservationId"),
    ("event", "roomId", "room", "roomId"),
    ("task", "roomId", "room", "roomId"),
    ("task", "staffId", "staff", "staffId"),
    ("task", "taskTypeId", "task_type", "taskTypeId"),
    ("staff_event", "staffId", "staff", "staffId"),
    ("staff_event", "eventId", "event", "eventId"),
    ("guest_card", "guestId", "guest", "guestId"),
    ("guest_card", "roomId", "room", "roomId"),
    ("message", "guestId", "guest", "guestId"),
)


def schema(table: str) -> StructType:
    """Declared ``StructType`` of one table (never inferred).

    Every field is nullable to Spark: its nullability flag is a promise the
    optimizer acts on (it may drop NULL checks), while an unparsable date or a
    bad row can still bring a NULL in.  The declared NOT NULL constraints are
    kept in :data:`TABLES` and checked as data (B1).
    """
    return StructType([StructField(c.name, c.dtype, True) for c in TABLES[table]])


def schemas() -> dict[str, StructType]:
    """All 28 declared schemas."""
    return {t: schema(t) for t in TABLES}


def not_null_columns(table: str) -> list[str]:
    return [c.name for c in TABLES[table] if not c.nullable]


def column_names(table: str) -> list[str]:
    return [c.name for c in TABLES[table]]
