"""Hotel tables derived from the TPC-H-shaped driver tables.

The driver provides ``region nation customer supplier part orders lineitem
events`` as single Parquet files.  This module maps them, lazily, onto the
declared hotel model so every query runs over the whole of the given data.
The same mapping is written as DuckDB CTEs in :mod:`innsight.oracle` for the
cross-engine check; keep the two in step.

Every mapped column is cast to its declared type.  Nothing here collects: the
two divisors (``count(supplier)``, ``count(part)``, ``count(orders)``) enter as
scalar subqueries, and room types are numbered by a digest of their name, so
no step needs a global order.  Charges and stays are identified by the text of
four line-item columns (``chargeId`` and ``stayId`` are text here, unlike the
declared long): no long can hold four keys that grow with the data.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.sources.schemas import TABLES, schema
from innsight.sources.tables import apply_defaults

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Fixed values.  Names of the three room statuses, five charge types, four
# task types, and the five staff occupations (indexed by user_id % 5), as in
# the reference's seed data.
STATUS_NAMES = ["Available", "Occupied", "Out of Service"]
CHARGE_TYPE_NAMES = ["Room Night", "Resort Fee", "Parking", "Restaurant", "Spa"]
TASK_TYPE_NAMES = ["Clean Room", "Maintenance Request", "Room Service Delivery", "Mini Bar Refill"]
OCCUPATIONS = ["Front Desk", "Housekeeping", "Maintenance", "Concierge", "Events Manager"]

TEXT_KEYS = ("chargeId", "stayId")
STAY_NIGHTS = 3  # check-out = check-in + 3 days


def _lookup(spark: SparkSession, table: str, names: list[str]) -> DataFrame:
    rows = [(i + 1, n) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, schema(table))


def _line_id() -> F.Column:
    # (l_orderkey, l_linenumber) is not unique in the driver data; these four
    # columns are.  NULL when one of them is.
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return F.concat(parts[0], *(x for p in parts[1:] for x in (F.lit("-"), p)))


def _type_number(name: str) -> F.Column:
    # 60 bits of the name's MD5: the same in every engine, at any size
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


class HotelTables(Mapping):
    """The mapped hotel tables as a lazy, read-only ``dict[str, DataFrame]``.

    A table (and each driver file it reads) is only set up when a query asks
    for it, so a query pays the planning cost of the tables it uses only.
    Every table is conformed to its declared schema (names, order, types),
    but for the text keys of ``TEXT_KEYS``.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._src: dict[str, DataFrame] = {}
        self._built: dict[str, DataFrame] = {}
        self.shared: dict[tuple, DataFrame] = {}  # sub-plans shared by queries
        self._builders = {
            name[len("_t_"):]: getattr(self, name) for name in dir(self) if name.startswith("_t_")
        }

    # Mapping protocol
    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name not in self._builders:
                raise KeyError(name)
            self._built[name] = apply_defaults(self._builders[name](), name, as_text=TEXT_KEYS)
        return self._built[name]

    def __iter__(self):
        return iter(sorted(self._builders, key=list(TABLES).index))

    def __len__(self) -> int:
        return len(self._builders)

    # driver inputs
    def src(self, name: str) -> DataFrame:
        if name not in self._src:
            self._src[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._src[name]

    def _count(self, name: str) -> F.Column:
        """Row count of a driver table as a scalar subquery (no collect)."""
        return self.src(name).select(F.count(F.lit(1))).scalar()

    # hotel tables
    def _t_hotel(self) -> DataFrame:
        return self.src("region").select(
            F.col("r_regionkey").alias("hotelId"),
            F.col("r_name").alias("name"),
            F.concat(F.lit("Brand "), (F.col("r_regionkey") % 3).cast("string")).alias("brand"),
        )

    def _t_building(self) -> DataFrame:
        return self.src("nation").select(
            F.col("n_nationkey").alias("buildingId"),
            F.col("n_regionkey").alias("hotelId"),
            F.col("n_name").alias("name"),
        )

    def _t_wing(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.src("supplier").select(
            k.alias("wingId"),
            F.col("s_nationkey").alias("buildingId"),
            F.col("s_name").alias("name"),
            (k % 2).alias("nearPool"),
            F.when(k % 3 == 0, 1).otherwise(0).alias("nearParking"),
            F.when(k % 5 == 0, 1).otherwise(0).alias("handicapAccessible"),
        )

    def _t_floor(self) -> DataFrame:
        # three levels per wing, generated in place (no join)
        level = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("level")
        return (
            self.src("supplier").select(F.col("s_suppkey").alias("wingId"), level)
            .select(
                (F.col("wingId") * 3 + F.col("level") - 1).alias("floorId"),
                "wingId",
                F.when(F.col("level") == 3, "Smoking").otherwise("Non-smoking").alias("smokingPolicy"),
                "level",
            )
        )

    def _t_room_type(self) -> DataFrame:
        return (
            self.src("part").select(F.col("p_type").alias("name")).distinct()
            .select(_type_number("name").alias("roomTypeId"), "name")
        )

    def _t_status_type(self) -> DataFrame:
        return _lookup(self.spark, "status_type", STATUS_NAMES)

    def _t_room(self) -> DataFrame:
        pk = F.col("p_partkey")
        wing_of_room = pk % self._count("supplier")
        return (
            self.src("part").select(
                pk.alias("roomId"),
                wing_of_room.alias("wingId"),
                _type_number("p_type").alias("roomTypeId"),
                (wing_of_room * 3 + F.col("p_size") % 3).alias("floorId"),
                (pk % 3 + 1).alias("statusId"),
                pk.cast("string").alias("roomNumber"),
                F.col("p_retailprice").alias("baseDailyRate"),
                (F.col("p_size") % 5 + 1).alias("maxOccupancy"),
            )
        )

    def _t_party(self) -> DataFrame:
        return self.src("customer").select(
            F.col("c_custkey").alias("partyId"),
            F.col("c_mktsegment").alias("firstName"),
            F.col("c_name").alias("lastName"),
            F.lit(None).cast("string").alias("phone"),
            F.when(F.col("c_acctbal") >= 0, F.concat(F.lower("c_name"), F.lit("@example.com"))).alias("email"),
        )

    def _t_customer_qualification(self) -> DataFrame:
        return self.src("customer").select(
            F.col("c_custkey").alias("qualificationId"),
            F.col("c_custkey").alias("partyId"),
            (F.floor((F.col("c_acctbal") + 1000) / 1100) + 1).alias("score"),
            F.lit(None).cast("string").alias("notes"),
        )

    def _t_reservation(self) -> DataFrame:
        return self.src("orders").select(
            F.col("o_orderkey").alias("reservationId"),
            F.col("o_custkey").alias("partyId"),
            F.col("o_orderdate").alias("dateTime"),
        )

    def _t_charge_type(self) -> DataFrame:
        return _lookup(self.spark, "charge_type", CHARGE_TYPE_NAMES)

    def _t_charge(self) -> DataFrame:
        ln = F.col("l_linenumber")
        return self.src("lineitem").select(
            _line_id().alias("chargeId"),
            F.col("l_orderkey").alias("reservationId"),
            F.when(F.col("l_returnflag") == "R", 1)
            .when(F.col("l_returnflag") == "A", ln % 2 + 2)
            .otherwise(ln % 2 + 4)
            .alias("chargeTypeId"),
            F.lit(None).cast("string").alias("description"),
            # whole cents, as the exact decimal(18,2) value's double
            (F.rint(F.col("l_extendedprice") * 100.0) / 100.0).alias("cost"),
            F.col("l_shipdate").alias("dateTime"),
            F.lit(None).cast("string").alias("time"),
            F.lit(0).alias("splitCharge"),
        )

    def _t_stay(self) -> DataFrame:
        return self.src("lineitem").where(F.col("l_returnflag") == "R").select(
            _line_id().alias("stayId"),
            F.col("l_orderkey").alias("reservationId"),
            F.col("l_partkey").alias("roomId"),
            F.col("l_shipdate").alias("checkInTime"),
            F.timestamp_add("DAY", F.lit(STAY_NIGHTS), F.col("l_shipdate")).alias("checkoutTime"),
        )

    def _t_event(self) -> DataFrame:
        return self.src("events").where(F.col("event_type") == "purchase").select(
            F.col("event_id").alias("eventId"),
            (F.col("event_id") % self._count("orders")).alias("reservationId"),
            (F.col("event_id") % self._count("part")).alias("roomId"),
            F.floor("value").alias("guestCount"),
        )

    def _t_staff(self) -> DataFrame:
        occupation = F.element_at(
            F.array(*[F.lit(o) for o in OCCUPATIONS]), (F.col("user_id") % len(OCCUPATIONS) + 1).cast("int")
        )
        return (
            self.src("events").select("user_id").distinct()
            .select(
                F.col("user_id").alias("staffId"),
                F.lit("User").alias("firstName"),
                F.col("user_id").cast("string").alias("lastName"),
                occupation.alias("occupation"),
            )
        )

    def _t_task_type(self) -> DataFrame:
        return _lookup(self.spark, "task_type", TASK_TYPE_NAMES)

    def _t_task(self) -> DataFrame:
        ev = self.src("events")
        return ev.where(F.col("event_type") == "click").select(
            F.col("event_id").alias("taskId"),
            (F.col("event_id") % self._count("part")).alias("roomId"),
            F.col("user_id").alias("staffId"),
            (F.col("event_id") % len(TASK_TYPE_NAMES) + 1).alias("taskTypeId"),
        )

    def _t_staff_event(self) -> DataFrame:
        ev = self.src("events")
        return ev.where(F.col("event_type") == "purchase").select(
            F.col("user_id").alias("staffId"), F.col("event_id").alias("eventId")
        )


def hotel_tables(spark: SparkSession, sf_dir: str) -> HotelTables:
    """All mapped hotel tables, keyed by table name, built on first use.

    Made anew on every call: a call lists the folder's files as they are then.
    """
    return HotelTables(spark, sf_dir)
