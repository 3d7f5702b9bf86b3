"""Cross-engine oracle: the expected rows of each query as DuckDB SQL.

per reservation, room or staff member first, then the fan-out as a product.  It
runs over the same hotel mapping as :mod:`innsight.sources.derived`, written
here as CTEs over the driver's views (``region nation customer supplier part
orders lineitem events``).  The tests hold Spark's join forms against it too.

Numeric rules shared with the Spark side: money is summed as
``DECIMAL(18,2)`` and cast to DOUBLE, means are DOUBLE total / row count,
integer sums are cast to BIGINT, calendar parts to INTEGER.
"""

from __future__ import annotations

from innsight.sources.derived import CHARGE_TYPE_NAMES, OCCUPATIONS, STATUS_NAMES, TASK_TYPE_NAMES
from innsight.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, not_null_columns


def _values(names: list[str]) -> str:
    return ", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(names))


_OCC = ", ".join(f"'{o}'" for o in OCCUPATIONS)
_LINE_ID = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR)"
_TYPE_NUMBER = "CAST('0x' || substr(md5(p_type), 1, 15) AS BIGINT)"

MAPPING = f"""
hotel AS (
  SELECT CAST(r_regionkey AS BIGINT) AS hotelId, r_name AS name,
         'Brand ' || CAST(r_regionkey % 3 AS VARCHAR) AS brand
  FROM region),
building AS (
  SELECT CAST(n_nationkey AS BIGINT) AS buildingId, CAST(n_regionkey AS BIGINT) AS hotelId, n_name AS name
  FROM nation),
wing AS (
  SELECT CAST(s_suppkey AS BIGINT) AS wingId, CAST(s_nationkey AS BIGINT) AS buildingId, s_name AS name,
         CAST(s_suppkey % 2 AS BIGINT) AS nearPool,
         CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS nearParking,
         CAST(CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS handicapAccessible
  FROM supplier),
floor_ AS (
  SELECT CAST(s_suppkey * 3 + lv.level - 1 AS BIGINT) AS floorId, CAST(s_suppkey AS BIGINT) AS wingId,
         CASE WHEN lv.level = 3 THEN 'Smoking' ELSE 'Non-smoking' END AS smokingPolicy,
         CAST(lv.level AS BIGINT) AS level
  FROM supplier, (VALUES (1), (2), (3)) lv(level)),
room_type AS (
  SELECT {_TYPE_NUMBER} AS roomTypeId, p_type AS name
  FROM (SELECT DISTINCT p_type FROM part)),
status_type AS (
  SELECT CAST(i AS BIGINT) AS statusId, n AS name FROM (VALUES {_values(STATUS_NAMES)}) v(i, n)),
room AS (
  SELECT CAST(p_partkey AS BIGINT) AS roomId,
         CAST(p_partkey % (SELECT count(*) FROM supplier) AS BIGINT) AS wingId,
         {_TYPE_NUMBER} AS roomTypeId,
         CAST((p_partkey % (SELECT count(*) FROM supplier)) * 3 + p_size % 3 AS BIGINT) AS floorId,
         CAST(p_partkey % 3 + 1 AS BIGINT) AS statusId,
         CAST(p_partkey AS VARCHAR) AS roomNumber,
         CAST(p_retailprice AS DOUBLE) AS baseDailyRate,
         CAST(p_size % 5 + 1 AS BIGINT) AS maxOccupancy
  FROM part),
party AS (
  SELECT CAST(c_custkey AS BIGINT) AS partyId, c_mktsegment AS firstName, c_name AS lastName,
         CAST(NULL AS VARCHAR) AS phone,
         CASE WHEN c_acctbal >= 0 THEN lower(c_name) || '@example.com' END AS email
  FROM customer),
customer_qualification AS (
  SELECT CAST(c_custkey AS BIGINT) AS qualificationId, CAST(c_custkey AS BIGINT) AS partyId,
         CAST(floor((c_acctbal + 1000) / 1100) + 1 AS BIGINT) AS score, CAST(NULL AS VARCHAR) AS notes
  FROM customer),
reservation AS (
  SELECT CAST(o_orderkey AS BIGINT) AS reservationId, CAST(o_custkey AS BIGINT) AS partyId,
         o_orderdate AS dateTime
  FROM orders),
charge_type AS (
  SELECT CAST(i AS BIGINT) AS chargeTypeId, n AS name FROM (VALUES {_values(CHARGE_TYPE_NAMES)}) v(i, n)),
charge AS (
  SELECT {_LINE_ID} AS chargeId,
         CAST(l_orderkey AS BIGINT) AS reservationId,
         CAST(CASE WHEN l_returnflag = 'R' THEN 1
                   WHEN l_returnflag = 'A' THEN l_linenumber % 2 + 2
                   ELSE l_linenumber % 2 + 4 END AS BIGINT) AS chargeTypeId,
         CAST(NULL AS VARCHAR) AS description,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS cost,
         l_shipdate AS dateTime,
         CAST(NULL AS VARCHAR) AS time,
         CAST(0 AS BIGINT) AS splitCharge
  FROM lineitem),
stay AS (
  SELECT {_LINE_ID} AS stayId, CAST(l_orderkey AS BIGINT) AS reservationId,
         CAST(l_partkey AS BIGINT) AS roomId, l_shipdate AS checkInTime,
         l_shipdate + INTERVAL 3 DAY AS checkoutTime
  FROM lineitem WHERE l_returnflag = 'R'),
event_ AS (
  SELECT CAST(event_id AS BIGINT) AS eventId,
         CAST(event_id % (SELECT count(*) FROM orders) AS BIGINT) AS reservationId,
         CAST(event_id % (SELECT count(*) FROM part) AS BIGINT) AS roomId,
         CAST(floor(value) AS BIGINT) AS guestCount
  FROM events WHERE event_type = 'purchase'),
staff AS (
  SELECT CAST(user_id AS BIGINT) AS staffId, 'User' AS firstName, CAST(user_id AS VARCHAR) AS lastName,
         list_extract([{_OCC}], CAST(user_id % 5 + 1 AS INTEGER)) AS occupation
  FROM (SELECT DISTINCT user_id FROM events)),
task_type AS (
  SELECT CAST(i AS BIGINT) AS taskTypeId, n AS name FROM (VALUES {_values(TASK_TYPE_NAMES)}) v(i, n)),
task AS (
  SELECT CAST(event_id AS BIGINT) AS taskId, CAST(event_id % (SELECT count(*) FROM part) AS BIGINT) AS roomId,
         CAST(user_id AS BIGINT) AS staffId, CAST(event_id % 4 + 1 AS BIGINT) AS taskTypeId
  FROM events WHERE event_type = 'click'),
staff_event AS (
  SELECT CAST(user_id AS BIGINT) AS staffId, CAST(event_id AS BIGINT) AS eventId
  FROM events WHERE event_type = 'purchase')
"""

# Mapped tables and the CTE that holds each (two names are reserved words or
# clash with driver views, hence the trailing underscore).
MAPPED = {
    "hotel": "hotel", "building": "building", "wing": "wing", "floor": "floor_",
    "room_type": "room_type", "status_type": "status_type", "room": "room", "party": "party",
    "customer_qualification": "customer_qualification", "reservation": "reservation",
    "charge_type": "charge_type", "charge": "charge", "stay": "stay", "event": "event_",
    "staff": "staff", "task_type": "task_type", "task": "task", "staff_event": "staff_event",
}

MONEY_SUM = "CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def _sum(c: str) -> str:
    return MONEY_SUM.format(c=c)


def _avg(c: str) -> str:
    return f"{_sum(c)} / CAST(COUNT({c}) AS DOUBLE)"


def _ilike(column: str, term: str) -> str:
    """LIKE that folds A-Z only."""
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"{fold.format(column)} LIKE {fold.format(chr(39) + '%' + term.replace(chr(39), chr(39) * 2) + '%' + chr(39))}"


def _ilike3(first: str, last: str, term: str) -> str:
    return "(" + " OR ".join(_ilike(c, term) for c in (first, last, f"({first} || ' ' || {last})")) + ")"


# Parameters used by the registered queries (see __spark_entry__.py).
Q6_WINDOW = ("1997-01-01", "1997-04-01")
GUEST_TERM = "build"
HOTEL_TERM = "a"
STAFF_TERM = "user 1"
DISPATCH = ("hotel", "  east ")


# Parts of the derivations: one row per reservation before anything is joined.
def _spent(where: str = "") -> str:
    """Exact cost total and number of priced charges of each reservation."""
    return (f"(SELECT reservationId, SUM(CAST(cost AS DECIMAL(18,2))) AS total, COUNT(cost) AS priced "
            f"FROM charge {where} GROUP BY reservationId)")


#: Stays of each reservation in each hotel.
_PLACED = """(
    SELECT reservationId, hotelId, COUNT(*) AS stays
    FROM stay JOIN room USING (roomId) JOIN wing USING (wingId) JOIN building USING (buildingId)
    GROUP BY reservationId, hotelId)"""

#: Tasks and supported events of each staff member, counted apart.
_WORK = """staff
    LEFT JOIN (SELECT staffId, COUNT(DISTINCT taskId) AS tasks FROM task GROUP BY staffId) USING (staffId)
    LEFT JOIN (SELECT staffId, COUNT(DISTINCT eventId) AS helped FROM staff_event GROUP BY staffId) USING (staffId)"""
_WORK_COUNTS = "COALESCE(tasks, 0) AS num_tasks, COALESCE(helped, 0) AS num_events_supported"
_WORK_ORDER = "num_tasks DESC, num_events_supported DESC, staffId"


def _by_month(year: str, month: str) -> str:
    return f"""
SELECT revenue_year, revenue_month, {_sum('cost')} AS total_revenue
FROM (SELECT cost, {year} AS revenue_year, {month} AS revenue_month FROM charge)
GROUP BY revenue_year, revenue_month
ORDER BY revenue_year, revenue_month"""


def body_monthly_revenue() -> str:
    return _by_month("CAST(year(dateTime) AS INTEGER)", "CAST(month(dateTime) AS INTEGER)")


def body_monthly_revenue_text() -> str:
    return _by_month("strftime(dateTime, '%Y')", "strftime(dateTime, '%m')")


def body_revenue_by_hotel() -> str:
    # a reservation's charges count once per stay it has in the hotel
    return f"""
SELECT hotelId, hotel.name AS hotel_name, CAST(SUM(total * stays) AS DOUBLE) AS total_revenue,
       COUNT(*) AS num_reservations
FROM {_PLACED} JOIN {_spent()} USING (reservationId) JOIN hotel USING (hotelId)
WHERE reservationId IN (SELECT reservationId FROM reservation)
GROUP BY hotelId, hotel.name
ORDER BY total_revenue DESC, hotelId"""


def body_top_customers(n: int = 10) -> str:
    return f"""
SELECT partyId, firstName, lastName, total_revenue, num_reservations
FROM (SELECT partyId, CAST(SUM(total) AS DOUBLE) AS total_revenue, COUNT(*) AS num_reservations
      FROM reservation JOIN {_spent()} USING (reservationId) GROUP BY partyId)
JOIN party USING (partyId)
ORDER BY total_revenue DESC NULLS LAST, partyId NULLS FIRST
LIMIT {n}"""


def body_revenue_by_charge_type() -> str:
    return f"""
SELECT chargeTypeId, name AS charge_type, total_revenue, num_charges, avg_charge_amount
FROM (SELECT chargeTypeId, {_sum('cost')} AS total_revenue, COUNT(*) AS num_charges,
             {_avg('cost')} AS avg_charge_amount
      FROM charge GROUP BY chargeTypeId)
JOIN charge_type USING (chargeTypeId)
ORDER BY total_revenue DESC, chargeTypeId"""


def body_room_type_performance(charge_type_id: int = 1) -> str:
    return f"""
SELECT roomTypeId, room_type.name AS room_type, CAST(SUM(stays) AS BIGINT) AS num_stays,
       CAST(SUM(total * stays) AS DOUBLE) AS total_revenue,
       CAST(SUM(total * stays) AS DOUBLE) / CAST(SUM(priced * stays) AS DOUBLE) AS avg_revenue_per_stay
FROM (SELECT reservationId, roomTypeId, COUNT(*) AS stays FROM stay JOIN room USING (roomId) GROUP BY ALL)
JOIN {_spent(f'WHERE chargeTypeId = {charge_type_id}')} USING (reservationId)
JOIN room_type USING (roomTypeId)
WHERE reservationId IN (SELECT reservationId FROM reservation)
GROUP BY roomTypeId, room_type.name
ORDER BY total_revenue DESC, roomTypeId"""


def body_occupancy_by_hotel(start: str = Q6_WINDOW[0], end: str = Q6_WINDOW[1]) -> str:
    return f"""
SELECT hotelId, hotel_name, num_stays, total_rooms,
       CAST(num_stays AS DOUBLE) / CAST(total_rooms AS DOUBLE) AS stays_per_room_ratio
FROM (
  SELECT hotelId, hotel.name AS hotel_name, CAST(COALESCE(SUM(began), 0) AS BIGINT) AS num_stays,
         COUNT(roomId) AS total_rooms
  FROM room JOIN wing USING (wingId) JOIN building USING (buildingId) JOIN hotel USING (hotelId)
  LEFT JOIN (SELECT roomId, COUNT(*) AS began FROM stay
             WHERE checkInTime >= TIMESTAMP '{start}' AND checkInTime < TIMESTAMP '{end}'
             GROUP BY roomId) USING (roomId)
  GROUP BY hotelId, hotel.name)
ORDER BY stays_per_room_ratio DESC, hotelId"""


def body_value_by_score() -> str:
    return f"""
SELECT score AS qualification_score, COUNT(DISTINCT partyId) AS num_customers,
       CAST(SUM(paid) AS DOUBLE) AS total_revenue,
       CAST(SUM(paid) AS DOUBLE) / CAST(SUM(charges) AS DOUBLE) AS avg_revenue_per_customer
FROM customer_qualification
JOIN (SELECT partyId, SUM(total) AS paid, SUM(priced) AS charges
      FROM reservation JOIN {_spent()} USING (reservationId) GROUP BY partyId) USING (partyId)
WHERE partyId IN (SELECT partyId FROM party)
GROUP BY score
ORDER BY qualification_score DESC"""


def body_staff_workload() -> str:
    return f"""
SELECT staffId, firstName, lastName, occupation, {_WORK_COUNTS}
FROM {_WORK}
ORDER BY {_WORK_ORDER}"""


def body_search_guest(term: str = GUEST_TERM) -> str:
    return f"""
SELECT reservationId, firstName || ' ' || lastName AS customer_name, email, check_in, check_out,
       CAST(total * COALESCE(stays, 1) AS DOUBLE) AS total_revenue
FROM reservation JOIN party USING (partyId)
LEFT JOIN (SELECT reservationId, MIN(checkInTime) AS check_in, MAX(checkoutTime) AS check_out, COUNT(*) AS stays
           FROM stay GROUP BY reservationId) USING (reservationId)
LEFT JOIN {_spent()} USING (reservationId)
WHERE {_ilike3('firstName', 'lastName', term)}
ORDER BY check_in DESC NULLS LAST, reservationId"""


def body_search_hotel(term: str = HOTEL_TERM) -> str:
    return f"""
SELECT hotel.name AS hotel_name, year_month, CAST(SUM(total * stays) AS DOUBLE) AS total_revenue
FROM (SELECT reservationId, strftime(dateTime, '%Y-%m') AS year_month, SUM(CAST(cost AS DECIMAL(18,2))) AS total
      FROM charge GROUP BY ALL)
JOIN {_PLACED} USING (reservationId) JOIN hotel USING (hotelId)
WHERE {_ilike('hotel.name', term)} AND reservationId IN (SELECT reservationId FROM reservation)
GROUP BY hotel.name, year_month
ORDER BY year_month, hotel_name"""


def body_search_staff(term: str = STAFF_TERM) -> str:
    return f"""
SELECT staffId, firstName || ' ' || lastName AS staff_name, occupation, {_WORK_COUNTS}
FROM {_WORK}
WHERE {_ilike3('firstName', 'lastName', term)}
ORDER BY {_WORK_ORDER}"""


def body_null_report() -> str:
    parts = []
    for table, cte in MAPPED.items():
        for c in not_null_columns(table):
            parts.append(
                f"SELECT '{table}' AS table_name, '{c}' AS column_name, "
                f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_rows FROM {cte}"
            )
    return "\nUNION ALL\n".join(parts)


def body_key_report(composite: bool) -> str:
    parts = []
    for table, cte in MAPPED.items():
        keys = PRIMARY_KEYS[table]
        if (len(keys) > 1) != composite:
            continue
        k = ", ".join(keys)
        parts.append(f"""
SELECT '{table}' AS table_name, '{",".join(keys)}' AS key_columns,
       CAST(COALESCE(SUM(n), 0) AS BIGINT) AS num_rows, CAST(COUNT(*) AS BIGINT) AS num_keys,
       CAST(COUNT(*) FILTER (WHERE n > 1) AS BIGINT) AS duplicate_keys,
       CAST(COALESCE(SUM(CASE WHEN n > 1 THEN n ELSE 0 END), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT {k}, COUNT(*) AS n FROM {cte} GROUP BY {k})""")
    return "\nUNION ALL\n".join(parts)


def body_orphan_report() -> str:
    parts = []
    for c, f, p, k in FOREIGN_KEYS:
        if c not in MAPPED or p not in MAPPED:
            continue
        parts.append(f"""
SELECT '{c}' AS child_table, '{f}' AS fk_column, '{p}' AS parent_table, '{k}' AS pk_column,
       CAST(COUNT(*) AS BIGINT) AS orphan_rows
FROM {MAPPED[c]} x
WHERE x.{f} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {MAPPED[p]} y WHERE y.{k} = x.{f})""")
    return "\nUNION ALL\n".join(parts)


def body_defaults() -> str:
    return f"""
SELECT CAST(l_orderkey AS BIGINT) AS chargeId, CAST(l_orderkey AS BIGINT) AS reservationId,
       CAST(CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN l_linenumber % 2 + 2
                 ELSE l_linenumber % 2 + 4 END AS BIGINT) AS chargeTypeId,
       CAST(NULL AS VARCHAR) AS description,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS cost,
       l_shipdate AS dateTime, CAST(NULL AS VARCHAR) AS time, CAST(0 AS BIGINT) AS splitCharge
FROM lineitem"""


def body_wing_defaults() -> str:
    return """
SELECT wingId, buildingId, name, CAST(0 AS BIGINT) AS nearPool, CAST(0 AS BIGINT) AS nearParking,
       CAST(0 AS BIGINT) AS handicapAccessible
FROM wing"""


def body_missing_email() -> str:
    return "SELECT * FROM party WHERE email IS NULL"


def body_repeated_lines() -> str:
    return """
SELECT l_orderkey, l_linenumber, COUNT(*) AS "rows"
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1"""


def body_without_stay() -> str:
    return "SELECT * FROM reservation WHERE reservationId NOT IN (SELECT reservationId FROM stay WHERE reservationId IS NOT NULL)"


def with_mapping(body: str) -> str:
    return f"WITH {MAPPING}\n{body}"


def wrap(body: str, select: str) -> str:
    """``select`` over the result of ``body`` (aliased ``q``), keeping order."""
    return f"WITH {MAPPING}, q AS ({body})\n{select}"


# Report SELECTs over `q` (F6-F10): money "$%.2f", ratio "%.2f", dash for a
# missing check-in/out, display names from two columns.
def _money(c: str) -> str:
    return f"printf('$%.2f', COALESCE({c}, 0))"


def _ratio(c: str) -> str:
    return f"printf('%.2f', COALESCE({c}, 0))"


def _dash_ts(c: str) -> str:
    return f"COALESCE(NULLIF(strftime({c}, '%Y-%m-%d %H:%M:%S'), ''), '—')"


REPORT_SELECTS = {
    "monthly_revenue": f"SELECT revenue_year AS year, revenue_month AS month, {_money('total_revenue')} AS total_revenue FROM q",
    "revenue_by_hotel": f"SELECT hotel_name AS hotel, {_money('total_revenue')} AS total_revenue, num_reservations AS reservations FROM q",
    "top_customers": f"SELECT firstName || ' ' || lastName AS customer, {_money('total_revenue')} AS total_revenue, num_reservations AS reservations FROM q",
    "revenue_by_charge_type": f"SELECT charge_type, {_money('total_revenue')} AS total_revenue, num_charges AS charges, {_money('avg_charge_amount')} AS avg_charge FROM q",
    "room_type_perf": f"SELECT room_type, num_stays AS stays, {_money('total_revenue')} AS total_revenue, {_money('avg_revenue_per_stay')} AS avg_revenue_per_stay FROM q",
    "occupancy_by_hotel": f"SELECT hotel_name AS hotel, num_stays AS stays, total_rooms AS rooms, {_ratio('stays_per_room_ratio')} AS stays_per_room FROM q",
    "value_vs_score": f"SELECT qualification_score, num_customers AS customers, {_money('total_revenue')} AS total_revenue, {_money('avg_revenue_per_customer')} AS avg_revenue_per_customer FROM q",
    "staff_workload": "SELECT firstName || ' ' || lastName AS staff, occupation AS role, num_tasks AS tasks, num_events_supported AS events_supported FROM q",
    "search_guest": f"SELECT reservationId AS reservation_id, customer_name AS guest, email, {_dash_ts('check_in')} AS check_in, {_dash_ts('check_out')} AS check_out, {_money('total_revenue')} AS total_revenue FROM q",
    "search_hotel": f"SELECT hotel_name AS hotel, year_month, {_money('total_revenue')} AS total_revenue FROM q",
    "search_staff": "SELECT staff_name AS staff, occupation AS role, num_tasks AS tasks, num_events_supported AS events_supported FROM q",
}

REPORT_BODIES = {
    "monthly_revenue": body_monthly_revenue_text,
    "revenue_by_hotel": body_revenue_by_hotel,
    "top_customers": body_top_customers,
    "revenue_by_charge_type": body_revenue_by_charge_type,
    "room_type_perf": body_room_type_performance,
    "occupancy_by_hotel": body_occupancy_by_hotel,
    "value_vs_score": body_value_by_score,
    "staff_workload": body_staff_workload,
    "search_guest": body_search_guest,
    "search_hotel": body_search_hotel,
    "search_staff": body_search_staff,
}


#: The eight results of a dashboard refresh.
DASHBOARD = [name for name in REPORT_BODIES if not name.startswith("search_")]


def oracle_queries() -> dict[str, str]:
    q = {
        "q1a_monthly_revenue": with_mapping(body_monthly_revenue()),
        "q1b_monthly_revenue_text": with_mapping(body_monthly_revenue_text()),
        "q2_revenue_by_hotel": with_mapping(body_revenue_by_hotel()),
        "q3_top_customers": with_mapping(body_top_customers()),
        "q4_revenue_by_charge_type": with_mapping(body_revenue_by_charge_type()),
        "q5_room_type_performance": with_mapping(body_room_type_performance()),
        "q6_occupancy_by_hotel": with_mapping(body_occupancy_by_hotel()),
        "q7_value_by_score": with_mapping(body_value_by_score()),
        "q8_staff_workload": with_mapping(body_staff_workload()),
        "s1_search_guest": with_mapping(body_search_guest()),
        "s2_search_hotel": with_mapping(body_search_hotel()),
        "s3_search_staff": with_mapping(body_search_staff()),
        "m2_search_dispatch": with_mapping(body_search_hotel(DISPATCH[1].strip())),
        "b1_null_violations": with_mapping(body_null_report()),
        "b2_duplicate_keys": with_mapping(body_key_report(composite=False)),
        "b3_duplicate_composite_keys": with_mapping(body_key_report(composite=True)),
        "b4_orphans": with_mapping(body_orphan_report()),
        "a4_defaults": with_mapping(body_defaults()),
        "a4_defaults_wing": with_mapping(body_wing_defaults()),
        "b1_rows_missing_email": with_mapping(body_missing_email()),
        "b3_rows_repeated_lines": with_mapping(body_repeated_lines()),
        "b4_rows_without_stay": with_mapping(body_without_stay()),
        "m2_dispatch_guest": with_mapping(body_search_guest()),
        "m2_dispatch_staff": with_mapping(body_search_staff()),
        "m2_dispatch_blank": with_mapping(body_search_hotel()),
        "m2_dispatch_unknown": with_mapping(body_search_guest()),
        "a3_ingest_twice": with_mapping("SELECT reservationId, partyId, dateTime FROM reservation"),
        "a3_rejects": """SELECT 'loaded' AS outcome, count(*) FILTER (l_linenumber % 3 <> 0) AS n_rows FROM lineitem
            UNION ALL SELECT 'rejected', count(*) FILTER (l_linenumber % 3 = 0) FROM lineitem""",
        "a5_write_and_load": with_mapping("SELECT roomId, wingId, roomNumber, baseDailyRate FROM room"),
        "b2_repeated_across_loads": with_mapping("SELECT reservationId, CAST(2 AS BIGINT) AS n_rows, CAST(2 AS BIGINT) AS n_loads FROM reservation WHERE reservationId % 6 = 0"),
        "m1_incremental_monthly_revenue": with_mapping(REPORT_BODIES["monthly_revenue"]()),
        "m1_incremental_room_type_perf": with_mapping(REPORT_BODIES["room_type_perf"]()),
        "n1_bucketed_revenue_by_hotel": with_mapping(body_revenue_by_hotel()),
        "n1_bucketed_room_type_perf": with_mapping(body_room_type_performance()),
        "n1_bucketed_search_guest": with_mapping(body_search_guest()),
        "n1_bucketed_search_hotel": with_mapping(body_search_hotel()),
    }
    for name in DASHBOARD:
        q[f"m1_dashboard_{name}"] = with_mapping(REPORT_BODIES[name]())
    for name, body in REPORT_BODIES.items():
        q[f"f10_report_{name}"] = wrap(body(), REPORT_SELECTS[name])
    return q
