"""Small hotel data sets for tests, made by rule from a seed.

Primary keys are unique (the model guarantees it); everything else the
seed-shaped data hides is planted: reservations with 0-3 stays, stays of one
reservation in two hotels, reservations without charges, charges of unknown
reservations and stays in unknown rooms (orphans), NULL e-mails, parties with
two qualification rows, two hotels of one name, check-ins exactly on the
occupancy window's ends, charges without a date, ties on revenue, staff with
many tasks and many events, and names with accents, ``%``, ``_``, ``\\`` and
mixed case.
"""

from __future__ import annotations

import datetime as dt
import random

import duckdb
from pyspark.sql import DataFrame, SparkSession

from innsight.sources.derived import CHARGE_TYPE_NAMES, OCCUPATIONS, STATUS_NAMES, TASK_TYPE_NAMES
from innsight.sources.schemas import TABLES, schema

HOTEL_NAMES = ["Harbor Light", "Pine Ridge Lodge", "Old Town Hotel", "Harbor Light", "Café Ünïcode 50%_off\\",
               "Empty Hotel"]
FIRST = ["Alex", "morgane", "ROBIN", "Dana", "Lee", "Émile", "Zoë", "Kai", "O'Neil", "Jo_ey"]
LAST = ["Hart", "HART", "hartley", "Moreno", "Tran", "Okafor", "Silva", "100%", "Back\\slash", "Müller"]


def _ts(day: int, hour: int = 15) -> dt.datetime:
    return dt.datetime(2025, 1, 1, hour) + dt.timedelta(days=day)


def make_rows(seed: int = 7, n_res: int = 60, orphans: bool = True) -> dict[str, list[tuple]]:
    rnd = random.Random(seed)
    r: dict[str, list[tuple]] = {name: [] for name in TABLES}
    r["hotel"] = [(i + 1, n, f"Brand {i % 2}") for i, n in enumerate(HOTEL_NAMES)]
    # hotel 6 has no building; building 7 points at a missing hotel
    r["building"] = [(1, 1, "Main"), (2, 1, "Ocean"), (3, 2, "Summit"), (4, 3, "Tower"), (5, 4, "Annex"),
                     (6, 5, "Odd"), (7, 99 if orphans else 2, "Lost")]
    r["wing"] = [(w, w, f"W{w}", w % 2, 1 - w % 2, int(w % 3 == 0)) for w in range(1, 8)]
    r["floor"] = [(w * 3 + lv - 1, w, "Smoking" if lv == 3 else "Non-smoking", lv)
                  for w in range(1, 8) for lv in (1, 2, 3)]
    r["room_type"] = [(i + 1, n) for i, n in enumerate(["Twin", "Queen", "King", "Junior Suite", "Family"])]
    r["status_type"] = [(i + 1, n) for i, n in enumerate(STATUS_NAMES)]
    n_rooms = 24
    for rid in range(1, n_rooms + 1):
        wing = 1 + (rid - 1) % 7
        rtype = 1 + rid % 4
        if orphans and rid == n_rooms:
            rtype = 9  # unknown room type
        r["room"].append((rid, wing, rtype, wing * 3, 1 + rid % 3, f"{rid:04d}", float(100 + 10 * rid), 2))
    n_party = 30
    for p in range(1, n_party + 1):
        first, last = FIRST[p % len(FIRST)], LAST[(p * 3) % len(LAST)]
        email = None if p % 7 == 0 else f"{first.lower()}.{p}@example.com"
        r["party"].append((p, first, last, None, email))
        r["customer_qualification"].append((p, p, 1 + p % 10, None))
    r["customer_qualification"].append((1000, 3, 9, "second row"))   # party 3 twice, two scores
    r["customer_qualification"].append((1001, 5, 1 + 5 % 10, "same score again"))  # party 5 twice, same score
    if orphans:
        r["customer_qualification"].append((1002, 777, 4, "unknown party"))
    r["charge_type"] = [(i + 1, n) for i, n in enumerate(CHARGE_TYPE_NAMES)]

    stay_id = charge_id = 0
    for res in range(1, n_res + 1):
        party = 1 + rnd.randrange(n_party - 3)  # the last parties never book
        r["reservation"].append((res, party, _ts(rnd.randrange(-20, 100), 0)))
        n_stays = rnd.choice([0, 1, 1, 1, 2, 3])
        rooms = rnd.sample(range(1, n_rooms + 1), n_stays)
        for room in rooms:
            stay_id += 1
            day = rnd.randrange(-10, 100)
            r["stay"].append((stay_id, res, room, _ts(day), _ts(day + 3, 11)))
        n_ch = rnd.choice([0, 1, 2, 3, 4])
        for _ in range(n_ch):
            charge_id += 1
            ctype = rnd.choice([1, 1, 2, 3, 4])  # type 5 never used
            cost = rnd.randrange(1, 200000) / 100.0
            when = None if rnd.random() < 0.05 else _ts(rnd.randrange(-40, 120), rnd.randrange(24))
            r["charge"].append((charge_id, res, ctype, None, cost, when, None, 0))
    # window ends exactly: 2025-01-01 00:00:00 counts, 2025-04-01 00:00:00 does not
    r["stay"].append((stay_id + 1, 1, 2, dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)))
    r["stay"].append((stay_id + 2, 2, 3, dt.datetime(2025, 4, 1), dt.datetime(2025, 4, 2)))
    # one reservation with stays in two hotels (rooms of wings 1 and 3)
    r["stay"].append((stay_id + 3, 3, 1, _ts(5), _ts(6)))
    r["stay"].append((stay_id + 4, 3, 3, _ts(5), _ts(6)))
    # equal revenue for parties near the top-10 cut
    for p in (n_party - 2, n_party - 1):
        res = 1000 + p
        r["reservation"].append((res, p, _ts(3, 0)))
        charge_id += 1
        r["charge"].append((charge_id, res, 2, "tie", 12345.67, _ts(3), None, 0))
    if orphans:
        r["stay"].append((stay_id + 5, 555, 4, _ts(7), _ts(8)))          # unknown reservation
        r["stay"].append((stay_id + 6, 4, 999, _ts(7), _ts(8)))          # unknown room
        charge_id += 1
        r["charge"].append((charge_id, 555, 1, None, 99.99, _ts(7), None, 0))  # unknown reservation
        r["reservation"].append((556, 888, _ts(9, 0)))                  # unknown party
        charge_id += 1
        r["charge"].append((charge_id, 556, 1, None, 10.0, _ts(9), None, 0))

    staff = [(1, "Nia", "Osei", OCCUPATIONS[0]), (2, "Omar", "Haddad", OCCUPATIONS[1]),
             (3, "Lena", "Vogel", OCCUPATIONS[2]), (4, "Ravi", "Iyer", OCCUPATIONS[3]),
             (5, "Sofia", "Marin", OCCUPATIONS[4]), (6, "Ana", "Ñandú", OCCUPATIONS[0])]
    r["staff"] = staff
    r["task_type"] = [(i + 1, n) for i, n in enumerate(TASK_TYPE_NAMES)]
    r["event"] = [(e, 1 + e % n_res, 1 + e % n_rooms, None if e % 4 == 0 else e) for e in range(1, 16)]
    task_id = 0
    for s, n in ((2, 12), (5, 7), (6, 3)):
        for _ in range(n):
            task_id += 1
            r["task"].append((task_id, 1 + task_id % n_rooms, s, 1 + task_id % 4))
    r["staff_event"] = [(5, e) for e in range(1, 11)] + [(2, e) for e in range(3, 9)] + [(4, 15)]
    if orphans:
        r["task"].append((task_id + 1, 1, 42, 1))         # unknown staff member
        r["staff_event"].append((43, 1))
    return r


def spark_tables(spark: SparkSession, rows: dict[str, list[tuple]]) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame(rs, schema(name)) for name, rs in rows.items()}


_DUCK_TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}


def duck_tables(rows: dict[str, list[tuple]]) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name, cols in TABLES.items():
        ddl = ", ".join(f'"{c.name}" {_DUCK_TYPES[c.dtype.simpleString()]}' for c in cols)
        con.execute(f'CREATE TABLE "{name}" ({ddl})')
        if rows.get(name):
            marks = ", ".join("?" for _ in cols)
            con.executemany(f'INSERT INTO "{name}" VALUES ({marks})', rows[name])
    return con
