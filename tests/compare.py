"""Exact, order-insensitive comparison of result sets."""

from __future__ import annotations

import datetime as dt
import decimal


def norm(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def as_set(cols: list[str], rows) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def duck_rows(con, sql):
    res = con.execute(sql)
    return [c[0] for c in res.description], res.fetchall()


def assert_same(a, b, ordered: bool = False):
    (ca, ra), (cb, rb) = a, b
    assert sorted(ca) == sorted(cb), (ca, cb)
    if ordered:
        ia = [sorted(range(len(ca)), key=lambda i: ca[i])]
        ib = [sorted(range(len(cb)), key=lambda i: cb[i])]
        la = [tuple(norm(r[i]) for i in ia[0]) for r in ra]
        lb = [tuple(norm(r[i]) for i in ib[0]) for r in rb]
        assert la == lb
    else:
        assert as_set(ca, ra) == as_set(cb, rb)
