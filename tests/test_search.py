"""Search dispatch (M2) and search semantics against brute force."""

from __future__ import annotations

import re

from innsight.operators import search


def _like(term: str):
    """A LIKE '%term%' pattern as a regex: % any run, _ any one character,
    everything else literal; A-Z folded, nothing else."""
    body = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in term)
    return re.compile(".*" + body + ".*", re.IGNORECASE | re.ASCII | re.DOTALL)


def test_blank_term_or_unknown_kind_gives_no_rows(t):
    for kind, q in (("guest", ""), ("guest", "   "), ("hotel", "\t"), ("staff", ""), ("nope", "hart")):
        df = search.search(t, kind, q)
        assert df.collect() == []
    assert search.search(t, "nope", "x").columns == search.search_guest(t, "x").columns


def test_term_is_trimmed_and_kind_dispatched(t):
    from innsight.operators.operations import search_staff

    a = search.search(t, "staff", "  sofia ").collect()
    b = search_staff(t, "sofia").collect()
    assert a == b and len(a) == 1
    assert search.search(t, q=" hart ").collect() == search.search_guest(t, "hart").collect()


def test_guest_search_brute_force(t, rows):
    for term in ("hart", "%", "_i", "\\", "müller", "zzz"):
        rx = _like(term)
        parties = {p[0]: p for p in rows["party"]
                   if rx.fullmatch(p[1]) or rx.fullmatch(p[2]) or rx.fullmatch(f"{p[1]} {p[2]}")}
        expected = {}
        for r in rows["reservation"]:
            if r[1] not in parties:
                continue
            stays = [s for s in rows["stay"] if s[1] == r[0]]
            charges = [c for c in rows["charge"] if c[1] == r[0]]
            total = None
            if charges:
                total = sum(round(c[4] * 100) for c in charges) * max(1, len(stays)) / 100.0
            p = parties[r[1]]
            expected[r[0]] = (f"{p[1]} {p[2]}", p[4], min((s[3] for s in stays), default=None),
                              max((s[4] for s in stays), default=None), total)
        got = {x.reservationId: (x.customer_name, x.email, x.check_in, x.check_out, x.total_revenue)
               for x in search.search_guest(t, term).collect()}
        assert got == expected, term


def test_guest_search_order_newest_first_no_stay_last(t):
    out = search.search_guest(t, "%").collect()
    ins = [r.check_in for r in out]
    with_stay = [x for x in ins if x is not None]
    assert with_stay == sorted(with_stay, reverse=True)
    assert ins[len(with_stay):] == [None] * (len(ins) - len(with_stay))


def test_hotel_search_merges_namesakes(t):
    out = search.search_hotel(t, "harbor").collect()
    assert {r.hotel_name for r in out} == {"Harbor Light"}
    months = [r.year_month for r in out]
    assert len(months) == len(set(months))  # hotels 1 and 4 share one row per month
