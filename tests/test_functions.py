"""Scalar helpers: money text, LIKE patterns, names, month parts."""

from __future__ import annotations

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from innsight.functions.money import fixed2, money_text, ratio_text
from innsight.functions.text import dash_if_blank, full_name, like_pattern, name_matches
from innsight.functions.timeparts import month_text, parse_datetime, year_month_text, year_text

TRICKY = [0.0, 0.125, 2.675, 508.125, 58.125, 1234.565, 0.005, 0.015, 0.0049, -0.001, -2.675, 1.005, 99.995,
          123456789012.345, 0.375, 7.0 / 3, 1e-10, 3.3000000000000003, 2.0**-8, 4503599627370497.0, 1e17]


def _fmt(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    got = {r.i: r.t for r in df.select("i", fn("v").alias("t")).collect()}
    return [got[i] for i in range(len(values))]


def test_fixed2_matches_python_on_ties(spark):
    assert _fmt(spark, TRICKY, fixed2) == ["%.2f" % v for v in TRICKY]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(
    st.floats(min_value=-1e9, max_value=1e9, allow_nan=False, allow_infinity=False),
    st.builds(lambda c, n: c / 100 / n, st.integers(0, 10**10), st.integers(1, 500)),
    st.builds(lambda m: m / 1000, st.integers(-10**9, 10**9)),
), min_size=1, max_size=200))
def test_fixed2_matches_python_random(spark, values):
    assert _fmt(spark, values, fixed2) == ["%.2f" % v for v in values]


def test_money_and_ratio_text(spark):
    df = spark.createDataFrame([(508.125,), (None,), (0.0,), (2.6666666666666665,)], "v double")
    got = [(r.m, r.r) for r in df.select(money_text("v").alias("m"), ratio_text("v").alias("r")).collect()]
    assert got == [("$508.12", "508.12"), ("$0.00", "0.00"), ("$0.00", "0.00"), ("$2.67", "2.67")]


def test_like_pattern_escapes_backslash_only():
    assert like_pattern("a%b_c\\") == "%a%b_c\\\\%"


def _matches(spark, names, term):
    df = spark.createDataFrame(names, "first string, last string")
    return [tuple(r) for r in df.where(name_matches("first", "last", term)).collect()]


def test_name_match_rules(spark):
    names = [("Alex", "Hart"), ("morgane", "HART"), ("Émile", "Müller"), ("Jo_ey", "100%"),
             ("Back", "sla\\sh"), ("Jo", None)]
    assert _matches(spark, names, "hart") == [("Alex", "Hart"), ("morgane", "HART")]
    assert _matches(spark, names, "alex ha") == [("Alex", "Hart")]            # full name
    assert len(_matches(spark, names, "%")) == 6                               # wildcard, NULL last name too
    assert _matches(spark, names, "jo_e") == [("Jo_ey", "100%")]
    assert _matches(spark, names, "l_x") == [("Alex", "Hart")]                 # '_' is any one character
    assert _matches(spark, names, "a\\s") == [("Back", "sla\\sh")]           # backslash is literal
    assert _matches(spark, names, "\\") == [("Back", "sla\\sh")]              # even at the end
    assert _matches(spark, names, "émile") == []                               # only A-Z is folded
    assert _matches(spark, names, "ÉMILE m") == [("Émile", "Müller")]
    assert _matches(spark, names, "MÜLLER") == []
    assert _matches(spark, names, "jo ") == []                                 # full name NULL -> no match


def test_display_helpers(spark):
    df = spark.createDataFrame([("a", "b", ""), ("a", None, None), ("x", "y", "t")], "f string, l string, s string")
    got = [(r.n, r.d) for r in df.select(full_name("f", "l").alias("n"), dash_if_blank(df.s).alias("d")).collect()]
    assert got == [("a b", "—"), (None, "—"), ("x y", "t")]


def test_month_parts_and_parse(spark):
    df = spark.createDataFrame([("2025-01-16 15:00:00",), ("not a date",), ("0999-12-31 23:59:59",)], "s string")
    out = df.select(parse_datetime(df.s).alias("ts")).select(
        "ts", year_text("ts").alias("y"), month_text("ts").alias("m"), year_month_text("ts").alias("ym")).collect()
    assert out[0].ts == dt.datetime(2025, 1, 16, 15) and (out[0].y, out[0].m, out[0].ym) == ("2025", "01", "2025-01")
    assert out[1].ts is None and out[1].y is None
    assert (out[2].y, out[2].m) == ("0999", "12")


def test_shapes_of_a_time(spark):
    at = dt.datetime(2025, 1, 16, 15, 0)
    shapes = {
        "2025-01-16 15:00": at, "2025-01-16T15:00": at, "2025-01-16  15:00:00": at, "2025-01-16 15:00:00Z": at, "2025-01-16 15:00z": at,
        "2025-01-16 15:00:00.1234567": at.replace(microsecond=123456), "2025-01-16 15:00:00.5": at.replace(microsecond=500000),
        "2025-01-16 15:00:00+02:00": at - dt.timedelta(hours=2), "2025-01-16 15:00 -05:30": at + dt.timedelta(hours=5, minutes=30),
        "2025-01-16": at.replace(hour=0), "2025-02-30 10:00": None, "2025-01-16 25:00": None, "2025-01-16 15": None, "2025-01-16 15:00:00.": None,
        "2025-01-16 15:00:00+15:00": None, "2025-01-16 15:00:00 UTC": None, "2025-01-16Z": None, "": None}
    df = spark.createDataFrame([(s,) for s in shapes], "s string")
    assert {r.s: r.ts for r in df.select("s", parse_datetime(df.s).alias("ts")).collect()} == shapes


def test_time_text_keeps_the_fraction(spark):
    from innsight.functions.timeparts import datetime_text

    df = spark.createDataFrame([("2025-01-16 15:00:00.250",), ("2025-01-16 15:00:00",)], "s string")
    assert [r[0] for r in df.select(datetime_text(parse_datetime(df.s))).collect()] == ["2025-01-16 15:00:00.25", "2025-01-16 15:00:00"]


def test_time_text_is_zone_free(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        from pyspark.sql import functions as F

        from innsight.functions.timeparts import datetime_text

        df = spark.createDataFrame([("2025-03-09 02:30:00",), ("2024-12-31 23:59:59",)], "s string")
        ts = F.col("ts")
        out = df.select(parse_datetime(df.s).alias("ts")).select(
            datetime_text(ts).alias("txt"), year_month_text(ts).alias("ym")).collect()
        assert [(r.txt, r.ym) for r in out] == [("2025-03-09 02:30:00", "2025-03"), ("2024-12-31 23:59:59", "2024-12")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
