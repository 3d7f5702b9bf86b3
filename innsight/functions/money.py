"""Money arithmetic and money text.

Sums: costs are doubles at rest but hold whole cents.  Inside aggregations a
cost becomes an integer count of cents (``rint(cost * 100)``, exact for
whole-cent values), so sums are exact long additions, independent of row
order across partitions, and stay in generated code (no per-row decimal
objects).  A total becomes money again once, as ``cents / 100.0``; this is
bit-for-bit the double of the exact ``decimal(18, 2)`` total.  Means are that
double over the row count.  Long overflow raises an error under ANSI mode
rather than wrapping.

Text: the report shows ``"%.2f"`` as Python prints it, i.e. the exact binary
value of the double rounded half-to-even.  Spark's ``format_string`` rounds the
shortest decimal form half-up instead (``508.125`` -> ``508.13``,
``2.675`` -> ``2.68``), so :func:`fixed2` does the rounding itself in exact
integer arithmetic: ``|x| = m / 2**k`` with integer ``m``, then
``round_half_even(100 * m / 2**k)`` from the quotient and remainder.  All of it
is built-in expressions (no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = float(2**52)
_TWO_M8 = 2.0**-8  # below this |x| < 0.005 and prints as 0.00


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(c: Column | str) -> Column:
    """Whole cents of a money value as a long."""
    return F.rint(_c(c).cast("double") * 100.0).cast("long")


def money_sum(c: Column | str) -> Column:
    """Exact ``SUM`` of a money column, in cents (long)."""
    return F.sum(cents(c))


def to_money(cents_col: Column | str) -> Column:
    """Cents back to a money double."""
    return _c(cents_col).cast("double") / F.lit(100.0)


def mean(total_cents: Column, count: Column) -> Column:
    """``AVG`` as money total over the row count (NULL when no rows)."""
    return to_money(total_cents) / F.nullif(count, F.lit(0)).cast("double")


def _cents_half_even(a: Column) -> Column:
    """``round_half_even(100 * a)`` as a long, for finite ``0 <= a < 2**52``.

    ``k`` is chosen so that ``m = a * 2**k`` is an integer below ``2**55``;
    ``floor(log2(a))`` may be off by one without harm.
    """
    k = (F.lit(53) - F.floor(F.log2(a))).cast("int")
    m = (a * F.pow(F.lit(2.0), k)).cast("long")  # exact: scaling by 2**k
    num = m.cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
    den = F.pow(F.lit(2.0), k).cast("long").cast("decimal(20,0)")  # exact for k <= 62
    rem = num % den
    quo = ((num - rem) / den).cast("long")
    twice = rem * F.lit(2).cast("decimal(1,0)")
    up = (twice > den) | ((twice == den) & (quo % 2 == 1))
    return quo + F.when(up, F.lit(1)).otherwise(F.lit(0))


def fixed2(c: Column | str) -> Column:
    """``"%.2f" % x`` exactly as Python prints it (NULL stays NULL)."""
    x = _c(c).cast("double")
    a = F.abs(x)
    cents = (
        F.when(a < F.lit(_TWO_M8), F.lit(0).cast("long"))
        .when(a < F.lit(_TWO_52), _cents_half_even(a))
    )
    text = (cents.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)").cast("string")
    # Beyond 2**52 every double is an integer: plain formatting is exact.
    big = F.format_string("%.2f", a)
    body = F.when(a < F.lit(_TWO_52), text).otherwise(big)
    # x < 0, or x is -0.0 (its text form keeps the sign): Python prints "-0.00"
    negative = F.when(x == 0, x.cast("string").startswith("-")).otherwise(x < 0)
    sign = F.when(negative, F.lit("-")).otherwise(F.lit(""))
    return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(F.concat(sign, body))


def _or_zero(x: Column) -> Column:
    """``x or 0``: NULL and both zeros are 0."""
    return F.when(x.isNull() | (x == 0), F.lit(0.0)).otherwise(x)


def money_text(c: Column | str) -> Column:
    """``"$%.2f" % (x or 0)``."""
    x = _c(c).cast("double")
    return F.concat(F.lit("$"), fixed2(_or_zero(x)))


def ratio_text(c: Column | str) -> Column:
    """``"%.2f" % (x or 0)``."""
    return fixed2(_or_zero(_c(c).cast("double")))
