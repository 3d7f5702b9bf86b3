"""Sharding along a Hilbert curve.

Several metadata columns are quantised to a small grid, each row gets the
index of its cell on the Hilbert curve through that grid, and the rows in
curve order are cut into runs of equal row count.  Rows of a run lie close in
*every* dimension at once, so min/max statistics of a shard's files prune on
any of the columns.

Defined results: a NULL in a dimension is the lowest cell of that dimension; a
dimension of one value, or none, is cell 0 for all rows (NULL) or 1; equal rows lie
next to each other; an empty table gives an empty table; columns of the input
that clash with the operator's are not carried (only ``keep`` is).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.common import with_running_total

BITS = 5


def equi_depth_bounds(df: DataFrame, column: str, cells: int) -> list:
    """At most ``cells - 1`` values that cut the column's non-NULL rows into
    ``cells`` equal parts: the first value at which k/cells of the rows are reached.

    Exact, from the counts of all values; only the cut points reach the driver.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    cum = with_running_total(counts, ["v"], F.col("n"), "before", "hilbert-bounds")
    total = cum.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    cell = lambda rows: F.expr(f"({rows}) * {cells} div {total}")
    # a value ends cell k when the rows up to it pass k/cells of all rows
    cuts = (cum.withColumn("a", cell("before")).withColumn("b", cell("before + n"))
            .where("b > a and b < %d" % cells).select("v").orderBy("v"))
    return [r.v for r in cuts.collect()]


def quantised(column: str, bounds: list) -> Column:
    """0 for NULL, else 1 + the number of bounds below the value."""
    above = F.lit(1)
    for b in bounds:
        above = above + (F.col(column) > F.lit(b)).cast("int")
    return F.when(F.col(column).isNull(), 0).otherwise(above)


def curve_index(cells: list[Column], bits: int) -> Column:
    """Index of a cell on the Hilbert curve through a ``2**bits`` grid.

    John Skilling's transposition ("Programming the Hilbert curve", 2004), as
    a fold over the (bit, axis) steps; the state is the array of coordinates.
    """
    d = len(cells)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(d)])

    def undo(x: Column, s: Column) -> Column:
        mask = s.q - 1
        at = F.get(x, s.i)
        first = F.get(x, F.lit(0))
        swap = first.bitwiseXOR(at).bitwiseAND(mask)
        flipped = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(mask)).otherwise(v))
        swapped = F.transform(x, lambda v, j: F.when((j == 0) | (j == s.i), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(at.bitwiseAND(s.q) != 0, flipped).otherwise(swapped)

    x = F.aggregate(steps, F.array(*[c.cast("int") for c in cells]), undo)
    gray = F.aggregate(
        F.sequence(F.lit(1), F.lit(d - 1)), x,
        lambda a, i: F.transform(a, lambda v, j: F.when(j == i, v.bitwiseXOR(F.get(a, i - 1))).otherwise(v)),
    ) if d > 1 else x

    def turned(a: Column) -> Column:
        last = F.get(a, F.lit(d - 1))
        t = F.lit(0)
        for b in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, (1 << b) - 1).otherwise(0))
        return F.transform(a, lambda v: v.bitwiseXOR(t))

    # bits of all axes interleaved, highest first
    spread = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(d)])
    return F.aggregate(
        spread, F.struct(F.lit(0).cast("bigint").alias("h"), turned(gray).alias("x")),
        lambda a, s: F.struct(
            (a.h * 2 + F.call_function("getbit", F.get(a.x, s.i).cast("bigint"), s.b)).cast("bigint").alias("h"), a.x.alias("x")),
        lambda a: a.h)


def hilbert_shards(df: DataFrame, dims: list[str], shards: int, tie_break: list[str], keep: list[str], bits: int = BITS) -> DataFrame:
    """``keep`` + ``curve`` (index), ``shard`` and ``slot`` (place in the shard).

    Row counts of the shards differ by one at most.  ``dims`` and
    ``tie_break`` must be among ``keep``; the text itself never moves.
    """
    cells = (1 << bits) - 1
    bounds = {c: equi_depth_bounds(df, c, cells) for c in dims}
    # quantised first, so that the fold reads plain columns
    grid = df.select(*keep, *[quantised(c, bounds[c]).alias(f"__cell{i}") for i, c in enumerate(dims)])
    placed = grid.withColumn("curve", curve_index([F.col(f"__cell{i}") for i in range(len(dims))], bits)).select(*keep, "curve")
    order = ["curve", *tie_break]
    ranked = with_running_total(placed, order, F.lit(1).cast("bigint"), "__rank", "hilbert-order")
    total = df.count()
    shard = F.expr(f"__rank * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (ranked.withColumn("shard", shard.cast("int"))
            .withColumn("slot", (F.col("__rank") - first).cast("bigint")).drop("__rank"))
