"""Document fingerprints: invertible Bloom lookup sketches of digests of a text's parts.

A text is the set of the 64-bit digests of its parts, cut where the text itself
says so, so that texts of one line have parts to compare and equal parts are
cut alike.  The query's parts (``part_digests``) end with their line, after each
word whose hash falls in one of ``RESIDUES`` residues, and after ``MOST`` words
(words that repeat may hold no such hash).  A word is what stands between
spaces; of scripts without spaces and of runs of over ``RUN`` characters each
character counts as a word.  Paragraphs (``digests``) are coarser: a line, or
within a line what ends with a sentence whose last letter is a to e.  A sketch has two tables of cells; each digest goes to one cell of
each, which keeps a count, the xor of its digests and the xor of their checks
(Goodrich and Mitzenmacher 2011; Eppstein et al., "What's the Difference?",
2011).  The cells of two versions are subtracted; a cell that holds one digest
gives it up, is peeled from its other cells, and so on.  What is
recovered are the parts of only one version, and with them the likeness
(shared digests / all digests).

The fingerprints' own cells first tell how many digests differ: the squares of
the subtracted counts add up to that number on average (less what the known difference
of the two sizes adds).  A few are peeled from the fingerprints themselves; for more, both
versions are sketched again, first in one table of so many cells (only those in use are kept) that
hardly two of the digests that differ meet: each cell left by the subtraction then gives up its digest.  Should any
not, two tables with ``ROOM`` cells for each digest that seems to differ are peeled,
and should cells be left over, with twice as many and another seed, until none is.

All of it is Spark expressions over one row; cells are kept sparse and sorted.

Defined results: NULL is the empty text; texts without a part are alike
(1.0) to each other and not at all (0.0) to others; blank lines are no
parts, repeated ones count once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm.common import partitions, stage, with_running_total

#: Cells of a fingerprint, in two tables.
CELLS = 48
#: Rounds of peeling; each gives up all single cells at once.
ROUNDS = 24
#: Cells for each differing digest: nearly all digests then are single in some cell.
ROOM = 128
#: Cells of the one table for each pair of differing digests: some 1 % of such sketches hold two digests in a cell.
PAIR = 64
#: Sketches are made again with twice the cells so many times at most: beyond any text's digests.
RETRIES = 30
_BREAK = "\\n|(?<=[a-e][.!?])[ ]"  # a Java pattern
#: A part ends after a word whose hash is 0 modulo this power of two, or after so many words.
RESIDUES, MOST = 8, 16
#: Of longer runs without a space, each character is a word.
RUN = 32
# Java patterns.  Fixed values: Thai to Myanmar, Khmer, Han, kana and Yi.
_UNSPACED = r"[\u0E00-\u109F\u1780-\u17FF\u2E80-\uA4CF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text, ascending."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), _BREAK), lambda p: F.trim(p) != "")
    return F.sort_array(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p))))


def _words(line: Column) -> Column:
    """Hashes of a line's words.  Characters that count as words have hashes of their own, the space after them too."""
    other = lambda x: (F.octet_length(x) != F.length(x)) & x.rlike(_UNSPACED)

    def fine(w: Column) -> Column:
        each = F.transform(F.split(F.concat(w, F.lit(" ")), ""), lambda c: F.xxhash64(c, F.lit(1)))
        return F.when((F.length(w) > RUN) | other(w), each).otherwise(F.array(F.xxhash64(w)))

    def hashed(words: Column) -> Column:
        plain = ~F.exists(words, lambda w: F.length(w) > RUN) & ~other(line)
        return F.when(plain, F.transform(words, lambda w: F.xxhash64(w))).otherwise(F.flatten(F.transform(words, fine)))

    return _let(F.split(line, " "), hashed)


def part_digests(text: Column) -> Column:
    """The distinct digests of a text's content-defined parts, ascending."""
    def parts(h: Column) -> Column:
        def cut(first: Column, end: Column) -> Column:
            return F.transform(F.sequence(first, end - 1, F.lit(MOST)), lambda a: F.xxhash64(F.slice(h, a + 1, F.least(F.lit(MOST), end - a))))

        starts = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i - 1).bitwiseAND(F.lit(RESIDUES - 1).cast("bigint")) == 0))
        return _let(starts, lambda at: F.flatten(F.transform(at, lambda a, j: _let(F.coalesce(F.get(at, j + 1), F.size(h)), lambda end: cut(a, end)))))

    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.trim(p) != "")
    return F.sort_array(F.array_distinct(F.flatten(F.transform(lines, lambda x: _let(_words(x), parts)))))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(3))


def _entries(keys: Column, count: int, cells: Column, seed: Column) -> Column:
    """The digests' entries, one in each of the two tables."""
    def placed(half: Column) -> Column:
        def of(key: Column) -> Column:
            entry = lambda x, j: F.struct((F.pmod(F.shiftrightunsigned(x.h, 32 * j), half).cast("int") + half * j).alias("cell"),
                                          F.lit(count).alias("count"), key.alias("key"), x.check.alias("check"))
            return _let(F.struct(F.xxhash64(key, seed).alias("h"), _check(key).alias("check")), lambda x: F.array(entry(x, 0), entry(x, 1)))

        return F.flatten(F.transform(keys, of))

    return _let(F.floor(cells / 2).cast("int"), placed)


_ENTRY = "struct<cell:int,count:int,key:bigint,check:bigint>"


def _added(entries: Column) -> Column:
    """Entries of one cell added up; cells of nothing are gone.  Linear after the sort."""
    zero = F.struct(F.lit(0).alias("count"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("check"))

    def add(s: Column, e: Column) -> Column:
        return F.struct((s["count"] + e["count"]).alias("count"), s.key.bitwiseXOR(e.key).alias("key"), s.check.bitwiseXOR(e.check).alias("check"))

    def runs(e: Column) -> Column:
        starts = _let(e.cell, lambda c: F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (F.get(c, i - 1) != F.get(c, i))))

        def total(a: Column, n: Column) -> Column:
            of = lambda s: F.struct(F.get(e, a).cell.alias("cell"), s["count"].alias("count"), s.key.alias("key"), s.check.alias("check"))
            return F.when(n == 1, F.get(e, a)).otherwise(F.aggregate(F.slice(e, a + 1, n), zero, add, of))

        return _let(starts, lambda at: F.transform(at, lambda a, j: _let(F.coalesce(F.get(at, j + 1), F.size(e)) - a, lambda n: total(a, n))))

    def used(c: Column) -> Column:
        return (c["count"] != 0) | (c.key != 0) | (c.check != 0)

    empty = F.array().cast(f"array<{_ENTRY}>")
    return _let(F.sort_array(entries), lambda e: F.when(F.size(e) == 0, empty).otherwise(F.filter(runs(e), used)))


def sketch(keys: Column, cells: Column, seed: Column) -> Column:
    """Cells (sorted, without empty ones) of a set of digests."""
    return _added(_entries(keys, 1, cells, seed))


def subtracted(a: Column, b: Column) -> Column:
    minus = F.transform(b, lambda e: F.struct(e.cell.alias("cell"), (-e["count"]).alias("count"), e.key.alias("key"), e.check.alias("check")))
    return _added(F.concat(a, minus))


def _sum(keys: Column, start: Column) -> Column:
    """``start``, a struct (key, check), xor all digests and their checks."""
    return F.aggregate(keys, start, lambda s, k: F.struct(s.key.bitwiseXOR(k).alias("key"), s.check.bitwiseXOR(_check(k)).alias("check")))


def peeled(cells: Column, size: Column, seed: Column) -> Column:
    """struct(plus, minus: digests of only the first and only the second version; left: number of cells that could not be peeled)."""
    none = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("bigint")
    # the first table holds every digest once: once its sum is spent, nothing is left
    whole = F.aggregate(F.filter(cells, lambda c: c.cell < F.floor(size / 2)), F.struct(zero.alias("key"), zero.alias("check")),
                        lambda s, c: F.struct(s.key.bitwiseXOR(c.key).alias("key"), s.check.bitwiseXOR(c.check).alias("check")))

    def single(s: Column) -> Column:
        def signed(pure: Column) -> Column:
            of = lambda n: F.array_distinct(F.transform(F.filter(pure, lambda c: c["count"] == n), lambda c: c.key))
            return F.struct(of(1).alias("plus"), of(-1).alias("minus"))

        return _let(F.filter(s.cells, lambda c: (F.abs(c["count"]) == 1) & (c.check == _check(c.key))), signed)

    def peel(s: Column, _: Column) -> Column:
        def less(new: Column) -> Column:
            def rest(unspent: Column) -> Column:
                cells = F.when((unspent.key == 0) & (unspent.check == 0), F.array().cast(f"array<{_ENTRY}>")).otherwise(
                    _added(F.concat(s.cells, _entries(new.plus, -1, size, seed), _entries(new.minus, 1, size, seed))))
                return F.struct(cells.alias("cells"), F.concat(s.plus, new.plus).alias("plus"), F.concat(s.minus, new.minus).alias("minus"),
                                unspent.alias("unspent"), (F.size(new.plus) + F.size(new.minus) > 0).alias("going"))

            return _let(_sum(new.minus, _sum(new.plus, s.unspent)), rest)

        # a round without a single cell is the last one
        return F.when(s.going & (F.size(s.cells) > 0), _let(single(s), less)).otherwise(s)

    begin = F.struct(cells.alias("cells"), none.alias("plus"), none.alias("minus"), whole.alias("unspent"), F.lit(True).alias("going"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, peel,
                       lambda s: F.struct(s.plus.alias("plus"), s.minus.alias("minus"), F.size(s.cells).alias("left")))


def single(a: Column, b: Column, size: Column, seed: Column) -> Column:
    """struct(plus, minus) of the digests of only one version from one table of ``size`` cells; NULL where a cell holds several."""
    def entries(keys: Column, count: int) -> Column:
        return F.transform(keys, lambda key: F.struct(F.pmod(F.xxhash64(key, seed), size).cast("int").alias("cell"), F.lit(count).alias("count"),
                                                      key.alias("key"), _check(key).alias("check")))

    def read(cells: Column) -> Column:
        of = lambda n: F.transform(F.filter(cells, lambda c: c["count"] == n), lambda c: c.key)
        return F.when(F.forall(cells, lambda c: (F.abs(c["count"]) == 1) & (c.check == _check(c.key))), F.struct(of(1).alias("plus"), of(-1).alias("minus")))

    return _let(_added(F.concat(entries(a, 1), entries(b, -1))), read)


def differing(cells: Column, more: Column) -> Column:
    """About how many digests differ, from subtracted cells of a fingerprint and the difference of the two numbers of digests."""
    squares = F.aggregate(cells, F.lit(0).cast("bigint"), lambda s, c: s + c["count"].cast("bigint") * c["count"])
    # two tables, in each of which a known excess adds its square over the table's cells
    return F.ceil(F.greatest((squares - 4.0 * more * more / CELLS) / 2, F.abs(more).cast("double"))).cast("int")


def difference(a: Column, b: Column, a_cells: Column, b_cells: Column) -> Column:
    """The digests of only one of the versions ``a`` and ``b``: struct(plus, minus)."""
    both = F.size(a) + F.size(b)
    found = "struct<plus:array<bigint>,minus:array<bigint>>"

    def whole(p: Column) -> Column:
        return F.when(p.left == 0, F.struct(p.plus.alias("plus"), p.minus.alias("minus")))

    def again(cells: Column) -> Column:
        some = F.least(differing(cells, F.size(a) - F.size(b)), both).cast("double")
        pairs = _let(F.least(some * some * (PAIR / 2) + CELLS, F.lit(float(1 << 30))).cast("int"), lambda size: single(a, b, size, F.lit(99)))

        def attempt(done: Column, k: Column) -> Column:
            def made(size: Column) -> Column:
                # the two sketches, the second one's counts negative: added up, they are subtracted
                return _let(_added(F.concat(_entries(a, 1, size, k + 100), _entries(b, -1, size, k + 100))), lambda c: _let(peeled(c, size, k + 100), whole))

            size = (some * float(ROOM) + CELLS) * F.pow(F.lit(2.0), k)
            return F.when(done.isNotNull(), done).otherwise(_let(F.least(size, F.lit(float(1 << 30))).cast("int"), made))

        return F.coalesce(pairs, F.aggregate(F.sequence(F.lit(0), F.lit(RETRIES)), F.lit(None).cast(found), attempt))

    def first(cells: Column) -> Column:
        few = _let(peeled(cells, F.lit(CELLS), F.lit(0)), whole)
        return F.coalesce(F.when(differing(cells, F.size(a) - F.size(b)) <= CELLS // 4, few), again(cells))

    return F.coalesce(_let(subtracted(a_cells, b_cells), first), F.raise_error(F.lit("sketches could not be peeled")).cast(found))


def likeness(a: Column, b: Column, difference: Column) -> Column:
    """Shared digests / all digests, from the numbers of each and of the recovered ones."""
    total = F.size(a) + F.size(b)
    return _let(F.size(difference.plus) + F.size(difference.minus), lambda n: F.when(total == 0, F.lit(1.0)).otherwise((total - n) / (total + n)))


def as_text(keys: Column, cells: Column) -> Column:
    """A fingerprint as text: number of digests, then cell:count:xor:check of each cell in use."""
    each = F.transform(cells, lambda c: F.concat_ws(":", c.cell.cast("string"), c["count"].cast("string"), F.hex(c.key), F.hex(c.check)))
    return F.concat(F.size(keys).cast("string"), F.lit("/"), F.array_join(each, ","))


_LOWEST = -(1 << 63)


def with_next(docs: DataFrame, parts: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, text, own, own_cells, next_text, after, after_cells): digests and cells of the text and of
    the next document's in ascending doc_id, after the last that of the first.

    Exact cut points of (doc_id, hash of the text) deal the documents into runs; texts move once, and are sketched
    where they arrive.  A run's last document gets the first one of the next run, of which there
    are as many as runs.  NULL counts as the lowest doc_id; rows of one doc_id are ordered by a hash of their text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("*", F.coalesce("doc_id", F.lit(_LOWEST)).alias("__d"), F.xxhash64("text").alias("__h"))
    ids = docs.groupBy("__d", "__h").agg(F.count("*").alias("n"))
    cum = with_running_total(ids, ["__d", "__h"], F.col("n"), "before", "ids")
    total = cum.agg(F.sum("n")).first()[0] or 0
    runs = 4 * partitions(spark)
    cut = F.expr(f"before * {runs} div {max(total, 1)}")
    last = F.expr(f"(before + n) * {runs} div {max(total, 1)}")
    # a run starts at the first key of its share: at most ``runs`` of them, and the first of all
    bounds = cum.where((last > cut) | (F.col("before") == 0)).select("__d", "__h").orderBy("__d", "__h").collect() or [(0, 0)]
    ds, hs = F.lit([r[0] for r in bounds]), F.lit([r[1] for r in bounds])
    d, h = F.col("__d"), F.col("__h")
    run = F.lit(0)
    # binary search among the bounds
    def further(low: Column, step: int) -> Column:
        at = low + (step - 1)
        under = (F.get(ds, at) < d) | ((F.get(ds, at) == d) & (F.get(hs, at) <= h))
        return low + F.when((at < len(bounds)) & under, step).otherwise(0)

    for k in range(len(bounds).bit_length() - 1, -1, -1):
        run = _let(run, lambda low: further(low, 1 << k))  # noqa: B023
    placed = docs.withColumn("__run", run)
    order = ["__d", "__h", "text"]

    def sketched(rows: DataFrame) -> DataFrame:
        return rows.withColumn("own", parts(F.col("text"))).withColumn("own_cells", sketch(F.col("own"), F.lit(CELLS), F.lit(0)))

    inside = Window.partitionBy("__run").orderBy(*order)
    what = {"next_text": "text", "after": "own", "after_cells": "own_cells"}
    led = sketched(placed.repartition("__run")).select("*", *[F.lead(c).over(inside).alias(n) for n, c in what.items()])
    starts = placed.where((F.get(ds, F.col("__run") - 1) == d) & (F.get(hs, F.col("__run") - 1) == h))
    heads = sketched(stage(starts.groupBy("__run").agg(F.min("text").alias("text")), "firsts"))
    heads = heads.select(F.when(F.col("__run") == 1, len(bounds)).otherwise(F.col("__run") - 1).alias("__run"), *[F.col(c).alias(f"__{n}") for n, c in what.items()])
    rows = led.join(heads, "__run", "left")
    return rows.select("doc_id", "text", "own", "own_cells", *[F.coalesce(n, f"__{n}").alias(n) for n in what])


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last quarter of code points replaced by as many first ones of ``other``."""
    part = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - part), F.substring(other, F.lit(1), part))


def fingerprints(docs: DataFrame, parts: Callable[[Column], Column] = digests) -> DataFrame:
    """doc_id, text, next_text, edited_text, fingerprint, edited_fingerprint, near_edited, near_next; ``parts`` gives a text's digests."""
    rows = with_next(docs, parts).withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("other", parts(F.col("edited_text"))).withColumn("other_cells", sketch(F.col("other"), F.lit(CELLS), F.lit(0)))
    col = F.col
    rows = rows.withColumn("to_edited", difference(col("own"), col("other"), col("own_cells"), col("other_cells")))
    rows = rows.withColumn("to_next", difference(col("own"), col("after"), col("own_cells"), col("after_cells")))
    return rows.select("doc_id", "text", "next_text", "edited_text", as_text(col("own"), col("own_cells")).alias("fingerprint"),
                       as_text(col("other"), col("other_cells")).alias("edited_fingerprint"),
                       likeness(col("own"), col("other"), col("to_edited")).alias("near_edited"),
                       likeness(col("own"), col("after"), col("to_next")).alias("near_next"))
