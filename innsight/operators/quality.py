"""Declared constraints as data-quality jobs.

The reference declares NOT NULL, primary keys and foreign keys but never has
them enforced on reads; here each becomes a batch check that returns the
offending rows, plus a per-table summary built on top of it.  Each check is one
pass (NOT NULL) or one aggregation on the keys of all tables together (keys, references);
nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from innsight.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, not_null_columns


def _union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def null_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a NULL in any of ``cols`` (B1)."""
    if not cols:
        return df.where(F.lit(False))
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]))


def null_counts(df: DataFrame, table: str, cols: list[str] | None = None) -> DataFrame:
    """``table_name, column_name, null_rows`` for each NOT NULL column of
    ``table``: one scan, one counter per column."""
    cols = cols if cols is not None else [c for c in not_null_columns(table) if c in df.columns]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return (
        counts.unpivot([], cols, "column_name", "null_rows")
        .select(F.lit(table).alias("table_name"), "column_name", F.col("null_rows").cast("long"))
    )


def duplicate_keys(df: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """Key values held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def key_summary(df: DataFrame, table: str, keys: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """``table_name, key_columns, num_rows, num_keys, duplicate_keys,
    duplicate_rows`` from one aggregation on the key."""
    keys = list(keys or PRIMARY_KEYS[table])
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return per_key.agg(
        F.sum("rows").alias("num_rows"),
        F.count(F.lit(1)).alias("num_keys"),
        F.count_if(F.col("rows") > 1).alias("duplicate_keys"),
        F.sum(F.when(F.col("rows") > 1, F.col("rows")).otherwise(0)).alias("duplicate_rows"),
    ).select(
        F.lit(table).alias("table_name"),
        F.lit(",".join(keys)).alias("key_columns"),
        F.coalesce(F.col("num_rows"), F.lit(0)).cast("long").alias("num_rows"),
        F.col("num_keys").cast("long").alias("num_keys"),
        F.col("duplicate_keys").cast("long").alias("duplicate_keys"),
        F.coalesce(F.col("duplicate_rows"), F.lit(0)).cast("long").alias("duplicate_rows"),
    )


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-NULL ``fk`` has no parent row (B4).  A NULL
    reference is not an orphan."""
    keys = parent.select(F.col(pk).alias("__pk"))
    return child.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("__pk"), "left_anti")


def orphan_count(child: DataFrame, fk: str, parent: DataFrame, pk: str,
                 names: tuple[str, str, str, str]) -> DataFrame:
    """One-row summary of :func:`orphans`.  Rows are counted per reference
    value first (map-side partial counts collapse a value held by many rows),
    so the anti join sees each distinct value once."""
    c, f, p, k = names
    per_value = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n"))
    return orphans(per_value, fk, parent, pk).agg(F.sum("n").alias("orphan_rows")).select(
        F.lit(c).alias("child_table"), F.lit(f).alias("fk_column"),
        F.lit(p).alias("parent_table"), F.lit(k).alias("pk_column"),
        F.coalesce(F.col("orphan_rows"), F.lit(0)).cast("long").alias("orphan_rows"),
    )


def null_report(t: dict[str, DataFrame]) -> DataFrame:
    """B1 over every given table with declared NOT NULL columns."""
    return _union_all([null_counts(df, name) for name, df in t.items() if name in PRIMARY_KEYS])


def key_report(t: dict[str, DataFrame], composite: bool | None = None) -> DataFrame:
    """B2 (single-column keys), B3 (``composite=True``) or both (``None``):
    one :func:`key_summary` row per table.

    All tables' keys are tagged with their table and counted in a single
    aggregation (one job and one shuffle for every table together, map-side
    partial counts first).  One zero-count padding row per table keeps an
    empty table in the report without any join.
    """
    items = [(name, PRIMARY_KEYS[name]) for name in t if name in PRIMARY_KEYS
             and (composite is None or (len(PRIMARY_KEYS[name]) > 1) == composite)]
    if not items:
        raise ValueError("no table here has such a key")
    width = max(len(keys) for _, keys in items)
    kcols = [f"k{i}" for i in range(width)]
    text = any(t[name].schema[k].dataType == StringType() for name, keys in items for k in keys)
    tagged = _union_all([
        t[name].select(
            F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
            *[(F.col(keys[i]) if i < len(keys) else F.lit(None)).cast("string" if text else "long").alias(kcols[i])
              for i in range(width)],
        )
        for name, keys in items
    ])
    per_key = (
        tagged.groupBy("table_name", "key_columns", *kcols)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("table_name", "key_columns", "rows", F.lit(1).alias("is_key"))
    )
    spark = next(iter(t.values())).sparkSession
    padding = spark.createDataFrame(
        [(name, ",".join(keys), 0, 0) for name, keys in items],
        "table_name string, key_columns string, rows long, is_key int",
    )
    dup = F.col("rows") > 1
    return (
        per_key.unionByName(padding)
        .groupBy("table_name", "key_columns")
        .agg(
            F.sum("rows").cast("long").alias("num_rows"),
            F.sum("is_key").cast("long").alias("num_keys"),
            F.count_if(dup).cast("long").alias("duplicate_keys"),
            F.sum(F.when(dup, F.col("rows")).otherwise(0)).cast("long").alias("duplicate_rows"),
        )
    )


def orphan_report(t: dict[str, DataFrame]) -> DataFrame:
    """B4 over every declared foreign key whose two tables are given.

    Each table is read once: a row gives its own key, if others refer to it,
    and its references, each tagged with the key it refers to (the domain) and the
    edge's place among the references to that key.  One aggregation on
    (domain, value), counted map-side first, says of each value whether its
    parent is there and how many rows of each edge refer to it.
    """
    edges = [e for e in FOREIGN_KEYS if e[0] in t and e[2] in t]
    if not edges:
        raise ValueError("no foreign key has both its tables here")
    domains = {d: i for i, d in enumerate(dict.fromkeys((p, k) for _, _, p, k in edges))}
    place: dict[tuple, int] = {}
    for e in edges:
        place[e] = sum(1 for other in place if other[2:] == e[2:])
    width = 1 + max(place.values())
    text = any(t[c].schema[f].dataType == StringType() or t[p].schema[k].dataType == StringType() for c, f, p, k in edges)
    kind = "string" if text else "long"

    def tagged(column: str, domain: tuple[str, str], slot: int | None) -> F.Column:
        return F.struct(F.lit(domains[domain]).alias("domain"), F.col(column).cast(kind).alias("value"), F.lit(slot).cast("int").alias("slot"))

    reads = []
    for name in dict.fromkeys(x for c, _, p, _ in edges for x in (c, p)):
        given = [tagged(k, (p, k), None) for p, k in domains if p == name]
        given += [tagged(e[1], e[2:], place[e]) for e in edges if e[0] == name]
        reads.append(t[name].select(F.explode(F.array(*given)).alias("x")).select("x.*"))
    per_value = (
        _union_all(reads).where(F.col("value").isNotNull())
        .groupBy("domain", "value")
        .agg(F.max(F.col("slot").isNull()).alias("there"), *[F.count_if(F.col("slot") == i).alias(f"n{i}") for i in range(width)])
    )
    lost = per_value.where(~F.col("there")).groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(width)])
    spark = next(iter(t.values())).sparkSession
    names = spark.createDataFrame([(*e, domains[e[2:]], place[e]) for e in edges],
                                  "child_table string, fk_column string, parent_table string, pk_column string, domain int, slot int")
    count = F.get(F.array(*[F.col(f"n{i}") for i in range(width)]), F.col("slot"))
    return names.join(lost, "domain", "left").select(
        "child_table", "fk_column", "parent_table", "pk_column", F.coalesce(count, F.lit(0)).cast("long").alias("orphan_rows"))
