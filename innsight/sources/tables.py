"""Scan, ingest and sink for the declared tables (A2-A5).

Tables live as one Parquet folder per table under a root directory, in it one
folder per load; the load ledger (:mod:`innsight.sources.ledger`) says which
loads count.  Reads always pass the declared schema, so column pruning and
filter pushdown reach the Parquet scan and nothing is inferred.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.functions.timeparts import parse_datetime
from innsight.sources import ledger
from innsight.sources.schemas import TABLES, schema


def load(spark: SparkSession, root: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """Lazy full-table scans, one ``DataFrame`` per table (A2): the committed loads, and
    Parquet files that lie at the table's root."""
    names = tables or list(TABLES)

    def scan(t: str) -> DataFrame:
        declared = schema(t)
        paths = ledger.committed_paths(spark, root, t)
        if not paths:  # a ledger without a load
            return spark.createDataFrame([], declared)
        # a load's folder name is not a column of the table
        return spark.read.schema(declared).parquet(*paths).select(*declared.fieldNames())

    return {t: scan(t) for t in names}


def _conform(df: DataFrame, table: str, as_text: Collection[str] = ()) -> list[Column]:
    """Select the declared columns by name, in declared order, cast to the
    declared type; fill an absent column with its declared default (or a typed
    NULL).  An explicit NULL that is present stays NULL (B1 reports it)."""
    fields = {f.name.lower(): f for f in df.schema.fields}
    out = []
    for c in TABLES[table]:
        f = fields.get(c.name.lower())
        if f is not None and c.name in as_text:
            out.append(F.col(f.name).cast("string").alias(c.name))
        elif f is not None and f.name == c.name and f.dataType == c.dtype:
            out.append(F.col(f.name))
        elif f is not None:
            out.append(F.col(f.name).cast(c.dtype).alias(c.name))
        else:
            out.append(F.lit(c.default).cast(c.dtype).alias(c.name))
    return out


def apply_defaults(df: DataFrame, table: str, as_text: Collection[str] = ()) -> DataFrame:
    """Give ``df`` the declared shape of ``table`` (A4); columns named in
    ``as_text`` that are there become text instead of their declared type."""
    have = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(c.name, c.dtype) for c in TABLES[table]]
    if have == want:
        return df
    return df.select(*_conform(df, table, as_text))


def text_schema(table: str, columns: list[str] | None = None):
    """Declared columns (or the given subset, in file order) as text: how raw
    CSV is read, with no inference.  CSV columns bind by position."""
    from pyspark.sql.types import StringType, StructField, StructType

    names = columns or [c.name for c in TABLES[table]]
    return StructType([StructField(n, StringType(), True) for n in names])


def from_text(raw: DataFrame, table: str) -> DataFrame:
    """Cast text columns of ``raw`` to the declared types of ``table``.

    Unparsable numbers and timestamps become NULL instead of failing the job
    (B1 then reports them); columns missing from ``raw`` are left out, so
    :func:`apply_defaults` can fill them.
    """
    cols = []
    for c in TABLES[table]:
        match = next((x for x in raw.columns if x.lower() == c.name.lower()), None)
        if match is None:
            continue
        if c.dtype.typeName() == "timestamp_ntz":
            cols.append(parse_datetime(F.col(match)).alias(c.name))
        elif c.dtype.typeName() == "string":
            cols.append(F.col(match).alias(c.name))
        else:
            cols.append(F.expr(f"try_cast(`{match}` AS {c.dtype.simpleString()})").alias(c.name))
    return raw.select(*cols)


def read_raw(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """Read raw rows of ``table`` from CSV (with header) or Parquet files.

    CSV columns are read as text and cast to the declared types; timestamps
    that do not parse become NULL instead of failing the job.
    """
    if fmt == "csv":
        # files whose header differs from the first one's fail instead of being bound by position
        raw = spark.read.option("header", "true").option("enforceSchema", "false").option("mode", "PERMISSIVE").csv(path)
        return from_text(raw, table)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format {fmt!r}")


def ingest(df: DataFrame, table: str) -> DataFrame:
    """Bulk load (A3): conform raw rows to the declared table shape."""
    return apply_defaults(df, table)


def write(df: DataFrame, root: str, table: str, mode: str = "append", load_id: str | None = None, files: DataFrame | None = None) -> None:
    """Sink (A5): one Parquet folder per table, in it one folder per load, entered in the ledger once it is whole.

    The one sink of batch and stream: loads of either kind add up, and a load
    repeated under its ``load_id`` replaces itself.  Mode ``overwrite`` replaces
    all earlier loads at once for readers; their files stay until they are removed.
    ``files``: the source files (path, length, modified) that the load takes in.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unsupported mode {mode!r}")
    spark = df.sparkSession
    load_id = load_id or uuid.uuid4().hex
    ledger.open_ledger(spark, root, table)
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{table}/load_id={load_id}")
    ledger.commit(spark, root, table, load_id, files, replaces=mode == "overwrite")


def unparsed(raw: DataFrame, table: str) -> Column:
    """Names of the columns of text rows that hold something that is not of their declared type."""
    parsed = {f.name: f for f in schema(table).fields}
    bad = []
    for c in raw.columns:
        name = next((x for x in parsed if x.lower() == c.lower()), None)
        if name is None or parsed[name].dataType.typeName() == "string":
            continue
        kind = parsed[name].dataType
        value = parse_datetime(F.col(c)) if kind.typeName() == "timestamp_ntz" else F.expr(f"try_cast(`{c}` AS {kind.simpleString()})")
        bad.append(F.when(F.col(c).isNotNull() & value.isNull(), F.lit(name)))
    return F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
