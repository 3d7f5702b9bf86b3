"""Incremental file ingest (A3) on Structured Streaming.

New raw files of one table (CSV with a header, or Parquet) are conformed to
the declared shape (types, defaults) and appended to the table's Parquet
folder.  Which files a load took in is kept in the table's ledger (path,
length, modification time; :mod:`innsight.sources.ledger`), so every file lands
exactly once: after a run that died half-way, in another application, and with another
or a lost streaming checkpoint.  A file that has changed counts as new.  With
``available_now`` the query processes what is there and stops, which suits a scheduled batch load.

With ``rejects`` rows that do not parse go to ``root/_rejects/<table>`` instead,
with the columns at fault and the file; else they are loaded with NULLs, for B1 to report.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from innsight.sources import ledger
from innsight.sources.schemas import schema
from innsight.sources.tables import apply_defaults, from_text, text_schema, unparsed, write

#: Source file of a row, as Spark's file scans know it.
_FILE = {"__path": "file_path", "__length": "file_size", "__modified": "file_modification_time"}


def _land(batch: DataFrame, table: str, root: str, fmt: str, rejects: bool) -> None:
    """Load what the batch holds of files that no load took in yet."""
    spark = batch.sparkSession
    ledger.open_ledger(spark, root, table)
    named = batch.select([F.col(c).alias(n) for c, n in zip(_FILE, ledger.FILE, strict=True)])
    # a row per file: kept, so that the source is read for them once, and of measured size when the rows meet them
    new = ledger.unloaded(spark, named, root, table).persist()
    try:
        load_id = ledger.load_name(new)
        if load_id is not None:
            _land_new(batch, new, load_id, table, root, fmt, rejects)
    finally:
        new.unpersist()


def _land_new(batch: DataFrame, new: DataFrame, load_id: str, table: str, root: str, fmt: str, rejects: bool) -> None:
    """Load the rows of the files in ``new`` as ``load_id``."""
    own = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(_FILE, ledger.FILE, strict=True)]
    rows = batch.join(new, own[0] & own[1] & own[2], "left_semi")
    if fmt == "csv" and rejects:
        raw = rows.drop(*_FILE).columns
        told = rows.withColumn("reason", unparsed(rows.select(*raw), table))
        bad = told.where(F.size("reason") > 0).select(
            F.to_json(F.struct(*raw)).alias("row"), "reason", F.col("__path").alias("path"))
        bad.write.mode("overwrite").parquet(f"{root.rstrip('/')}/_rejects/{table}/load_id={load_id}")
        rows = told.where(F.size("reason") == 0)
    rows = from_text(rows, table) if fmt == "csv" else rows.drop(*_FILE)
    write(apply_defaults(rows, table), root, table, load_id=load_id, files=new)


def rejected(spark: SparkSession, root: str, table: str) -> DataFrame:
    """(row as JSON, reason, path) of the rows that committed loads set aside."""
    kept = [r.load_id for r in ledger._loads(spark, root, table) if r.load_id]
    every = spark.read.schema("row string, reason array<string>, path string, load_id string").parquet(f"{root.rstrip('/')}/_rejects/{table}")
    # picks folders: no row is moved to meet its load
    return every.where(F.col("load_id").isin(kept)).select("row", "reason", "path")


def ingest_files(
    spark: SparkSession,
    source_dir: str,
    table: str,
    target_root: str,
    fmt: str = "csv",
    checkpoint: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    columns: list[str] | None = None,
    rejects: bool = False,
) -> StreamingQuery:
    """Start loading files of ``table`` from ``source_dir`` into
    ``target_root/table``; returns the running query.

    ``checkpoint`` defaults to a folder beside the target's tables, which outlasts
    the application.
    ``columns`` names the columns the files carry (for CSV in file order;
    default: all declared columns); declared columns not carried get their
    declared defaults.
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        # a file whose header is not these columns in this order fails
        raw = reader.schema(text_schema(table, columns)).option("header", "true").option("enforceSchema", "false").csv(source_dir)
    elif fmt == "parquet":
        declared = schema(table)
        keep = set(columns or declared.fieldNames())
        raw = reader.schema(StructType([f for f in declared.fields if f.name in keep])).parquet(source_dir)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    stream = hashlib.sha256("\n".join([source_dir.rstrip("/"), target_root.rstrip("/"), table]).encode()).hexdigest()[:16]
    ckpt = checkpoint or f"{target_root.rstrip('/')}/_progress/{table}-{stream}"
    sourced = raw.select("*", *[F.col(f"_metadata.{m}").alias(c) for c, m in _FILE.items()])
    writer = (
        sourced.writeStream.foreachBatch(lambda batch, _: _land(batch, table, target_root, fmt, rejects))
        .option("checkpointLocation", ckpt)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
