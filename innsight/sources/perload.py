"""What each load gives, kept per load: charge totals (M1), keys.

``keep`` derives a table from every committed load of a declared table that
has none yet, each from the rows of that load alone, and reads all of them
together.  Work on a table then grows with what came in since, not with the
table.  What is derived from a load is named after the load and the files that
make it up, so a load that was repeated with other files is derived again, and
its own ledger (:mod:`innsight.sources.ledger`) is the commit: a run that died
in between leaves nothing that is seen.  Loads that a replacing load hides drop
out, since only the loads that readers follow are asked for.

Files at the table's root that belong to no load are derived as one load named
``root``, again whenever one is added.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.sources import ledger
from innsight.sources.schemas import PRIMARY_KEYS, schema

LOAD = "load_id"


@dataclass
class Kept:
    """``rows``: what the loads gave, with their name in :data:`LOAD`; ``new``: the loads that were read for it."""

    rows: DataFrame
    new: list[str]


def _marks(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Name of each load -> name of what is derived from it, by path, length and time of its files.

    Only the listing is read; one row per load reaches the driver.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
             .load(paths).select("path", "length", F.col("modificationTime").alias("modified")))
    name = F.coalesce(F.nullif(F.regexp_extract("path", r"/load_id=([^/]+)/[^/]+$", 1), F.lit("")), F.lit("root"))
    h = F.xxhash64("path", "length", "modified")
    each = files.groupBy(name.alias(LOAD)).agg(F.concat_ws(" ", F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).alias("mark"))
    return {r.load_id: f"{r.load_id}-{r.mark}" for r in each.select(LOAD, F.substring(F.sha2("mark", 256), 1, 16).alias("mark")).collect()}


def keep(spark: SparkSession, root: str, table: str, state: str, name: str, derive: Callable[[DataFrame], DataFrame]) -> Kept:
    """``derive`` of each committed load of ``root/table``, kept under ``state/name``."""
    declared = schema(table)
    out = derive(spark.createDataFrame([], declared)).withColumn(LOAD, F.lit("")).schema
    paths = ledger.committed_paths(spark, root, table)
    paths = [p for p in paths if ledger._found(spark, p)]
    marks = _marks(spark, paths) if paths else {}
    ledger.open_ledger(spark, state, name)
    done = {r.load_id for r in ledger._loads(spark, state, name)}
    base = f"{state.rstrip('/')}/{name}"
    new = [load for load in sorted(marks) if marks[load] not in done]
    for load in new:
        path = next(p for p in paths if p.endswith(f"/load_id={load}") or (load == "root" and "/load_id=" not in p))
        rows = spark.read.schema(declared).parquet(path).select(*declared.fieldNames())
        # the name lies in the rows too: folder names may be written with escapes
        derive(rows).withColumn(LOAD, F.lit(load)).write.mode("overwrite").parquet(f"{base}/{LOAD}={marks[load]}")
        ledger.commit(spark, state, name, marks[load])
    if not marks:
        return Kept(spark.createDataFrame([], out), new)
    return Kept(spark.read.schema(out).parquet(*[f"{base}/{LOAD}={m}" for m in marks.values()]), new)


def key_rows(table: str) -> Callable[[DataFrame], DataFrame]:
    """The primary key values of a table's rows with ``n_rows``; a key that is NULL in part is none (B1 reports it)."""
    keys = list(PRIMARY_KEYS[table])

    def derive(rows: DataFrame) -> DataFrame:
        whole = rows.select(*keys).dropna(how="any")
        return whole.groupBy(*keys).agg(F.count("*").alias("n_rows"))

    return derive


def repeated_keys(spark: SparkSession, root: str, table: str, state: str, load_id: str | None = None) -> DataFrame:
    """B2, B3 over loads: the keys held by more than one row, with ``n_rows`` and ``n_loads``.

    Reads the rows of loads that have no kept keys yet; of all others the kept
    keys only.  With ``load_id`` the keys of that load alone are checked against all loads.
    """
    keys = list(PRIMARY_KEYS[table])
    index = keep(spark, root, table, state, f"{table}_keys", key_rows(table)).rows
    asked = index
    if load_id is not None:
        # the load's keys are few beside all keys: the planner sends them out where their measured size allows
        asked = index.join(index.where(F.col(LOAD) == load_id).select(*keys), keys, "left_semi")
    return (asked.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_loads")).where("n_rows > 1"))
