"""Load ledger (A3, A5): which loads a table consists of, and which files they took in.

``root/_ledger/<table>/<load_id>`` holds one Parquet folder per load: a row for each source file
(path, length, modification time), or one row without a file.  It lives with
the tables, so it outlasts applications and streaming checkpoints.

Writing a load's rows comes first, its ledger entry last: the entry is the
commit.  Readers follow the committed loads only, so a load that died in
between is not seen, and its repetition, under the same ``load_id``, replaces
what it left.  A replacing load (mode ``overwrite``) hides all earlier ones
the moment it is committed.  One application at a time writes to a table.

What was there before the ledger stays: load folders are entered when
the ledger is opened, and Parquet files at the table's root (a table written
by other means) are read along with the loads until a load replaces them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "load_id string, seq long, replaces boolean, path string, length long, modified timestamp"
FILE = ["path", "length", "modified"]


def _entries(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/_ledger/{table}"


def _found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, in whatever store it names; none if there is nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath().toString() for s in status or []]


def entries(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The ledger of ``table``: a row per load and source file."""
    path = _entries(root, table)
    if not _found(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def _loads(spark: SparkSession, root: str, table: str) -> list:
    """(load_id, seq, replaces) of each load, a few per load, in order."""
    each = entries(spark, root, table).groupBy("load_id").agg(F.max("seq").alias("seq"), F.max("replaces").alias("replaces"))
    return sorted(each.collect(), key=lambda r: r.seq)


def open_ledger(spark: SparkSession, root: str, table: str) -> None:
    """Make the ledger where there is none, with the load folders that are there already."""
    path = _entries(root, table)
    if _found(spark, path):
        return
    old = [p.rsplit("load_id=", 1)[1] for p in _found(spark, f"{root.rstrip('/')}/{table}/load_id=*")]
    rows = [(i, 0, False, None, None, None) for i in [None, *old]]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/opened")


def commit(spark: SparkSession, root: str, table: str, load_id: str, files: DataFrame | None = None, replaces: bool = False) -> None:
    """Enter a load whose rows are written; ``files``: (path, length, modified) of what it took in."""
    before = _loads(spark, root, table)
    seq = next((r.seq for r in before if r.load_id == load_id), max((r.seq for r in before), default=0) + 1)
    entry = spark.createDataFrame([(load_id, seq, replaces, None, None, None)], SCHEMA)
    if files is not None:
        entry = entry.unionByName(files.select(F.lit(load_id).alias("load_id"), F.lit(seq).cast("long").alias("seq"), F.lit(replaces).alias("replaces"), *FILE))
    entry.coalesce(1).write.mode("overwrite").parquet(f"{_entries(root, table)}/{load_id}")


def committed_paths(spark: SparkSession, root: str, table: str) -> list[str]:
    """The folders (and a pattern for files at the root) that make up ``table`` now."""
    path = f"{root.rstrip('/')}/{table}"
    plain = [f"{path}/*.parquet"] if _found(spark, f"{path}/*.parquet") else []
    if not _found(spark, _entries(root, table)):
        folders = _found(spark, f"{path}/load_id=*")
        return plain + folders or [path]
    loads = _loads(spark, root, table)
    last = max((r.seq for r in loads if r.replaces), default=None)
    if last is not None:
        plain, loads = [], [r for r in loads if r.seq >= last]
    return plain + [f"{path}/load_id={r.load_id}" for r in loads if r.load_id]


def unloaded(spark: SparkSession, files: DataFrame, root: str, table: str) -> DataFrame:
    """Those of ``files`` (path, length, modified) that no committed load took in."""
    done = entries(spark, root, table).where("path is not null").select(*FILE).distinct()
    return files.select(*FILE).distinct().join(done, FILE, "left_anti")


def load_name(files: DataFrame) -> str | None:
    """A name that these files give, in whatever order and however often they are tried; None for no file."""
    h = F.xxhash64(*FILE)
    n, total, mixed = files.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return hashlib.sha256(f"{n} {total} {mixed}".encode()).hexdigest()[:24] if n else None
