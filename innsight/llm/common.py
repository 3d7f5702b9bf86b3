"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import innsight
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from innsight.session import staging_dir


def ship(spark: SparkSession) -> None:
    """Give the package's source to the executors' Python, once per application (as ``--py-files`` would)."""
    context = spark.sparkContext
    if getattr(context, "_innsight_shipped", False):
        return
    top = Path(innsight.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="innsight-"), "innsight-src.zip")  # the driver's own; Spark sends it on
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._innsight_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the session's shared folder and read it back.

    Cuts lineage: a lost executor costs no more than the tasks after it.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def first_by_hash(df: DataFrame, h: str, n: int) -> DataFrame:
    """The rows of ``df`` whose 64-bit hash in column ``h`` is among the ``n`` smallest that occur.

    Only hashes are looked for, and only those under a bound that the number of
    different ones gives, so what meets in one task is some ``n`` numbers at
    any input size; the rows themselves are fetched by them.
    """
    each = stage(df.select(h).distinct(), "hashes")
    total = each.count()
    likely = n + 8 * n**0.5 + 32  # hashes spread evenly: fewer than n under this share is next to impossible
    few = each
    if likely < total:
        few = each.where(F.col(h) < F.lit(int(likely / total * 2**64) - 2**63))
        if few.count() < n:
            few = each
    # at most n numbers
    return df.join(F.broadcast(stage(few.orderBy(h).limit(n), "picked")), h, "left_semi")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_running_total(df: DataFrame, order: list, weight, out: str, name: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all rows before this one in ``order``.

    No task sees all rows: the rows are staged (range partitioning reads its input
    twice, to find the bounds and to deal it), range-partitioned and staged again, so the
    block of a row is fixed; one sum per block (as many as partitions) gives
    each block's start; a window within the block does the rest.  ``order``
    must be total for a defined result.  Columns named ``__block``, ``__w``
    and ``__start`` are reserved.
    """
    n = partitions(df.sparkSession)
    blocks = stage(
        stage(df.withColumn("__w", weight), f"{name}-rows").repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("__block", F.spark_partition_id()), name)
    each = blocks.groupBy("__block").agg(F.sum("__w").alias("__sum"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: as small as the partition count, at any input size
    return (blocks.join(F.broadcast(starts), "__block")
            .withColumn(out, F.col("__start") + F.coalesce(F.sum("__w").over(inside), F.lit(0)))
            .drop("__block", "__w", "__start"))
