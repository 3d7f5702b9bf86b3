"""The fact tables of a reservation, stored by reservation (A5).

Charges, stays and reservations meet on ``reservationId`` in most queries.
``write_facts`` stores them once in buckets of it, sorted; aggregations and
joins on the reservation then read them in place, without an exchange.  A stay
is stored with the hotel and the room type that its room leads to, so that no
query has to move stays to their rooms first; store again when rooms change.  The
buckets of one number belong together: they lie in ``root/_facts/buckets=<n>``, where ``load`` finds the number again.

Spark keeps bucketing in its catalogue; an entry of a session's own, with the
files outside of it, carries it to the readers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from innsight.operators.preagg import placed_stays
from innsight.sources.ledger import _found
from innsight.sources.schemas import TABLES
from innsight.sources.tables import load as load_tables

FACTS = ("reservation", "charge", "stay")
KEY = "reservationId"


def _entry(table: str) -> str:
    return f"innsight_{table}_{uuid.uuid4().hex}"


def write_facts(spark: SparkSession, t: dict[str, DataFrame], root: str, buckets: int, tables: Iterable[str] = FACTS) -> None:
    """Store the facts of ``t`` under ``root``, in place of what was stored in as many buckets before."""
    for name in tables:
        entry = _entry(name)
        rows = placed_stays(t) if name == "stay" else t[name]
        # rows go to their bucket first, so that each task writes the files of its own buckets only
        (rows.repartition(buckets, KEY).sortWithinPartitions(KEY).write.mode("overwrite").format("parquet")
         .bucketBy(buckets, KEY).sortBy(KEY).option("path", f"{root.rstrip('/')}/_facts/buckets={buckets}/{name}").saveAsTable(entry))
        spark.sql(f"DROP TABLE {entry}")  # the files stay


def _bucketed(spark: SparkSession, path: str, name: str, buckets: int) -> DataFrame:
    entry = _entry(name)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(f"CREATE TABLE {entry} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(entry)


def load(spark: SparkSession, root: str, others: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All tables, the stored facts read by bucket; ``others`` (default: the tables under ``root``) gives the rest."""
    found = _found(spark, f"{root.rstrip('/')}/_facts/buckets=*/*")
    out = dict(others) if others is not None else load_tables(spark, root, [t for t in TABLES if t not in FACTS])
    for path in found:
        buckets, name = path.rsplit("buckets=", 1)[1].split("/")
        out[name] = _bucketed(spark, path, name, int(buckets))
    return out
