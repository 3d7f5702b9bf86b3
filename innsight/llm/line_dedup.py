"""Lines that many documents share go; the other lines stay in their places.

1. Every document's lines are normalised (ASCII white space stripped at both ends,
   A-Z lower-cased) and hashed (MD5); the hashes are staged in line order, with
   a key of the row (128 bits of doc_id and text).  Texts do not move.
2. The hashes are exploded, each once a document, and counted; counts are
   combined before they are shuffled.
3. Lines whose hash reaches the threshold are marked by position.  A hash that
   holds more than a ``HOT``-th of all (document, hash) pairs is sent to all
   tasks; there can be ``HOT`` of those at most, at any size.  The others meet
   their lines in a shuffled join, in which no hash has more than that share.
4. Marked positions of a row meet its text, and what is left is put together
   again by position.

Defined results: NULL and empty texts are one empty line, which has no key and
stays; a line of white space alone has no key either; every row is a document (repeated
rows count again), a line repeated within it counts once; a NULL doc_id is a
document like others; an empty table gives no rows; further columns are not
carried.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.common import stage

#: Hashes with more than this part of all pairs are sent out; so many at most.
HOT = 4096
_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The normalised line; NULL where nothing is left."""
    return F.nullif(F.translate(F.btrim(line, F.lit(_SPACE)), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _row_key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2")]


def frequent_lines(hashes: DataFrame, least: int) -> DataFrame:
    """(hash, n): line hashes of ``least`` documents or more, from rows of ``hashes`` array<string>."""
    each = hashes.select(F.explode(F.array_distinct("hashes")).alias("hash")).where("hash is not null")
    return each.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def drop_frequent_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, text, kept_text, n_lines, n_dropped): without the lines whose key ``least`` documents or more have."""
    docs = docs.select("doc_id", "text")
    hashed = F.transform(_lines(F.col("text")), lambda x: F.md5(line_key(x).cast("binary")))
    hashes = stage(docs.select(*_row_key(), hashed.alias("hashes")), "line-hashes")
    frequent = stage(frequent_lines(hashes, least), "frequent-lines")
    total = frequent.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total // HOT  # fewer than HOT hashes: their counts add up to at most ``total``
    lines = hashes.select("k1", "k2", F.posexplode("hashes").alias("pos", "hash")).where("hash is not null")
    marked = lines.join(F.broadcast(frequent.where(hot).select("hash", F.lit(True).alias("hot"))), "hash", "left")
    cold = marked.where("hot is null").join(frequent.where(~hot).select("hash"), "hash", "left_semi")
    found = marked.where("hot").unionByName(cold)
    # as many positions as the text has lines, also for repeated rows
    gone = stage(found.groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone")), "dropped-lines")
    rows = docs.select("*", *_row_key()).join(gone, ["k1", "k2"], "left").withColumn("lines", _lines(F.col("text")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(F.array_sort(stay), lambda i: F.get("lines", i)), "\n"))
    return rows.select("doc_id", "text", kept.alias("kept_text"), F.size("lines").cast("bigint").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"))
