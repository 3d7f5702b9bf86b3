"""Token ids in byte-aligned files, and back.

A corpus is written as a table of one row per document in ascending doc_id
order: ``n_tokens``, ``control`` and ``data``.  Ids are replaced by their rank
in the corpus-wide frequency order, so frequent ids are small numbers; a rank
takes 1 to 4 bytes in ``data`` (little-endian) and two bits (bytes less one)
in ``control``, four ranks to a control byte, the first in the low bits.  The
last control byte of a document is filled with zero bits.  The table
``ranks`` beside it maps ranks to ids; it has at most as many rows as the
vocabulary.  Both are Parquet, so they go wherever Spark can write and a lost
executor repeats only its tasks.

Defined results: a NULL text is the empty text (its end id alone); repeated
rows are kept; rows of equal or NULL doc_id are ordered by length and bytes of their ids
(NULL first); an empty table gives empty files; further columns are not
carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.chunks import WordIds, encoded, slices
from innsight.llm.common import partitions, stage

# fixed values: bytes of the four ranks of each control byte
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def rank_bytes(ranks: np.ndarray) -> np.ndarray:
    return (1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)


def pack_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(control, data) of each of consecutive documents."""
    n = rank_bytes(ranks)
    raw = np.ascontiguousarray(ranks, "<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < n[:, None]].tobytes()
    ends = np.cumsum(counts)
    data_at = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[np.concatenate([[0], ends])]
    groups = -(-counts // 4)
    control_at = np.concatenate([[0], np.cumsum(groups)])
    codes = np.zeros(4 * int(control_at[-1]), np.uint8)
    codes[np.arange(len(n)) + np.repeat(4 * control_at[:-1] - (ends - counts), counts)] = n - 1
    codes = codes.reshape(-1, 4)
    control = (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).tobytes()
    cut = lambda x, at: [x[a:b] for a, b in zip(at, at[1:], strict=False)]
    return cut(control, control_at), cut(data, data_at)


def unpack_ranks(counts: np.ndarray, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Ranks of consecutive documents from their concatenated streams."""
    # each document's streams are whole bytes: the filling at its end is masked out
    groups = -(-counts // 4)
    lens = _LENGTHS[control].reshape(-1)
    filled = np.ones(len(lens), bool)
    ends = np.cumsum(groups) * 4
    for k in range(1, 4):
        filled[ends[groups * 4 - counts >= k] - k] = False
    lens = lens[filled]
    at = np.cumsum(lens, dtype=np.int64) - lens
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lens > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: Bytes of text that are encoded at once; fewer, larger slices look up fewer words.
SLICE_BYTES = 16 << 20


def token_ids(docs: DataFrame, tokenizer_file: str, end_id: int, spaces: bool) -> tuple[DataFrame, str]:
    """((kind, doc_id, n_tokens, ids binary), numpy type of an id): two bytes an id where the vocabulary allows, else four.

    Rows of kind 0 are documents; kind 1: (id as doc_id, its occurrences in one task as n_tokens).
    """
    from tokenizers import Tokenizer

    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    kind = "<u2" if max(Tokenizer.from_str(spec).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    names = ["kind", "doc_id", "n_tokens", "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(tokenizer_file, spec, spaces)
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                flat, at = encoded(part.column("text"), words, spaces, end_id)
                more = np.bincount(flat, minlength=len(total))
                more[: len(total)] += total
                total = more
                raw = flat.astype(kind).tobytes()
                at_byte = at * int(kind[-1])
                ids = pa.array([raw[a:b] for a, b in zip(at_byte, at_byte[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), part.column("doc_id"), pa.array(np.diff(at), pa.int64()), ids], names)
        found = np.flatnonzero(total)  # at most the vocabulary
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), np.int32)), pa.array(found, pa.int64()), pa.array(total[found], pa.int64()), pa.nulls(len(found), pa.binary())], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encode, "kind int, doc_id bigint, n_tokens bigint, ids binary"), kind


def _joined(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, spaces: bool = True) -> None:
    """Encode ``text`` of (doc_id, text), append ``end_id``, write ``path``/docs and ``path``/ranks.

    ``spaces``: whether the tokenizer keeps white space (byte-level) or drops it.
    The ids are staged once, with their counts, then put in order and coded.
    """
    spark = docs.sparkSession
    made, kind = token_ids(docs, tokenizer_file, end_id, spaces)
    staged = stage(made, "token-ids", codec="zstd")
    found = staged.where("kind = 1").groupBy(F.col("doc_id").alias("id")).agg(F.sum("n_tokens").alias("n"))
    counts = {r.id: r.n for r in found.collect()}  # at most the vocabulary
    ids = sorted(counts, key=lambda i: (-counts[i], i))
    spark.createDataFrame([(r, i, counts[i]) for r, i in enumerate(ids)], "rank bigint, id bigint, n bigint").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(ids, default=0) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                control, data = pack_ranks(rank_of[_joined(part.column("ids"), kind)], part.column("n_tokens").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_tokens"), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                    ["doc_id", "n_tokens", "control", "data"])

    ordered = staged.where("kind = 0").drop("kind").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
    (ordered.mapInArrow(code, "doc_id bigint, n_tokens bigint, control binary, data binary")
     .write.option("compression", "none").parquet(f"{path}/docs"))


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids array<bigint>), or with ``digest`` (doc_id, n_tokens, ids_crc32)."""
    ranks = spark.read.schema("rank bigint, id bigint, n bigint").parquet(f"{path}/ranks").orderBy("rank").collect()  # at most the vocabulary
    id_of = np.array([r.id for r in ranks], "<u4")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "data"):
                counts = part.column("n_tokens").to_numpy()
                raw = [np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8) for c in ("control", "data")]
                ids = id_of[unpack_ranks(counts, *raw)] if counts.sum() else np.zeros(0, "<u4")
                at = np.concatenate([[0], np.cumsum(counts)])
                if digest:
                    raw = memoryview(np.ascontiguousarray(ids)).cast("B") if len(ids) else b""
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_tokens"), last], ["doc_id", "n_tokens", "ids_crc32" if digest else "ids"])

    table = spark.read.schema("doc_id bigint, n_tokens bigint, control binary, data binary").parquet(f"{path}/docs")
    return table.mapInArrow(decode, "doc_id bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids array<bigint>"))
