"""Byte-level BPE by a rank file, as Spark expressions over the corpus's distinct words.

1. Texts are split by the file's pattern, once; slices of documents are staged as
   codes of their words.  Words that are pieces need no merge.
2. Each other distinct word is a byte array; ranked merges are folded over it: the
   leftmost pair of the lowest rank becomes one id, until no pair has a rank.
   The rank map is one constant for all rows, hashed into short lists since a
   lookup in a map scans it.
3. Ids go back into the slices: the ``HOT`` words that most slices have (a bound, not a
   share of the data) are folded once and sent to all executors; words beyond them are folded
   where they occur, once a slice, by the same expression.  Nothing is left out at any size.

Decoding concatenates the binary pieces of the ids.

Defined results: a NULL text is the empty text and has no ids; repeated rows
are encoded alike; an empty table gives no rows; columns but doc_id and text are not carried.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.chunks import chunked, slices
from innsight.llm.common import stage

#: Frequent words that every executor holds; some 40 bytes each.
HOT = 1 << 19
#: Bytes of text of a slice (a longer single text is one).
SLICE_BYTES = 4 << 20
_NONE = 1 << 30
_BITS = 20
_LISTS = 131_071


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


class RankMap:
    """The rank file as one Spark constant.

    A scalar subquery holds it, so that plans stay small.  It may stand
    outside of lambdas only: :meth:`over` adds it as a column that is used once,
    which the optimizer puts in place, so no row carries it.
    """

    COLUMN = "__ranks"

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        keys, values = [[] for _ in range(_LISTS)], [[] for _ in range(_LISTS)]
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
                if a is not None and b is not None:
                    key = a << _BITS | b
                    keys[key % _LISTS].append(key)
                    values[key % _LISTS].append(rank)
        made = json.dumps({"b": [ranks[bytes([i])] for i in range(256)], "k": keys, "v": values}, separators=(",", ":"))
        self._one = spark.createDataFrame([(made,)], "j string").select(
            F.from_json("j", "b array<int>, k array<array<bigint>>, v array<array<int>>").alias("m"))

    def over(self, df: DataFrame, out: str, use) -> DataFrame:
        """``df`` with ``out``: ``use`` of a function from a word to its ids."""
        made = _let(F.col(self.COLUMN), lambda m: use(lambda word: _word_ids(word, m)))
        return df.select("*", self._one.scalar().alias(self.COLUMN)).select(*df.columns, made.alias(out))


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _before(left: Column, right: Column, m: Column) -> Column:
    """The fold's entry for id ``left`` that stands before ``right``: the rank of their merge, then the id."""
    key = F.shiftleft(left, _BITS).bitwiseOR(right)
    at = F.pmod(key, _long(_LISTS)).cast("int")
    rank = F.get(F.get(m.v, at), F.array_position(F.get(m.k, at), key).cast("int") - 1)
    return F.coalesce(F.shiftleft(rank.cast("bigint"), _BITS), _long(_NONE << _BITS)).bitwiseOR(left)


def _word_ids(word: Column, m: Column) -> Column:
    """The fold over the merges of one word, from its bytes.

    An entry holds an id and, above it, the rank of its merge with the next one. Entries of equal rank
    are equal, so the place of the least entry is the leftmost pair of the lowest rank.
    """
    last = lambda i: _long(_NONE << _BITS).bitwiseOR(i)  # noqa: E731  an id before nothing
    own = lambda entry: entry.bitwiseAND(_long((1 << _BITS) - 1))
    # one character a byte
    single = F.transform(F.split(F.decode(F.encode(word, "utf-8"), "ISO-8859-1"), ""), lambda c: F.get(m.b, F.ascii(c)).cast("bigint"))

    def begin(ids: Column) -> Column:
        return F.transform(ids, lambda x, i: F.when(i + 1 < F.size(ids), _before(x, F.get(ids, i + 1), m)).otherwise(last(x)))

    def step(entries: Column, _: Column) -> Column:
        def merged(least: Column, at: Column) -> Column:
            new = F.shiftright(least, _BITS)  # a merge's rank is its id
            here = F.when(at + 1 < F.size(entries), _before(new, own(F.get(entries, at + 1)), m)).otherwise(last(new))
            head = F.when(at > 1, F.concat(F.slice(entries, F.lit(1), at - 2), F.array(_before(own(F.get(entries, at - 2)), new, m), here))).otherwise(F.array(here))
            return F.concat(head, F.slice(entries, at + 2, F.size(entries)))

        def found(least: Column) -> Column:
            place = F.array_position(entries, least).cast("int")
            return F.when(least >= _long(_NONE << _BITS), entries).otherwise(_let(place, lambda at: merged(least, at)))

        return _let(F.array_min(entries), found)

    return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), _let(single, begin), step, lambda e: F.transform(e, lambda x: own(x).cast("int")))


def _words(distinct: pa.Array, pattern) -> tuple[pa.Array, np.ndarray]:
    """(words of all chunks one after the other, number of words of each chunk).

    Letters after one space at most are one word, with the punctuation that ends them two;
    all other chunks go through the pattern.
    """
    simple = pc.match_substring_regex(distinct, r"^ ?\p{L}+[.,;:!?]*$").to_numpy(zero_copy_only=False)
    at, rest = np.flatnonzero(simple), np.flatnonzero(~simple)
    whole = distinct.take(pa.array(at))
    stems = pc.utf8_rtrim(whole, ".,;:!?")
    ends = pc.binary_length(stems).to_numpy(zero_copy_only=False) < pc.binary_length(whole).to_numpy(zero_copy_only=False)
    tails = pc.replace_substring_regex(whole.filter(pa.array(ends)), r"(?s)^.*[^.,;:!?]", "")
    found = [pattern.findall(c) for c in distinct.take(pa.array(rest)).to_pylist()]
    each = np.zeros(len(distinct), np.int64)
    each[at], each[rest] = 1 + ends, np.fromiter(map(len, found), np.int64, len(found))
    first = np.cumsum(each) - each
    order = np.empty(each.sum(), np.int64)
    order[first[at]] = np.arange(len(at))
    order[first[at[ends]] + 1] = len(at) + np.arange(len(tails))
    other = each[rest]
    order[np.repeat(first[rest] - (np.cumsum(other) - other), other) + np.arange(other.sum())] = len(at) + len(tails) + np.arange(other.sum())
    words = pa.concat_arrays([stems, tails, pa.array([w for f in found for w in f], pa.string())])
    return words.take(pa.array(order)), each


def _blocks(docs: DataFrame, pattern: str, pieces: list[str]) -> DataFrame:
    """One row per slice of documents: their texts as codes of chunks, chunks as codes of words.

    A word code of 0 or more is a place in ``pieces`` (words that are themselves
    pieces, at most the vocabulary); -1, -2, ... are the slice's own ``words``.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut, whole = regex.compile(pattern), pa.array(pieces, pa.string())
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                codes, rows, distinct = chunked(part.column("text"), spaces=True)
                words, each = _words(distinct, cut)
                coded = words.dictionary_encode()
                place = pc.index_in(coded.dictionary, value_set=whole)
                own = coded.dictionary.filter(pc.is_null(place))
                place = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                place[place < 0] = -1 - np.arange(len(own))
                of_chunk = place[coded.indices.to_numpy(zero_copy_only=False)]
                wide = len(distinct) > 1 << 16
                raw = [x.astype(t).tobytes() for x, t in ((codes, "<u4" if wide else "<u2"), (rows, "<i8"), (of_chunk, "<i4"), (each, "<i4"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays([0, part.num_rows], part.column("doc_id")), pa.ListArray.from_arrays([0, len(own)], own), pa.array([wide]), *(pa.array([x], pa.binary()) for x in raw)],
                    ["doc_ids", "words", "wide", "codes", "rows", "of_chunk", "each"])

    return docs.mapInArrow(split, "doc_ids array<bigint>, words array<string>, wide boolean, codes binary, rows binary, of_chunk binary, each binary")


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """(word) of the highest counts in (word, n), ``most`` at most: all above a cut in the count."""
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r[0])  # under 1024 levels
    total, cut = 0, 1 << 20
    for r in levels:
        total += r["count"]
        if total > most:
            break
        cut = r.level
    return words.where(level >= cut).select("word")


def _known_apart(blocks: DataFrame, known: Broadcast) -> DataFrame:
    """``blocks`` with ``words`` that were not sent out only; ``place`` says of each former one where it is (-1, -2, ...: in ``words``)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = known.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                words = row.column("words").flatten()
                place = pc.index_in(words, value_set=sent)
                rest = words.filter(pc.is_null(place))
                place = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                place[place < 0] = -1 - np.arange(len(rest))
                row = row.set_column(row.schema.get_field_index("words"), "words", pa.ListArray.from_arrays([0, len(rest)], rest))
                yield row.append_column("place", pa.array([place.astype("<i4").tobytes()], pa.binary()))

    return blocks.mapInArrow(part, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema) + ", place binary")


def _put_together(blocks: DataFrame, known: Broadcast, piece_ids: list[int], pieces: list[bytes], digest: bool) -> DataFrame:
    """Ids (or digests) of each document of ``blocks`` with ``ids``: those of each of its ``words``.

    ``piece_ids`` are the ids of the words that are pieces, ``pieces`` the bytes of every id.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        sums = lambda x, e: pa.array([sha256(x[a:b]).hexdigest() for a, b in zip(e, e[1:], strict=False)], pa.string())
        base = pa.concat_arrays([pa.array([i.to_bytes(4, "little") for i in piece_ids], pa.large_binary()), known.value])
        bytes_of = pa.array(pieces, pa.large_binary())
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[k].as_py(), t)  # noqa: B023, E731
                each = np.concatenate([[0], np.cumsum(get("each", "<i4"))])
                own = batch.column("ids")[k].values
                own = _id_bytes(own) if own is not None and len(own) else pa.array([], pa.large_binary())
                # pieces, then words that were sent out, then the slice's own
                place = get("place", "<i4").astype(np.int64)
                place = np.where(place >= 0, len(piece_ids) + place, len(base) - 1 - place)
                words = get("of_chunk", "<i4").astype(np.int64)
                mine = words < 0
                words[mine] = place[-1 - words[mine]]
                codes = pa.array(get("codes", "<u4" if batch.column("wide")[k].as_py() else "<u2"))
                raw, ends = _texts(_runs(_runs(pa.concat_arrays([base, own]).take(pa.array(words)), each).take(codes), get("rows", "<i8")))
                ids, n = np.frombuffer(raw, "<u4"), pa.array(np.diff(ends) // 4)
                docs_of = batch.column("doc_ids")[k].values
                if not digest:
                    listed = pa.LargeListArray.from_arrays(pa.array(ends // 4), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([docs_of, n, listed], ["doc_id", "n_tokens", "ids"])
                    continue
                # the pieces of the ids, one after the other
                text = _texts(_runs(bytes_of.take(pa.array(ids)), ends // 4))
                yield pa.RecordBatch.from_arrays([docs_of, n, sums(raw, ends), sums(*text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return blocks.mapInArrow(join, "doc_id bigint, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"))


def _id_bytes(lists: pa.ListArray) -> pa.Array:
    """Lists of ids as little-endian unsigned 32-bit integers."""
    flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<u4")
    at = 4 * np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at), pa.py_buffer(flat)])


def _runs(values: pa.Array, at: np.ndarray) -> pa.Array:
    """The concatenation of each run of binary values; run i ends where i + 1 begins.  No byte moves."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets[at])), values.buffers()[2] or pa.py_buffer(b"")])


def _texts(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """(bytes of all values, first byte of each and the end)."""
    raw = values.buffers()[2]
    return memoryview(raw if raw is not None else b""), np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, digest: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>), or with ``digest`` (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    ranks = read_ranks(rank_file)
    rank_map = RankMap(spark, ranks)
    # a word that is itself a piece is not merged
    whole = [(w, r) for w, r in ((p.decode("utf-8", "replace"), r) for p, r in ranks.items()) if ranks.get(w.encode()) == r]
    blocks = stage(_blocks(docs, pattern, [w for w, _ in whole]), "blocks", codec="zstd")
    counts = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # a word of one slice is folded once, there
    frequent = _frequent(stage(counts.where("n > 1"), "words"), hot)
    table = stage(rank_map.over(frequent, "ids", lambda ids: ids(F.col("word"))), "word-ids").toArrow()  # ``hot`` rows at most
    # the words go to one side, their ids to the other
    words_sent = spark.sparkContext.broadcast(pa.concat_arrays([pa.array([], pa.string()), *table.column("word").cast(pa.string()).chunks]))
    ids_sent = spark.sparkContext.broadcast(pa.concat_arrays([pa.array([], pa.large_binary()), *(_id_bytes(c) for c in table.column("ids").chunks if len(c))]))
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    rest = rank_map.over(_known_apart(blocks, words_sent), "ids", lambda ids: F.transform("words", ids)).drop("words")
    return _put_together(rest, ids_sent, [r for _, r in whole], pieces, digest)


def decode_ids(encoded: DataFrame, rank_file: str) -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the pieces of ``ids`` one after the other."""
    spark = encoded.sparkSession
    ranks = read_ranks(rank_file)
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = spark.createDataFrame([(pieces,)], "p array<string>").scalar()
    bytes_of = _let(F.col("__pieces"), lambda p: F.unhex(F.array_join(F.transform("ids", lambda i: F.get(p, i)), "")))
    return encoded.select("*", table.alias("__pieces")).select(*encoded.columns, bytes_of.alias("decoded"))
