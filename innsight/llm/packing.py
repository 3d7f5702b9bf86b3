"""Packing of token pieces into sequences by best fit and swap-based local search.

Pieces are dealt by hash into groups of about ``GROUP`` pieces; a task packs
one group: best fit in falling length, then local search.  The search takes
the emptiest sequence and moves a document out of it, or exchanges one of its
documents, or two of them, for a shorter one elsewhere, always so that the sum of
squared fills grows; a sequence that has become empty is gone.  It stops when
no such step is left.  The pieces of all sequences with room left are then dealt
anew and packed again, round by round, until one group holds them all or a round
needs as many sequences as the one before.

Defined results: a NULL text has the end id alone; empty tables give no rows;
repeated rows are packed once per row, dealt like any others; further columns are not carried.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from innsight.llm.chunks import WordIds, encoded, slices
from innsight.llm.common import stage

#: Pieces that one task packs together.
GROUP = 8192


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int, most: int, spaces: bool, ids: bool = True) -> DataFrame:
    """Cut the ids of each ``text`` into pieces of ``most`` ids; the last may be shorter.

    Returns doc_id, piece, start, length, ids_crc32 and, if asked, ids.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(tokenizer_file, spec, spaces)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, at = encoded(part.column("text"), words, spaces, end_id)
                n = np.diff(at)
                each = -(-n // most)
                row = np.repeat(np.arange(len(n)), each)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * most
                length = np.minimum(n[row] - start, most)
                begin = at[row] + start
                raw = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B") if len(flat) else b""
                crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(begin, length, strict=True)]
                cols = [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begin, at[-1]), pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of indices): longest first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        k = bisect_left(rooms, (n, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
            bins[b].append(int(i))
        else:
            room, b = capacity, len(bins)
            bins.append([int(i)])
        if room > n:
            insort(rooms, (room - n, b))
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills by moves and exchanges until no step is left; drop empty bins."""
    home = np.empty(len(lengths), np.int64)
    for b, items in enumerate(bins):
        home[items] = b
    fill = np.bincount(home, lengths, len(bins)).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    members = [set(x) for x in bins]
    # only documents of bins with room can take part; full bins stay as they are
    live = np.flatnonzero(fill[home] < capacity)
    size = lengths[live].astype(np.int64)

    def step(b: int) -> bool:
        """One improving step out of bin b: the one that leaves the least room where it goes."""
        by_length = {int(lengths[i]): i for i in sorted(members[b], reverse=True)}
        twice = {int(lengths[i]): i for i in members[b] if by_length[int(lengths[i])] != i}
        mine = sorted(by_length, reverse=True)
        room = capacity - fill
        for total in mine:  # a move: no document comes back
            fits = np.flatnonzero((room >= total) & (fill + total > fill[b]) & (fill > 0))
            fits = fits[fits != b]
            if len(fits):
                to = fits[np.argmin(room[fits])]
                _exchange(b, int(to), (by_length[total],), None)
                return True
        # exchanges, one for one, then two for one.  The lengths of one bin add up to its capacity at
        # most, so few of them differ (63 of 2048) and so do their sums: one pair a sum stands for all
        outs = {total: (by_length[total],) for total in mine}
        for k, u in enumerate(mine):
            if u in twice:
                outs.setdefault(2 * u, (by_length[u], twice[u]))
            for v in mine[k + 1 :]:
                outs.setdefault(u + v, (by_length[u], by_length[v]))
        # shortest document to come back, by the room that its bin has once it is out
        elsewhere = np.flatnonzero(home[live] != b)
        freed = room[home[live[elsewhere]]] + size[elsewhere]
        back = np.full(capacity + 1, capacity + 1, np.int64)
        np.minimum.at(back, freed, size[elsewhere])
        for total, out in outs.items():
            # room enough, the least left over; shorter than what comes; the other bin ends fuller than this one was
            end = min(capacity + total - int(fill[b]), capacity + 1)
            good = np.flatnonzero(back[total:end] < total)
            if len(good):
                c = total + int(good[0])
                k = elsewhere[np.flatnonzero((freed == c) & (size[elsewhere] == back[c]))[0]]
                _exchange(b, int(home[live[k]]), out, int(live[k]))
                return True
        return False

    def _exchange(b: int, a: int, out: tuple, back: int | None) -> None:
        for i in out:
            members[b].remove(i)
            members[a].add(i)
            home[i] = a
        moved = sum(int(lengths[i]) for i in out)
        if back is not None:
            members[a].remove(back)
            members[b].add(back)
            home[back] = b
            moved -= int(lengths[back])
        fill[a] += moved
        fill[b] -= moved

    again = True
    while again:
        again = False
        for b in np.argsort(fill, kind="stable"):
            while 0 < fill[b] < capacity and step(int(b)):
                again = True
    return [sorted(x) for x in members if x]


def _pack_groups(pieces: DataFrame, capacity: int, groups: int, base: int) -> DataFrame:
    """One round: pieces dealt evenly to ``groups``, each packed by one task; ``__room`` is left in a piece's sequence."""
    schema = StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long").add("__room", "long")

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins = local_search(lengths, best_fit(lengths, capacity), capacity)
        sequence, offset, room = (np.empty(len(rows), np.int64) for _ in range(3))
        for b, items in enumerate(bins):
            sequence[items] = ((base + int(key[0])) << 24) + b
            n = lengths[items]
            offset[items] = np.cumsum(n) - n
            room[items] = capacity - n.sum()
        return rows.drop(columns="__group").assign(sequence_id=sequence, offset=offset, __room=room)

    # by place in the written table: rows that repeat part like any others
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(solve, schema)


def pack(pieces: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset.

    ``pieces`` should be a written table: it is counted, then dealt out by place.
    Keep token ids out of it and join them on (doc_id, piece) where wanted.
    """
    left, n, base, used, held, done = pieces, pieces.count(), 0, None, None, []
    while True:
        groups = max(1, -(-n // group))
        packed = stage(_pack_groups(left, capacity, groups, base), "packed")
        base += groups
        with_room = F.col("__room") > 0
        first = F.col("offset") == 0
        now, n, roomy = packed.agg(F.count_if(first), F.count_if(with_room), F.count_if(first & with_room)).first()
        if used is not None and now >= used:  # nothing gained over the round before: its sequences stay
            done.append(held)
            break
        if groups == 1 or n == 0:
            done.append(packed)
            break
        done.append(packed.where(~with_room))
        left, held, used = packed.where(with_room).select(*pieces.columns), packed.where(with_room), roomy
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("__room")


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int, spaces: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stage(token_pieces(docs, tokenizer_file, end_id, capacity, spaces, ids=False), "pieces"), capacity)
