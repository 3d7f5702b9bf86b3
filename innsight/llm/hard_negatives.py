"""Hard negatives by segment summaries.

Vectors are integers.  Each is cut into segments; of every segment the mean and the
deviation (the root of the sum of squares about the mean) are stored.  The
inner product of two segments of m entries lies within

    m * mean_a * mean_b  -/+  deviation_a * deviation_b

so the sums over segments bound the score.  Segments are refined: halves of
halves (``LEVELS``) give closer bounds to the pairs that the coarser ones leave
open, and what is still open is scored exactly in integers.

Two searches over all rows, for the anchors in blocks of ``ANCHORS`` (the only
thing that is sent to the tasks, bounded at any size):

* positives: the best rows of the anchor's label.  A row goes if its upper
  bound is below the k-th best lower bound seen so far.
* negatives, per anchor and positive: the best rows of other labels whose score lies
  within [low %, high %] of the positive's.  A row goes if its bounds miss that
  band, or if its upper bound is below the k-th best score that the question has so far.

Each task gives its best k per question; Spark merges these.  Nothing is sampled or capped.

Defined results: rows with a NULL label or vec_id (nothing could name it), or with a vector that is NULL or has NULL
or non-finite entries take no part; shorter vectors count as filled up with
zeros; repeated rows (equal vec_id, label and vector) are one row, rows that share a vec_id only are
rows of their own; ties go to the smaller vec_id; an anchor without a positive
or a positive without a negative gives no row; an empty table gives none.  A score beyond a
long raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm.common import ship, stage

#: Anchors that are searched for in one pass over the rows.
ANCHORS = 8_192
#: Parts into which each level cuts a vector.
LEVELS = (4, 16, 32)
#: Rows and anchors that are held against each other at once.
ROW_TILE, ANCHOR_TILE = 2_048, 256
_LOWEST, _HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Scores stay exact in doubles below this.
_EXACT = 1 << 53


def summaries(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(means times the root of the segment's length, deviations) of each row's segments."""
    n, d = x.shape
    cuts = np.unique(np.linspace(0, d, min(parts, d) + 1).astype(int))
    if d == 0:
        return np.zeros((n, 1)), np.zeros((n, 1))
    size = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    off = x - np.repeat(mean, size, axis=1)
    return mean * np.sqrt(size), np.sqrt(np.add.reduceat(off * off, cuts[:-1], axis=1))


class Vectors:
    """Integer vectors with ids, labels and the summaries of every level."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, stored: np.ndarray | None = None):
        self.ids, self.labels, self.x = ids, labels, x
        if stored is None:
            stored = stored_summaries(x)
        self.norm = stored[:, 0].astype(float)
        at, self.levels = 1, []
        for parts in LEVELS:
            k = max(1, min(parts, x.shape[1]))
            self.levels.append((stored[:, at : at + k].astype(float), stored[:, at + k : at + 2 * k].astype(float)))
            at += 2 * k

    def part(self, at) -> Vectors:
        out = object.__new__(Vectors)
        out.ids, out.labels, out.x, out.norm = self.ids[at], self.labels[at], self.x[at], self.norm[at]
        out.levels = [(m[at], s[at]) for m, s in self.levels]
        return out

    def __len__(self) -> int:
        return len(self.ids)


def stored_summaries(x: np.ndarray) -> np.ndarray:
    """Norm, then means and deviations of each level, as 32-bit numbers (the bounds allow for their rounding)."""
    f = x.astype(float)
    columns = [np.sqrt((f * f).sum(axis=1))[:, None]]
    for parts in LEVELS:
        columns += summaries(f, parts)
    return np.concatenate(columns, axis=1).astype(np.float32)


def bounds(a: Vectors, b: Vectors, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of all scores of ``a`` against ``b``."""
    (ma, sa), (mb, sb) = a.levels[level], b.levels[level]
    middle, off = ma @ mb.T, sa @ sb.T
    off += 4e-6 * np.outer(a.norm, b.norm) + 1e-6  # rounding of the stored numbers
    return middle - off, middle + off


def _pair_bounds(a: Vectors, b: Vectors, i: np.ndarray, j: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    (ma, sa), (mb, sb) = a.levels[level], b.levels[level]
    middle, off = np.einsum("ij,ij->i", ma[i], mb[j]), np.einsum("ij,ij->i", sa[i], sb[j])
    off += 4e-6 * a.norm[i] * b.norm[j] + 1e-6
    return middle - off, middle + off


def _scores(a: Vectors, b: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact integer scores of pairs: in doubles where these are exact, else in Python's integers."""
    if not len(i):
        return np.zeros(0, np.int64)
    if a.norm.max() * b.norm.max() * 1.01 < _EXACT:
        if 16 * len(i) > len(a) * len(b):  # most pairs are open
            return (a.x.astype(float) @ b.x.astype(float).T)[i, j].astype(np.int64)
        return np.einsum("ij,ij->i", a.x[i].astype(float), b.x[j].astype(float)).astype(np.int64)
    out = [sum(int(p) * int(q) for p, q in zip(a.x[r], b.x[c], strict=True)) for r, c in zip(i, j, strict=True)]
    return np.array(out, np.int64)  # beyond a long: OverflowError


def _kth_lower(q: np.ndarray, lower: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th highest of ``lower`` of each of ``n`` questions; -inf where there are fewer."""
    order = np.lexsort((-lower, q))
    q, lower = q[order], lower[order]
    start = np.searchsorted(q, np.arange(n))
    end = np.searchsorted(q, np.arange(n), side="right")
    out = np.full(n, -np.inf)
    have = end - start >= k
    out[have] = lower[start[have] + k - 1]
    return out


class Best:
    """The best k (score, smaller id first) of each question so far."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.q = np.zeros(0, np.int64)
        self.score, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.least = np.full(n, _LOWEST)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        q, score, ids = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.q, self.score, self.ids = q[keep], score[keep], ids[keep]
        last = place == self.k - 1
        self.least[q[last]] = score[last]


def search(anchors: Vectors, rows: Vectors, same: bool, q_anchor: np.ndarray, q_low: np.ndarray, q_high: np.ndarray, best: Best) -> tuple[int, int]:
    """Add ``rows`` to ``best``.  Question q is about anchor ``q_anchor[q]`` (ascending) and wants rows of its
    label (``same``) or of others, with scores within [q_low, q_high].  Returns (pairs, pairs scored exactly)."""
    pairs = scored = 0
    label_order = np.argsort(rows.labels, kind="stable")
    for r0 in range(0, len(rows), ROW_TILE):
        b = rows.part(label_order[r0 : r0 + ROW_TILE])
        present = np.unique(b.labels)
        wanted = np.flatnonzero(np.isin(anchors.labels, present)) if same else np.arange(len(anchors))
        for a0 in range(0, len(wanted), ANCHOR_TILE):
            at = wanted[a0 : a0 + ANCHOR_TILE]
            a = anchors.part(at)
            fits = (a.labels[:, None] == b.labels[None, :]) == same
            if same:
                fits &= ~_equal(a, b)
            pairs += int(fits.sum())
            # questions of these anchors
            of = np.full(len(anchors), -1)
            of[at] = np.arange(len(at))
            qs = np.flatnonzero(of[q_anchor] >= 0)
            if not len(qs):
                continue
            mine = of[q_anchor[qs]]
            # the whole band of an anchor's questions, at the coarsest level
            low = np.full(len(at), np.inf)
            high = np.full(len(at), -np.inf)
            least, most = np.maximum(q_low[qs], best.least[qs]), q_high[qs]
            np.minimum.at(low, mine, np.where(least == _LOWEST, -np.inf, least))
            np.maximum.at(high, mine, np.where(most == _HIGHEST, np.inf, most))
            lower, upper = bounds(a, b, 0)
            open_ = fits & (upper >= low[:, None]) & (lower <= high[:, None])
            i, j = np.nonzero(open_)
            lower, upper = lower[i, j], upper[i, j]
            for level in range(len(LEVELS)):
                if level:
                    lower, upper = _pair_bounds(a, b, i, j, level)
                keep = (upper >= low[i]) & (lower <= high[i])
                if same:  # one question an anchor, no band: the k-th best lower bound holds for all
                    kth = _kth_lower(i, lower, len(at), best.k)
                    keep &= upper >= kth[i]
                i, j = i[keep], j[keep]
                if 2 * len(i) > len(a) * len(b):  # nearly all are open: closer bounds cost more than the scores
                    break
            scored += len(i)
            score = _scores(a, b, i, j)
            # an anchor's pairs against each of its questions, the q-th of every anchor at once
            turn = np.arange(len(qs)) - np.searchsorted(mine, mine)
            for t in range(int(turn.max()) + 1):
                which = np.full(len(at), -1)
                which[mine[turn == t]] = qs[turn == t]
                q = which[i]
                ok = q >= 0
                ok[ok] &= (score[ok] >= np.maximum(q_low[q[ok]], best.least[q[ok]])) & (score[ok] <= q_high[q[ok]])
                best.add(q[ok], score[ok], b.ids[j[ok]])
    return pairs, scored


def _equal(a: Vectors, b: Vectors) -> np.ndarray:
    """Pairs of one id and the same vector: the anchor itself."""
    out = np.zeros((len(a), len(b)), bool)
    i, j = np.nonzero(a.ids[:, None] == b.ids[None, :])
    out[i, j] = (a.x[i] == b.x[j]).all(axis=1)
    return out


def _of(table, d: int) -> Vectors:
    """Vectors from Arrow columns vec_id, label, x and summary."""
    flat = lambda c: table.column(c).combine_chunks().flatten() if isinstance(table, pa.Table) else table.column(c).flatten()
    n = table.num_rows
    x = flat("x").to_numpy(zero_copy_only=False).reshape(n, d)
    stored = flat("summary").to_numpy(zero_copy_only=False).reshape(n, -1) if n else stored_summaries(x)
    return Vectors(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), x, stored)


def summarised(rows: DataFrame) -> tuple[DataFrame, int]:
    """(staged rows (vec_id, label, x, summary), entries of a vector); ``rows`` are (vec_id, label, x array<bigint>)."""
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(d) - F.size("x")))
    rows = rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), filled.alias("x")).distinct()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 8_192):
                part = batch.slice(k, 8_192)
                made = stored_summaries(part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d))
                at = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * made.shape[1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at, pa.array(made.ravel()))], ["vec_id", "label", "x", "summary"])

    return stage(rows.mapInArrow(add, "vec_id bigint, label bigint, x array<bigint>, summary array<float>"), "summaries"), d


def _ask(rows: DataFrame, d: int, anchors: pa.Table, same: bool, questions: pa.Table, k: int) -> DataFrame:
    """(q, score, vec_id): the best ``k`` of each question over all rows, at most k a task before they are merged."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((anchors, questions))  # ANCHORS anchors at most, k questions each

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors_of, asked = sent.value
        a = _of(anchors_of, d)
        q_anchor, low, high = (asked.column(c).to_numpy() for c in ("anchor", "low", "high"))
        best = Best(len(q_anchor), k)
        for batch in batches:
            search(a, _of(batch, d), same, q_anchor, low, high, best)
        yield pa.RecordBatch.from_arrays([pa.array(best.q), pa.array(best.score), pa.array(best.ids)], ["q", "score", "vec_id"])

    found = rows.mapInArrow(find, "q bigint, score bigint, vec_id bigint")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, label, x array<bigint>).

    ``anchor`` says which rows ask; scores of negatives lie within ``low`` to ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    ship(spark)
    staged, d = summarised(rows.where("vec_id is not null and label is not null and x is not null"))
    asking = stage(staged.where(anchor), "anchors")
    # blocks of anchors: runs of a hash of the id, so many that a block holds ANCHORS at most
    total = asking.count()
    cut = max(1, -(-total * 2 // ANCHORS))
    while True:
        block = F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(cut))
        sizes = asking.groupBy(block.alias("block")).count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= ANCHORS:
            break
        cut *= 2
    made = None
    for b in range(cut):
        held = asking.where(block == b).orderBy("vec_id", "label", "x").toArrow()  # ANCHORS rows at most
        n = held.num_rows
        if not n:
            continue
        every = pa.table({"anchor": np.arange(n), "low": np.full(n, _LOWEST), "high": np.full(n, _HIGHEST)})
        found = stage(_ask(staged, d, held, True, every, positives), "positives").orderBy("q", "rank").toArrow()  # positives times ANCHORS
        score = found.column("score").to_numpy()
        # whole scores between the bounds, without rounding: low * s <= 100 * n <= high * s
        whole = [(-(-low * int(s) // 100), high * int(s) // 100) for s in score]
        asked = pa.table({"anchor": found.column("q").to_numpy(), "low": pa.array([p for p, _ in whole], pa.int64()), "high": pa.array([q for _, q in whole], pa.int64())})
        answers = _ask(staged, d, held, False, asked, negatives)
        ids = held.column("vec_id").to_numpy()
        names = pa.table({"q": pa.array(np.arange(found.num_rows)), "anchor_id": pa.array(ids[found.column("q").to_numpy()], pa.int64()),
                          "positive_id": found.column("vec_id"), "positive_score": found.column("score")})
        named = stage(answers.join(F.broadcast(spark.createDataFrame(names)), "q"), "negatives").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        made = named if made is None else made.unionByName(named)
    if made is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return made
