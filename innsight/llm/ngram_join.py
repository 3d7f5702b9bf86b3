"""Similarity join of documents on their sets of n-word shingles.

Prefix filtering with a rare-first order, and length, positional and suffix
filters (Bayardo et al. 2007; Xiao et al., "Efficient Similarity Joins for
Near Duplicate Detection", 2008), laid out for Spark:

1. Documents with equal sets are one class; only classes are joined.
2. Every shingle goes to a bucket by its hash, as packed arrays (one row per
   slice of documents and bucket).  There its number of classes is counted.
   A bucket holds some ``BUCKET`` shingles, whatever the input.
   A shingle of one class cannot link anything and ends there; a class of
   which fewer shared shingles are left than the least overlap has no partner.
3. What is left of a class is ordered rare-first; shingles within its prefix
   become rows keyed by shingle.  Shingles that a 64th of the documents share
   come last in the order, spread by class and not by shingle.
4. Each prefix shingle's list is first checked against one pivot class; then,
   between classes that these links have not yet put together, in full.  A large group
   of near copies thus costs one check per member, not one per pair.
   Every pair is verified once, by the exact overlap of its sets.
5. Connected components of the links.

Components need no link inside a group that is already connected, so those
are not verified; :func:`jaccard_links` finds every link and counts them per document.
Links of a class stand for links of all its documents.  Hashes of shingles
have 64 bits (in buckets 48 and the bucket).

Defined results: NULL and word-less texts have the empty set (0 shingles) and
no link; repeated rows are copies of each other; a NULL doc_id takes part in
links but never names a component that has others; an empty table gives no
rows; further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.chunks import chunked, slices
from innsight.llm.common import partitions, stage
from innsight.llm.components import components

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))  # fixed values: multipliers of MurmurHash3's finaliser
_BASE = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 / golden ratio
#: A shingle that this part of the documents share is ordered after all others.
COMMON = 64
#: Bytes of text that are cut into shingles at once: some thirty times that in a task's memory.
SLICE_BYTES = 2 << 20
#: Shingles of a bucket, some 7 bytes each as they travel and ten times that while a task works on them.
BUCKET = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in _MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, ascending, one text after the other; first of each text and the end)."""
    from xxhash import xxh3_64_intdigest

    codes, rows, distinct = chunked(pc.ascii_lower(texts), spaces=False)
    known = np.fromiter((xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
    full = pc.not_equal(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)[codes]  # the split leaves empty ends
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[full]
    w = known[codes[full]]
    count = np.bincount(row, minlength=len(rows) - 1)
    first = np.cumsum(count) - count
    size = np.minimum(count, words)  # a short text is one shingle
    windows = np.where(count > 0, count - size + 1, 0)
    owner = np.repeat(np.arange(len(count)), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + first[owner]
    h = size[owner].astype(np.uint64)
    w = np.concatenate([w, np.zeros(words, np.uint64)])
    for k in range(words):
        h = h * _BASE + np.where(k < size[owner], w[at + k], np.uint64(0))
    h = _mixed(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(count)))])


def _classes(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; the same for equal sets."""
    from xxhash import xxh3_64_intdigest

    raw = memoryview(np.ascontiguousarray(sets)).cast("B") if len(sets) else b""
    return np.fromiter((xxh3_64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(at, at[1:], strict=False)), np.uint64, len(at) - 1)


def _members(docs: DataFrame, words: int) -> DataFrame:
    """kind 0: (doc_id, n shingles, class); kind 1: (count, shingle) of those frequent in a task's documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sets, at = shingle_sets(part.column("text"), words)
                n = np.diff(at)
                key = _classes(sets, at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(n), np.int32)), part.column("doc_id"), pa.array(n), pa.array(key.view(np.int64), mask=n == 0)], names)
                fresh = np.array([not (k in seen or seen.add(k)) for k in key.tolist()], bool) & (n > 0)
                total += int(fresh.sum())
                more, times = np.unique(sets[np.repeat(fresh, n)], return_counts=True)
                # what a slice forgets is under a 4 * COMMON-th of its documents, and so is what the task
                # forgets at its end: what a COMMON-th of all documents have keeps half of its count or more
                hashes, back = np.unique(np.concatenate([hashes, more]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, times])).astype(np.int64)
                keep = counts * 4 * COMMON >= int(fresh.sum())
                hashes, counts = hashes[keep], counts[keep]
        keep = counts * 4 * COMMON >= total
        hashes, counts = hashes[keep], counts[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(hashes), np.int32)), pa.nulls(len(hashes), pa.int64()), pa.array(counts), pa.array(hashes.view(np.int64))], names)

    names = ["kind", "doc_id", "n", "key"]
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, "kind int, doc_id bigint, n bigint, key bigint")


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each run of equal keys, its length)."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(keys)))


def _rows(bucket: np.ndarray, cls: np.ndarray, n: np.ndarray, q: np.ndarray, level: np.ndarray, common: bool) -> Iterator[tuple]:
    """One packed row per bucket from parallel arrays; a class is named once per bucket."""
    order = np.lexsort((cls, bucket))
    bucket, cls, n, q, level = bucket[order], cls[order], n[order], q[order], level[order]
    start, size = _runs(bucket)
    for a, m in zip(start, size, strict=True):
        part = slice(a, a + m)
        s, count = _runs(cls[part])
        yield (int(bucket[a]), common, cls[part][s].astype("<u8").tobytes(), n[part][s].astype("<u4").tobytes(), count.astype("<u4").tobytes(), _six(q[part]), level[part].tobytes())


_PACKED = "bucket int, common boolean, cls binary, n binary, counts binary, shingles binary, level binary"
_PACKED_NAMES = ["bucket", "common", "cls", "n", "counts", "shingles", "level"]


def _unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    joined = {c: b"".join(rows[c]) for c in ("cls", "n", "counts", "shingles", "level")}
    count = np.frombuffer(joined["counts"], "<u4")
    return (np.repeat(np.frombuffer(joined["cls"], "<u8"), count), np.repeat(np.frombuffer(joined["n"], "<u4"), count),
            _from_six(joined["shingles"]), np.frombuffer(joined["level"], np.uint8))


def _shared(docs: DataFrame, words: int, common: np.ndarray, buckets: int) -> DataFrame:
    """Packed rows of the shingles that two or more classes have, dealt by class.

    ``level``: the order's first key, the bits of the number of classes
    (255 for common shingles).  A shingle is kept as 48 bits of its quotient by the
    number of buckets, and its bucket.
    """
    low = np.uint64((1 << 48) - 1)
    m = np.uint64(buckets)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sets, at = shingle_sets(part.column("text"), words)
                n = np.diff(at)
                key = _classes(sets, at)
                fresh = np.array([not (k in seen or seen.add(k)) for k in key.tolist()], bool) & (n > 0)
                take = np.repeat(fresh, n)
                sets, cls, size = sets[take], np.repeat(key, n)[take], np.repeat(n, n)[take]
                often = np.isin(sets, common)
                rest = ~often
                q, none = sets[rest] // m & low, np.zeros(0, np.uint8)
                out = list(_rows((sets[rest] % m).astype(np.int64), cls[rest], size[rest], q, np.zeros(len(q), np.uint8), False))
                # common ones go by class; 48 bits of their own hash name them (their bucket is not needed)
                q = sets[often] & low
                out += _rows((cls[often] % m).astype(np.int64), cls[often], size[often], q, np.full(len(q), 255, np.uint8), True)
                out = [r if r[1] else (*r[:6], none.tobytes()) for r in out]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], _PACKED_NAMES)

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ready = rows[rows["common"]]
        rows = rows[~rows["common"]].assign(level=b"")
        out = ready[_PACKED_NAMES].values.tolist()
        if len(rows):
            cls, n, q, _ = _unpacked(rows)
            order = np.lexsort((cls, q))
            cls, n, q = cls[order], n[order], q[order]
            # the same class from two tasks counts once
            new = np.concatenate([[True], (q[1:] != q[:-1]) | (cls[1:] != cls[:-1])])
            cls, n, q = cls[new], n[new], q[new]
            start, size = _runs(q)
            many = np.repeat(size, size)
            keep = many > 1
            cls, n, q, many = cls[keep], n[keep], q[keep], many[keep]
            level = np.minimum(np.ceil(np.log2(many)), 254).astype(np.uint8)
            out += [(b, False, *r) for b, _, *r in _rows((cls % m).astype(np.int64), cls, n, q, level, False)]
        made = pd.DataFrame(out, columns=_PACKED_NAMES)
        return made.assign(origin=int(key[0]))

    types = [pa.int32(), pa.bool_()] + [pa.binary()] * 5
    return docs.select("text").mapInArrow(post, _PACKED).groupBy("bucket").applyInPandas(count, _PACKED + ", origin int")


def _candidates(shared: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(cls, n, unique, ranked): classes that can have a partner; shared shingles rare-first, 8 bytes each."""
    m = np.uint64(buckets)

    def assemble(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for (origin, common), some in rows.groupby(["origin", "common"]):
            cls, n, q, level = _unpacked(some)
            # a name for the shingle from quotient and bucket, below 2**64 for any number of buckets; common ones apart
            name = q * m + np.uint64(origin) if not common else q | np.uint64(1 << 63)
            parts.append((cls, n, name, level))
        cls, n, name, level = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((name, level, cls))
        cls, n, name, level = cls[order], n[order], name[order], level[order]
        new = np.concatenate([[True], (cls[1:] != cls[:-1]) | (name[1:] != name[:-1])])  # from two tasks
        cls, n, name = cls[new], n[new], name[new]
        start, size = _runs(cls)
        total = n[start].astype(np.int64)
        good = np.flatnonzero(100 * size >= percent * total)
        return pd.DataFrame({
            "cls": cls[start[good]].view(np.int64), "n": total[good], "unique": total[good] - size[good],
            "ranked": [name[start[i] : start[i] + size[i]].tobytes() for i in good]})

    return shared.groupBy("bucket").applyInPandas(assemble, "cls bigint, n bigint, unique bigint, ranked binary")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, cls, n, u, at, short): a row per shared shingle in the class's prefix.

    ``at`` is its place in the whole order, of which the first ``u`` shingles are the class's
    own.  ``short``: it is in the shorter prefix that is enough for the shorter set of a pair.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, unique = batch.column("n").to_numpy(), batch.column("unique").to_numpy()
            prefix = n + (-percent * n) // 100 + 1  # n - ceil(percent n / 100) + 1
            take = np.maximum(prefix - unique, 0)
            names = [np.frombuffer(r.as_py(), "<u8")[:k] for r, k in zip(batch.column("ranked"), take, strict=True)]
            take = np.array([len(x) for x in names], np.int64)
            at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(unique, take)
            names = np.concatenate([np.zeros(0, np.uint64), *names]).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.view(np.int64)), pa.array(np.repeat(batch.column("cls").to_numpy(), take)), pa.array(np.repeat(n, take)),
                 pa.array(np.repeat(unique, take)), pa.array(at), pa.array(at < np.repeat(n + (-2 * percent * n) // (100 + percent) + 1, take))],
                ["shingle", "cls", "n", "u", "at", "short"])

    return sets.mapInArrow(cut, "shingle bigint, cls bigint, n bigint, u bigint, at bigint, short boolean")


def _near(percent: int, rows: DataFrame, whole: bool) -> DataFrame:
    """Length and positional filters on (a, a_n, a_u, a_at, b, ...); then one row per pair, a < b.

    A shared shingle at places ``a_at`` and ``b_at`` leaves at most the shorter
    part from it on to be shared, and before it what is not a set's own.  If
    all shared prefix shingles of a pair are there (``whole``), their number
    takes the place of the part before the last.
    """
    need = F.ceil(F.lit(percent) * (F.col("a_n") + F.col("b_n")) / F.lit(100 + percent))
    sized = rows.where(F.lit(100) * F.least("a_n", "b_n") >= F.lit(percent) * F.greatest("a_n", "b_n"))
    after = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    near = sized.where(after + F.least(F.col("a_at") - F.col("a_u"), F.col("b_at") - F.col("b_u")) >= need)
    if whole:
        near = near.groupBy("a", "b", "a_n", "b_n").agg(F.count("*").alias("both"), F.max("a_at").alias("a_at"), F.max("b_at").alias("b_at"))
        near = near.where(F.col("both") + after - 1 >= need)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _differ(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """Least number of elements of the ascending arrays that are not in both (suffix filter)."""
    if depth == 0 or len(x) == 0 or len(y) == 0:
        return abs(len(x) - len(y))
    middle = y[len(y) // 2]
    i, j = np.searchsorted(x, middle), len(y) // 2
    return _differ(x[:i], y[:j], depth - 1) + _differ(x[i:], y[j:], depth - 1)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that link; ``b``'s sets travel to ``a``'s, one time per pair."""
    second = pairs.join(sets.select(F.col("cls").alias("b"), F.col("n").alias("b_n"), F.col("ranked").alias("b_set")), "b")
    both = second.join(sets.select(F.col("cls").alias("a"), F.col("n").alias("a_n"), F.col("ranked").alias("a_set")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                a, a_set, b_set = batch.column("a")[i].as_py(), batch.column("a_set")[i], batch.column("b_set")[i]
                if a != last:
                    last, x = a, np.sort(np.frombuffer(a_set.as_py(), "<u8"))
                y = np.sort(np.frombuffer(b_set.as_py(), "<u8"))
                sizes = batch.column("a_n")[i].as_py() + batch.column("b_n")[i].as_py()
                need = -(-percent * sizes // (100 + percent))
                # shared at most: what the differing elements leave
                if len(x) + len(y) - _differ(x, y, 3) < 2 * need:
                    good.append(False)
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared >= need)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(check, "a bigint, b bigint")


def _sides(rows: DataFrame, side: str, group: bool) -> DataFrame:
    names = [F.col("cls").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", "u", "at", "short"))]
    return rows.select("shingle", *names, *([F.col("g").alias(f"g{side}")] if group else []))


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes, enough of them for the same components as all."""
    rows = stage(_prefixes(sets, percent), "prefixes")
    # the class with the fewest shingles of its own is nearest to what a group has in common
    pivot = F.min(F.struct("u", "n", "cls", "at"))
    pivots = stage(
        rows.groupBy("shingle").agg(pivot.alias("p"), F.count("*").alias("many")).where("many > 1")
        .select("shingle", F.col("p.cls").alias("a"), F.col("p.n").alias("a_n"), F.col("p.u").alias("a_u"), F.col("p.at").alias("a_at")), "pivots")
    to_pivot = _sides(rows, "b", group=False).join(pivots, "shingle").where("a != b")
    checked = stage(_near(percent, to_pivot, whole=False), "checked")
    first = stage(_verified(checked, sets, percent), "links")
    groups = components(first)
    # lists that still hold more than one group: pairs between different groups, the shorter
    # set's shingle in its shorter prefix.  Rows without any partner long enough go first.
    named = stage(rows.join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("g", F.coalesce("component", "cls")).drop("component"), "grouped")
    lists = named.groupBy("shingle").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.min(F.when(F.col("short"), F.col("n"))).alias("least"))
    lists = stage(lists.where("low != high and least is not null").select("shingle", "least"), "open")
    reach = F.lit(percent) * (F.col("least") + F.col("n")) <= F.lit(100 + percent) * (F.col("n") - F.col("u"))
    open_rows = stage(named.join(lists, "shingle").where(F.col("short") | reach).drop("least"), "open-rows")
    # the largest partner that a row's own shingles leave possible
    limit = F.floor((F.lit(100 + percent) * (F.col("n") - F.col("u")) - F.lit(percent) * F.col("n")) / percent)
    held = stage(open_rows.groupBy("shingle", "g").agg(
        F.count("*").alias("m"), F.max("short").alias("short"), F.min("n").alias("n"), F.max(limit).alias("limit")), "open-groups")
    side = lambda x: held.select("shingle", *[F.col(c).alias(f"{c}{x}") for c in ("g", "m", "short", "n", "limit")])
    cross = side("a").join(side("b"), "shingle").where("(ma < mb or (ma = mb and ga < gb)) and (shorta or shortb) and na <= limitb and nb <= limita")
    cross = cross.select("shingle", "ga", "gb")
    # the smaller group's rows first; the filters hold while the larger one's are joined
    across = cross.join(_sides(open_rows, "a", group=True), ["shingle", "ga"]).join(_sides(open_rows, "b", group=True), ["shingle", "gb"])
    across = across.where("case when a_n < b_n or (a_n = b_n and a < b) then a_short else b_short end")
    pairs = stage(_near(percent, across, whole=True), "pairs")
    pairs = stage(pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
    return first.unionByName(_verified(pairs, sets, percent))


def _every_link(sets: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) between classes: as many rows as the answer has, and what the filters leave beside it."""
    rows = stage(_prefixes(sets, percent), "prefixes")
    met = _sides(rows, "a", group=False).join(_sides(rows, "b", group=False), "shingle").where("a < b")
    # the shorter set's shingle in its shorter prefix: enough for every pair
    met = met.where("case when a_n < b_n or (a_n = b_n and a < b) then a_short else b_short end")
    return _verified(stage(_near(percent, met, whole=True), "pairs"), sets, percent)


def _classed(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, n_shingles, cls; sets of the classes that can have a partner)."""
    spark = docs.sparkSession
    found = stage(_members(docs, words), "members")
    members = found.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("cls"))
    total, shingles = members.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    # at least a 2 * COMMON-th of the documents hold each: at most 2 * COMMON mean set sizes of them
    often = found.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * 2 * COMMON >= max(total, 1)).select("key")
    common = np.sort(np.array([r.key for r in often.collect()], np.int64).view(np.uint64))
    buckets = max(partitions(spark), -(-shingles // BUCKET))
    return members, stage(_candidates(_shared(docs, words, common, buckets), percent, buckets), "sets")


def jaccard_links(docs: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, links): every link, between classes of equal sets.

    members: (doc_id, n_shingles, cls, links), a row per document; ``links`` counts the documents of other
    classes that it links with and the other members of its own.  links: (a, b) with a < b, a row per
    pair of classes.  Documents of a class link with each other and with all documents of a linked class.
    """
    members, sets = _classed(docs, words, percent)
    links = stage(_every_link(sets, percent), "every-link")
    sizes = stage(members.where("cls is not null").groupBy("cls").agg(F.count("*").alias("size")), "class-sizes")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes, F.col("b") == F.col("cls")).groupBy("a").agg(F.sum("size").alias("others"))
    counted = sizes.join(others, F.col("cls") == F.col("a"), "left").select("cls", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return members.join(counted, "cls", "left").select("doc_id", "n_shingles", "cls", F.coalesce("links", F.lit(0)).alias("links")), links


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents joined where ``100 * intersection >= percent * union``."""
    members, sets = _classed(docs, words, percent)
    groups = components(_links(sets, percent)).withColumnRenamed("node", "cls")
    # class -> component of classes -> smallest document of the component
    some = members.where("cls is not null").join(groups, "cls", "left")
    named = stage(some.select("doc_id", "n_shingles", F.coalesce("component", "cls").alias("g")), "named")
    least = stage(named.groupBy("g").agg(F.min("doc_id").alias("component_id")), "least")
    linked = named.join(least, "g").select("doc_id", "n_shingles", "component_id")
    alone = members.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
