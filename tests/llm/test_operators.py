"""The training-data operators against brute force, and their edge cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from innsight.llm import bpe, crf, hilbert, iblt, isolation, ngram_join, packing, surrogates, token_files, toolcalls
from innsight.llm.common import first_by_hash, ship, stage
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts() -> list:
    """Rows (doc_id, text): plain, copied, empty, null, very long, odd white space, repeated."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghiß éü")[:1] for _ in range(rng.randrange(1, 8))).replace(" ", "x") for _ in range(300)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 200))) + ".\nNext line here. And more."))
    base = [rng.choice(vocab) for _ in range(120)]
    for i in range(60, 80):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, " \n\t \v"), (103, "one"), (104, "a  b   c \n\n d\te "), (105, "x\x00y z \x01 w"), (106, " lead and trail "), (107, rows[0][1]), (107, rows[0][1]),
             (None, "no id here"), (108, "word " * 20_000), (109, "日本語 текст 👍🏽 é"), (110, "it's <|endoftext|> we'll")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    ship(spark)
    # further columns, some of them named like the operators' own
    return spark.createDataFrame([(i, t, "s%d" % (k % 3), k % 5 or None, "extra") for k, (i, t) in enumerate(texts)],
                                 "doc_id long, text string, source string, n_chars long, kept string").withColumn("n_words", F.lit("clash"))


def test_hilbert_runs_are_even_and_the_curve_is_connected(spark, docs):
    cube = spark.range(64).select(*[F.shiftright("id", 2 * i).bitwiseAND(F.lit(3)).cast("int").alias(f"c{i}") for i in range(3)])
    rows = sorted(cube.select(hilbert.curve_index([F.col(f"c{i}") for i in range(3)], 2), "*").collect())
    assert [r[0] for r in rows] == list(range(64))
    assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:])) == 1 for x, y in zip(rows, rows[1:]))
    placed = hilbert.hilbert_shards(docs, ["source", "n_chars"], 8, ["doc_id"], ["doc_id", "source", "n_chars"]).collect()
    shards = collections.defaultdict(list)
    for r in placed:
        shards[r.shard].append(r.slot)
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and len(placed) == docs.count()
    assert hilbert.hilbert_shards(docs.limit(0), ["source"], 8, ["doc_id"], ["doc_id", "source"]).count() == 0


def _encode(name, end, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_token_files_round_trip(spark, docs, texts, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tokens')}/t"
    token_files.write_token_files(docs, path, P.path("byte_bpe_50k.json"), end_id=2)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in token_files.read_token_files(spark, path).collect())
    assert got == sorted((i is not None, i or 0, _encode("byte_bpe_50k.json", 2, t).tolist()) for i, t in texts)
    digests = sorted(r.ids_crc32 for r in token_files.read_token_files(spark, path, digest=True).collect())
    assert digests == sorted(zlib.crc32(_encode("byte_bpe_50k.json", 2, t).tobytes()) for _, t in texts)
    token_files.write_token_files(docs.limit(0), path + "0", P.path("byte_bpe_50k.json"), end_id=2)
    assert token_files.read_token_files(spark, path + "0").count() == 0


def test_chunks_give_the_ids_of_the_whole_text():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from innsight.llm import chunks

    rng = random.Random(11)
    bits = ["word", "Été", "x", "42", "7", "it's", "'", ".", ",", "?!", ")", "...", " ", " ", " ", "\n", "\n", "\n\n", "  ", "\t", "\u00a0", "\u3000", "e\u0301", "日本", "\x00", "\x01", "\r\n", "\x85", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        spec = open(P.path(name), encoding="utf-8").read()
        library = Tokenizer.from_str(spec)
        library.encode_special_tokens = True
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        words = chunks.WordIds(spec, spaces, limit=500)
        for k in range(0, len(texts), 300):
            ids, at = chunks.encoded(pa.array(texts[k : k + 300]), words, spaces, None)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want[k : k + 300]


def test_ranks_pack_and_unpack():
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, 7, 3, 9], np.uint32)
    counts = np.array([5, 0, 1, 3])
    control, data = token_files.pack_ranks(ranks, counts)
    join = lambda x: np.frombuffer(b"".join(x), np.uint8)
    assert token_files.unpack_ranks(counts, join(control), join(data)).tolist() == ranks.tolist()


def test_packing_is_whole_and_tight(docs, texts):
    rows = packing.pack_documents(docs, P.path("word_bpe_49k.json"), end_id=0, capacity=64).collect()
    want = collections.Counter()
    for i, t in texts:
        ids = _encode("word_bpe_49k.json", 0, t)
        want.update((i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 64
    assert len(bins) <= -(-sum(r.length for r in rows) // 64) + 2
    assert packing.pack_documents(docs.limit(0), P.path("word_bpe_49k.json"), end_id=0, capacity=64).count() == 0


def test_local_search_empties_a_bin_that_best_fit_leaves():
    lengths = np.array([6, 5, 5, 4, 4, 3, 3])  # three bins of ten: 6+4, 5+5, 4+3+3
    poor = [[0, 5], [1, 3], [2, 4], [6]]
    better = packing.local_search(lengths, poor, 10)
    assert len(better) == 3 and sorted(i for b in better for i in b) == list(range(7))


def _improving_step(lengths, bins, capacity):
    """Any move or exchange (one or two documents for a shorter one or none) that raises the sum of squared fills, tried one by one."""
    fill = [int(lengths[b].sum()) for b in bins]
    for x, mine in enumerate(bins):
        outs = [int(lengths[i]) for i in mine] + [int(lengths[i] + lengths[j]) for k, i in enumerate(mine) for j in mine[k + 1 :]]
        for y, other in enumerate(bins):
            if x != y and 0 < fill[x] < capacity and fill[y] < capacity:
                backs = [int(lengths[i]) for i in other]
                singles = len(mine)
                for k, out in enumerate(outs):
                    for back in backs + [0] * (k < singles):
                        net = out - back
                        if net > 0 and fill[y] + net <= capacity and fill[y] + net > fill[x]:
                            return x, y, out, back
    return None


@pytest.mark.parametrize("seed", range(6))
def test_local_search_leaves_no_step(seed):
    rng = np.random.default_rng(seed)
    capacity = (40, 200, 2048)[seed % 3]
    lengths = rng.integers(1, (capacity // 3, max(2, capacity // 60))[seed % 2], 400)  # many documents a bin in every second case
    bins = [list(map(int, b)) for b in np.array_split(np.arange(400), -(-int(lengths.sum()) // (capacity // 3)))]
    bins = [b for b in bins if lengths[b].sum() <= capacity] + [[i] for b in bins if lengths[b].sum() > capacity for i in b]
    out = packing.local_search(lengths, bins, capacity)
    assert sorted(i for b in out for i in b) == sorted(i for b in bins for i in b)
    assert all(lengths[b].sum() <= capacity for b in out) and len(out) <= len(bins)
    assert _improving_step(lengths, out, capacity) is None


def test_groups_meet_again_and_repeated_rows_part(spark):
    rng = np.random.default_rng(5)
    lengths = [int(x) for x in rng.integers(1, 60, 2000)] + [7] * 1000  # a third of the rows is one row
    rows = [(i if i < 2000 else 9_999, 0, n, i if i < 2000 else 1) for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long").repartition(3)
    pieces = stage(pieces, "test-pieces")
    packed = packing.pack(pieces, 100, group=100)
    out = packed.collect()
    assert collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out) == collections.Counter(rows)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 100
    apart = packing._pack_groups(pieces, 100, 30, 0).select("sequence_id").distinct().count()
    least = -(-sum(lengths) // 100)
    assert least <= len(bins) <= least + (apart - least) // 2  # groups that never meet lose far more
    assert packed.columns == ["doc_id", "piece", "length", "ids_crc32", "sequence_id", "offset"]
    groups = packing._pack_groups(pieces, 100, 30, 0).where("doc_id = 9999").select((F.col("sequence_id") / 2**24).cast("long")).distinct().count()
    assert groups == 30
    # nothing to gain: one piece a sequence, in any number of rounds
    alone = stage(pieces.withColumn("length", F.lit(60).cast("long")), "test-pieces")
    assert packing.pack(alone, 100, group=100).select("sequence_id").distinct().count() == 3000


def test_first_by_hash(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    hot = df.unionByName(spark.range(3000).select(F.xxhash64(F.lit(1).cast("long")).alias("h"), F.lit(1).cast("long").alias("id")))
    hashes = sorted(r.h for r in df.collect())
    for n in (1, 100, 4999, 6000):
        got = first_by_hash(hot, "h", n)
        assert sorted(r.h for r in got.select("h").distinct().collect()) == hashes[:n]
    uneven = spark.range(50).select((F.col("id") + 2**62).alias("h"))  # all over the bound
    assert first_by_hash(uneven, "h", 3).count() == 3 and first_by_hash(uneven.limit(0), "h", 3).count() == 0


def test_bpe_equals_the_library(docs, texts, monkeypatch):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for size, hot in ((bpe.SLICE_BYTES, bpe.HOT), (700, bpe.HOT), (700, 20)):  # a slice a task; a few texts a slice; nearly all folded where they stand
        monkeypatch.setattr(bpe, "SLICE_BYTES", size)
        encoded = bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, hot=hot)
        made = bpe.decode_ids(encoded, P.path("byte_bpe_multi_50k.tiktoken"))
        key = lambda i, ids, raw: (i is not None, i or 0, ids, raw)
        assert sorted(key(r.doc_id, r.ids, bytes(r.decoded)) for r in made.collect()) == sorted(key(i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts)
        sums = bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, digest=True, hot=hot).collect()
        want = []
        for i, t in texts:
            ids = np.array(enc.encode_ordinary(t or ""), "<u4")
            want.append((str(i), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert sorted((str(r.doc_id), *r[1:]) for r in sums) == sorted(want)
    assert bpe.encode_documents(docs.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, digest=True).count() == 0


def _components(rows, percent=80):
    sets = {}
    for i, x in rows:
        w = WORD.findall((x or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_components(spark, docs, texts):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    base, rows = [rng.choice(vocab) for _ in range(150)], []
    for i in range(260):
        kind = rng.random()
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 150))]
        if kind < 0.5:  # a large group of near copies
            w = list(base)
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind < 0.7:  # a passage that many share
            w = base[:60] + w
        elif kind < 0.8 and rows:
            w = rng.choice(rows)[1].split()
        rows.append((3 * i + 1, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "a b"), (5004, "A B"), (5005, "a b c")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _components(rows)
    # repeated rows, a NULL doc_id, clashing columns
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == len(texts)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (0, 107, None)} == {(0, 0), (107, 0), (None, None)}
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_every_jaccard_link_is_counted(spark, monkeypatch):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(2000)]
    base, rows = [rng.choice(vocab) for _ in range(80)], []
    for i in range(120):
        w = list(base) if i % 3 else [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 5)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(200, rows[1][1]), (201, rows[1][1]), (202, None), (203, "a b"), (204, "A B")]
    sets = {}
    for i, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    linked = {(i, j) for i in sets for j in sets if i != j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    monkeypatch.setattr(ngram_join, "BUCKET", 64)  # more buckets than partitions
    members, links = ngram_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = members.collect()
    assert {r.doc_id: r.links for r in got} == {i: sum(1 for a, _ in linked if a == i) for i, _ in rows}
    cls = {r.doc_id: r.cls for r in got}
    want = {tuple(sorted((cls[i], cls[j]))) for i, j in linked if cls[i] != cls[j]}
    assert sorted(map(tuple, links.collect())) == sorted(want) and len(want) > 20


def test_quality_counts_and_verdicts(spark, docs, texts):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    got = isolation.quality(docs, labels).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(texts)
    for i, t in texts:
        w = WORD.findall(t or "")
        grams, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if grams[w[k], w[k + 1], w[k + 2]] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = by_id[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)
    unlabelled = isolation.quality(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in unlabelled)
    kept = isolation.kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert isolation.quality(docs.limit(0), labels).count() == 0


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(1)
    forest = isolation.grow(rng.normal(size=(2000, 4)), 3)
    inside, outside = isolation.scores(rng.normal(size=(200, 4)), forest, 256), isolation.scores(rng.normal(6, 1, size=(200, 4)), forest, 256)
    assert np.quantile(inside, 0.95) < np.quantile(outside, 0.05)


def test_held_out_accuracy_of_the_forest(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    fitted, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = isolation.quality(spark.read.parquet(f"{d}/documents.parquet"), fitted).where("not base_failed").join(held, "doc_id").collect()
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.95 and np.mean([not r.kept for r in got if r.quality == 0]) > 0.9


def test_fingerprints(docs, texts):
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    parts = lambda t: {p for p in re.split(r"\n|(?<=[a-e][.!?])[ ]", t) if p.strip(" ")}
    near = lambda a, b: 1.0 if not (a or b) else len(a & b) / len(a | b)
    got = {(r.doc_id, r.text): r for r in iblt.fingerprints(docs).collect()}
    seen: dict = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        e = t[: len(t) - cut] + after[:cut]
        r = got[i, t]
        if i != 107:  # the first of the repeated rows has its copy as the next
            assert (r.edited_text, r.next_text) == (e, after)
            assert r.near_edited == pytest.approx(near(parts(t), parts(e))) and r.near_next == pytest.approx(near(parts(t), parts(after)))
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
    assert iblt.fingerprints(docs.limit(0)).count() == 0


def test_one_table_gives_up_each_digest_or_tells_that_some_met(spark, monkeypatch):
    a, b = [k * 7919 for k in range(300)], [k * 7919 for k in range(80, 390)]
    sets = spark.createDataFrame([(a, b), (a, a), ([], b), (a[:1], b[:1])], "a array<bigint>, b array<bigint>")
    for x in "ab":
        sets = sets.withColumn(f"{x}_cells", iblt.sketch(F.col(x), F.lit(iblt.CELLS), F.lit(0)))
    wanted = [(sorted(set(x) - set(y)), sorted(set(y) - set(x))) for x, y, *_ in sets.collect()]

    def taken(of):
        return [r.d and (sorted(r.d.plus), sorted(r.d.minus)) for r in sets.select(of(F.col("a"), F.col("b")).alias("d")).collect()]

    def found(a, b):
        return iblt.difference(a, b, F.col("a_cells"), F.col("b_cells"))

    assert taken(lambda a, b: iblt.single(a, b, F.lit(1 << 30), F.lit(99))) == wanted
    # 170 digests cannot be alone in two cells; equal sets leave nothing behind
    assert taken(lambda a, b: iblt.single(a, b, F.lit(2), F.lit(99)))[:2] == [None, ([], [])]
    assert taken(found) == wanted
    monkeypatch.setattr(iblt, "single", lambda a, b, size, seed: F.lit(None).cast("struct<plus:array<bigint>,minus:array<bigint>>"))
    assert taken(found) == wanted


def test_fingerprints_of_texts_without_marks(spark, tmp_path_factory):
    import xxhash

    from innsight.llm import queries

    rng = random.Random(9)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
    made = [" ".join(word("qrstuvwxyz") for _ in range(400)), " ".join(word("бгджзклмн") for _ in range(400)) + ".", "".join(rng.choice("日本語文字列漢学校山川") for _ in range(900)),
            "".join(rng.choice("ABCDEFGHabcdefgh0123") for _ in range(3000)), "word " * 500, "word " * 250 + "other " * 250, "a few words\nand lines  \n \nwith  gaps", "one", "", None]
    path = f"{tmp_path_factory.mktemp('marks')}"
    spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")

    def parts(t):
        hashed = lambda w, seed=42: xxhash.xxh64_intdigest(w.encode(), seed)
        out = set()
        for line in t.split("\n"):
            part: tuple = ()
            words = [(x, fine) for w in line.split(" ") for fine in [len(w) > 32 or any("\u2e80" <= c <= "\ua4cf" for c in w)] for x in (w + " " if fine else [w])]
            for w, fine in words if line.strip(" ") else []:
                # Spark's xxhash64 of (c, 1) hashes the number with the character's hash as its seed
                h = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), hashed(w)) if fine else hashed(w)
                part += ((w, fine),)
                if h % 8 == 0 or len(part) == 16:
                    out.add(part)
                    part = ()
            out |= {part} - {()}
        return out

    got = {r.doc_id: r for r in queries.op10(spark, path).collect()}
    for i, t in enumerate(made):
        t, after = t or "", made[(i + 1) % len(made)] or ""
        a, b, c = parts(t), parts(t[: len(t) - len(t) // 4] + after[: len(t) // 4]), parts(after)
        near = lambda x, y: 1.0 if not (x or y) else len(x & y) / len(x | y)
        assert got[i].near_edited == pytest.approx(near(a, b)) and got[i].near_next == pytest.approx(near(a, c))
    assert all(got[i].near_edited > 0.25 for i in range(6))


def test_surrogates(spark, docs, texts):
    rows = [(1, "Mr. John Smith met Mrs Ann Smith; later Mr. Smith. г-н Иван Петров, IP 10.1.2.3 +1 (555) 555-0100 card 4111 1111 1111 1111"),
            (2, "write to Ann.Lee@mail.example.com or ANN.LEE@MAIL.EXAMPLE.COM, not bob@mail.example.com, 10.1.2.3"), (3, None), (4, ""), (None, "10.1.2.3"), (2, "10.1.2.3")]
    got = surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string").withColumn("surrogate", F.lit("clash")), "k").collect()
    assert len(got) == len(rows)
    out = {(r.doc_id, len(r.text or "") > 20): r.text for r in got}
    one, two = out[1, True], out[2, True]
    ip = re.findall(r"(?:\d+\.){3}\d+", one)[0]
    assert ip != "10.1.2.3" and ip in two and out[None, False] == ip and out[3, False] is None and out[4, False] == ""
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+); later Mr\. (\w+)\. г-н (\w+) (\w+), IP .* card (\d{4}) (\d{4}) (\d{4}) (\d{4})", one)
    assert m[2] == m[4] == m[5] and m[1].endswith("n") and m[3].endswith("na") and re.fullmatch("[а-яА-Я]+", m[6])
    digits = [int(c) for c in "".join(m.groups()[7:])][::-1]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0 and "4111" != m[8]
    mails = re.findall(r"\S+@[^\s,]+", two)
    assert mails[0] == mails[1].lower() != mails[2] and not set(mails) & {"ann.lee@mail.example.com", "bob@mail.example.com"}
    # texts without entities come back as they were
    assert sorted(map(str, surrogates.replace_entities(docs, "k").select("doc_id", "text", "kept").collect())) == sorted(map(str, docs.select("doc_id", "text", "kept").collect()))
    assert surrogates.replace_entities(docs.limit(0), "k").count() == 0


def test_collisions_draw_again(spark):
    # 300 of the thousand three-digit numbers: many first draws collide, or are numbers of the corpus
    many = spark.createDataFrame([("phone", f"{i:03d}") for i in range(300)], "kind string, value string")
    got = surrogates.settled(many, "k").collect()
    said = [r.surrogate for r in got]
    assert len(got) == 300 == len(set(said)) and not set(said) & {r.value for r in got}


def test_more_names_than_short_surrogates(spark, monkeypatch):
    # two syllables: eight names of three
    monkeypatch.setattr(surrogates, "_SYLLABLES", {"latin": ["ba", "do"], "cyrillic": ["ба", "до"]})
    many = spark.createDataFrame([("surname", f"Smith{chr(97 + i)}") for i in range(20)] + [("given_f", "Анна")], "kind string, value string")
    got = surrogates.settled(many, "k").collect()
    assert len(got) == 21 == len({r.surrogate for r in got}) and any(len(r.surrogate) > 6 for r in got if r.kind == "surname")


def test_tool_calls(spark):
    kind = "conv_id long, turn long, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string"
    rows = [(1, 0, "assistant", None, [("a", "search", '{"limit":3,"query":"$b"}'), ("b", "lookup", '{"key":"kk"}'), ("c", "lookup", "[1]"), ("a", "search", "{}")], None),
            (1, 1, "tool", "ra", None, "a"), (1, 2, "tool", "ra2", None, "a"), (1, 3, "tool", "zz", None, "q"),
            (2, 0, "assistant", None, [("x", "lookup", '{"key":"$y"}'), ("y", "lookup", '{"key":"$x","z":{"b":1,"a":[1,2]}}'), (None, "nope", None)], None),
            (None, 0, "assistant", None, [("x", "translate", '{"text":5,"target":"xx"}')], None)]
    table = spark.createDataFrame(rows, kind)
    got = {(r.conv_id, r.position): r for r in toolcalls.link_tool_calls(table).collect()}
    assert [got[1, k].id for k in range(4)] == ["b", "c", "a", "a"]
    assert [got[1, k].status for k in range(4)] == ["no result", "no result", "linked", "repeated"]
    assert got[1, 2].json == '{"arguments":{"limit":3,"query":"$b"},"conv_id":1,"errors":[],"id":"a","name":"search","result":"ra","result_turn":1,"status":"linked","turn":0}'
    assert got[1, 1].errors == ["not an object"] and got[1, 3].errors == ["limit: missing", "query: missing"]
    assert [got[2, k].status for k in range(3)] == ["cyclic", "cyclic", "no id"] and '"z":{"a":[1,2],"b":1}' in got[2, 1].json
    assert got[None, 0].errors == ["target: not allowed", "text: not string"]
    assert [(r.conv_id, r.n) for r in toolcalls.stray_results(table).collect()] == [(1, 2)]
    assert toolcalls.link_tool_calls(table.limit(0)).count() == 0


def test_main_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    chain = crf.fit(pages)
    odd = spark.createDataFrame([(-1, "u", None), (-2, None, ""), (None, "u", "<p>a &amp; b<br>c"), (-3, "u", "<script>x</script><p>" + "long " * 50_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in crf.extract(odd, chain).collect()}
    assert got[-1].text == got[-2].text == "" and got[-3].n_chars in (0, 249_999)
    import html

    made = {r.page_id: r.text for r in crf.extract(pages, chain).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", p.html, re.S)[1]
        assert made[p.page_id] == "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"<p>|</p>|<h1>|</h1>", body)) if t)
    comments = '<div class="content"><h1>Title</h1><p>First paragraph with several words here, and more text.</p></div><div class="comments"><p>I like this very much.</p></div><footer>x</footer>'
    assert crf.main_text(comments, chain) == "Title\nFirst paragraph with several words here, and more text."
    assert crf.extract(pages.limit(0), crf.fit(pages.limit(0))).count() == 0


def test_pages_without_the_end_of_their_head():
    body = '<article><h1>Title</h1><p>First paragraph.</p></article>'
    want = ["Title", "First paragraph."]
    heads = ["<head><title>T</title><body>", "<head><title>T</title>", "<head><meta charset=u><style>p {}</style><noscript><p>hide</p></noscript>", "<head><noscript><p>hide</p><body>", "<head><title>T</title></head><body>"]
    for head in heads:
        assert [b[0] for b in crf.leaf_blocks(f"<html>{head}{body}</html>")] == want, head
    assert [b[0] for b in crf.leaf_blocks("<head><title>T</title>Plain <b>text</b>")] == ["Plain text"]
    assert [b[0] for b in crf.leaf_blocks("<head><title>T</title><a href=x>Link</a>")] == ["Link"]


def test_pipeline_rows(spark, tmp_path_factory):
    import corpus_pipeline as C
    from innsight.llm.queries import KEY

    ship(spark)
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r.doc_id for r in isolation.quality(docs, spark.read.parquet(f"{d}/labels.parquet")).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    first = {i for i, (_, c) in _components(rows).items() if i == c}
    final = {r.doc_id: r.text for r in surrogates.replace_entities(docs.where(F.col("doc_id").isin(sorted(first))), KEY).collect()}
    want = sorted((i, k // 2048, zlib.crc32(ids[k : k + 2048].tobytes())) for i, t in final.items() for ids in [_encode("word_bpe_49k.json", 0, t)] for k in range(0, len(ids), 2048))
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in C.run(spark, d).collect()) == want
    for _, step in C.STAGES[:-1]:
        assert step(spark, docs.limit(0), d).columns == docs.columns
