"""Line dedup, whitening and hard negatives against brute force, and their edge cases."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest

from innsight.llm import hard_negatives, line_dedup, whitening
from innsight.llm.common import ship
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def _deduped(texts: list, least: int) -> list:
    """(kept text, lines, dropped) of each text, line by line."""
    split = [(t or "").split("\n") for t in texts]
    keys = [[x.strip(SPACE).translate(LOWER) for x in s] for s in split]
    seen = collections.Counter(k for ks in keys for k in set(ks) if k)
    left = [[x for x, k in zip(s, ks) if not k or seen[k] < least] for s, ks in zip(split, keys)]
    return [("\n".join(x), len(s), len(s) - len(x)) for x, s in zip(left, split)]


@pytest.fixture(scope="module")
def lined() -> list:
    rows = [(i, f"Unique {i}\n \tShared LINE {i % 3}\r\nwhite space\n\n{'x' * (i % 4)}") for i in range(30)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, " \t\n "), (44, "Shared line 0\n" * 5), (45, "\n".join(f"long {k}" for k in range(30_000)) + "\nSHARED LINE 1"),
             (46, "ÄB\näB"), (None, "shared line 2"), (None, "shared line 2"), (47, rows[0][1]), (47, rows[0][1])]
    rows += [(50 + i, "nine only") for i in range(9)] + [(60 + i, "Just Ten") for i in range(10)] + [(70, "nul\x00\nnul\x00")]
    return rows


def test_lines_against_brute_force(spark, lined, monkeypatch):
    ship(spark)
    docs = spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in lined], "doc_id long, text string, hash string, lines string, n long")
    docs = docs.withColumn("pos", F.lit(1)).withColumn("gone", F.lit("clash")).withColumn("k1", F.lit(2))
    want = collections.Counter((i, *x) for (i, _), x in zip(lined, _deduped([t for _, t in lined], 10)))
    assert any(x[3] for x in want) and want[(40, "", 1, 0)] == 1
    for hot in (line_dedup.HOT, 1, 1 << 40):  # some sent out, all by the shuffled join, all sent out
        monkeypatch.setattr(line_dedup, "HOT", hot)
        got = line_dedup.drop_frequent_lines(docs, 10).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()
        assert collections.Counter(map(tuple, got)) == want


def test_lines_of_an_empty_table(spark):
    assert line_dedup.drop_frequent_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _vectors(n: int, d: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(2, 0.2, d) + rng.normal(size=(1, d))).astype(np.float32)


def test_scatter_is_the_exact_product():
    rng = np.random.default_rng(1)
    for rows, bits in ((1, 1), (63, 7), (200, 20), (130, 45)):
        u = rng.integers(0, 1 << bits, (rows, 5)).astype(np.uint64)
        whole = u.astype(object)
        assert whitening.scatter(u, bits) == (whole.T @ whole).tolist()


def test_whitening_against_numpy(spark):
    v = _vectors(400, 20, 2)
    rows = [(i, [float(c) for c in x], "clash") for i, x in enumerate(v)]
    rows += [(7, rows[7][1], "again"), (900, rows[3][1], "same vector"), (None, rows[5][1], "no id"), (901, None, ""), (902, [], ""), (903, [float("nan")] * 20, ""),
             (904, [math.inf] + [0.0] * 19, ""), (905, [None] + [0.0] * 19, ""), (906, [1.0] * 3, "short")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string").withColumn("component", F.lit("clash"))
    got = whitening.whiten(df).collect()
    x = np.floor(64 * v.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    e, c = np.linalg.eigh(cov)
    e, c = e[::-1][:16], c[:, ::-1][:, :16]
    want = (x - s / n) @ c / np.sqrt(e)
    assert len(got) == 403 * 16
    by = {(r.vec_id, r.component): r for r in got}
    sign = {k: np.sign(by[0, k].whitened * want[0, k - 1]) for k in range(1, 17)}
    for i in (0, 7, 11, 399):
        for k in range(1, 17):
            r = by[i, k]
            assert r.n == n and r.whitened * sign[k] == pytest.approx(want[i, k - 1], rel=1e-7, abs=1e-9)
            assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s)) and r.explained == pytest.approx(e[k - 1] / np.trace(cov), rel=1e-9)
    assert by[0, 1].identity_error < 1e-9 and collections.Counter(r.vec_id for r in got)[7] == 32
    assert {r.whitened for r in got if r.vec_id == 900} == {r.whitened for r in got if r.vec_id == 3}


def test_whitening_without_variance_and_of_wide_numbers(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitening.whiten(make([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()  # rank one
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1.0)
    wide = whitening.whiten(make([(i, [1e6 * i, float(i % 3)]) for i in range(5)])).collect()
    x = [[64_000_000 * i + 1_000_000, 64 * (i % 3) + 1_000_000] for i in range(5)]
    s = [sum(c) for c in zip(*x)]
    assert {r.vec_id: r.deviation for r in wide} == {i: sum((5 * a - b) ** 2 for a, b in zip(x[i], s)) for i in range(5)}


def _mined(rows: list, positives=5, negatives=5) -> collections.Counter:
    """(anchor, positive, rank, negative, scores) by comparing every pair."""
    out = collections.Counter()
    d = max(len(x) for _, _, x in rows)
    rows = sorted({(i, l, tuple(x) + (0,) * (d - len(x))) for i, l, x in rows})
    for a in rows:
        if a[0] % 100:
            continue
        score = lambda b: sum(p * q for p, q in zip(a[2], b[2]))  # noqa: B023, E731
        near = sorted(((-score(b), b[0]) for b in rows if b[1] == a[1] and b != a))[:positives]
        far = sorted((-score(b), b[0]) for b in rows if b[1] != a[1])
        for s, p in near:
            hit = [(-t, j) for t, j in far if 80 * -s <= 100 * -t <= 100 * -s][:negatives]
            for k, (t, j) in enumerate(hit):
                out[a[0], p, k + 1, j, -s, t] += 1
    return out


@pytest.mark.parametrize("large", [1, 1 << 22])
def test_hard_negatives_against_brute_force(spark, large, monkeypatch):
    ship(spark)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 10)) * 40
    rows = [(i, int(rng.integers(4)), x) for i in range(700) for x in [None]]
    rows = [(i, l, [int(v) * large for v in centre[l] * 0.4 + rng.normal(size=10) * 30]) for i, l, _ in rows]
    rows += [(1000 + i, i % 4, rows[100][2]) for i in range(60)]  # ties
    rows += [(300, rows[300][1], rows[300][2]), (200, 3, rows[5][2]), (200, 2, rows[6][2]), (2000, 9, [1, 2]), (2100, 0, [0] * 10), (2200, 1, [])]
    lost = [(None, 1, rows[0][2]), (2300, None, rows[0][2]), (2400, 1, None)]
    df = spark.createDataFrame(rows + lost, "vec_id long, label long, x array<bigint>").withColumn("q", F.lit("clash")).withColumn("score", F.lit("clash"))
    want = _mined(rows)
    assert len(want) > 100
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)  # several passes
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = hard_negatives.hard_negatives(df.repartition(5), F.col("vec_id") % 100 == 0).select(columns).collect()
    assert collections.Counter(map(tuple, got)) == want


def test_scores_beyond_a_long_are_an_error(spark):
    ship(spark)
    df = spark.createDataFrame([(0, 0, [1 << 40]), (1, 0, [1 << 40])], "vec_id long, label long, x array<bigint>")
    with pytest.raises(Exception, match="OverflowError"):
        hard_negatives.hard_negatives(df, F.col("vec_id") == 0).count()


def test_bounds_hold_and_set_pairs_aside():
    rng = np.random.default_rng(8)
    # smooth vectors: segments say much about them
    x = np.cumsum(rng.normal(size=(300, 64)), axis=1).astype(np.int64) * 10
    make = lambda at, label: hard_negatives.Vectors(at, np.full(len(at), label), x[at])
    a, b = make(np.arange(20), 0), make(np.arange(20, 300), 0)
    exact = a.x @ b.x.T
    widths = []
    for level in range(len(hard_negatives.LEVELS)):
        low, high = hard_negatives.bounds(a, b, level)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths == sorted(widths, reverse=True)
    best = hard_negatives.Best(20, 5)
    n = np.iinfo(np.int64)
    pairs, scored = hard_negatives.search(a, b, True, np.arange(20), np.full(20, n.min), np.full(20, n.max), best)
    assert pairs == 20 * 280 and scored < pairs // 4
    for q in range(20):
        assert sorted(best.score[best.q == q])[::-1] == sorted(exact[q])[::-1][:5]


def test_hard_negatives_of_an_empty_table(spark):
    ship(spark)
    assert hard_negatives.hard_negatives(spark.createDataFrame([], "vec_id long, label long, x array<bigint>"), F.col("vec_id") % 100 == 0).count() == 0
