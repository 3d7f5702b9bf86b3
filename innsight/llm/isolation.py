"""Quality rules with an isolation forest on the rules' statistics.

Per document, counts over the whole text (words, characters, symbols,
repeated lines, repeated three-word windows and more) give a vector of rates.
Two base rules reject outright: too few words, too many words in repeated
windows.  An isolation forest (Liu, Ting and Zhou, 2008) judges the rest: each
tree splits a sample of good labelled rows at random, and a document that few
splits set apart is anomalous.  The threshold is calibrated from labelled
rows: of all cuts, the one with the best balanced accuracy.

``FIT_ROWS`` bounds the labelled rows that the trees are grown from, chosen by
hash; the calibration counts all labelled rows, and every document is scored.

Defined results: a NULL or word-less text has all counts 0 and fails the
base; without labelled rows of both kinds nothing but the base rules rejects;
repeated rows are judged alike; an empty table gives no rows; columns of the
input that clash with the operator's are replaced, further ones are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.chunks import chunked, slices
from innsight.llm.common import first_by_hash, stage

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks", "n_plain"]
#: Labelled rows that the trees are grown from.
FIT_ROWS = 20_000
TREES, SAMPLE = 100, 256
#: Bytes of text that are counted at once.
SLICE_BYTES = 2 << 20
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))  # fixed values: odd multipliers


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text."""
    codes, rows, distinct = chunked(texts, spaces=False)
    n_texts = len(rows) - 1
    full = pc.not_equal(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n_texts), np.diff(rows))[full[codes]] if len(codes) else np.zeros(0, np.int64)
    codes = codes[full[codes]].astype(np.int64) if len(codes) else np.zeros(0, np.int64)
    n = np.bincount(row, minlength=n_texts)
    add = lambda of_word: np.bincount(row, of_word.to_numpy(zero_copy_only=False).astype(np.float64)[codes], n_texts).astype(np.int64)
    out = {
        "n_words": n,
        "word_chars": add(pc.utf8_length(distinct)),
        "n_symbols": add(pc.count_substring_regex(distinct, r"[#*$%&|<>]")),
        "n_upper": add(pc.count_substring_regex(distinct, r"\p{Lu}")),
        "n_marks": add(pc.count_substring_regex(distinct, r"[!?]")),
        "n_plain": add(pc.match_substring_regex(distinct, r"^\p{L}+[.,;:]?$")),
        "n_distinct": np.bincount(np.unique(row * max(len(distinct), 1) + codes) // max(len(distinct), 1), minlength=n_texts),
    }
    # lines with a word; each that an earlier one equals
    lists = pc.split_pattern(texts, "\n")
    coded = lists.flatten().dictionary_encode()
    line_row = np.repeat(np.arange(n_texts), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    worded = pc.match_substring_regex(coded.dictionary, "[^ \\t-\\r]").to_numpy(zero_copy_only=False)
    line_row, line = (line_row[worded[line]], line[worded[line]]) if len(line) else (line_row, line)
    kinds = max(len(coded.dictionary), 1)
    out["n_lines"] = np.bincount(line_row, minlength=n_texts)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(np.unique(line_row * kinds + line) // kinds, minlength=n_texts)
    # words of three-word windows that occur twice or more in their text
    begin = np.flatnonzero(row[:-2] == row[2:]) if len(row) > 2 else np.zeros(0, np.int64)
    h = row[begin].astype(np.uint64)
    for k in range(3):
        h = (h ^ (h >> np.uint64(29))) * _ODD[k] + codes[begin + k].astype(np.uint64) * _ODD[(k + 1) % 3]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(row), bool)
    for k in range(3):
        covered[begin[twice] + k] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n_texts)
    return out


def with_counts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) and :data:`COUNTS`, clashing ones replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    docs = docs.select(*{c: None for c in [*keep, "text"]})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                counts = text_counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], [*keep, *COUNTS])

    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return docs.mapInArrow(scan, schema)


def features() -> list:
    """Rates of the counts, each in a bounded range.

    Rates that clean texts also reach (digits of personal data, a line or a
    passage that many pages share) are left to the base rules: as features
    they made the forest reject clean labelled rows.
    """
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [F.least(F.col("word_chars") / n, F.lit(30.0)), F.col("n_symbols") / chars, F.col("n_upper") / chars,
            F.col("n_marks") / n, F.col("n_plain") / n, F.col("n_distinct") / F.pow(n, F.lit(0.75))]


def grow(rows: np.ndarray, seed: int, trees: int = TREES, sample: int = SAMPLE) -> list[tuple]:
    """Isolation trees as flat arrays (feature, cut, left, path length at a leaf)."""
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        some = rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)]
        limit = int(np.ceil(np.log2(max(len(some), 2))))
        feature, cut, left, path = [], [], [], []
        todo = [(some, 0)]
        # breadth first; children of a node stand side by side
        while len(feature) < len(todo):
            x, depth = todo[len(feature)]
            low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(rows.shape[1]),) * 2
            wide = np.flatnonzero(high > low)
            if depth >= limit or len(x) < 2 or not len(wide):
                feature.append(-1), cut.append(0.0), left.append(0), path.append(depth + mean_path(len(x)))
                continue
            f = int(rng.choice(wide))
            c = float(rng.uniform(low[f], high[f]))
            feature.append(f), cut.append(c), left.append(len(todo)), path.append(0.0)
            todo += [(x[x[:, f] < c], depth + 1), (x[x[:, f] >= c], depth + 1)]
        # what lies outside the sample's range at a node is set apart there
        forest.append((np.array(feature), np.array(cut), np.array(left), np.array(path)))
    return forest


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n."""
    if n < 2:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def scores(x: np.ndarray, forest: list[tuple], sample: int) -> np.ndarray:
    """2 ** -(mean path length / expected), near 1 for anomalies."""
    total = np.zeros(len(x))
    for feature, cut, left, path in forest:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            f = feature[node[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            at = node[rows]
            node[rows] = left[at] + (x[rows, f] >= cut[at])
        total += path[node]
    return 2.0 ** (-(total / len(forest)) / max(mean_path(sample), 1e-9))


def with_score(counted: DataFrame, forest: list[tuple], sample: int) -> DataFrame:
    """``counted`` with ``anomaly``; the statistics travel as one array."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def judge(x):
        import pandas as pd

        rows = np.array(x.tolist(), np.float64).reshape(len(x), -1)
        return pd.Series(scores(rows, forest, sample))

    return counted.withColumn("anomaly", judge(F.array(*[f.cast("double") for f in features()])))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def fit(counted: DataFrame, labels: DataFrame, seed: int = 7, fit_rows: int = FIT_ROWS) -> tuple[list[tuple], int, float] | None:
    """(forest, sample size, threshold) from ``labels`` (doc_id, quality); None without labelled rows of both kinds."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = counted.where(~base_failed()).select("doc_id", *COUNTS).join(known, "doc_id")
    rows = stage(rows, "labelled")
    # labelled documents by the hash of their id, each once however often it is repeated
    known_good = rows.where("quality = 1").select(F.xxhash64("doc_id", F.lit(seed)).alias("h"), F.array(*[f.cast("double") for f in features()]).alias("x"))
    picked = sorted(first_by_hash(known_good, "h", fit_rows).groupBy("h").agg(F.min("x").alias("x")).collect(), key=lambda r: r.h)
    good = np.array([r.x for r in picked], np.float64)
    if not len(good):
        return None
    forest, sample = grow(good, seed), min(SAMPLE, len(good))
    # a thousandth of the score is fine enough; at most 1001 bins of two labels reach the driver
    bins = with_score(rows, forest, sample).groupBy(F.round("anomaly", 3).alias("s"), "quality").agg(F.count("*").alias("n")).collect()
    return cut_of(forest, sample, bins)


def cut_of(forest: list[tuple], sample: int, bins: list) -> tuple[list[tuple], int, float] | None:
    total = {q: sum(r.n for r in bins if (r.quality == 1) == q) for q in (True, False)}
    if not total[True] or not total[False]:
        return None
    best, threshold = -1.0, 1.0
    kept, dropped = 0, total[False]
    for s in sorted({r.s for r in bins}):
        kept += sum(r.n for r in bins if r.s == s and r.quality == 1)
        dropped -= sum(r.n for r in bins if r.s == s and r.quality != 1)
        balanced = kept / total[True] + dropped / total[False]
        if balanced >= best:  # of equal cuts the one that keeps more
            best, threshold = balanced, s
    return forest, sample, float(threshold)


def judge(counted: DataFrame, model: tuple[list[tuple], int, float] | None) -> DataFrame:
    """``counted`` (with :data:`COUNTS`) with ``base_failed``, ``anomaly`` and ``kept``."""
    counted = counted.withColumn("base_failed", base_failed())
    if model is None:
        return counted.withColumn("anomaly", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    forest, sample, threshold = model
    return with_score(counted, forest, sample).withColumn("kept", ~F.col("base_failed") & (F.round("anomaly", 3) <= F.lit(threshold)))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document doc_id, counts, ``base_failed``, ``anomaly`` and ``kept``; the texts are read once."""
    counted = stage(with_counts(docs, ["doc_id"]), "counts")
    return judge(counted, fit(counted, labels))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged; the texts are read twice and never shuffled."""
    model = fit(with_counts(docs, ["doc_id"]), labels)
    # a NULL text has no words and is never kept
    return judge(with_counts(docs), model).where("kept").select(*docs.columns)
