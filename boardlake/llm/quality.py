"""Quality rules: an isolation forest over rule statistics.

Each text gives counts (words, symbols, repeated lines, repeated word windows, ..) and from them
rates. Random splits of those rates isolate odd documents after few steps; the mean path length
over all trees gives a score, and labelled rows set the score from which a document is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import stage

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines"]
FEATURES = ["symbols", "upper_rate", "word_length"]
_SYMBOL = bt.table(lambda b: b in b"#*$%&|<>")
_UPPER = bt.table(lambda b: 65 <= b <= 90)
_MARK = bt.table(lambda b: b in b"!?.,;:")
_START = bt.table(lambda b: (b & 0xC0) != 0x80)
_NOT_NEWLINE = bt.table(lambda b: b != 10)
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
TREES = 100
#: Rows per tree; the forest is fitted on at most TREES * ROWS_PER_TREE rows, whatever the input.
ROWS_PER_TREE = 256
#: Rows labelled bad per row labelled good in the fitting sample: few enough to stay odd.
ODD_SHARE = 0.015
#: Share of good labelled rows that the calibrated threshold may reject.
CLEAN_LOSS = 0.002
BINS = 2000


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of many texts at once; see `bytetext` for the layout."""
    n = len(offsets) - 1
    word = bt.SPACED[data]
    starts, ends, owner = bt.spans(word, offsets)
    out = {"n_words": np.bincount(owner, minlength=n), "word_chars": bt.per_text(word & _START[data], offsets)}
    out["n_symbols"] = bt.per_text(_SYMBOL[data], offsets)
    out["n_upper"] = bt.per_text(_UPPER[data], offsets)
    out["n_marks"] = bt.per_text(_MARK[data], offsets)
    ls, le, lo = bt.spans(_NOT_NEWLINE[data], offsets)
    words_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(word, out=words_before[1:])
    full = words_before[le] > words_before[ls]
    lines, of = bt.block_hash(data, ls[full], le[full]), lo[full]
    order = np.lexsort((lines, of))
    again = (lines[order][1:] == lines[order][:-1]) & (of[order][1:] == of[order][:-1])
    out["n_lines"] = np.bincount(of, minlength=n)
    out["n_dup_lines"] = np.bincount(of[order][1:][again], minlength=n)
    hashes = bt.block_hash(data, starts, ends)
    at, grams = bt.grams(hashes, owner, 3)
    grams = bt.mix(grams ^ bt.mix(owner[at].astype(np.uint64) + np.uint64(1)))  # windows of different texts differ
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(starts) + 2, bool)
    for j in range(3):
        covered[at[twice] + j] = True
    out["n_repeat_words"] = np.bincount(owner[covered[:len(starts)]], minlength=n)
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in bt.blocks(batch, "text"):
            counts = text_counts(*bt.texts(b, "text"))
            keep = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "text"]
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(keep + [pa.array(counts[c].astype(np.int64)) for c in COUNTS], names + COUNTS)


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts, ``base_failed``), one row per document, over whole texts; null counts as empty."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(_count_batches, f"key {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def rates() -> list[Column]:
    """The features of the forest, from the counts."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    values = [1 - F.exp(-4 * per("n_symbols", "n_words")), per("n_upper", "word_chars"), per("word_chars", "n_words")]
    return [v.alias(name) for v, name in zip(values, FEATURES)]


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), (n == 2).astype(float))


class Forest:
    """Isolation trees as arrays: node 2i + 1 and 2i + 2 are the children of node i."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, per_tree: int = ROWS_PER_TREE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rows = min(per_tree, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(self.rows, 2)))))
        n = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((trees, n), np.int16)
        self.cut = np.full((trees, n), np.inf)
        self.leaf = np.full((trees, n), -1.0)
        for t in range(trees):
            some = rows[rng.permutation(len(rows))[:self.rows]]
            todo = [(0, some, 0)]
            while todo:
                i, x, d = todo.pop()
                lo, hi = (x.min(0), x.max(0)) if len(x) else (np.zeros(rows.shape[1]), np.zeros(rows.shape[1]))
                ways = np.flatnonzero(hi > lo)
                if d == self.depth or len(ways) == 0:
                    self.leaf[t, i] = d + float(expected_path(np.array(len(x))))
                    continue
                f = int(rng.choice(ways))
                c = float(rng.uniform(lo[f], hi[f]))
                self.feature[t, i], self.cut[t, i] = f, c
                left = x[:, f] <= c
                todo += [(2 * i + 1, x[left], d + 1), (2 * i + 2, x[~left], d + 1)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (- mean path / expected path): near 1 is odd, below 0.5 is usual."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = leaf[at] < 0
                at = np.where(inner, 2 * at + 1 + (x[every, feature[at]] > cut[at]), at)
            total += leaf[at]
        return 2.0 ** (-total / len(self.leaf) / max(float(expected_path(np.array(self.rows))), 1e-9))


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", trees: int = TREES, per_tree: int = ROWS_PER_TREE) -> Forest | None:
    """A forest on labelled rows that pass the base rules: of the good ones those with the smallest
    hashed keys, ``trees * per_tree`` at most, and ``ODD_SHARE`` as many bad ones. Without good
    labelled rows it takes any rows; None if there are none."""
    usable = stats.filter(~F.col("base_failed"))

    def sample(rows: DataFrame, most: int) -> list:
        return rows.orderBy(F.xxhash64("key"), *COUNTS).limit(most).select(*rates()).collect()

    marks = labels.groupBy(F.col(key).alias("key")).agg(F.min(label).alias("mark"))
    known = usable.join(marks, "key")
    good = sample(known.filter("mark = 1"), trees * per_tree)
    rows = good + sample(known.filter("mark = 0"), max(3, round(ODD_SHARE * len(good)))) if good else sample(usable, trees * per_tree)
    return Forest(np.array(rows, float), trees, per_tree) if rows else None


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """Add the forest's ``score`` to the statistics."""
    wide = stats.select(*stats.columns, *rates())
    names = stats.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([np.asarray(b.column(c), float) for c in FEATURES]) if b.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(forest.score(x))], [*names, "score"])

    return wide.mapInArrow(run, stats.select(*names, F.lit(0.0).alias("score")).schema)


def threshold(scores: DataFrame, labels: DataFrame, loss: float = CLEAN_LOSS, key: str = "doc_id", label: str = "quality") -> float:
    """The smallest score that rejects at most ``loss`` of the labelled good rows (those that pass the
    base rules), from a histogram over all labelled rows. Without good labelled rows: 1, nothing rejected."""
    good = labels.filter(F.col(label) == 1).select(F.col(key).alias("key")).distinct()
    bins = (scores.filter(~F.col("base_failed")).join(good, "key").groupBy(F.floor(F.col("score") * BINS).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")).collect())  # at most BINS + 1 rows
    total, over = sum(r.n for r in bins), 0
    if not total:
        return 1.0
    for r in sorted(bins, key=lambda r: -r.bin):
        over += r.n
        if over > loss * total:
            return (r.bin + 1) / BINS
    return 0.0


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts, ``base_failed``, ``score``, ``kept``), one row per document.

    A document is kept if it passes the base rules (MIN_WORDS words, not more than MAX_REPEAT_PCT % of
    them in repeated windows) and its score is below the threshold calibrated on ``labels``.
    Null, empty and one-word texts fail the base rules; they, repeated rows and null keys each give
    a row. Without documents that pass, scores are 0; without good labels nothing more is rejected.
    Only key and text are read of ``docs``; other columns may have any names.
    """
    stats = stage(statistics(docs, key, text), "quality-statistics")
    forest = fit(stats, labels)
    if forest is None:
        return stats.withColumn("score", F.lit(0.0)).withColumn("kept", ~F.col("base_failed")).withColumnRenamed("key", key)
    scores = scored(stats, forest)
    cut = threshold(scores, labels)
    return scores.withColumn("kept", ~F.col("base_failed") & (F.col("score") < cut)).withColumnRenamed("key", key)
