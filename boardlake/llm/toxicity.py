"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(grade > k) = sigmoid(w . x - t_k) with one weight per word for all thresholds t_1 < t_2 < ..; the
expected severity is the sum of these over k. Features are words, and how many different words
start with a stem (insults are inflected); those that differ most between toxic and other
labelled rows are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt

#: Labelled rows the model is fitted on: at most so many toxic and so many other ones.
MAX_TOXIC, MAX_CLEAN = 3000, 6000
FEATURES = 1000
LEAST_Z = 3.0
GRADES = 3
STEPS = 400
PENALTY = 1e-3
_LETTER = bt.table(lambda b: b >= 128 or 97 <= b <= 122 or 48 <= b <= 57)
#: Bytes of a stem, and the numbers of different words from which on a stem is a feature.
STEMS = (5, 6, 7)
LEVELS = (1, 2, 3, 5)
_LOW = np.uint64(7)  # the level's place; the rest of a feature names its word or stem


def features(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, text index): words of A-Z lower-cased letters, digits and bytes beyond ASCII,
    and stems by the number of different words they start. ``known``: keep these features only."""
    data = bt.LOWER[data]
    starts, ends, owner = bt.spans(_LETTER[data], offsets)
    prefix = bt.prefix_hash(data)
    word = bt.span_hash(prefix, starts, ends)
    quick = None
    if known is not None:
        bases = np.unique(known & ~_LOW)
        quick = np.zeros(1 << 16, bool)
        quick[bases >> np.uint64(48)] = True

    def some(h: np.ndarray) -> np.ndarray:
        """Places of the hashes that known features name."""
        if quick is None:
            return np.arange(len(h))
        at = np.flatnonzero(quick[h >> np.uint64(48)])
        return at[np.isin(h[at], bases)]

    base = bt.mix(word) & ~_LOW
    at = some(base)
    found = [(base[at], owner[at])]
    for n in STEMS:
        long = np.flatnonzero(ends - starts >= n)
        stem = bt.mix(bt.span_hash(prefix, starts[long], starts[long] + n) ^ np.uint64(n)) & ~_LOW
        at = some(stem)
        of, stem, whole = owner[long[at]], stem[at], word[long[at]]
        order = np.lexsort((whole, stem, of))
        of, stem, whole = of[order], stem[order], whole[order]
        if not len(of):
            continue
        group = np.ones(len(of), bool)
        group[1:] = (of[1:] != of[:-1]) | (stem[1:] != stem[:-1])
        new = group.copy()
        new[1:] |= whole[1:] != whole[:-1]
        first = np.flatnonzero(group)
        count = np.add.reduceat(new.astype(np.int64), first)
        for place, least in enumerate(LEVELS, 1):
            at = first[count >= least]
            found.append((stem[at] | np.uint64(place), of[at]))
    h, of = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], of[new]


@dataclass
class Model:
    """Sorted features, their weights, and ascending thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """w . x of each text."""
        out = np.zeros(len(offsets) - 1)
        if len(self.words):
            h, of = features(data, offsets, self.words)
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            np.add.at(out, of[hit], self.weights[at[hit]])
        return out

    def above(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.thresholds[None, :], -30, 30)))


def _feature_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in bt.blocks(batch, "text"):
            h, of = features(*bt.texts(b, "text"))
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=b.num_rows))])
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), bt.signed(h))], ["toxic", "words"])


def select_words(toxic: list[np.ndarray], clean: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, z) of the words whose share of rows differs most: log odds ratio over its deviation."""
    every = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (toxic, clean)]
    words = np.unique(np.concatenate(every))
    count = []
    for x in every:
        n = np.zeros(len(words))
        w, c = np.unique(x, return_counts=True)
        n[np.searchsorted(words, w)] = c
        count.append(n)
    (a, b), p, n = count, len(toxic), len(clean)
    odds = np.log((a + 0.5) / (p - a + 0.5)) - np.log((b + 0.5) / (n - b + 0.5))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (p - a + 0.5) + 1 / (b + 0.5) + 1 / (n - b + 0.5))
    keep = np.flatnonzero(np.abs(z) >= LEAST_Z)
    keep = np.sort(keep[np.argsort(-np.abs(z[keep]), kind="stable")[:FEATURES]])
    return words[keep], z[keep]


def fit_ordinal(x: np.ndarray, grade: np.ndarray, levels: int, steps: int = STEPS, rate: float = 0.1, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on the mean log loss with a quadratic penalty; gaps between
    thresholds are kept positive by their logarithm."""
    w = np.zeros(x.shape[1])
    share = [np.clip((grade > k).mean(), 1e-3, 1 - 1e-3) for k in range(levels)]
    t = -np.log(np.array(share) / (1 - np.array(share)))
    raw = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    p = np.concatenate([w, raw])
    m, v = np.zeros_like(p), np.zeros_like(p)
    d = x.shape[1]
    for step in range(1, steps + 1):
        gaps = np.exp(np.clip(p[d + 1:], -10, 5))
        t = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        cum = 1 / (1 + np.exp(-np.clip((x @ p[:d])[:, None] - t[None, :], -30, 30)))  # P(grade > k)
        up = np.concatenate([np.ones((len(x), 1)), cum], axis=1)
        down = np.concatenate([cum, np.zeros((len(x), 1))], axis=1)
        rows = np.arange(len(x))
        prob = np.maximum(up[rows, grade] - down[rows, grade], 1e-9)
        slope = cum * (1 - cum)
        dm = np.zeros((len(x), levels))
        has_low = grade > 0
        dm[rows[has_low], grade[has_low] - 1] += slope[rows[has_low], grade[has_low] - 1] / prob[has_low]
        has_high = grade < levels
        dm[rows[has_high], grade[has_high]] -= slope[rows[has_high], grade[has_high]] / prob[has_high]
        dm = -dm / len(x)
        gt = -dm.sum(0)
        grad = np.concatenate([x.T @ dm.sum(1) + penalty * p[:d], [gt.sum()], np.array([gt[k + 1:].sum() * gaps[k] for k in range(levels - 1)])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        p = p - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(p[d + 1:], -10, 5)))])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", levels: int = GRADES) -> Model:
    """Fit on the labelled rows with the smallest hashed keys, ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` others.

    Labels tell toxic from clean only; a toxic row's grade, 1 to ``levels``, is the rank of its
    summed evidence (z of the selected words that speak for toxicity), in equal parts. Without
    toxic or without clean labelled rows the model has no words and finds nothing.
    """
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    chosen = [marks.filter(F.col("toxic") == v).orderBy(F.xxhash64("id"), "id").limit(n) for v, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    picked = F.broadcast(chosen[0].union(chosen[1]))  # at most MAX_TOXIC + MAX_CLEAN rows
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(picked, "id").select("toxic", "text")
    sample = rows.mapInArrow(_feature_lists, "toxic int, words array<long>").toArrow()  # bounded as above
    sets = {0: [], 1: []}
    for t, w in zip(sample.column("toxic").to_pylist(), sample.column("words")):
        sets[t].append(np.asarray(w.values).view(np.uint64) if len(w) else np.zeros(0, np.uint64))
    if not sets[0] or not sets[1]:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(levels, 10.0))
    words, z = select_words(sets[1], sets[0])
    if not len(words):
        return Model(words, np.zeros(0), np.full(levels, 10.0))

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), len(words)), np.float32)
        for i, r in enumerate(rows):
            at = np.minimum(np.searchsorted(words, r), len(words) - 1)
            x[i, at[words[at] == r]] = 1
        return x

    x1, x0 = matrix(sets[1]), matrix(sets[0])
    evidence = x1 @ np.maximum(z, 0)
    grade = np.concatenate([np.argsort(np.argsort(evidence, kind="stable"), kind="stable") * levels // len(x1) + 1, np.zeros(len(x0), int)]).astype(int)
    w, t = fit_ordinal(np.concatenate([x1, x0]).astype(float), grade, levels)
    return Model(words, w, t)


def severity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, severity, grade, toxic), one row per document, over whole texts.

    ``severity`` is the expected grade; ``grade`` the number of thresholds passed with probability
    above one half; ``toxic`` whether the first is. Null and empty texts have no words: their
    severity is that of a text without evidence, and they aren't toxic unless most labelled rows
    are. Repeated rows, ties and null keys give a row each; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in bt.blocks(batch, "text"):
                p = model.above(model.margins(*bt.texts(b, "text")))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(p.sum(1)), pa.array((p > 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] > 0.5)],
                                                 ["id", "severity", "grade", "toxic"])

    return rows.mapInArrow(run, f"id {kind}, severity double, grade int, toxic boolean").withColumnRenamed("id", key)
