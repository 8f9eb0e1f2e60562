"""Every stage of the pipeline against plain Python, on its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from boardlake.llm import mixing, quality
from boardlake.llm.common import read, stage
from tests.llm import brute
from tests.llm.test_operators import SHAPE, TEXTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    """The input of each stage and the result of the last."""
    found = [read(spark, SF, "documents")]
    for name, work in corpus_pipeline.STAGES:
        found.append(stage(work(spark, found[-1], SF), name))
    return found


def test_stage_columns(inputs):
    assert all(d.columns == inputs[0].columns for d in inputs[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mix_sources", "shards"]


def test_quality_stage(spark, inputs):
    kept = {r.doc_id for r in inputs[1].collect()}
    for r in inputs[0].collect():
        c = brute.quality_counts(r.text)
        if c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]:
            assert r.doc_id not in kept
    passed = quality.statistics(inputs[0]).filter("NOT base_failed").withColumnRenamed("key", "doc_id").join(read(spark, SF, "labels"), "doc_id").collect()
    clean, junk = ([r.doc_id for r in passed if r.quality == q] for q in (1, 0))
    assert sum(i in kept for i in clean) >= 0.98 * len(clean) and sum(i in kept for i in junk) <= 0.3 * len(junk)


def test_dedup_stage(inputs):
    want = brute.near_duplicates([(r.doc_id, r.text) for r in inputs[1].collect()], 5)
    assert sorted(r.doc_id for r in inputs[2].collect()) == sorted(i for i, (_, root) in want.items() if i == root)


def test_decontamination_stage(spark, inputs):
    import re

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    az = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    grams = set()
    for r in read(spark, SF, "benchmark").collect():
        w = word.findall(r.text.translate(az))
        grams |= {tuple(w[i:i + 10]) for i in range(len(w) - 9)}
    clean = []
    for r in inputs[2].collect():
        w = word.findall(r.text.translate(az))
        if not any(tuple(w[i:i + 10]) in grams for i in range(len(w) - 9)):
            clean.append(r.doc_id)
    assert sorted(r.doc_id for r in inputs[3].collect()) == sorted(clean)


def test_mixing_stage(inputs):
    plan = mixing.schedule(inputs[3], key="doc_id").collect()
    texts = Counter(r.doc_id for r in inputs[4].collect())
    assert set(texts) <= {r.doc_id for r in plan} and max(texts.values()) <= 3
    words, target = Counter(), {r.source: r.target for r in plan}
    longest = Counter()
    for r in plan:
        words[r.source] += texts[r.doc_id] * r["size"]
        longest[r.source] = max(longest[r.source], r["size"])
    assert all(target[s] - longest[s] <= words[s] <= target[s] for s in target)


def test_shard_stage(inputs):
    assert Counter(r.doc_id for r in inputs[5].collect()) == Counter(r.doc_id for r in inputs[4].collect())


def test_odd_rows_pass_through(spark):
    docs = spark.createDataFrame([(i, t, None, s, None, "x", "y", 1, 2, 3, 4) for (i, t), s in zip(TEXTS, ["a", "b", None] * 5)], SHAPE)
    for d in (docs, docs.limit(0)):
        for name, work in corpus_pipeline.STAGES[1:]:
            out = stage(work(spark, d, SF), name)
            if name != "shards":
                assert out.columns == docs.columns
            d = out
    assert corpus_pipeline.quality_rules(spark, docs.limit(0), SF).collect() == []
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()} <= {8, 9, 11}
