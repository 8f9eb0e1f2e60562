"""Null and repeated ids in the pipeline: no row is lost outside a stage's own decision."""

from collections import Counter

import corpus_pipeline

SHAPE = "doc_id long, text string, source string"
WORDS = " ".join(f"w{i}" for i in range(10))


def test_equal_rows_are_queued_as_often_as_they_come(spark):
    # four equal rows without an id, the same text in another source: every source weighs what it has
    rows = [(None, WORDS, "a")] * 4 + [(None, WORDS, "b")] * 8 + [(None, "", "a")]
    out = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, SHAPE), "")
    assert Counter(r.source for r in out.collect()) == {"a": 4, "b": 8}  # targets 40 and 80 of 120 words


def test_a_null_is_not_another_columns_null(spark):
    rows = [(1, WORDS, None, "x"), (1, WORDS, "x", None)]
    out = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), "")
    assert [(r.source, r.lang) for r in out.collect()] == [(None, "x")]  # targets 6.7 and 13.3 of 20 words; as one row it would come twice


def test_unlike_texts_under_one_id_stay(spark):
    other = " ".join(f"v{i}" for i in range(10))
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(1, WORDS, "a"), (1, other, "a"), (1, WORDS, "a"), (2, other, "b"), (3, near, "a"), (3, near + " tail", "b"), (None, WORDS, "a"), (None, WORDS, "a")]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SHAPE), "").collect()
    found = Counter((r.doc_id, r.text) for r in out)
    assert found[1, WORDS] == 1 and found[1, other] == 1 and (2, other) not in found
    assert sum(n for (i, _), n in found.items() if i == 3) == 1 and found[None, WORDS] == 2
