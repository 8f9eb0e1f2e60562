"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; `run` writes
each result as Parquet and reads it again. All stages but the last return the columns of docs.
Null and repeated ids do no harm. Quality rules and decontamination tell rows apart by a 128-bit hash of id and
text: rows that agree in both share each decision. Near-dedup and mixing tell them apart by all columns. Very long texts are read
whole. Columns of any names may stand beside those of documents; the stages choose free names for their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.llm import decontaminate, dedup, mixing, quality, sharding
from boardlake.llm.common import read, row_key, stage


def _free(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _row(*cols: str) -> Column:
    """128-bit hash of columns; a null hashes to nothing, so it says which are null."""
    return row_key(*[F.col(c) for c in cols], *[F.col(c).isNull() for c in cols])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the isolation forest does not reject."""
    row = _free(docs, "row")
    tagged = docs.withColumn(row, _row("doc_id", "text"))
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    marks = tagged.select("doc_id", row).join(labels, "doc_id").select(F.col(row).alias("doc_id"), "quality")
    kept = quality.judge(tagged, marks, key=row).filter("kept").select(row)
    return tagged.join(kept, row, "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group (five-word shingles, similarity 0.8). Unlike texts
    under one id are documents of their own; equal rows are one. Rows without an id stay."""
    row = _free(docs, "row")
    tagged = docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", _row(*docs.columns).alias("row"))))
    kept = dedup.near_duplicates(tagged.select(row, "text"), key=row, words=5).filter(F.col("kept") & F.col(row).isNotNull()).select(row)
    own = tagged.filter(F.col(row).isNotNull()).join(kept, row, "left_semi").dropDuplicates([row])
    return own.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    row = _free(docs, "row")
    tagged = docs.withColumn(row, _row("doc_id", "text"))
    hit = decontaminate.contamination(tagged.select(row, "text"), read(spark, sf_dir, "benchmark"), key=row).filter("contaminated").select(row)
    return tagged.join(hit, row, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them: rows repeat, and some documents go. Equal rows are
    counted and queued as often as they come."""
    row, count = _free(docs, "row"), _free(docs, "count")
    tagged = docs.withColumn(row, _row(*docs.columns)).groupBy(row).agg(F.count(F.lit(1)).alias(count), *[F.first(c).alias(c) for c in docs.columns])
    plan = mixing.schedule(tagged.select(row, "text", "source", count), key=row, count=count)
    copies = mixing.mix(plan, whole=True).select(row, F.explode(F.sequence(F.lit(1), F.expr("words div (size div rows)"))).alias(count)).select(row)
    return tagged.join(copies, row).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contiguous shards of equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("mix_sources", mix_sources), ("shards", shards)]

#: SQL can't express the forest's random splits; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = read(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), name)
    return docs
