"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, dedup, merkle, mixing, quality, recompress, secrets, sharding, substrings, toxicity, urls, warc
from .common import fresh_path, read
from .sql import ORACLES

#: The rules that `op3_url_filters` applies, (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


#: Folder of the public tokenizer files that `op13_cross_tokenizer_alignment` reads.
TOKENIZERS = "/opt/tokenizers"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(read(spark, sf_dir, "documents"), words=2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.schedule(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(read(spark, sf_dir, "pages"), rules)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(read(spark, sf_dir, "pages"), fresh_path(spark, "archives"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(read(spark, sf_dir, "documents")).drop("spans")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), 24)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    listed = secrets.joined(F.col("spans"))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 2 == 0)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.repeats(read(spark, sf_dir, "documents")).drop("spans")


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(read(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash_near_dedup, op2_mixing, op3_url_filters, op4_toxicity, op5_warc, op6_quality_rules, op7_suffix_array_dedup, op8_decontamination, op9_sharding, op10_secret_scans,
                              op11_merkle_manifest, op12_substring_dedup, op13_cross_tokenizer_alignment)}

__all__ = ["ORACLES", "QUERIES"]
