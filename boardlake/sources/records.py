"""Capture logs: JSON lines with a header, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA_VERSION = 1

EVENT = (
    "struct<type: string, actor: int, target: int, pai: string, consumed: array<string>, tsumogiri: boolean, bakaze: string, kyoku: int, "
    "honba: int, kyotaku: int, oya: int, dora_marker: string, scores: array<int>, tehais: array<array<string>>, id: int>"
)
RECORD = (
    "seq long, ts double, flow_id string, seat int, last_op_step int, syncing boolean, method string, action_name string, "
    f"raw_liqi string, mjai array<{EVENT}>, screenshot string, meta map<string, string>"
)
RECORD_FIELDS = ["seq", "ts", "flow_id", "seat", "last_op_step", "syncing", "method", "action_name", "raw_liqi", "mjai", "screenshot", "meta"]
# what a line may hold beside the record: the header's version mark
LINE = f"_schema int, {RECORD}"


def _records(lines: DataFrame) -> DataFrame:
    """Drop header lines and fill the defaults of optional fields."""
    header = F.col("_schema").isNotNull() & F.col("seq").isNull() & F.col("mjai").isNull()
    d = lines.filter(~header).drop("_schema")
    return d.withColumns({
        "mjai": F.coalesce("mjai", F.array().cast(d.schema["mjai"].dataType)),
        "meta": F.coalesce("meta", F.create_map().cast("map<string, string>")),
        "syncing": F.coalesce("syncing", F.lit(False))})


def read_records(spark: SparkSession, *paths: str, game: Column | None = None) -> DataFrame:
    """Capture logs as a table; keys the schema does not know are dropped.

    ``game`` is an expression over ``path``, by default the file's stem.
    """
    d = spark.read.schema(LINE).option("mode", "FAILFAST").json(list(paths)).withColumn("path", F.col("_metadata.file_path"))
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1) if game is None else game
    return _records(d.withColumn("game", name)).drop("path")


def as_lines(records: DataFrame) -> DataFrame:
    """One JSON text per record in the log's field order; nulls are written, messages stay nested."""
    cols = [F.try_parse_json(c).alias(c) if c == "raw_liqi" else F.col(c) for c in RECORD_FIELDS if c in records.columns]
    return records.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def write_records(records: DataFrame, path: str) -> None:
    """Header line and one JSON line per record.

    The header may end up in any part file; readers skip it wherever it is.
    """
    head = records.sparkSession.range(1).select(F.lit('{"_schema": %d}' % SCHEMA_VERSION).alias("value"))
    head.unionByName(as_lines(records)).write.text(path)


def unwrap_bytes(raw: Column, path: str) -> Column:
    """Bytes that were wrapped as base64 inside a message."""
    return F.unbase64(F.get_json_object(raw, f"{path}.__bytes_b64__"))


def stream_records(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Growing folder of capture files as a stream of records."""
    r = spark.readStream.schema(LINE)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return _records(r.json(path))


def append_records(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of records to a folder of JSON lines, each record once."""
    return as_lines(records).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True).start()


def monotonic(records: DataFrame) -> DataFrame:
    """Games whose seq does not grow with arrival. Input: ``game, arrival, seq``."""
    from ..operators.ordered import Run, scan, seq_chunk

    d = scan(records, ["game"], ["arrival"], [Run("_top", "max", F.col("seq"), inclusive=False)], seq_chunk("arrival"))
    return d.filter(F.col("seq") <= F.col("_top")).groupBy("game").agg(F.count(F.lit(1)).alias("late"))
