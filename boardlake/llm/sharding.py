"""Contiguous balanced shards from global prefix sums of byte sizes.

Rows are dealt into ranges of their key, each range is summed, the range totals are scanned, and
a row's place is its range's offset plus a running sum inside the range. A row goes to the shard
in which the middle of its bytes falls, so shards are contiguous in key order and every shard's
bytes differ from the equal target by less than one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

OVERHEAD = 8


def shard(docs: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    Null text counts as empty (size 8, checksum 0); a null key comes first. Repeated rows are kept
    and placed one after the other. An empty table gives no rows. Other columns are not read, so
    their names cannot clash. ``ranges`` (default: the session's shuffle partitions) changes no
    result. ``law`` is ``bytes``; ``grown_shard`` is null as every cut moves with the total.
    """
    spark = docs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    # The range of a row is written down once: a rerun of lost tasks cannot deal it elsewhere.
    dealt = stage(rows.repartitionByRange(n, F.col(key).asc_nulls_first(), "text_crc32", "size")
                  .withColumn("range", F.spark_partition_id()), "shard-ranges")
    scan = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    offsets = (totals.withColumn("bytes_before", F.coalesce(F.sum("b").over(scan), F.lit(0)))
               .withColumn("rows_before", F.coalesce(F.sum("n").over(scan), F.lit(0)))
               .withColumn("total", F.sum("b").over(Window.partitionBy())).drop("b", "n"))
    # one row per range: as many as the session has shuffle partitions
    inside = Window.partitionBy("range").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    placed = (dealt.join(F.broadcast(offsets), "range")
              .withColumn("end", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("place", F.col("rows_before") + F.row_number().over(inside) - 1)
              .withColumn("shard", F.expr(f"cast((2 * end - size) * {n_shards} div (2 * total) as int)")))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return (placed.join(F.broadcast(first), "shard")  # one row per shard
            .select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
