"""Run streams over a growing folder and read what they wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import fresh_path


def source(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files of a folder as a stream; each run takes the files that came since the last one."""
    return spark.readStream.schema(schema).parquet(path)


#: State store that keeps several states per key, as `board_stream` needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"


def drain(stream: DataFrame, out: str, checkpoint: str, apart: str | None = None, store: str | None = None) -> None:
    """Process everything available and append it to a Parquet table, each result once.

    Rows that differ in ``apart`` go to folders of their own. ``store`` is the state store of this query only.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_STORE_CONF, None)
    sink = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    sink = sink.partitionBy(apart) if apart else sink
    try:
        if store:
            spark.conf.set(_STORE_CONF, store)
        q = sink.outputMode("append").trigger(availableNow=True).start()
    finally:
        if store:
            spark.conf.set(_STORE_CONF, before) if before else spark.conf.unset(_STORE_CONF)
    q.awaitTermination()


def drain_growing(slices: list[tuple[DataFrame, ...]], build: Callable[..., DataFrame], name: str, apart: str | None = None, store: str | None = None) -> DataFrame:
    """Let one or more sources grow slice by slice and stream each slice as it lands.

    ``build`` gets one stream per source.  Every slice is a micro-batch of its own; state and
    progress live in a checkpoint in the shared folder, so a run can stop after any slice.
    """
    spark = slices[0][0].sparkSession
    paths = [fresh_path(spark, f"{name}-in{i}") for i in range(len(slices[0]))]
    out, check = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    schema = None
    for parts in slices:
        for part, path in zip(parts, paths):
            part.write.mode("append").parquet(path)
        stream = build(*[source(spark, path, part.schema) for part, path in zip(parts, paths)])
        schema = stream.schema
        drain(stream, out, check, apart, store)
    return spark.read.schema(schema).parquet(out)
