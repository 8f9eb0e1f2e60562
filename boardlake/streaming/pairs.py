"""Stateful joins, duplicates and counters over the live log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_offers(records: DataFrame, watermark: str) -> DataFrame:
    """Each (flow_id, seq) once, replayed (syncing) records left out.

    Input has a timestamp ``ts``.
    """
    live = records.filter(~F.coalesce("syncing", F.lit(False)))
    return live.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["flow_id", "seq"])


def capture_counters(frames: DataFrame, watermark: str, width: str) -> DataFrame:
    """Captures by status in time windows."""
    w = F.window("ts", width)
    d = frames.withWatermark("ts", watermark).groupBy(w, "status").agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.unix_micros(F.col("window.start")).alias("start_us"), "status", "n")


def pair_frames(records: DataFrame, frames: DataFrame, watermark: str, within: str) -> DataFrame:
    """Frames with the record that caused them; a frame comes at most ``within`` after it.

    Both inputs have ``game, seq, ts``.
    """
    r = records.withWatermark("ts", watermark).alias("r")
    f = frames.withWatermark("ts", watermark).alias("f")
    on = F.expr(f"r.game = f.game AND r.seq = f.seq AND f.ts >= r.ts AND f.ts <= r.ts + INTERVAL {within}")
    return r.join(f, on).select("r.game", "r.seq", (F.unix_micros(F.col("f.ts")) - F.unix_micros(F.col("r.ts"))).alias("dt_us"),
                                *[F.col(f"f.{c}") for c in frames.columns if c not in ("game", "seq", "ts")])
