"""Screenshot timing over the log: what gets captured when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.tiles import lit_array, lit_map
from .ordered import Run, greedy_islands, numbered, scan, seq_chunk

OPS_SCHEMA = "data struct<data: struct<operation: struct<seat: int, operationList: array<struct<type: int>>>>>"


def ops_from_record(raw: Column, syncing: Column, seat: Column) -> Column:
    """P10: operation codes a record offers to the hero, else null.

    Null for replayed (syncing) records, records without a message, offers to another seat and
    empty lists.
    """
    op = F.from_json(raw, OPS_SCHEMA)["data"]["data"]["operation"]
    types = F.filter(F.transform(op["operationList"], lambda o: o["type"]), lambda x: x.isNotNull())
    own = op["seat"].isNull() | seat.isNull() | (op["seat"] == seat)
    return F.when(~F.coalesce(syncing, F.lit(False)) & own & (F.size(types) > 0), types)


def buttons_for_ops(ops: Column) -> Column:
    """Button classes on screen from left to right; any button brings the skip button."""
    offered = F.transform(ops, lambda t: lit_map(dims.OP_BUTTON)[t])
    shown = F.filter(lit_array(dims.BUTTON_ORDER), lambda b: F.array_contains(offered, b))
    shown = F.coalesce(shown, F.array().cast("array<string>"))
    return F.when(F.size(shown) > 0, F.concat(shown, F.array(F.lit("btn_skip")))).otherwise(shown)


def opens_window(types: Column, ops: Column, syncing: Column) -> Column:
    """Records worth extra screenshots: a call, or an offer that shows buttons; never a replay."""
    hit = F.coalesce(F.arrays_overlap(types, lit_array(dims.CALL_EVENTS)), F.lit(False))
    return ~F.coalesce(syncing, F.lit(False)) & (hit | (F.size(buttons_for_ops(ops)) > 0))


def deal_suppressed(records: DataFrame, order: str, chunk: Column | None = None) -> DataFrame:
    """Captures are off from a round start until a record with a discard.

    ``capture`` also asks for a board-changing type.  Needs ``types``.
    """
    has = lambda e: F.array_contains("types", e)
    mark = F.when(has("dahai"), False).when(has("start_kyoku"), True)
    d = scan(records, ["game"], [order], [Run("dealing", "last", mark)], seq_chunk(order) if chunk is None else chunk)
    d = d.withColumn("dealing", F.coalesce("dealing", F.lit(False)))
    return d.withColumn("capture", ~F.col("dealing") & F.arrays_overlap("types", lit_array(dims.BOARD_EVENTS)))


def debounce(events: DataFrame, quiet_us: int, cap_us: int, chunk: Column | None = None) -> DataFrame:
    """One capture per quiet spell, or when a burst has run for ``cap_us``.

    Input ``game, seq, ts_us``.  A gap of at least ``quiet_us`` ends a burst.  Inside a burst
    the pending time restarts at the first event after each forced capture; the newest key of
    the pending time is the one captured.
    """
    ch = F.floor(F.col("ts_us") / F.lit(max(cap_us, quiet_us) * 64)) if chunk is None else chunk
    d = greedy_islands(events.select("game", "seq", "ts_us"), ["game"], "ts_us", "seq", quiet_us, cap_us + 1, ch)
    pend = d.groupBy("game", "run", "head_no").agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"), F.max("seq").alias("key"))
    tails = pend.groupBy("game", "run").agg(F.max("head_no").alias("_last"))
    pend = pend.join(tails, ["game", "run"])
    tail = F.col("head_no") == F.col("_last")
    limit, still = F.col("start_us") + cap_us, F.col("last_us") + quiet_us
    return pend.select("game", "key", "start_us", F.when(tail, F.least(still, limit)).otherwise(limit).alias("capture_us"),
                       (~tail | (limit < still)).alias("capped"))


def extra_shots(armed: DataFrame, offsets_ms: list[int], chunk: Column | None = None) -> DataFrame:
    """Planned extra screenshots; the next record cancels what has not fired yet.

    Input ``game, seq, ts_us, window``; rows with ``window = false`` only cancel.
    """
    d = scan(armed, ["game"], ["seq"], [Run("_next", "next", F.col("ts_us"), inclusive=False)],
             seq_chunk() if chunk is None else chunk)
    d = d.filter("window").withColumn("offset_ms", F.explode(F.array(*[F.lit(o) for o in sorted(offsets_ms)])))
    fires = F.col("ts_us") + F.col("offset_ms").cast("long") * 1000
    return d.filter(F.col("_next").isNull() | (fires < F.col("_next"))).select(
        "game", "seq", "offset_ms", fires.alias("fire_us"))


def spread_sample(df: DataFrame, keys: list[str], order: list[str], k: int, chunk: Column | None,
                  ends: bool = False) -> DataFrame:
    """K evenly spaced rows of each group, or all rows of groups that have no more.

    Default picks rank ``floor(i * n / k)``; ``ends=True`` spreads from the first to the last row.
    """
    d = numbered(df, keys, order, chunk, "_rn", "_n").withColumn("_rn", F.col("_rn") - 1)
    sizes = d.groupBy(*keys).agg(F.max("_n").alias("_n")).filter(F.col("_n") > k)
    i, n = F.col("_i"), F.col("_n").cast("double")
    rank = F.floor(i * ((n - 1) / (k - 1))) if ends else F.floor(i * (n / k))
    if ends:
        rank = F.when(i == k - 1, F.col("_n") - 1).otherwise(rank)
    picks = sizes.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) \
        .select(*keys, rank.cast("long").alias("_rn")).distinct()
    small = d.filter(F.col("_n") <= k)
    big = d.filter(F.col("_n") > k).join(picks, keys + ["_rn"], "left_semi").select(*d.columns)
    return small.unionByName(big).drop("_rn", "_n")


def as_of(left: DataFrame, right: DataFrame, key: str, on: str, payload: list[str], chunk: Column | None = None) -> DataFrame:
    """The newest ``right`` row at or before each ``left`` row; a null payload also counts.

    Both sides meet in one ordered scan instead of a range join.
    """
    pay = F.struct(*payload)
    l_cols = [c for c in left.columns if c not in (key, on)]
    a = left.select(key, on, F.lit(1).alias("_side"), F.struct(*l_cols).alias("_left"),
                    F.lit(None).cast(right.select(pay.alias("p")).schema["p"].dataType).alias("_right"))
    b = right.select(key, on, F.lit(0).alias("_side"),
                     F.lit(None).cast(left.select(F.struct(*l_cols).alias("p")).schema["p"].dataType).alias("_left"),
                     pay.alias("_right"))
    d = scan(a.unionByName(b), [key], [on, "_side"], [Run("_hit", "last", F.col("_right"))],
             seq_chunk(on) if chunk is None else chunk)
    return d.filter(F.col("_side") == 1).select(key, on, *[F.col(f"_left.{c}").alias(c) for c in l_cols],
                                                *[F.col(f"_hit.{c}").alias(c) for c in payload])


def successor_rescue(states: DataFrame, zones: list[str], chunk: Column | None = None) -> DataFrame:
    """Use the next state where only the hero's draw was still missing in the log.

    Input per (game, seq): ``gt`` and ``obs`` structs with ``drawn`` and the zones, ``open``.
    """
    nxt = F.struct("gt", "open")
    d = scan(states, ["game"], ["seq"], [Run("_next", "next", nxt, inclusive=False)],
             seq_chunk() if chunk is None else chunk)
    same = F.lit(True)
    for z in zones:
        same = same & F.col(f"obs.{z}").eqNullSafe(F.col(f"_next.gt.{z}"))
    swap = F.coalesce(F.col("gt.drawn").isNull() & F.col("obs.drawn").isNotNull() & F.col("_next.open")
                      & (F.col("_next.gt.drawn") == F.col("obs.drawn")) & same, F.lit(False))
    return d.withColumns({"rescued": swap, "gt": F.when(swap, F.col("_next.gt")).otherwise(F.col("gt"))}).drop("_next")


def stable_rows(frames: DataFrame, keys: list[str], order: list[str], limit: float, chunk: Column | None) -> DataFrame:
    """Distance of each vector to the one before, and whether it stands still."""
    from .vectors import mean_abs_diff

    d = scan(frames, keys, order, [Run("_prev", "last", F.col("v"), inclusive=False)], chunk)
    d = d.withColumn("dist", F.when(F.col("_prev").isNotNull(), mean_abs_diff(F.col("v"), F.col("_prev")))).drop("_prev")
    return d.withColumn("stable", F.coalesce(F.col("dist") <= limit, F.lit(False)))


def first_stable(stable: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The first row of each key that stands still; null if none does."""
    return stable.groupBy(*keys).agg(F.min(F.when(F.col("stable"), F.col(at))).alias("first_stable"))


def sync_report(changing: DataFrame, frames: DataFrame) -> DataFrame:
    """A1: frame counts by status and how many board changes have a saved frame, per game."""
    stat = frames.groupBy("game").agg(
        F.count(F.lit(1)).alias("frames"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "timeout", "extra", "no_capture")])
    saved = frames.filter(F.col("file").isNotNull()).select("game", "seq").distinct().withColumn("_saved", F.lit(1))
    cov = changing.select("game", "seq").distinct().join(saved, ["game", "seq"], "left") \
        .groupBy("game").agg(F.count(F.lit(1)).alias("changing"), F.count("_saved").alias("covered"))
    out = cov.join(stat, "game", "full_outer").na.fill(0)
    pct = F.expr("(100 * covered) div greatest(1, changing)")
    return out.withColumn("covered_pct", pct)


def offer_inventory(offers: DataFrame, frames: DataFrame) -> DataFrame:
    """A2: offers, records with buttons, those with a frame and per-button counts; per game and in total.

    ``offers`` has ``game, seq, ops``; totals have a null game.
    """
    saved = frames.filter(F.col("status").isin("ok", "timeout") & F.col("file").isNotNull()) \
        .select("game", "seq").distinct().withColumn("_framed", F.lit(True))
    d = offers.join(saved, ["game", "seq"], "left").withColumn("btn", buttons_for_ops(F.col("ops")))
    shown = (F.size("btn") > 0)
    framed = shown & F.coalesce(F.col("_framed"), F.lit(False))
    per = [F.count_if(framed & F.array_contains("btn", b)).alias(b) for b in dims.BUTTON_ORDER + ["btn_skip"]]
    return d.rollup("game").agg(F.count_if(F.col("ops").isNotNull()).alias("offers"),
                                F.count_if(shown).alias("with_buttons"), F.count_if(framed).alias("with_frame"), *per)
