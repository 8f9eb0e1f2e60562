"""Queries for the streaming operators (S19, G1-G6): the log lands in slices and is streamed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capture as C
from ..session import fresh_path
from ..sources import records as RC
from ..streaming import pairs as P
from ..streaming import board_stream, replay_stream, timers
from ..streaming.run import STORE, drain_growing
from . import q_board as QB
from . import q_sequences as QS
from .q_sources import log_records
from .registry import ORACLES, query

ROWS_PER_SLICE = 2_000_000  # what one micro-batch may bring to a game's state
ROWS_PER_CALL = 16_384  # what a shelf of games should bring to one call


def _slices(d, extra: list | None = None, lag: bool = False):
    """The table in log order, cut into micro-batches of bounded size; with ``lag`` every other game
    comes one slice later than the others. Written once, a folder per slice."""
    b = d.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    k = max(3, -(-b["n"] // ROWS_PER_SLICE))
    step = (b["hi"] - b["lo"]) // k + 1
    no = F.floor((F.col("seq") - b["lo"]) / step) + (F.col("game") % 2 if lag else 0)
    path = fresh_path(d.sparkSession, "slices")
    d.withColumn("_slice", no.cast("int")).write.partitionBy("_slice").parquet(path)
    cut = d.sparkSession.read.parquet(path)
    return [cut.filter(F.col("_slice") == i).drop("_slice") for i in range(k + lag)] + (extra or [])


def _shelf(d, slices: list) -> int:
    """Games to a shelf: fewer where a game brings many rows to a slice, so that such games stay apart."""
    n, games = d.agg(F.count(F.lit(1)), F.approx_count_distinct("game")).first()
    return max(1, min(timers.SHELF, ROWS_PER_CALL * games * len(slices) // max(n, 1)))


def _ts(us):
    return F.timestamp_micros(us)


@query("s19_record_stream", "SELECT CAST(game AS VARCHAR) AS flow_id, rec AS seq, count(*) AS n_events FROM ev GROUP BY ALL")
def s19(t):
    root = fresh_path(t.spark, "live")
    RC.write_records(log_records(t), root + "/in")
    out = root + "/out"
    RC.append_records(RC.stream_records(t.spark, root + "/in"), out, root + "/checkpoint").awaitTermination()
    return RC.read_records(t.spark, out).select("flow_id", "seq", F.size("mjai").cast("long").alias("n_events"))


def _g1_sql() -> str:
    sql = QS._w2_sql()
    seats = lambda c: ", ".join(f"{c}_{s}" for s in range(4))
    return f"""WITH w2 AS ({sql}) SELECT w2.game, w2.seq, w2.kyoku_ord, {seats('concealed')}, {seats('score')}, {seats('reach')}, sticks, n_dora, owed FROM w2 JOIN owe USING (game, seq)"""


@query("g1_live_replay", _g1_sql())
def g1(t):
    d = t.mj.select("game", "seq", "ev_idx", "type", "actor", F.size("consumed").alias("n_consumed"), "kyotaku", "scores")
    slices = _slices(d)
    shelf = _shelf(d, slices)
    out = drain_growing([(p,) for p in slices], lambda s: replay_stream.replay(s, shelf), "snapshots").filter(~F.col("late"))
    per = [F.col(src)[s].alias(f"{name}_{s}") for src, name in (("concealed", "concealed"), ("scores", "score"), ("reach", "reach")) for s in range(4)]
    return out.select("game", "seq", "kyoku_ord", *per, "sticks", "n_dora", "owed")


@query("g1_live_boards", ORACLES["g1_board_states"])
def g1_boards(t):
    """The batch states of every record, from a log that lands in slices."""
    slices = _slices(t.mj)
    shelf = _shelf(t.mj, slices)
    out = drain_growing([(p,) for p in slices], lambda s: board_stream.boards(s, 0, shelf), "boards", apart="late", store=STORE)
    return QB.texts(out.filter("NOT late"))


def _end(d):
    """A row per game that closes it."""
    top = d.agg((F.max("ts_us") + 10 * QS.CAP).alias("ts_us"), (F.max("seq") + 1).alias("seq"))
    return d.select("game").distinct().crossJoin(F.broadcast(top)).select("game", "seq", "ts_us").withColumn("closing", F.lit(True))  # one row


@query("g2_live_debounce", ORACLES["w11_debounce"])
def g2(t):
    d = t.ev.select("game", "seq", "ts_us", F.lit(False).alias("closing"))
    parts = [(p,) for p in _slices(d, [_end(d)], lag=True)]
    out = drain_growing(parts, lambda s: timers.debounce(s, QS.QUIET, QS.CAP), "captures")
    return out.filter("NOT late").drop("late")


@query("g3_live_extra_shots", ORACLES["w13_extra_shots"])
def g3(t):
    win = C.opens_window(F.array("type"), F.col("ops"), F.col("syncing"))
    d = QS._offers(t).select("game", "seq", "ts_us", win.alias("window"), F.lit(False).alias("closing"))
    end = _end(d).select("game", "seq", "ts_us", F.lit(False).alias("window"), "closing")
    parts = [(p,) for p in _slices(d, [end], lag=True)]
    out = drain_growing(parts, lambda s: timers.extra_shots(s, [7200000, 14400000, 28800000]), "shots")
    return out.filter("NOT late").drop("late")


@query("g4_live_dedup", "SELECT CAST(game AS VARCHAR) AS flow_id, seq FROM ev WHERE NOT syncing")
def g4(t):
    d = t.ev.select(F.col("game").cast("string").alias("flow_id"), "seq", "syncing", _ts("ts_us").alias("ts"))
    again = d.filter(F.col("seq") % 4 == 0)  # a reconnect sends part of the log twice
    parts = [(s.unionByName(again.join(s.select("seq"), "seq", "left_semi").select(*d.columns)),) for s in _slices(d)]
    return drain_growing(parts, lambda s: P.first_offers(s, "2 days"), "offers").select("flow_id", "seq")


@query("g5_live_counters", """
SELECT ts_us // 86400000000 * 86400000000 AS start_us, status, count(*) AS n FROM fr GROUP BY ALL
""")
def g5(t):
    d = t.fr.select("seq", "ts_us", "status")
    end = d.agg((F.max("seq") + 1).alias("seq"), (F.max("ts_us") + 10 * QS.CAP).alias("ts_us")).withColumn("status", F.lit("end"))
    parts = [(p.withColumn("ts", _ts("ts_us")),) for p in _slices(d, [end])]
    return drain_growing(parts, lambda s: P.capture_counters(s, "1 hour", "1 day"), "counters").filter("status <> 'end'")


@query("g6_live_pairing", """
SELECT game, seq, (seq % 50) * 1000000 AS dt_us, file FROM fr WHERE file IS NOT NULL AND seq % 50 <= 30
""")
def g6(t):
    rec = t.ev.select("game", "seq", _ts("ts_us").alias("ts"))
    late = (F.col("seq") % 50) * 1_000_000
    frames = t.fr.filter(F.col("file").isNotNull()).select("game", "seq", _ts(F.col("ts_us") + late).alias("ts"), "file")
    parts = list(zip(_slices(rec), _slices(frames)))
    return drain_growing(parts, lambda r, f: P.pair_frames(r, f, "1 hour", "30 SECONDS"), "paired")
