"""Queries for the replay scans and the other sequence operators (W*, J3, J13, J14, F1-F5, F8, P16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.num import r6
from ..functions.sqltext import sql_in, sql_list
from ..operators import capture as C
from ..operators import replay as R
from ..operators.ordered import Run, scan
from ..session import stage
from .proxies import CTE
from .registry import query

TN = sql_list(dims.TILES)
CALLS, OWED = sql_in(dims.CALL_EVENTS), sql_in(dims.OWED_EVENTS)
RW = "OVER (PARTITION BY game, kyoku_ord ORDER BY seq ROWS UNBOUNDED PRECEDING)"

CTE["mj"] = f"""
SELECT *, type = 'start_kyoku' AS is_start,
  CASE WHEN type = 'start_kyoku' THEN (['E', 'S', 'W', 'N'])[k // 25 + 1] END AS bakaze,
  CASE WHEN type = 'start_kyoku' THEN k % 4 + 1 END AS kyoku, CASE WHEN type = 'start_kyoku' THEN k % 5 END AS honba,
  CASE WHEN type = 'start_kyoku' THEN k % 3 END AS kyotaku, CASE WHEN type = 'start_kyoku' THEN k % 4 END AS oya,
  CASE WHEN k % 7 = 0 THEN 70 - k % 70 END AS left_count,
  CASE WHEN type IN ('chi', 'pon') THEN 2 WHEN type IN ('daiminkan', 'kakan') THEN 3 WHEN type = 'ankan' THEN 4 ELSE 0 END AS n_consumed,
  CASE WHEN type = 'start_kyoku' THEN (CASE WHEN k % 20 = 19 THEN 3 ELSE 4 END) END AS n_scores
FROM ev
"""
CTE["rnd"] = """
SELECT *, CAST(sum(CASE WHEN is_start THEN 1 ELSE 0 END) OVER (PARTITION BY game ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS kyoku_ord
FROM mj
"""


@query("w1_kyoku_epoch", """
SELECT game, seq, type, kyoku_ord,
  last_value(bakaze IGNORE NULLS) OVER w AS r_bakaze, last_value(kyoku IGNORE NULLS) OVER w AS r_kyoku,
  last_value(honba IGNORE NULLS) OVER w AS r_honba, last_value(oya IGNORE NULLS) OVER w AS r_oya
FROM rnd WINDOW w AS (PARTITION BY game ORDER BY seq ROWS UNBOUNDED PRECEDING)
""")
def w1(t):
    return R.replayed(t.mj, ("round",)).select("game", "seq", "type", "kyoku_ord", "r_bakaze", "r_kyoku", "r_honba", "r_oya")


def _w2_sql() -> str:
    cols = []
    for s in range(4):
        score = f"20000 + 100 * ((k * {s + 1}) % 100)"
        if s == 3:
            score = f"CASE WHEN n_scores = 3 THEN 0 ELSE {score} END"
        mine = f"NOT is_start AND actor = {s}"
        cols += [
            f"""CAST(sum(CASE WHEN is_start THEN 13 WHEN {mine} AND type = 'tsumo' THEN 1 WHEN {mine} AND type = 'dahai' THEN -1
              WHEN {mine} AND type IN ('chi','pon','daiminkan','ankan') THEN -n_consumed
              WHEN {mine} AND type IN ('kakan','nukidora') THEN -1 ELSE 0 END) {RW} AS BIGINT)
              + CASE WHEN kyoku_ord = 0 THEN 13 ELSE 0 END AS concealed_{s}""",
            f"""CAST(sum(CASE WHEN is_start THEN {score} WHEN {mine} AND type = 'reach_accepted' THEN -1000 ELSE 0 END) {RW} AS BIGINT)
              + CASE WHEN kyoku_ord = 0 THEN 25000 ELSE 0 END AS score_{s}""",
            f"CAST(sum(CASE WHEN {mine} AND type = 'nukidora' THEN 1 ELSE 0 END) {RW} AS BIGINT) AS side_{s}",
            f"bool_or({mine} AND type = 'reach_accepted') {RW} AS reach_{s}",
        ]
    cols += [
        f"CAST(sum(CASE WHEN is_start THEN kyotaku WHEN type = 'reach_accepted' THEN 1 ELSE 0 END) {RW} AS BIGINT) AS sticks",
        f"CAST(sum(CASE WHEN is_start OR type = 'dora' THEN 1 ELSE 0 END) {RW} AS BIGINT) AS n_dora",
        f"coalesce(string_agg(CASE WHEN is_start OR type = 'dora' THEN pai END, ',') {RW}, '') AS dora",
    ]
    return f"SELECT game, seq, kyoku_ord, {', '.join(cols)} FROM rnd"


@query("w2_seat_scalars", _w2_sql())
def w2(t):
    d = R.replayed(t.mj, ("seats", "dora"))
    per_seat = [f"{c}_{s}" for s in range(4) for c in ("concealed", "score", "side", "reach")]
    return d.select("game", "seq", "kyoku_ord", *per_seat, "sticks", "n_dora", F.array_join("dora", ",").alias("dora"))


CTE["stk"] = f"""
SELECT *, s - least(0, min(s) OVER (PARTITION BY game, kyoku_ord, rseat ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS h
FROM (SELECT *, sum(CASE type WHEN 'dahai' THEN 1 ELSE -1 END) OVER (PARTITION BY game, kyoku_ord, rseat ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s
      FROM (SELECT *, CASE type WHEN 'dahai' THEN actor ELSE target END AS rseat FROM rnd WHERE type IN ('dahai', 'chi', 'pon', 'daiminkan')))
"""
CTE["riv"] = """
SELECT *, type = 'dahai' AND coalesce(lead(type) OVER w, 'dahai') <> 'dahai' AS called,
  CASE WHEN type = 'dahai' AND lead(type) OVER w <> 'dahai' THEN lead(seq) OVER w END AS called_seq,
  CASE WHEN type <> 'dahai' AND lag(type) OVER w = 'dahai' THEN lag(seq) OVER w END AS takes_seq
FROM (SELECT *, CASE type WHEN 'dahai' THEN h ELSE h + 1 END AS lvl FROM stk)
WINDOW w AS (PARTITION BY game, kyoku_ord, rseat, lvl ORDER BY seq)
"""


CTE["lies"] = """
SELECT e.game, e.kyoku_ord, e.rseat, e.seq, d.seq AS dseq, row_number() OVER (PARTITION BY e.game, e.kyoku_ord, e.rseat, e.seq ORDER BY d.seq) - 1 AS idx
FROM riv e JOIN riv d ON e.game = d.game AND e.kyoku_ord = d.kyoku_ord AND e.rseat = d.rseat AND d.type = 'dahai' AND d.seq <= e.seq AND (d.called_seq IS NULL OR d.called_seq > e.seq)
"""


@query("w3_river_visible_index", """
SELECT r.game, r.kyoku_ord, r.rseat AS river_seat, r.seq, pai, called, called_seq,
  CAST(row_number() OVER (PARTITION BY r.game, r.kyoku_ord, r.rseat ORDER BY r.seq) - 1 AS BIGINT) AS river_idx, CAST(l.idx AS BIGINT) AS visible_idx
FROM riv r JOIN lies l ON l.game = r.game AND l.kyoku_ord = r.kyoku_ord AND l.rseat = r.rseat AND l.seq = r.seq AND l.dseq = r.seq WHERE type = 'dahai'
""")
def w3(t):
    rounds = stage(R.with_round(t.mj), "rounds")
    return R.river(rounds).select("game", "kyoku_ord", "river_seat", "seq", "pai", "called", "called_seq",
                                  "river_idx", "visible_idx")


@query("j13_call_target", """
SELECT game, kyoku_ord, seq, type, target, takes_seq FROM riv WHERE type <> 'dahai'
""")
def j13(t):
    d = R.claim_levels(stage(R.with_round(t.mj), "rounds"))
    return d.filter(F.col("type") != "dahai").select("game", "kyoku_ord", "seq", "type", "target", "takes_seq")


CTE["rdis"] = """
SELECT * FROM (SELECT *, coalesce(lag(type) OVER (PARTITION BY game, kyoku_ord, actor ORDER BY seq) = 'reach', false) AS riichi
  FROM rnd WHERE type IN ('reach', 'dahai')) WHERE type = 'dahai'
"""


@query("w4_riichi_flag", "SELECT game, kyoku_ord, actor, seq, pai, riichi FROM rdis")
def w4(t):
    return R.riichi_discards(R.with_round(t.mj)).select("game", "kyoku_ord", "actor", "seq", "pai", "riichi")


@query("w5_sideways_index", """
WITH e AS (SELECT r.game, r.kyoku_ord, r.rseat, r.seq, min(CASE WHEN f.riichi THEN r.seq END) OVER (PARTITION BY r.game, r.kyoku_ord, r.rseat ORDER BY r.seq ROWS UNBOUNDED PRECEDING) AS rs
  FROM riv r LEFT JOIN rdis f ON r.game = f.game AND r.seq = f.seq)
SELECT e.game, e.kyoku_ord, e.rseat AS river_seat, e.seq, e.rs IS NOT NULL AS has_riichi, CAST(min(l.idx) AS BIGINT) AS sideways_idx
FROM e LEFT JOIN lies l ON l.game = e.game AND l.kyoku_ord = e.kyoku_ord AND l.rseat = e.rseat AND l.seq = e.seq AND l.dseq >= e.rs GROUP BY e.game, e.kyoku_ord, e.rseat, e.seq, e.rs
""")
def w5(t):
    rounds = stage(R.with_round(t.mj), "rounds")
    flags = R.riichi_discards(rounds).select("game", *R.ORDER, "riichi")
    d = R.claim_levels(rounds).select("game", "kyoku_ord", "river_seat", *R.ORDER, "type", "level").join(flags, ["game", *R.ORDER], "left")
    return R.sideways_index(d, ["game", "kyoku_ord", "river_seat"], R.ORDER, R.seq_chunk()).select("game", "kyoku_ord", "river_seat", "seq", "has_riichi", "sideways_idx")


CTE["hands"] = f"""
WITH h AS (SELECT game, kyoku_ord, seq, type,
    CASE WHEN actor = 0 AND type = 'tsumo' THEN [pai] ELSE [] END AS added,
    CASE WHEN actor <> 0 OR is_start THEN [] WHEN type IN ('dahai', 'kakan') THEN [pai]
      WHEN type IN ('chi', 'pon', 'daiminkan', 'ankan') THEN list_transform(range(n_consumed), lambda i: pai)
      WHEN type = 'nukidora' THEN ['N'] ELSE [] END AS removed FROM rnd),
hh AS (SELECT * FROM h WHERE len(added) + len(removed) > 0 OR type = 'start_kyoku'),
tiles AS (SELECT unnest({sql_list(dims.HAND_ORDER[:-1])}) AS tile, unnest(range({len(dims.HAND_ORDER) - 1})) AS rk),
x AS (SELECT game, kyoku_ord, seq, tile, rk,
    len(list_filter(added, lambda z: z = tile)) - len(list_filter(removed, lambda z: z = tile)) AS d FROM hh, tiles),
s1 AS (SELECT *, sum(d) OVER (PARTITION BY game, kyoku_ord, tile ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM x),
red AS (SELECT game, kyoku_ord, seq, left(tile, 2) AS five,
    least(0, min(s) OVER (PARTITION BY game, kyoku_ord, tile ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS miss
  FROM s1 WHERE tile LIKE '5_r'),
s2 AS (SELECT s1.game, s1.kyoku_ord, s1.seq, tile, rk, s + coalesce(miss, 0) AS s
  FROM s1 LEFT JOIN red ON red.game = s1.game AND red.kyoku_ord = s1.kyoku_ord AND red.seq = s1.seq AND red.five = s1.tile),
s3 AS (SELECT game, kyoku_ord, seq, tile, rk,
    s - least(0, min(s) OVER (PARTITION BY game, kyoku_ord, tile ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS n FROM s2)
SELECT game, kyoku_ord, seq, CAST(sum(n) AS BIGINT) AS n_tiles,
  coalesce(string_agg(rtrim(repeat(tile || ' ', CAST(n AS INTEGER))), ' ' ORDER BY rk) FILTER (n > 0), '') AS hand
FROM s3 GROUP BY game, kyoku_ord, seq
"""


@query("w6_hero_hand", "SELECT game, kyoku_ord, seq, n_tiles, hand FROM hands")
def w6(t):
    changes = stage(R.hero_events(R.with_round(t.mj), F.lit(0)), "hand_changes")
    d = R.hero_hand(changes)
    return d.select("game", "kyoku_ord", "seq", F.size("hand").cast("long").alias("n_tiles"),
                    F.concat_ws(" ", "hand").alias("hand"))


@query("w7_drawn_tile", f"""
SELECT game, kyoku_ord, seq, nullif(last_value(CASE WHEN actor = 0 AND type = 'tsumo' THEN pai
    WHEN actor = 0 AND type IN ('dahai', 'chi', 'pon', 'daiminkan', 'ankan', 'kakan', 'nukidora') THEN '' END IGNORE NULLS) {RW}, '') AS drawn
FROM rnd
""")
def w7(t):
    return R.replayed(t.mj, ("drawn",), F.lit(0)).select("game", "kyoku_ord", "seq", "drawn")


CTE["owe"] = f"""
SELECT *, CASE WHEN call_actor IS NULL THEN -1
  WHEN coalesce(CASE call_actor WHEN 0 THEN d0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, -1) > call_seq THEN -1 ELSE call_actor END AS owed
FROM (SELECT *, last_value(CASE WHEN type IN {OWED} THEN actor END IGNORE NULLS) {RW} AS call_actor,
  last_value(CASE WHEN type IN {OWED} THEN seq END IGNORE NULLS) {RW} AS call_seq,
  {', '.join(f"last_value(CASE WHEN type = 'dahai' AND actor = {s} THEN seq END IGNORE NULLS) {RW} AS d{s}" for s in range(4))}
  FROM rnd)
"""


@query("w8_owed_discard", "SELECT game, kyoku_ord, seq, CAST(owed AS INTEGER) AS owed FROM owe")
def w8(t):
    return R.replayed(t.mj, ("owed",)).select("game", "kyoku_ord", "seq", "owed")


CTE["recs"] = """
SELECT game, rec, max(kyoku_ord) AS kyoku_ord, bool_or(is_start) AS has_start, arg_max(type, seq) AS last_event,
  array_to_string(list_sort(list_distinct(list(type))), ',') AS types, max(left_count) AS left_count
FROM rnd GROUP BY game, rec
"""


def _records(t):
    d = R.with_round(t.mj)
    s = R.record_summary(d, ["game", "rec"])
    return s, d


@query("w9_left_count", """
SELECT game, rec, kyoku_ord, last_value(CASE WHEN NOT has_start THEN left_count END IGNORE NULLS)
  OVER (PARTITION BY game, kyoku_ord ORDER BY rec ROWS UNBOUNDED PRECEDING) AS left_tiles FROM recs
""")
def w9(t):
    d = R.with_round(t.mj)
    recs = d.groupBy("game", "rec").agg(F.max("kyoku_ord").alias("kyoku_ord"),
                                        F.max(F.col("type") == "start_kyoku").alias("has_start"),
                                        F.max("left_count").alias("left_count"))
    return R.left_count(recs, "rec", F.col("left_count")).select("game", "rec", "kyoku_ord", "left_tiles")


@query("w10_record_types", "SELECT game, rec, kyoku_ord, types, last_event FROM recs")
def w10(t):
    s, _ = _records(t)
    return s.select("game", "rec", "kyoku_ord", F.concat_ws(",", "types").alias("types"), "last_event")


CTE["kan"] = """
WITH q AS (SELECT *, CASE WHEN pai LIKE '5_r' THEN left(pai, 2) ELSE pai END AS base FROM rnd WHERE type IN ('pon', 'kakan')),
s AS (SELECT *, sum(CASE type WHEN 'pon' THEN 1 ELSE -1 END) OVER w AS s FROM q
  WINDOW w AS (PARTITION BY game, kyoku_ord, actor, base ORDER BY seq ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, s - least(0, min(s) OVER w) AS h FROM s WINDOW w AS (PARTITION BY game, kyoku_ord, actor, base ORDER BY seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, type = 'kakan' AND coalesce(lag(h) OVER w, 0) > 0 AS hit FROM m WINDOW w AS (PARTITION BY game, kyoku_ord, actor, base ORDER BY seq)),
n AS (SELECT *, sum(CASE WHEN type = 'pon' THEN 1 ELSE 0 END) OVER w AS pno, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS hno FROM b
  WINDOW w AS (PARTITION BY game, kyoku_ord, actor, base ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT k.game, k.kyoku_ord, k.actor, k.base, k.seq, p.seq AS pon_seq
FROM n k LEFT JOIN n p ON k.hit AND p.type = 'pon' AND p.game = k.game AND p.kyoku_ord = k.kyoku_ord AND p.actor = k.actor AND p.base = k.base AND p.pno = k.hno
WHERE k.type = 'kakan'
"""


@query("j14_added_kan", "SELECT game, kyoku_ord, actor, base, seq, pon_seq FROM kan")
def j14(t):
    d = R.added_kans(stage(R.with_round(t.mj), "rounds"))
    return d.select("game", "kyoku_ord", "actor", "base", "seq", "pon_seq")


@query("f1_board_change", f"""
SELECT game, rec, bool_or(k % 13 <> 0) AS changes FROM ev GROUP BY game, rec
""")
def f1(t):
    # every 13th event plays an event type that leaves the board alone
    d = t.mj.withColumn("type", F.when(F.col("k") % 13 == 0, "end_game").otherwise(F.col("type")))
    s = d.groupBy("game", "rec").agg(F.collect_set("type").alias("types"))
    return s.select("game", "rec", R.is_board_change(F.col("types")).alias("changes"))


CTE["dealw"] = f"""
SELECT game, seq, rec, kyoku_ord, kyoku_ord > 0 AS open,
  CAST(sum(CASE WHEN type = 'dahai' THEN 1 ELSE 0 END) {RW} AS BIGINT) AS n_discards FROM rnd
"""


@query("f2_deal_window", "SELECT game, seq, kyoku_ord, open AND n_discards = 0 AS deal FROM dealw")
def f2(t):
    d = R.replayed(t.mj, ("open",))
    return d.select("game", "seq", "kyoku_ord", R.deal_window(F.col("open"), F.col("n_discards")).alias("deal"))


@query("f3_call_window", f"""
SELECT game, rec, len(list_intersect(string_split(types, ','), {sql_list(dims.CALL_EVENTS)})) > 0 AS in_call FROM recs
""")
def f3(t):
    s, _ = _records(t)
    return s.select("game", "rec", R.in_window(F.col("types"), F.col("last_event"), dims.CALL_EVENTS).alias("in_call"))


@query("f4_score_window", f"""
SELECT game, rec, len(list_intersect(string_split(types, ','), {sql_list(dims.REACH_EVENTS)})) > 0 AS in_score FROM recs
""")
def f4(t):
    s, _ = _records(t)
    return s.select("game", "rec", R.in_window(F.col("types"), F.col("last_event"), dims.REACH_EVENTS).alias("in_score"))


@query("f5_call_pending", "SELECT game, seq, kyoku_ord > 0 AND owed >= 0 AS pending FROM owe")
def f5(t):
    d = R.replayed(t.mj, ("open", "owed"))
    return d.select("game", "seq", R.call_pending(F.col("open"), F.col("owed")).alias("pending"))


@query("f8_three_player", """
SELECT game, seq, bool_or(type = 'nukidora' OR (is_start AND (n_scores = 3 OR total = 105000)))
  OVER (PARTITION BY game ORDER BY seq ROWS UNBOUNDED PRECEDING) AS sanma
FROM (SELECT *, 1000 * kyotaku + 60000 + 100 * (k % 100 + (k * 2) % 100 + (k * 3) % 100)
  + CASE WHEN n_scores = 3 THEN 0 ELSE 20000 + 100 * ((k * 4) % 100) END AS total FROM rnd)
""")
def f8(t):
    return R.with_mode(t.mj).select("game", "seq", "sanma")


@query("p16_round_key", """
SELECT game, seq, coalesce(last_value(bakaze IGNORE NULLS) OVER w, 'None') || coalesce(last_value(kyoku IGNORE NULLS) OVER w, 0)
  || '.' || coalesce(last_value(honba IGNORE NULLS) OVER w, 0) AS round_key
FROM rnd WINDOW w AS (PARTITION BY game ORDER BY seq ROWS UNBOUNDED PRECEDING)
""")
def p16(t):
    d = R.with_round(t.mj)
    return d.select("game", "seq", R.round_key(F.col("r_bakaze"), F.col("r_kyoku"), F.col("r_honba")).alias("round_key"))


QUIET, CAP = 12 * 3600 * 1_000_000, 24 * 3600 * 1_000_000


@query("w11_debounce", f"""
WITH RECURSIVE g AS (SELECT game, seq, ts_us, CASE WHEN lag(ts_us) OVER w IS NULL OR ts_us - lag(ts_us) OVER w >= {QUIET} THEN 1 ELSE 0 END AS o
  FROM ev WINDOW w AS (PARTITION BY game ORDER BY ts_us, seq)),
e AS (SELECT game, seq, ts_us, sum(o) OVER (PARTITION BY game ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS burst FROM g),
n AS (SELECT a.game, a.burst, a.seq, a.ts_us, min(b.seq) AS nx FROM e a LEFT JOIN e b
  ON a.game = b.game AND a.burst = b.burst AND b.ts_us > a.ts_us + {CAP} GROUP BY ALL),
r AS (SELECT n.game, n.burst, n.seq, n.ts_us, n.nx FROM n JOIN (SELECT game, burst, min(seq) AS seq FROM e GROUP BY ALL) h USING (game, burst, seq)
  UNION ALL SELECT n.game, n.burst, n.seq, n.ts_us, n.nx FROM r JOIN n ON n.game = r.game AND n.seq = r.nx),
l AS (SELECT r.game, r.ts_us AS start_us, r.nx, max(e.seq) AS key, max(e.ts_us) AS last_us
  FROM r JOIN e ON e.game = r.game AND e.burst = r.burst AND e.ts_us BETWEEN r.ts_us AND r.ts_us + {CAP} GROUP BY ALL)
SELECT game, key, start_us, CASE WHEN nx IS NULL THEN least(last_us + {QUIET}, start_us + {CAP}) ELSE start_us + {CAP} END AS capture_us,
  nx IS NOT NULL OR start_us + {CAP} < last_us + {QUIET} AS capped FROM l
""")
def w11(t):
    return C.debounce(t.ev, QUIET, CAP)


CTE["rtypes"] = """
SELECT game, rec, list_distinct(list(type)) AS types, max(ts_us) AS ts_us FROM ev GROUP BY game, rec
"""


def _rec_types(t):
    return t.ev.groupBy("game", "rec").agg(F.collect_set("type").alias("types"), F.max("ts_us").alias("ts_us"))


@query("w12_deal_suppression", f"""
SELECT game, rec, dealing, NOT dealing AND len(list_intersect(types, {sql_list(dims.BOARD_EVENTS)})) > 0 AS capture FROM (
SELECT *, coalesce(last_value(CASE WHEN list_contains(types, 'dahai') THEN false WHEN list_contains(types, 'start_kyoku') THEN true END IGNORE NULLS)
  OVER (PARTITION BY game ORDER BY rec ROWS UNBOUNDED PRECEDING), false) AS dealing FROM rtypes)
""")
def w12(t):
    return C.deal_suppressed(_rec_types(t), "rec").select("game", "rec", "dealing", "capture")


CTE["opr"] = """
SELECT *, CASE WHEN k % 3 = 0 AND NOT syncing AND op_seat = seat THEN [1, 2 + k % 10] END AS ops
FROM (SELECT *, CASE WHEN k % 2 = 0 THEN k % 4 ELSE (k // 4) % 4 END AS op_seat FROM ev)
"""


def _offers(t):
    """Records with a nested message text as the tap would have written it."""
    k = F.col("k")
    seat = F.when(k % 2 == 0, k % 4).otherwise(F.expr("k div 4") % 4).cast("string")
    types = F.when(k % 3 == 0, F.concat(F.lit('{"type":1},{"type":'), (2 + k % 10).cast("string"), F.lit("}"))).otherwise("")
    raw = F.concat(F.lit('{"name":"m","data":{"data":{"operation":{"seat":'), seat, F.lit(',"operationList":['), types, F.lit("]}}}}"))
    d = t.ev.withColumn("raw_liqi", F.when(k % 3 != 2, raw).when(k % 9 == 2, F.lit("{broken")))
    return d.withColumn("ops", C.ops_from_record(F.col("raw_liqi"), F.col("syncing"), F.col("seat")))


BTN = f"""list_filter({sql_list(dims.BUTTON_ORDER)}, lambda b: list_contains(list_transform(coalesce(ops, []), lambda o:
  CASE o WHEN 2 THEN 'btn_chi' WHEN 3 THEN 'btn_pon' WHEN 4 THEN 'btn_kan' WHEN 5 THEN 'btn_kan' WHEN 6 THEN 'btn_kan' WHEN 7 THEN 'btn_riichi'
  WHEN 8 THEN 'btn_tsumo' WHEN 9 THEN 'btn_ron' WHEN 10 THEN 'btn_kyushu' WHEN 11 THEN 'btn_babei' END), b))"""
CTE["btn"] = f"""
SELECT *, CASE WHEN len(b0) > 0 THEN list_append(b0, 'btn_skip') ELSE b0 END AS btn FROM (SELECT *, {BTN} AS b0 FROM opr)
"""


@query("p10_ops_from_record", "SELECT game, seq, array_to_string(ops, ',') AS ops FROM opr")
def p10(t):
    return _offers(t).select("game", "seq", F.when(F.col("ops").isNotNull(), F.concat_ws(",", F.col("ops").cast("array<string>"))).alias("ops"))


@query("p11_buttons_for_ops", "SELECT game, seq, array_to_string(btn, ',') AS buttons FROM btn")
def p11(t):
    return _offers(t).select("game", "seq", F.concat_ws(",", C.buttons_for_ops(F.col("ops"))).alias("buttons"))


@query("w13_extra_shots", f"""
WITH a AS (SELECT game, seq, ts_us, NOT syncing AND (type IN {CALLS} OR len(btn) > 0) AS win,
  lead(ts_us) OVER (PARTITION BY game ORDER BY seq) AS nx FROM btn),
x AS (SELECT *, unnest([7200000, 14400000, 28800000]) AS offset_ms FROM a WHERE win)
SELECT game, seq, offset_ms, ts_us + CAST(offset_ms AS BIGINT) * 1000 AS fire_us FROM x WHERE nx IS NULL OR ts_us + CAST(offset_ms AS BIGINT) * 1000 < nx
""")
def w13(t):
    d = _offers(t).withColumn("window", C.opens_window(F.array("type"), F.col("ops"), F.col("syncing")))
    return C.extra_shots(d.select("game", "seq", "ts_us", "window"), [7200000, 14400000, 28800000])


@query("w14_spread_sample", """
WITH n AS (SELECT game, seq, row_number() OVER (PARTITION BY game ORDER BY seq) - 1 AS rn, count(*) OVER (PARTITION BY game) AS n FROM ev),
a AS (SELECT DISTINCT game, CAST(floor(i * (CAST(n AS DOUBLE) / 31)) AS BIGINT) AS rn FROM n, (SELECT unnest(range(31)) AS i) WHERE n > 31),
b AS (SELECT DISTINCT game, CASE WHEN i = 39 THEN n - 1 ELSE CAST(floor(i * (CAST(n - 1 AS DOUBLE) / 39)) AS BIGINT) END AS rn
  FROM n, (SELECT unnest(range(40)) AS i) WHERE n > 40)
SELECT 'step' AS how, game, seq FROM n WHERE n <= 31 OR EXISTS (SELECT 1 FROM a WHERE a.game = n.game AND a.rn = n.rn)
UNION ALL SELECT 'ends', game, seq FROM n WHERE n <= 40 OR EXISTS (SELECT 1 FROM b WHERE b.game = n.game AND b.rn = n.rn)
""")
def w14(t):
    e = t.ev.select("game", "seq")
    step = C.spread_sample(e, ["game"], ["seq"], 31, R.seq_chunk()).select(F.lit("step").alias("how"), "game", "seq")
    ends = C.spread_sample(e, ["game"], ["seq"], 40, R.seq_chunk(), ends=True).select(F.lit("ends").alias("how"), "game", "seq")
    return step.unionByName(ends)


MAD = "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))) / len({a})"


@query("w15_stability", f"""
WITH l AS (SELECT key, game, v, lag(v) OVER (PARTITION BY game ORDER BY key) AS p FROM vec),
d AS (SELECT key, game, CASE WHEN p IS NOT NULL THEN {MAD.format(a='v', b='p')} END AS dist FROM l)
SELECT key, game, round_even(dist, 6) AS dist, coalesce(dist <= 0.12, false) AS stable,
  min(CASE WHEN dist <= 0.12 THEN key END) OVER (PARTITION BY game) AS first_stable FROM d
""")
def w15(t):
    d = C.stable_rows(t.vec, ["game"], ["key"], 0.12, R.seq_chunk("key"))
    first = C.first_stable(d, ["game"], "key")
    return d.join(first, "game").select("key", "game", r6(F.col("dist")).alias("dist"), "stable", "first_stable")


@query("j3_latest_record", """
WITH f AS (SELECT game, seq * 2 AS seq, ts_us FROM fr WHERE file IS NOT NULL),
o AS (SELECT game, seq * 3 AS seq, ts_us, ops FROM opr)
SELECT f.game, f.seq, array_to_string(o.ops, ',') AS ops, f.ts_us - o.ts_us AS dt_us, o.seq AS event_seq
FROM f ASOF LEFT JOIN o ON f.game = o.game AND f.seq >= o.seq
""")
def j3(t):
    frames = t.fr.filter(F.col("file").isNotNull()).select("game", (F.col("seq") * 2).alias("seq"), "ts_us")  # two clocks that seldom meet
    recs = _offers(t).select("game", (F.col("seq") * 3).alias("seq"), "ops", F.col("ts_us").alias("event_us"), (F.col("seq") * 3).alias("event_seq"))
    d = C.as_of(frames, recs, "game", "seq", ["ops", "event_us", "event_seq"])
    return d.select("game", "seq", F.when(F.col("ops").isNotNull(), F.concat_ws(",", F.col("ops").cast("array<string>"))).alias("ops"),
                    (F.col("ts_us") - F.col("event_us")).alias("dt_us"), "event_seq")


@query("j4_successor_rescue", """
WITH s AS (SELECT game, seq, true AS open, CASE WHEN k % 2 = 0 THEN pai END AS gdrawn, k % 3 AS gz FROM ev),
n AS (SELECT *, lead(gdrawn) OVER w AS nd, lead(gz) OVER w AS nz, lead(open) OVER w AS no FROM s WINDOW w AS (PARTITION BY game ORDER BY seq)),
o AS (SELECT n.*, CASE WHEN seq % 2 = 0 THEN coalesce(nd, gdrawn) END AS odrawn, CASE WHEN seq % 5 = 0 THEN gz ELSE nz END AS oz FROM n),
r AS (SELECT *, coalesce(gdrawn IS NULL AND odrawn IS NOT NULL AND no AND nd = odrawn AND oz IS NOT DISTINCT FROM nz, false) AS rescued FROM o)
SELECT game, seq, rescued, CASE WHEN rescued THEN nd ELSE gdrawn END AS drawn, CASE WHEN rescued THEN nz ELSE gz END AS zone FROM r
""")
def j4(t):
    k = F.col("k")
    s = t.ev.select("game", "seq", F.lit(True).alias("open"), F.struct(
        F.when(k % 2 == 0, F.col("pai")).alias("drawn"), (k % 3).alias("zone")).alias("gt"))
    # the observation shows the next state's draw and zone on part of the frames
    nx = scan(s, ["game"], ["seq"], [Run("nx", "next", F.col("gt"), inclusive=False)], R.seq_chunk())
    obs = F.struct(F.when(F.col("seq") % 2 == 0, F.coalesce("nx.drawn", "gt.drawn")).alias("drawn"),
                   F.when(F.col("seq") % 5 == 0, F.col("gt.zone")).otherwise(F.col("nx.zone")).alias("zone"))
    d = C.successor_rescue(nx.select("game", "seq", "open", "gt", obs.alias("obs")), ["zone"])
    return d.select("game", "seq", "rescued", "gt.drawn", "gt.zone")


@query("a1_sync_report", """
WITH c AS (SELECT game, count(*) AS changing, count(f.seq) AS covered FROM (SELECT game, seq FROM ev WHERE k % 13 <> 0) e
  LEFT JOIN (SELECT game, seq FROM fr WHERE file IS NOT NULL) f USING (game, seq) GROUP BY game),
s AS (SELECT game, count(*) AS frames, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'timeout') AS n_timeout,
  count(*) FILTER (status = 'extra') AS n_extra, count(*) FILTER (status = 'no_capture') AS n_no_capture FROM fr GROUP BY game)
SELECT game, coalesce(changing, 0) AS changing, coalesce(covered, 0) AS covered, coalesce(frames, 0) AS frames, coalesce(n_ok, 0) AS n_ok,
  coalesce(n_timeout, 0) AS n_timeout, coalesce(n_extra, 0) AS n_extra, coalesce(n_no_capture, 0) AS n_no_capture,
  100 * coalesce(covered, 0) // greatest(1, coalesce(changing, 0)) AS covered_pct FROM c FULL JOIN s USING (game)
""")
def a1(t):
    return C.sync_report(t.ev.filter(F.col("k") % 13 != 0), t.fr)


@query("a2_offer_inventory", f"""
WITH d AS (SELECT b.game, b.ops, b.btn, f.seq IS NOT NULL AS framed FROM btn b
  LEFT JOIN (SELECT DISTINCT game, seq FROM fr WHERE status IN ('ok', 'timeout') AND file IS NOT NULL) f USING (game, seq))
SELECT game, count(*) FILTER (ops IS NOT NULL) AS offers, count(*) FILTER (len(btn) > 0) AS with_buttons,
  count(*) FILTER (len(btn) > 0 AND framed) AS with_frame,
  {', '.join(f"count(*) FILTER (framed AND list_contains(btn, '{b}')) AS {b}" for b in dims.BUTTON_ORDER + ['btn_skip'])}
FROM d GROUP BY ROLLUP (game)
""")
def a2(t):
    return C.offer_inventory(_offers(t), t.fr)


@query("j1_frame_state", """
SELECT f.game, f.seq, f.file, d.kyoku_ord, d.n_discards, d.open AND d.n_discards = 0 AS deal
FROM fr f JOIN dealw d USING (game, seq) WHERE f.status = 'ok'
""")
def j1(t):
    state = R.replayed(t.mj, ("open",))
    frames = t.fr.filter(F.col("status") == "ok").select("game", "seq", "file")
    return frames.join(state, ["game", "seq"]).select(
        "game", "seq", "file", "kyoku_ord", "n_discards", R.deal_window(F.col("open"), F.col("n_discards")).alias("deal"))
