"""Queries for scoring, statistics and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import tiles as TL
from ..functions.num import r6
from ..functions.sqltext import sql_list
from ..operators import consensus as CN
from ..operators import score as S
from ..session import stage
from .proxies import CTE
from .q_gates import _verdicts as box_verdicts
from .q_joins import _bags, _verdicts
from .registry import query

TN, HO = sql_list(dims.TILES), sql_list(dims.HAND_ORDER)
CN_ALL = sql_list(dims.CLASSES)


@query("p1_class_names", f"""
WITH c AS (SELECT frame, det_id, l_partkey % 60 AS cls FROM bx)
SELECT frame, det_id, cls, ({CN_ALL})[cls + 1] AS name, CASE WHEN cls < 38 THEN ({CN_ALL})[cls + 1] END AS tile, cls AS back_id FROM c WHERE cls < 57
""")
def p1(t):
    c = F.col("cls")
    d = t.bx.select("frame", "det_id", (F.col("l_partkey") % 60).alias("cls"))
    d = d.select("frame", "det_id", "cls", TL.class_name(c).alias("name"), TL.tile_name(c).alias("tile"))
    return d.filter(F.col("name").isNotNull()).withColumn("back_id", TL.class_id(F.col("name")))


LOGMAP = {v: k for k, v in dims.LOG_NOTATION.items()}


def _case(col: str, mapping: dict, default: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {default} END"


@query("p2_log_notation", f"""
WITH n AS (SELECT frame, det_id, ({TN})[cls + 1] AS name FROM bx), l AS (SELECT *, CASE WHEN name = 'back' THEN NULL ELSE {_case('name', dims.LOG_NOTATION, 'name')} END AS log_name FROM n)
SELECT frame, det_id, name, log_name, {_case('log_name', LOGMAP, 'log_name')} AS round_trip FROM l
""")
def p2(t):
    d = t.bx.select("frame", "det_id", TL.tile_name(F.col("cls")).alias("name")).withColumn("log_name", TL.to_log_name(F.col("name")))
    return d.withColumn("round_trip", TL.from_log_name(F.col("log_name")))


@query("p3_red_fives", f"""
SELECT frame, det_id, name, CASE WHEN name IN ('5mr', '5pr', '5sr') THEN left(name, 2) ELSE name END AS base, name IN ('5mr', '5pr', '5sr') AS red FROM (SELECT frame, det_id, ({TN})[cls + 1] AS name FROM bx)
""")
def p3(t):
    d = t.bx.select("frame", "det_id", TL.tile_name(F.col("cls")).alias("name"))
    return d.select("frame", "det_id", "name", TL.base_tile(F.col("name")).alias("base"), TL.is_red_five(F.col("name")).alias("red"))


CTE["nxt"] = f"""
SELECT game, seq, ind, CASE WHEN list_contains(['E','S','W','N'], b) THEN (['E','S','W','N'])[list_position(['E','S','W','N'], b) % 4 + 1]
  WHEN list_contains(['P','F','C'], b) THEN (['P','F','C'])[list_position(['P','F','C'], b) % 3 + 1] ELSE CAST(CAST(left(b, 1) AS INTEGER) % 9 + 1 AS VARCHAR) || right(b, 1) END AS dora
FROM (SELECT game, seq, ind, CASE WHEN c LIKE '5_r' THEN left(c, 2) ELSE c END AS b FROM (SELECT game, seq, ind, {_case('ind', LOGMAP, 'ind')} AS c
  FROM (SELECT game, seq, CASE WHEN k % 2 = 0 THEN pai ELSE {_case('pai', dims.LOG_NOTATION, 'pai')} END AS ind FROM ev)))
"""


@query("p4_next_tile", """
SELECT 'tile' AS what, game, seq, ind, dora FROM nxt
UNION ALL SELECT 'set', game, NULL, NULL, string_agg(DISTINCT dora, ',' ORDER BY dora) FROM nxt GROUP BY game
""")
def p4(t):
    ind = F.when(F.col("k") % 2 == 0, F.col("pai")).otherwise(TL.to_log_name(F.col("pai")))
    d = t.ev.select("game", "seq", ind.alias("ind")).withColumn("dora", TL.next_tile(F.col("ind")))
    sets = d.groupBy("game").agg(F.concat_ws(",", F.array_sort(F.collect_set("dora"))).alias("dora"))
    return d.select(F.lit("tile").alias("what"), "game", "seq", "ind", "dora").unionByName(
        sets.select(F.lit("set").alias("what"), "game", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("ind"), "dora"))


@query("k3_hand_order", f"""
WITH u AS (SELECT game, seq, unnest(list_transform(range(k % 14), lambda i: ({TN})[(k * 3 + i * 5) % 37 + 1])) AS x FROM ev)
SELECT game, seq, string_agg(x, ' ' ORDER BY list_position({HO}, x)) AS hand FROM u GROUP BY game, seq
UNION ALL SELECT game, seq, '' FROM ev WHERE k % 14 = 0
""")
def k3(t):
    k = F.col("k")
    tiles = F.slice(F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.get(TL.lit_array(dims.TILES), (k * 3 + i * 5) % 37)), F.lit(1), k % 14)
    return t.ev.select("game", "seq", F.concat_ws(" ", TL.sort_hand(tiles)).alias("hand"))


def _cands(t):
    d = t.bag.select("zone", "frame", "pred", "gt", "pos")
    nxt = TL.next_tile(F.when(F.col("pred") == "back", "1m").otherwise(F.col("pred")))
    return d.withColumn("cands", F.when(F.col("pos") == 1, F.array("pred", nxt)).otherwise(F.array("pred")))


CTE["anyof"] = f"""
SELECT zone, frame, pos, gt, CASE WHEN pos = 1 THEN [pred, CASE WHEN list_contains(['E','S','W','N'], b) THEN (['E','S','W','N'])[list_position(['E','S','W','N'], b) % 4 + 1]
  WHEN list_contains(['P','F','C'], b) THEN (['P','F','C'])[list_position(['P','F','C'], b) % 3 + 1] ELSE CAST(CAST(left(b, 1) AS INTEGER) % 9 + 1 AS VARCHAR) || right(b, 1) END] ELSE [pred] END AS cands
FROM (SELECT *, CASE WHEN pred = 'back' THEN '1m' WHEN pred LIKE '5_r' THEN left(pred, 2) ELSE pred END AS b FROM bag)
"""


@query("a5_any_of_agreement", """
SELECT 'rate' AS what, zone, count(*) AS n, count(*) FILTER (list_contains(cands, gt)) AS correct, round_even(CAST(count(*) FILTER (list_contains(cands, gt)) AS DOUBLE) / count(*), 6) AS agree, NULL AS example FROM anyof GROUP BY zone
UNION ALL SELECT 'bad', zone, frame, rn, NULL, gt || '<' || array_to_string(cands, '/') FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY frame, pos, gt, array_to_string(cands, '/')) AS rn FROM anyof WHERE NOT list_contains(cands, gt)) WHERE rn <= 20
""")
def a5(t):
    d = _cands(t).withColumn("ex", F.concat_ws("/", "cands"))
    rate = S.any_of_agreement(d, "zone").select(F.lit("rate").alias("what"), "zone", "n", "correct", r6(F.col("agree")).alias("agree"), F.lit(None).cast("string").alias("example"))
    bad = S.mismatch_examples(d, "zone", ["frame", "pos", "gt", "ex"], 20)
    return rate.unionByName(bad.select(F.lit("bad").alias("what"), "zone", F.col("frame").alias("n"), F.col("rank").cast("long").alias("correct"),
                                       F.lit(None).cast("double").alias("agree"), F.concat("gt", F.lit("<"), "ex").alias("example")))


@query("a6_tally", """
WITH s AS (SELECT zone, pos, grouping(pos) AS all_pos, CAST(sum(n_gt) AS BIGINT) AS n_gt, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(correct_lenient) AS BIGINT) AS correct_lenient
  FROM bagm GROUP BY GROUPING SETS ((zone), (zone, pos)))
SELECT *, round_even(CAST(correct AS DOUBLE) / n_gt, 6) AS recall, round_even(CAST(correct AS DOUBLE) / n_pred, 6) AS "precision", round_even(CAST(correct_lenient AS DOUBLE) / n_gt, 6) AS recall_lenient FROM s
""")
def a6(t):
    d = S.tally(S.bag_match(*_bags(t), ["zone", "pos", "frame"]), "zone", "pos")
    return d.withColumn("all_pos", F.col("all_pos").cast("int")).withColumns({c: r6(F.col(c)) for c in ("recall", "precision", "recall_lenient")})


@query("a7_confusions", """
SELECT 'class' AS what, gt, NULL AS pred, count(*) AS n, count(*) FILTER (gt = pred) AS correct, round_even(CAST(count(*) FILTER (gt = pred) AS DOUBLE) / count(*), 6) AS acc FROM bag GROUP BY gt
UNION ALL SELECT 'pair', gt, pred, count(*), NULL, NULL FROM bag WHERE gt <> pred GROUP BY gt, pred
""")
def a7(t):
    c = S.class_accuracy(t.bag).select(F.lit("class").alias("what"), "gt", F.lit(None).cast("string").alias("pred"), "n", "correct", r6(F.col("acc")).alias("acc"))
    p = S.confusions(t.bag).select(F.lit("pair").alias("what"), "gt", "pred", "n", F.lit(None).cast("long").alias("correct"), F.lit(None).cast("double").alias("acc"))
    return c.unionByName(p)


@query("a8_class_distribution", """
SELECT 'class' AS what, cls AS name, count(*) AS n FROM docs GROUP BY cls UNION ALL SELECT 'game', game, count(*) FROM docs GROUP BY game
""")
def a8(t):
    c = t.docs.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).select(F.lit("class").alias("what"), F.col("cls").alias("name"), "n")
    g = t.docs.groupBy("game").agg(F.count(F.lit(1)).alias("n")).select(F.lit("game").alias("what"), F.col("game").alias("name"), "n")
    return c.unionByName(g)


MESSAGES = ["scores sum 99000 + 1000*2 kyotaku != 100000", "kyotaku 0 < visible riichi count 1", "wall count 3 vs predicted 9 (>1 off)", "stray detection 5m (80px off-zone)",
            "seat1 meld strip unparsable (5 cells)", "seat2 river row1 hole (gap 130px)", "tile 5m seen 5>4 times across visible zones", "hero hand 9 + 3*1 melds != 13",
            "no dora marker visible", "seat 2 concealed 4 != 13(+1) for 0 melds", "seat 0 riichi with open melds"]


@query("a9_reject_categories", f"""
WITH m AS (SELECT seq // 5 AS frame, ({sql_list(MESSAGES)})[k % 11 + 1] AS msg FROM ev),
c AS (SELECT DISTINCT frame, CASE WHEN contains(msg, 'scores sum') THEN 'hud_scores' WHEN contains(msg, 'kyotaku') THEN 'hud_kyotaku' WHEN contains(msg, 'wall count') THEN 'hud_wall' WHEN contains(msg, 'stray detection') THEN 'stray'
  WHEN contains(msg, 'meld strip') THEN 'meld_parse' WHEN contains(msg, 'river') THEN 'river_geometry' WHEN contains(msg, '>4 times') THEN 'tile_gt4' WHEN contains(msg, 'hero hand') THEN 'hand_size'
  WHEN contains(msg, 'dora marker') THEN 'dora' WHEN contains(msg, 'concealed') THEN 'concealed' ELSE 'other' END AS category FROM m)
SELECT category, count(*) AS frames FROM c GROUP BY category
""")
def a9(t):
    msg = F.get(TL.lit_array(MESSAGES), F.col("k") % 11)
    return S.reject_counts(t.ev.select(F.expr("seq div 5").alias("frame"), msg.alias("message")), "frame", "message")


@query("a10_field_rates", """
WITH w AS (SELECT game, seq, unnest(['wall_count', 'honba', 'kyotaku']) AS field, unnest([CASE WHEN k % 7 > 0 THEN CAST(k % 70 AS VARCHAR) END, CAST(k % 5 AS VARCHAR), CAST(k % 3 AS VARCHAR)]) AS want FROM ev),
g AS (SELECT game, seq, unnest(['wall_count', 'honba', 'kyotaku']) AS field, unnest([CAST((k % 70) - k % 3 AS VARCHAR), CASE WHEN k % 4 > 0 THEN CAST(k % 5 AS VARCHAR) END, CAST(k % 2 AS VARCHAR)]) AS got FROM ev WHERE seq % 9 > 0),
v AS (SELECT w.game, w.seq, w.field, coalesce(got = want OR (w.field = 'wall_count' AND abs(CAST(got AS INTEGER) - CAST(want AS INTEGER)) <= 1), false) AS ok FROM w LEFT JOIN g USING (game, seq, field) WHERE want IS NOT NULL),
f AS (SELECT bool_and(ok) AS ok FROM v GROUP BY game, seq),
b AS (SELECT array_to_string(btn, ',') AS want, CASE WHEN k % 8 = 0 THEN '' ELSE array_to_string(btn, ',') END AS got FROM btn)
SELECT field, count(*) AS total, count(*) FILTER (ok) AS hit, round_even(CAST(count(*) FILTER (ok) AS DOUBLE) / count(*), 6) AS rate FROM v GROUP BY field
UNION ALL SELECT 'all', count(*), count(*) FILTER (ok), round_even(CAST(count(*) FILTER (ok) AS DOUBLE) / count(*), 6) FROM f
UNION ALL SELECT 'buttons', count(*), count(*) FILTER (want = got), round_even(CAST(count(*) FILTER (want = got) AS DOUBLE) / count(*), 6) FROM b
UNION ALL SELECT 'button_recall', count(*), count(*) FILTER (want = got), round_even(CAST(count(*) FILTER (want = got) AS DOUBLE) / count(*), 6) FROM b WHERE want <> ''
""")
def a10(t):
    from ..operators.capture import buttons_for_ops
    from .q_sequences import _offers

    fields, frames = S.field_rates(_verdicts(t), ["game", "seq"])
    want = F.concat_ws(",", buttons_for_ops(F.col("ops")))
    b = _offers(t).select(want.alias("want"), F.when(F.col("k") % 8 == 0, "").otherwise(want).alias("got"))
    b = S.button_rates(b)
    out = fields.unionByName(frames.select(F.lit("all").alias("field"), "total", "hit", "rate")).unionByName(b)
    return out.withColumn("rate", r6(F.col("rate")))


CTE["cons"] = """
WITH g AS (SELECT * FROM smp WHERE n_feat >= 2 AND score > 0),
w AS (SELECT a.round, a.pos, a.seq, a.d_along, a.d_cross, sum(b.score) AS w FROM g a JOIN g b ON a.round = b.round AND a.pos = b.pos AND abs(a.d_along - b.d_along) <= 12 AND abs(a.d_cross - b.d_cross) <= 12 GROUP BY ALL),
l AS (SELECT round, pos, arg_max({'a': d_along, 'c': d_cross, 'w': w}, w * 1000000000 - seq) AS l FROM w GROUP BY round, pos),
m AS (SELECT g.round, g.pos, sum(g.score) AS tot, sum(g.score) FILTER (abs(d_along - l.a) <= 12 AND abs(d_cross - l.c) <= 12) AS win,
  sum(g.score * d_along) FILTER (abs(d_along - l.a) <= 12 AND abs(d_cross - l.c) <= 12) AS sa, sum(g.score * d_cross) FILTER (abs(d_along - l.a) <= 12 AND abs(d_cross - l.c) <= 12) AS sc, count(*) AS n FROM g JOIN l USING (round, pos) GROUP BY g.round, g.pos),
k AS (SELECT DISTINCT round, pos FROM smp)
SELECT round, pos, coalesce(n, 0) AS n, CASE WHEN n >= 3 AND CAST(win AS DOUBLE) / tot >= 0.55e0 THEN round_even(CAST(sa AS DOUBLE) / win, 1) END AS d_along,
  CASE WHEN n >= 3 AND CAST(win AS DOUBLE) / tot >= 0.55e0 THEN round_even(CAST(sc AS DOUBLE) / win, 1) END AS d_cross, CASE WHEN n >= 3 AND CAST(win AS DOUBLE) / tot >= 0.55e0 THEN round_even(CAST(win AS DOUBLE) / tot, 3) END AS conf
FROM k LEFT JOIN m USING (round, pos)
"""


@query("a11_round_consensus", "SELECT * FROM cons")
def a11(t):
    return CN.round_consensus(t.smp, ["round", "pos"], "seq")


@query("a12_dominant_cluster", """
WITH v AS (SELECT pos, d_along AS x FROM smp), c AS (SELECT a.pos, a.x, (SELECT count(*) FROM v b WHERE b.pos = a.pos AND b.x BETWEEN a.x - 6 AND a.x + 6) AS c FROM (SELECT DISTINCT pos, x FROM v) a),
b AS (SELECT pos, arg_max(x, c * 100 - x) AS x, max(c) AS c FROM c GROUP BY pos)
SELECT v.pos, count(*) AS n, round_even(median(v.x) FILTER (abs(v.x - b.x) <= 6), 1) AS center, round_even(CAST(any_value(b.c) AS DOUBLE) / count(*), 3) AS share FROM v JOIN b USING (pos) GROUP BY v.pos
""")
def a12(t):
    return CN.dominant(t.smp.select("pos", "d_along"), ["pos"], "d_along", 6)


@query("a13_uniformity", """
WITH p AS (SELECT s.round, s.pos, c.d_along AS a, c.d_cross AS c, CASE WHEN s.seq % 97 = 0 THEN 1 ELSE 0 END AS odd FROM smp s JOIN cons c USING (round, pos)),
r AS (SELECT round, pos, count(DISTINCT (a + odd, c)) FILTER (a IS NOT NULL) + max(CASE WHEN a IS NULL THEN 1 ELSE 0 END) AS nv, count(*) FILTER (a IS NOT NULL) = 0 AS low FROM p GROUP BY round, pos)
SELECT count(*) AS rounds, count(*) FILTER (nv <> 1) AS nonuniform, count(*) FILTER (low) AS low_conf, round_even(CAST(count(*) FILTER (low) AS DOUBLE) / count(*), 6) AS low_share FROM r
""")
def a13(t):
    c = CN.round_consensus(t.smp, ["round", "pos"], "seq").select("round", "pos", "d_along", "d_cross")
    d = t.smp.select("round", "pos", "seq").join(c, ["round", "pos"])
    d = d.withColumn("d_along", F.col("d_along") + F.when(F.col("seq") % 97 == 0, 1).otherwise(0))
    return CN.uniformity_report(CN.uniformity(d, ["round", "pos"], ["d_along", "d_cross"])).withColumn("low_share", r6(F.col("low_share")))


def _fit_sql() -> str:
    s = "WITH d0 AS (SELECT seat AS pos, seq, k AS x, 2 * k + seat + CASE WHEN seq % 10 = 0 THEN 40 ELSE seq % 5 END AS y FROM ev)"
    for i in (1, 2):
        p = f"d{i - 1}"
        s += f""", f{i} AS (SELECT pos, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM {p} GROUP BY pos),
r{i} AS (SELECT {p}.*, y - (a * x + b) AS r FROM {p} JOIN f{i} USING (pos)), m{i} AS (SELECT pos, median(r) AS m FROM r{i} GROUP BY pos),
q{i} AS (SELECT r{i}.*, abs(r - m) < 4 AS keep FROM r{i} JOIN m{i} USING (pos)), c{i} AS (SELECT pos, count(*) FILTER (keep) AS kc FROM q{i} GROUP BY pos),
d{i} AS (SELECT q{i}.pos, seq, x, y FROM q{i} JOIN c{i} USING (pos) WHERE keep OR kc < 8)"""
    s += """, f AS (SELECT pos, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, count(*) AS n_used FROM d2 GROUP BY pos)
SELECT pos, (SELECT count(*) FROM d0 WHERE d0.pos = d2.pos) AS n, any_value(n_used) AS n_used, round_even(any_value(a), 6) AS slope, round_even(any_value(b), 6) AS intercept, round_even(sqrt(avg((y - (a * x + b)) ** 2)), 6) AS rmse FROM d2 JOIN f USING (pos) GROUP BY d2.pos"""
    return s


@query("a14_robust_line", _fit_sql())
def a14(t):
    k, seq = F.col("k"), F.col("seq")
    d = t.ev.select(F.col("seat").alias("pos"), k.alias("x"), (2 * k + F.col("seat") + F.when(seq % 10 == 0, 40).otherwise(seq % 5)).alias("y"))
    f = CN.robust_line(d, ["pos"])
    return f.select("pos", "n", "n_used", r6(F.col("slope")).alias("slope"), r6(F.col("intercept")).alias("intercept"), r6(F.col("rmse")).alias("rmse"))


@query("a15_offset_spread", """
WITH p AS (SELECT round, pos, count(*) AS n, stddev_pop(d_along) AS s, avg(d_along) AS m FROM smp GROUP BY round, pos)
SELECT 'pos' AS what, pos, count(*) AS n, round_even(stddev_pop(d_along), 6) AS a, round_even(median(d_along), 6) AS b FROM smp GROUP BY pos
UNION ALL SELECT 'rounds', NULL, count(*), round_even(avg(s) FILTER (n >= 2), 6), round_even(stddev_pop(m), 6) FROM p
""")
def a15(t):
    per, rounds = CN.offset_spread(t.smp, ["round"], "pos", "d_along")
    return per.select(F.lit("pos").alias("what"), "pos", "n", r6(F.col("sigma")).alias("a"), r6(F.col("median")).alias("b")).unionByName(
        rounds.select(F.lit("rounds").alias("what"), F.lit(None).cast("int").alias("pos"), F.col("rounds").alias("n"), r6(F.col("within")).alias("a"), r6(F.col("across")).alias("b")))


CTE["pilec"] = """
SELECT frame, det_id, CAST(frame % 4 AS INTEGER) AS pos, 1 + frame % 3 AS want, x0 AS cx, y0 AS cy, CASE WHEN frame % 2 = 0 THEN 1e0 ELSE 0e0 END AS ux, CASE WHEN frame % 2 = 0 THEN 0e0 ELSE 1e0 END AS uy, l_quantity * 2 AS extent, 15e0 AS face FROM bx
"""


@query("a16_pile_fit", """
WITH n AS (SELECT *, count(*) OVER (PARTITION BY frame) AS n, cx * ux + cy * uy AS t FROM pilec),
a AS (SELECT frame, pos, row_number() OVER (PARTITION BY frame ORDER BY t, det_id) - 1 AS k, cx, cy FROM n WHERE n = want),
m AS (SELECT frame, pos, unnest(range(want)) AS k, cx, cy, ux, uy, extent / want AS st, extent FROM n WHERE n = 1 AND want > 1 AND extent BETWEEN 0.75e0 * want * face AND 1.30e0 * want * face),
c AS (SELECT * FROM a UNION ALL SELECT frame, pos, k, cx + (k * st - (extent / 2 - st / 2)) * ux, cy + (k * st - (extent / 2 - st / 2)) * uy FROM m),
s AS (SELECT *, cx - lag(cx) OVER w AS sx, cy - lag(cy) OVER w AS sy FROM c WINDOW w AS (PARTITION BY frame, pos ORDER BY k))
SELECT pos, count(*) FILTER (k = 0) AS n, round_even(stddev_pop(cx) FILTER (k = 0), 6) AS anchor_sd_x, round_even(stddev_pop(cy) FILTER (k = 0), 6) AS anchor_sd_y,
  round_even(median(cx) FILTER (k = 0), 6) AS anchor_x, round_even(median(cy) FILTER (k = 0), 6) AS anchor_y, round_even(median(sx) FILTER (k > 0), 6) AS step_x, round_even(median(sy) FILTER (k > 0), 6) AS step_y,
  round_even(stddev_pop(sx) FILTER (k > 0), 6) AS step_sd_x, round_even(stddev_pop(sy) FILTER (k > 0), 6) AS step_sd_y FROM s GROUP BY pos
""")
def a16(t):
    f = F.col("frame")
    d = t.bx.select(
        "frame", F.col("det_id").alias("comp_id"), (f % 4).cast("int").alias("pos"), (1 + f % 3).alias("want"), F.col("x0").alias("cx"), F.col("y0").alias("cy"),
        F.when(f % 2 == 0, 1.0).otherwise(0.0).alias("ux"), F.when(f % 2 == 0, 0.0).otherwise(1.0).alias("uy"), (F.col("l_quantity") * 2).alias("extent"), F.lit(15.0).alias("face"))
    c = stage(CN.pile_centers(d, ["frame", "pos"]), "centers")
    out = CN.pile_fit(c, ["frame", "pos"], "pos")
    return out.select("pos", "n", *[r6(F.col(x)).alias(x) for x in out.columns if x not in ("pos", "n")])


@query("j18_override_lookup", """
SELECT s.round, s.pos, s.seq, CASE WHEN c.d_along IS NULL THEN 0e0 ELSE greatest(-70e0, least(70e0, c.d_along * 3)) END AS shift_along,
  CASE WHEN c.d_along IS NULL THEN 0e0 ELSE greatest(-70e0, least(70e0, c.d_cross - 90)) END AS shift_cross, c.d_along IS NOT NULL AS reliable FROM smp s LEFT JOIN cons c USING (round, pos)
""")
def j18(t):
    o = CN.round_consensus(t.smp, ["round", "pos"], "seq").withColumns({"d_along": F.col("d_along") * 3, "d_cross": F.col("d_cross") - 90})
    o = stage(o.select("round", "pos", "d_along", "d_cross"), "overrides")  # else the boxes are sorted beside all that makes them
    d = CN.apply_overrides(t.smp.select("round", "pos", "seq"), o, ["round", "pos"])
    return d.select("round", "pos", "seq", "shift_along", "shift_cross", "reliable")


@query("a18_gate_report", """
WITH f AS (SELECT frame, count(*) FILTER (NOT ok) AS bad FROM ver GROUP BY frame)
SELECT least(bad, 5) AS bad, CASE WHEN bad = 0 THEN 'keep' WHEN bad <= 2 THEN 'drop_boxes' ELSE 'drop_frame' END AS decision, count(*) AS frames, NULL AS p10, NULL AS p50, NULL AS p90 FROM f GROUP BY ALL
UNION ALL SELECT NULL, CASE WHEN ok THEN 'pass' ELSE 'fail' END, count(*), round_even(quantile_cont(conf, 0.1), 6), round_even(quantile_cont(conf, 0.5), 6), round_even(quantile_cont(conf, 0.9), 6) FROM ver GROUP BY ok
""")
def a18(t):
    v = box_verdicts(t)
    none = lambda c: F.lit(None).cast("double").alias(c)
    g = S.gate_report(v, "frame").select(F.col("bad").cast("long").alias("bad"), "decision", "frames", none("p10"), none("p50"), none("p90"))
    p = S.confidence_percentiles(v).join(v.groupBy("ok").agg(F.count(F.lit(1)).alias("frames")), "ok")
    return g.unionByName(p.select(F.lit(None).cast("long").alias("bad"), F.when(F.col("ok"), "pass").otherwise("fail").alias("decision"), "frames",
                                  *[r6(F.col(c)).alias(c) for c in ("p10", "p50", "p90")]))


@query("a19_sample_weights", "SELECT key, cls, round_even(1e0 / count(*) OVER (PARTITION BY cls), 9) AS weight FROM docs")
def a19(t):
    return S.inverse_frequency(t.docs.select("key", "cls"), "cls").select("key", "cls", F.bround("weight", 9).alias("weight"))


AP_GT = "SELECT frame, cls, det_id AS gt_id, x0, y0, x1, y1 FROM bx"


@query("a20_average_precision", f"""
WITH g AS ({AP_GT}), d AS (SELECT frame, CASE WHEN l_linenumber = 4 THEN (cls + 1) % 38 ELSE cls END AS cls, det_id, score100, x0 + score100 + shift AS x0, y0, x1 + score100 + shift AS x1, y1 FROM (SELECT *, CASE WHEN l_linenumber = 2 THEN 100000 ELSE 0 END AS shift FROM bx)),
dd AS (SELECT * FROM d),
p AS (SELECT dd.frame, dd.cls, dd.det_id, dd.score100, g.gt_id, least(dd.x1, g.x1) - greatest(dd.x0, g.x0) AS iw, least(dd.y1, g.y1) - greatest(dd.y0, g.y0) AS ih, (dd.x1 - dd.x0) * (dd.y1 - dd.y0) + (g.x1 - g.x0) * (g.y1 - g.y0) AS ar FROM dd JOIN g USING (frame, cls)),
i AS (SELECT *, iw * ih / (ar - iw * ih) AS iou FROM p WHERE iw > 0 AND ih > 0),
b AS (SELECT frame, cls, det_id, score100, gt_id FROM (SELECT *, row_number() OVER (PARTITION BY frame, det_id ORDER BY iou DESC, gt_id) AS rn FROM i WHERE iou >= 0.5e0) WHERE rn = 1),
tp AS (SELECT frame, det_id FROM (SELECT *, row_number() OVER (PARTITION BY frame, cls, gt_id ORDER BY score100 DESC, det_id) AS rn FROM b) WHERE rn = 1),
s AS (SELECT dd.cls, dd.score100, count(tp.det_id) AS t, count(*) AS n FROM dd LEFT JOIN tp USING (frame, det_id) GROUP BY ALL),
c AS (SELECT cls, score100, t, CAST(sum(t) OVER w AS DOUBLE) / sum(n) OVER w AS p FROM s WINDOW w AS (PARTITION BY cls ORDER BY score100 DESC ROWS UNBOUNDED PRECEDING)),
e AS (SELECT cls, t, max(p) OVER (PARTITION BY cls ORDER BY score100 ROWS UNBOUNDED PRECEDING) AS env FROM c),
a AS (SELECT cls, sum(env * t) AS s FROM e GROUP BY cls), ng AS (SELECT cls, count(*) AS n_gt FROM g GROUP BY cls),
ap AS (SELECT cls, n_gt, coalesce(s / n_gt, 0e0) AS ap FROM ng LEFT JOIN a USING (cls))
SELECT 'class' AS what, cls, n_gt, round_even(ap, 6) AS ap FROM ap UNION ALL SELECT 'tile', NULL, count(*), round_even(avg(ap), 6) FROM ap
""")
def a20(t):
    s = F.col("score100")
    g = t.bx.select("frame", "cls", F.col("det_id").alias("gt_id"), "x0", "y0", "x1", "y1")
    cls = F.when(F.col("l_linenumber") == 4, (F.col("cls") + 1) % 38).otherwise(F.col("cls"))
    shift = s + F.when(F.col("l_linenumber") == 2, 100_000).otherwise(0)  # second lines miss their truth
    d = t.bx.select("frame", cls.alias("cls"), "det_id", s.alias("score"), (F.col("x0") + shift).alias("x0"), "y0", (F.col("x1") + shift).alias("x1"), "y1")
    m = stage(S.match_detections(d, g).select("cls", "score", "tp"), "matched")  # boxes end here
    ap = S.average_precision(m, g, "score", F.floor(F.col("_neg") / 4))
    one = ap.select(F.lit("class").alias("what"), "cls", "n_gt", r6(F.col("ap")).alias("ap"))
    grp = S.grouped_ap(ap).select(F.col("kind").alias("what"), F.lit(None).cast("int").alias("cls"), F.col("classes").alias("n_gt"), r6(F.col("map")).alias("ap"))
    return one.unionByName(grp)


@query("a22_agreement", """
WITH a AS (SELECT game, seq, type, pai FROM ev), b AS (SELECT game, seq, CASE WHEN k % 21 = 0 THEN NULL ELSE type END AS type, CASE WHEN k % 15 = 0 THEN 'zz' ELSE pai END AS pai FROM ev WHERE seq % 7 > 0)
SELECT count(*) FILTER (b.type IS NULL) AS errors, count(*) FILTER (b.type IS NOT NULL AND a.type = b.type AND a.pai = b.pai) AS agree, count(*) FILTER (b.type IS NOT NULL AND NOT (a.type = b.type AND a.pai = b.pai)) AS disagree
FROM a LEFT JOIN b USING (game, seq)
""")
def a22(t):
    k = F.col("k")
    a = t.ev.select("game", "seq", "type", "pai")
    b = t.ev.filter(F.col("seq") % 7 > 0).select("game", "seq", F.when(k % 21 != 0, F.col("type")).alias("type"), F.when(k % 15 == 0, "zz").otherwise(F.col("pai")).alias("pai"))
    return S.agreement(a, b, ["game", "seq"])


@query("a23_round_trip_audit", """
SELECT CASE WHEN k % 10 = 0 THEN 'skipped_violations' WHEN k % 10 = 1 THEN 'skipped_call_pending' WHEN k % 4 = 3 THEN 'infeasible' WHEN seat <> target OR k % 3 = 0 THEN 'mismatch' ELSE 'ok' END AS outcome, count(*) AS n FROM ev GROUP BY ALL
""")
def a23(t):
    k = F.col("k")
    a = F.struct(F.col("seat").alias("drawn"), F.array("pai").alias("dora"))
    b = F.struct(F.col("target").alias("drawn"), F.when(k % 3 == 0, F.array("pai", "pai")).otherwise(F.array("pai")).alias("dora"))
    d = t.ev.withColumns({"a": a, "b": b})
    d = d.select(F.when(k % 10 == 0, "violations").when(k % 10 == 1, "call_pending").alias("skipped"), (k % 4 != 3).alias("feasible"),
                 S.zone_diff(F.col("a"), F.col("b"), ["drawn", "dora"]).alias("zones"))
    return S.audit(d)


@query("a24_tile_histogram", f"""
SELECT frame, {', '.join(f'''count(*) FILTER (b = '{x}') AS "{x}"''' for x in dims.TILES[:34])} FROM (SELECT frame, CASE WHEN gt LIKE '5_r' THEN left(gt, 2) ELSE gt END AS b FROM bag) GROUP BY frame
""")
def a24(t):
    return S.histogram34(t.bag, ["frame"], "gt")


@query("k1_top_confusions", """
WITH p AS (SELECT gt, pred, count(*) AS n FROM bag WHERE gt <> pred GROUP BY gt, pred ORDER BY n DESC, gt, pred LIMIT 12)
SELECT gt, pred, n, least(n, 5) AS n_examples FROM p
""")
def k1(t):
    d = t.bag.select("gt", "pred", F.concat_ws("-", F.col("frame").cast("string"), F.col("zone"), F.col("pos").cast("string")).alias("key"))
    d = S.top_confusions(d, 12, 5, "key")
    return d.groupBy("gt", "pred", "n").agg(F.count(F.lit(1)).alias("n_examples"))


@query("k2_worst_classes", """
SELECT gt, count(*) AS n, count(*) FILTER (gt = pred) AS correct, round_even(CAST(count(*) FILTER (gt = pred) AS DOUBLE) / count(*), 6) AS acc FROM bag GROUP BY gt
ORDER BY CAST(count(*) FILTER (gt = pred) AS DOUBLE) / count(*), gt LIMIT 12
""")
def k2(t):
    return S.worst_classes(t.bag, 12).withColumn("acc", r6(F.col("acc")))
