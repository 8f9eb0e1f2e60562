"""Queries for rules and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.num import r6
from ..functions.sqltext import sql_list
from ..functions.tiles import lit_array
from ..operators import gates as GT
from ..operators import replay as R
from .proxies import CTE
from .registry import query

TN = sql_list(dims.TILES)


@query("f6_state_invariants", """
WITH z AS (SELECT game, CASE WHEN pai LIKE '5_r' THEN left(pai, 2) ELSE pai END AS b FROM ev WHERE type IN ('tsumo', 'dahai')),
s AS (SELECT DISTINCT game, game % 4 AS hero, game % 15 AS h, game % 3 AS m FROM ev)
SELECT game, 'tile ' || b || ' seen ' || count(*) || '>4 times across visible zones' AS message FROM z GROUP BY game, b HAVING count(*) > 4
UNION ALL SELECT game, 'hero hand ' || h || ' + 3*' || m || ' melds = ' || (h + 3 * m) || ' not in 13/14' FROM s WHERE h > 0 AND h + 3 * m NOT IN (13, 14)
UNION ALL SELECT game, 'seat ' || i || ' concealed count ' || (game % 7 - i) || ' < 0' FROM (SELECT *, unnest([0, 1, 2, 3]) AS i FROM s) WHERE game % 7 - i < 0
""")
def f6(t):
    g = F.col("game")
    zone = t.ev.filter(F.col("type").isin("tsumo", "dahai")).select("game", F.col("pai").alias("tile"))
    states = t.ev.select("game").distinct().select("game", (g % 4).alias("hero"), (g % 15).alias("n_hand"), (g % 3).alias("n_melds"),
                                                   F.array(*[g % 7 - s for s in range(4)]).alias("concealed"))
    return GT.check_invariants(states, zone, ["game"])


F7 = f"""
SELECT game, seq, k, pai, CASE WHEN pai LIKE '5_r' THEN left(pai, 2) ELSE pai END AS base, 10 + k % 5 AS nh, list_transform(range(10 + k % 5), lambda i: ({TN})[(k + i) % 37 + 1]) AS hand,
  CASE WHEN k % 3 = 0 THEN pai END AS drawn, k % 7 AS nr, k % 2 AS nm, (['chi', 'pon', 'daiminkan', 'ankan', 'kakan'])[k % 5 + 1] AS mt, k % 4 AS rel, k % 3 AS nd,
  CASE WHEN k % 11 > 0 THEN k % 3 END AS kt, CASE WHEN k % 6 > 0 THEN 100000 - 1000 * (k % 4) END AS pts, CASE WHEN k % 4 > 0 THEN 70 - k % 9 END AS lf, (k % 13 = 0) AS odd FROM ev
"""


@query("f7_observed_rules", f"""
WITH s AS ({F7}),
c AS (SELECT *, CASE WHEN nm = 1 AND mt IN ('daiminkan', 'ankan', 'kakan') THEN 1 ELSE 0 END AS kans, nh + 3 * nm AS total, CAST(k % 2 = 0 AS INTEGER) + CAST(k % 5 = 0 AS INTEGER) AS reaches,
  nd + CAST(odd AS INTEGER) AS ndora FROM s),
t AS (SELECT game, seq, CASE WHEN x LIKE '5_r' THEN left(x, 2) ELSE x END AS b FROM (SELECT game, seq,
    unnest(hand || CASE WHEN drawn IS NULL THEN [] ELSE [drawn] END || list_transform(range(nr + 3 * nm), lambda i: pai) || list_transform(range(nd), lambda i: '1m')) AS x FROM c))
SELECT game, seq, 'tile ' || b || ' seen ' || count(*) || '>4 times across visible zones' AS message FROM t GROUP BY game, seq, b HAVING count(*) > 4
UNION ALL SELECT game, seq, 'unknown tile name ''zz''' FROM c WHERE odd
UNION ALL SELECT game, seq, 'hero hand ' || nh || ' + 3*' || nm || ' melds != 13' FROM c WHERE total <> 13 AND NOT (total = 14 AND drawn IS NULL AND nm = 1 AND mt IN ('chi', 'pon'))
UNION ALL SELECT game, seq, 'no dora marker visible' FROM c WHERE ndora = 0
UNION ALL SELECT game, seq, ndora || ' dora markers but only ' || kans || ' kans' FROM c WHERE ndora - 1 > kans
UNION ALL SELECT game, seq, 'seat 1 concealed ' || (k % 15) || ' != 13(+1) for 0 melds' FROM c WHERE k % 15 NOT IN (13, 14)
UNION ALL SELECT game, seq, 'seat 0 ' || mt || ' from_rel ' || rel || ' invalid' FROM c WHERE nm = 1 AND mt IN ('chi', 'pon', 'daiminkan') AND rel = 0
UNION ALL SELECT game, seq, 'seat 0 chi from_rel ' || rel || ' != 3 (kamicha only)' FROM c WHERE nm = 1 AND mt = 'chi' AND rel <> 3
UNION ALL SELECT game, seq, 'kyotaku ' || kt || ' < visible riichi count ' || reaches FROM c WHERE kt < reaches AND NOT (kt = reaches - 1 AND k % 2 = 0 AND nr > 0)
UNION ALL SELECT game, seq, 'scores sum ' || pts || ' + 1000*' || kt || ' kyotaku != 100000' FROM c WHERE pts + 1000 * kt <> 100000
UNION ALL SELECT game, seq, 'wall count ' || lf || ' vs predicted ' || w || ' (>1 off)' FROM (SELECT *, 70 - nr - kans - CAST(drawn IS NOT NULL AS INTEGER) AS w FROM c) WHERE abs(w - lf) > 1
UNION ALL SELECT game, seq, 'seat 0 riichi with open melds' FROM c WHERE k % 2 = 0 AND nm = 1 AND mt <> 'ankan'
""")
def f7(t):
    k, pai, tiles = F.col("k"), F.col("pai"), lit_array(dims.TILES)
    no_river = F.array().cast("array<struct<pai: string, sideways: boolean>>")
    no_meld = F.array().cast("array<struct<type: string, tiles: array<string>, from_rel: int>>")
    river = F.when(k % 7 > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), k % 7)), lambda i: F.struct(pai.alias("pai"), (i == k % 7).alias("sideways")))).otherwise(no_river)
    meld = F.when(k % 2 == 1, F.array(F.struct(F.get(lit_array(["chi", "pon", "daiminkan", "ankan", "kakan"]), k % 5).alias("type"), F.array(pai, pai, pai).alias("tiles"), (k % 4).alias("from_rel")))).otherwise(no_meld)
    q = F.floor((100000 - 1000 * (k % 4)) / 4).cast("int")
    d = t.ev.select(
        "game", "seq", F.transform(F.sequence(F.lit(0), 9 + k % 5), lambda i: F.get(tiles, (k + i) % 37)).alias("o_hand"), F.when(k % 3 == 0, pai).alias("drawn"),
        F.array(river, no_river, no_river, no_river).alias("o_rivers"), F.array(meld, no_meld, no_meld, no_meld).alias("o_melds"),
        F.concat(F.array_repeat(F.lit("1m"), k % 3), F.when(k % 13 == 0, F.array(F.lit("zz"))).otherwise(F.array().cast("array<string>"))).alias("dora"),
        F.array(F.lit(None).cast("int"), k % 15, F.lit(13), F.lit(None).cast("int")).alias("o_concealed"),
        F.array(k % 2 == 0, k % 5 == 0, F.lit(False), F.lit(False)).alias("o_reach"), F.when(k % 11 > 0, k % 3).alias("kyotaku"),
        F.when(k % 6 > 0, F.array(q, q, q, q)).alias("scores"), F.when(k % 4 > 0, 70 - k % 9).alias("left_tiles"))
    return GT.violation_rows(GT.check_observed(d), ["game", "seq"])


CTE["ver"] = f"""
SELECT key, frame, gt, sideways, CASE WHEN felt THEN false ELSE top = gt OR conf0 >= 0.5e0 END AS ok, CASE WHEN felt THEN '' ELSE top END AS pred, CASE WHEN felt THEN 0e0 ELSE conf0 END AS conf,
  CASE WHEN felt THEN 'empty_felt' WHEN top = gt OR conf0 >= 0.5e0 THEN '' ELSE 'mismatch' END AS reason
FROM (SELECT *, ({TN})[list_position(probs, list_max(probs))] AS top, probs[list_position({TN}, gt)] AS conf0 FROM prob)
"""


def _verdicts(t):
    v = GT.verdict(F.col("probs"), F.col("gt"), F.col("felt"))
    return t.prob.select("key", "frame", "gt", "sideways", v.alias("v")).select("key", "frame", "gt", "sideways", "v.*")


@query("f9_box_verdict", "SELECT key, gt, ok, pred, round_even(conf, 6) AS conf, reason FROM ver")
def f9(t):
    return _verdicts(t).select("key", "gt", "ok", "pred", r6(F.col("conf")).alias("conf"), "reason")


@query("f10_frame_decision", """
SELECT frame, count(*) FILTER (NOT ok) AS n_bad, CASE WHEN count(*) FILTER (NOT ok) = 0 THEN 'keep' WHEN count(*) FILTER (NOT ok) <= 2 THEN 'drop_boxes' ELSE 'drop_frame' END AS decision FROM ver GROUP BY frame
""")
def f10(t):
    d = _verdicts(t).groupBy("frame").agg(F.count_if(~F.col("ok")).alias("n_bad"))
    return d.withColumn("decision", GT.decide(F.col("n_bad")))


@query("f11_gate_frame", """
WITH p AS (SELECT frame, count(*) FILTER (NOT ok AND NOT sideways) AS n_bad FROM ver GROUP BY frame)
SELECT key, frame, n_bad, NOT sideways AND (n_bad > 2 OR (n_bad > 0 AND NOT ok)) AS dropped FROM ver JOIN p USING (frame)
""")
def f11(t):
    return GT.gate_boxes(_verdicts(t), "frame").select("key", "frame", "n_bad", "dropped")


@query("f12_unlabeled_button", """
SELECT frame, bool_or(l_linenumber = 7 AND l_returnflag = 'R') AS drop_detector FROM bx GROUP BY frame
""")
def f12(t):
    flag = F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R"), "count_mismatch").otherwise("other")
    d = t.bx.select("frame", flag.alias("flag")).groupBy("frame").agg(F.collect_set("flag").alias("flags"))
    return d.select("frame", GT.unlabeled_button(F.col("flags")).alias("drop_detector"))


@query("f13_row_moving", """
SELECT frame, bool_or(l_linenumber = 5 AND cls % 3 < 2) AS drop_frame FROM bx GROUP BY frame
""")
def f13(t):
    c = F.col("cls") % 3
    flag = F.when(F.col("l_linenumber") == 5, F.concat(F.lit("pos1:"), F.when(c == 0, "backs_sorting").when(c == 1, "backs_holding").otherwise("backs_bad_row_n=0"))).otherwise("hud:score_anim")
    d = t.bx.select("frame", flag.alias("flag")).groupBy("frame").agg(F.collect_set("flag").alias("flags"))
    return d.select("frame", GT.row_moving(F.col("flags")).alias("drop_frame"))


@query("f14_wide_screen", "SELECT frame, det_id, abs((1240 + x0) / (700 + y0 / 4) - 16e0 / 9) <= 0.02e0 AS wide FROM bx")
def f14(t):
    return t.bx.select("frame", "det_id", GT.wide_screen(1240 + F.col("x0"), 700 + F.col("y0") / 4).alias("wide"))


@query("f15_fill_gate", """
WITH s AS (SELECT frame, det_id, l_linenumber % 4 AS pos, l_suppkey AS idx, score100 * 3 AS f, l_linenumber % 4 = frame % 4 AS la, max(l_suppkey) OVER (PARTITION BY frame, l_linenumber % 4) AS newest FROM bx)
SELECT frame, det_id, pos, idx, f >= 25 AS reliable, f < 25 AND la AND idx = newest AS unrendered, f < 25 AND NOT (la AND idx = newest) AS low_conf,
  CASE WHEN f < 25 AND la AND idx = newest THEN 'pos' || pos || ':river[' || idx || ']:unrendered' WHEN f < 25 THEN 'pos' || pos || ':river[' || idx || ']:low_fill=0.' || lpad(CAST(f AS VARCHAR), 2, '0') END AS flag FROM s
""")
def f15(t):
    pos = F.col("l_linenumber") % 4
    d = t.bx.select("frame", "det_id", pos.alias("pos"), F.col("l_suppkey").alias("idx"), (F.col("score100") * 3 / 100.0).alias("fill"), (pos == F.col("frame") % 4).alias("is_last_actor"))
    return GT.fill_gate(d, ["frame", "pos"]).select("frame", "det_id", "pos", "idx", "reliable", "unrendered", "low_conf", "flag")


@query("f16_hand_gate", """
WITH b AS (SELECT frame, det_id, score100 * 4 / 100e0 AS fill, frame % 3 = 0 AS suspect, median(score100 * 4 / 100e0) OVER (PARTITION BY frame) AS med FROM bx)
SELECT frame, det_id, med >= 0.30e0 AND NOT suspect AS reliable, CASE WHEN med < 0.30e0 THEN 'hand:unrendered' WHEN suspect THEN 'hand:deal_unsorted' END AS flag FROM b
""")
def f16(t):
    d = t.bx.select("frame", "det_id", (F.col("score100") * 4 / 100.0).alias("fill"), (F.col("frame") % 3 == 0).alias("suspect"))
    return GT.hand_gate(d, "frame").select("frame", "det_id", "reliable", "flag")


@query("f17_text_gate", """
SELECT frame, det_id, l_linenumber % 3 = 0 OR l_returnflag <> 'R' AS text_reliable, l_linenumber % 3 <> 0 AND l_returnflag <> 'R' AS reader_row FROM bx
""")
def f17(t):
    text = F.when(F.col("l_linenumber") % 3 != 0, F.col("cls").cast("string"))
    d = t.bx.select("frame", "det_id", text.alias("text"), GT.text_gate(text, F.col("l_returnflag") == "R").alias("text_reliable"))
    return d.select("frame", "det_id", "text_reliable", (F.col("text").isNotNull() & F.col("text_reliable")).alias("reader_row"))


@query("f18_marker_gate", "SELECT frame, det_id, NOT (l_returnflag = 'R' AND score100 * 5 < 35) AS reliable FROM bx")
def f18(t):
    return t.bx.select("frame", "det_id", GT.marker_gate(F.col("score100") * 5 / 100.0, F.col("l_returnflag") == "R").alias("reliable"))


CTE["labtxt"] = """
SELECT key, game, CASE WHEN n_chars % 9 = 0 THEN NULL WHEN n_chars % 7 = 0 THEN '' WHEN key % 97 = 0 THEN '3 0.1 0.2 0.3 0.4 0.5 0.6 0.7 0.8' ELSE '3 0.1 0.2 0.3 0.4' END AS txt FROM docs
"""


def _label_files(t):
    n = F.col("n_chars")
    text = F.when(n % 7 == 0, F.lit("\n")).when(F.col("key") % 97 == 0, "\n3 0.1 0.2 0.3 0.4 0.5 0.6 0.7 0.8\n").otherwise("3 0.1 0.2 0.3 0.4\n")
    images = t.docs.filter(F.col("game") != "src3").select("game", F.col("key").cast("string").alias("stem"))
    # some games lack label files
    lab = t.docs.filter(~((n % 9 == 0) & F.col("game").endswith("7"))).select("game", F.col("key").cast("string").alias("stem"), text.alias("text"))
    return images, lab


@query("f19_label_problems", """
WITH i AS (SELECT game, count(*) AS n_img FROM docs WHERE game <> 'src3' GROUP BY game),
l AS (SELECT game, count(*) AS n_lab, min(CAST(key AS VARCHAR)) FILTER (key % 97 = 0 AND n_chars % 7 <> 0) AS bad FROM docs WHERE NOT (n_chars % 9 = 0 AND game LIKE '%7') GROUP BY game),
j AS (SELECT game, coalesce(n_img, 0) AS n_img, coalesce(n_lab, 0) AS n_lab, bad FROM i FULL JOIN l USING (game))
SELECT game, n_img, n_lab, CASE WHEN n_img = 0 THEN 'no yolo/images' WHEN n_img <> n_lab THEN 'truncated: ' || n_img || ' images vs ' || n_lab || ' labels'
  WHEN bad IS NOT NULL THEN bad || '.txt: 9-field rows (want 5 for HBB)' END AS problem FROM j
""")
def f19(t):
    return GT.label_problems(*_label_files(t), 5)


@query("f20_build_funnel", """
WITH f AS (SELECT d.*, e.k, e.type FROM fr JOIN dealw d USING (game, seq) JOIN ev e USING (game, seq) WHERE fr.status IN ('ok', 'timeout')),
r AS (SELECT *, CASE WHEN open AND n_discards = 0 THEN 'deal' WHEN type IN ('chi', 'pon', 'daiminkan', 'ankan', 'kakan', 'nukidora') THEN 'call' WHEN k % 29 = 0 THEN 'violation' WHEN k % 31 = 0 THEN 'unreadable'
  WHEN k % 23 = 0 THEN 'letterbox' WHEN k % 19 = 0 THEN 'sorting' END AS reason, k % 5 AS nb, k % 17 = 0 AS bm FROM f)
SELECT coalesce(reason, 'labeled') AS outcome, count(*) AS frames, count(*) FILTER (reason IS NULL AND nb > 2) AS occluded_frames,
  CAST(coalesce(sum(nb) FILTER (reason IS NULL AND nb BETWEEN 1 AND 2), 0) AS BIGINT) AS occluded_boxes, count(*) FILTER (reason IS NULL AND bm) AS button_dropped, count(*) FILTER (reason IS NULL AND NOT bm) AS detector_frames
FROM r GROUP BY ALL
""")
def f20(t):
    k = F.col("k")
    state = R.replayed(t.mj, ("open",)).select("game", "seq", "k", "type", "open", "n_discards")
    d = t.fr.filter(F.col("status").isin("ok", "timeout")).select("game", "seq").join(state, ["game", "seq"])
    reason = GT.drop_reason({
        "deal": R.deal_window(F.col("open"), F.col("n_discards")), "call": R.in_window(F.array("type"), F.col("type"), dims.CALL_EVENTS),
        "violation": k % 29 == 0, "unreadable": k % 31 == 0, "letterbox": k % 23 == 0, "sorting": k % 19 == 0})
    d = d.select(reason.alias("reason"), (k % 5).alias("n_bad"), F.lit(dims.MAX_BAD).alias("max_bad"), (k % 17 == 0).alias("button_mismatch"))
    return GT.funnel(d)


@query("f21_limit_gate", """
WITH m AS (SELECT 'mislock_' || (k % 4) AS metric, avg(CASE WHEN value > 20 THEN 1e0 ELSE 0e0 END) AS value, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT 'none', NULL, 0)
SELECT metric, n, coalesce(n > 0 AND value <= CASE metric WHEN 'mislock_0' THEN 0.08e0 WHEN 'mislock_1' THEN 0.5e0 WHEN 'mislock_2' THEN 0.9e0 WHEN 'mislock_3' THEN 0.2e0 ELSE 1e0 END, false) AS passed FROM m
""")
def f21(t):
    m = t.ev.groupBy(F.concat(F.lit("mislock_"), (F.col("k") % 4).cast("string")).alias("metric")).agg(
        F.avg((F.col("value") > 20).cast("double")).alias("value"), F.count(F.lit(1)).alias("n"))
    none = t.ev.agg(F.lit("none").alias("metric"), F.avg(F.lit(None).cast("double")).alias("value"), F.count_if(F.lit(False)).alias("n"))
    return GT.limit_gate(m.unionByName(none), {"mislock_0": 0.08, "mislock_1": 0.5, "mislock_2": 0.9, "mislock_3": 0.2, "none": 1.0}).select("metric", "n", "passed")


@query("x3_rule_pack", """
SELECT game, seq, message FROM (SELECT game, seq, unnest([CASE WHEN value > 15 THEN 'value ' || CAST(floor(value) AS BIGINT) || ' too high' END, CASE WHEN k % 9 = 0 THEN 'k divides' END, CASE WHEN syncing THEN 'replayed' END]) AS message FROM ev) WHERE message IS NOT NULL
""")
def x3(t):
    rules = [("high", F.col("value") > 15, F.concat(F.lit("value "), F.floor("value").cast("string"), F.lit(" too high"))),
             ("k", F.col("k") % 9 == 0, F.lit("k divides")), ("sync", F.col("syncing"), F.lit("replayed"))]
    return t.ev.select("game", "seq", F.explode(GT.failed(rules)).alias("message"))
