"""Queries that read raw detections to one observed board per frame (J5, W19-W22, J19, A21 as one flow)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import geometry as G
from ..functions.sqltext import dbl
from ..functions.tiles import lit_array
from ..operators import observe as O
from .proxies import CTE
from .q_geometry import MT, TN, _proj_sql
from .q_joins import ZONES
from .registry import ORACLES, query

_OX = "CASE WHEN frame % 5 = 0 THEN 240 ELSE 0 END"
_SX0, _SY0, _SX1, _SY1 = (dbl(v) for v in dims.DORA_STRIP)


def _case(f) -> str:
    """A fixed value by seat, one for strips and one for rivers."""
    pick = lambda g: "CASE seat " + " ".join(f"WHEN {s} THEN {dbl(g(s))}" for s in range(4)) + " END"
    return f"CASE WHEN strip THEN {pick(lambda s: f(s, True))} ELSE {pick(lambda s: f(s, False))} END"


def _axis(key: str, i: int) -> str:
    names = {"o": "corner", "u": "along", "v": "cross"}
    return _case(lambda s, strip: dims.STRIP["4p"][s][names[key]][i] if strip else G.river_axes("4p", s)[key][i])


def _long_edge() -> str:
    ex, ey = "(CASE WHEN sqrt(ax * ax + ay * ay) >= sqrt(bx * bx + by_ * by_) THEN ax ELSE bx END)", "(CASE WHEN sqrt(ax * ax + ay * ay) >= sqrt(bx * bx + by_ * by_) THEN ay ELSE by_ END)"
    return f"abs({ex} * ux + {ey} * uy) > abs({ex} * vx + {ey} * vy)"


CTE["shots"] = f"""
SELECT frame, det_id, CASE WHEN l_partkey % 11 > 0 THEN ({TN})[cls + 1] END AS tile, score100 AS score, {_OX} AS ox, 1920 + 2 * ({_OX}) AS fw,
  x0 * 18 + l_linenumber AS x0, y0 * 11 + 5 AS y0, x0 * 18 + l_linenumber + 30 + l_quantity AS x1, y0 * 11 + 45 + 20 * l_linenumber AS y1 FROM bx
"""
CTE["flat"] = f"""
SELECT *, {", ".join(f"{_proj_sql(f'({x} - ox) / 1920 * 1920', f'({y} / 1080 * 1080)', MT['full'], a)} AS p{i}{'xy'[a]}" for i, (x, y) in enumerate((('x0', 'y0'), ('x1', 'y0'), ('x1', 'y1'), ('x0', 'y1'))) for a in (0, 1))} FROM shots
"""
CTE["routed"] = f"""
SELECT *, CASE WHEN strip THEN 'meld' ELSE 'river' END AS kind, list_min([p0x, p1x, p2x, p3x]) AS lx, list_max([p0x, p1x, p2x, p3x]) AS hx FROM (
SELECT *, z.d AS dist, CAST(z.o // 2 AS INTEGER) AS seat, z.o % 2 = 1 AS strip FROM (SELECT *, list_min([{ZONES}]) AS z FROM (
  SELECT *, (p0x + p1x + p2x + p3x) / 4 AS x, (p0y + p1y + p2y + p3y) / 4 AS y FROM flat)))
"""


def _reach(s: int) -> str:
    ax = dims.STRIP["4p"][s]["along" if s in (1, 3) else "cross"]
    at = ", ".join(f"p{i}x * {dbl(ax[0])} + p{i}y * {dbl(ax[1])}" for i in range(4))
    return f"(seat = {s} AND list_max([{at}]) - list_min([{at}]) > {dbl(1.15 * dims.STRIP['4p'][s]['d'])})"


CTE["placed"] = f"""
SELECT *, abs(v - offs[1]) AS d0, abs(v - offs[2]) AS d1, abs(v - offs[3]) AS d2, {_long_edge()} AS sideways FROM (
SELECT *, (x - gx) * ux + (y - gy) * uy AS u, (x - gx) * vx + (y - gy) * vy AS v, p1x - p0x AS ax, p1y - p0y AS ay, p2x - p1x AS bx, p2y - p1y AS by_ FROM (
SELECT *, {_axis('o', 0)} AS gx, {_axis('o', 1)} AS gy, {_axis('u', 0)} AS ux, {_axis('u', 1)} AS uy, {_axis('v', 0)} AS vx, {_axis('v', 1)} AS vy,
  CASE seat {" ".join(f"WHEN {s} THEN [{', '.join(dbl(o) for o in G.river_axes('4p', s)['offs'])}]" for s in range(4))} END AS offs,
  CASE WHEN tile IS NULL THEN 'hud' WHEN ((x0 - ox) / 1920 + (x1 - ox) / 1920) / 2 BETWEEN {_SX0} AND {_SX1} AND (y0 / 1080 + y1 / 1080) / 2 BETWEEN {_SY0} AND {_SY1} THEN CASE WHEN tile = 'back' THEN 'ignored' ELSE 'dora' END
    WHEN tile <> 'back' AND y1 / 1080 - y0 / 1080 >= {dbl(dims.HAND_MIN_H)} AND (y0 / 1080 + y1 / 1080) / 2 >= {dbl(dims.HAND_Y0 - dims.HAND_SLACK)} THEN 'hand'
    WHEN dist > 60 THEN CASE WHEN tile = 'back' THEN 'ignored' WHEN ox > 0 AND (x0 + x1) / 2 < 0.35e0 * fw AND (y0 + y1) / 2 < 0.25e0 * 1080 THEN 'corner' ELSE 'stray' END
    WHEN tile = 'back' AND strip AND ({" OR ".join(_reach(s) for s in (1, 2, 3))}) THEN 'standing' ELSE kind END AS part
FROM routed))
"""
CTE["rowed"] = """
SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS rw, least(d0, d1, d2) <= 0.5e0 * (offs[2] - offs[1]) AS good FROM placed
"""
CTE["ostrips"] = f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY frame, seat ORDER BY u, det_id) AS rn, CASE seat {" ".join(f"WHEN {s} THEN {dbl(0.4 * dims.STRIP['4p'][s]['w'])}" for s in range(4))} END AS near FROM placed WHERE part = 'meld'),
h AS (SELECT frame, seat, rn, u AS ha, v AS hc, tile AS f, 1 AS no, tile AS l, sideways AS s, CAST(NULL AS VARCHAR) AS t FROM o WHERE rn = 1
  UNION ALL SELECT o.frame, o.seat, o.rn, CASE WHEN j THEN ha ELSE u END, CASE WHEN j THEN hc ELSE v END, CASE WHEN j THEN f ELSE tile END, CASE WHEN j THEN no ELSE no + 1 END,
    CASE WHEN j AND v > hc THEN f ELSE tile END, j OR sideways, CASE WHEN NOT j THEN NULL WHEN v > hc THEN tile ELSE f END
  FROM (SELECT o.*, h.ha, h.hc, h.f, h.no, o.u - h.ha < o.near AS j FROM h JOIN o ON o.frame = h.frame AND o.seat = h.seat AND o.rn = h.rn + 1) o)
SELECT frame AS game, seat AS rec, list(cell ORDER BY no) AS c FROM (SELECT frame, seat, no, arg_max({{'l': l, 's': s, 't': coalesce(t, '')}}, rn) AS cell FROM h GROUP BY ALL) GROUP BY ALL
"""
CTE["corners"] = """
SELECT *, abs(cy - median(cy) OVER (PARTITION BY frame)) < 0.6e0 * median(h) OVER (PARTITION BY frame) AS in_row FROM (SELECT *, (y0 + y1) / 2 AS cy, y1 - y0 AS h, (x0 + x1) / 2 AS cx FROM placed WHERE part = 'corner')
"""


def _shots(t):
    b = t.bx
    wide, ln = F.col("frame") % 5 == 0, F.col("l_linenumber")
    ox = F.when(wide, 240).otherwise(0)
    x0, y0 = F.col("x0") * 18 + ln, F.col("y0") * 11 + 5
    return b.select("frame", "det_id", F.when(F.col("l_partkey") % 11 > 0, F.get(lit_array(dims.TILES), F.col("cls"))).alias("tile"), F.col("score100").alias("score"),
                    F.struct(ox.alias("ox"), F.lit(0).alias("oy"), F.lit(1920).alias("bw"), F.lit(1080).alias("bh")).alias("region"),
                    (1920 + 2 * ox).alias("frame_w"), F.lit(1080).alias("frame_h"), x0.alias("x0"), y0.alias("y0"),
                    (x0 + 30 + F.col("l_quantity").cast("double")).alias("x1"), (y0 + 40 + 20 * ln).alias("y1"))


def _observed(t):
    return O.observe(_shots(t), "frame", "det_id", "4p")


def _seats(expr: str) -> str:
    return ", ".join(expr.format(s=s) for s in range(4))


_ZONE = "CASE WHEN p.part IN ('river', 'meld') THEN p.part || p.seat WHEN p.part = 'corner' THEN CASE WHEN c.in_row THEN 'dora' END WHEN p.part IN ('dora', 'hand', 'hud') THEN p.part END"


@query("p20_observe_frames", f"""
WITH own AS (SELECT *, n >= 2 AND k = n AND nx - lag(nx) OVER (PARTITION BY frame ORDER BY k) > {dbl(dims.HAND_W + 0.5 * dims.HAND_GAP)} AS apart FROM (
    SELECT frame, tile, (x0 - ox) / 1920 AS nx, row_number() OVER (PARTITION BY frame ORDER BY (x0 - ox) / 1920, det_id) AS k, count(*) OVER (PARTITION BY frame) AS n FROM placed WHERE part = 'hand')),
hand AS (SELECT frame, string_agg(tile, ' ' ORDER BY k) FILTER (NOT coalesce(apart, false)) AS hand, max(tile) FILTER (apart) AS drawn FROM own GROUP BY frame),
dora AS (SELECT frame, string_agg(tile, ' ' ORDER BY w, x, det_id) AS dora FROM (SELECT frame, tile, 0 AS w, (x0 - ox) / 1920 AS x, det_id FROM placed WHERE part = 'dora' UNION ALL SELECT frame, tile, 1, cx, det_id FROM corners WHERE in_row) GROUP BY frame),
orv AS (SELECT frame, {_seats("string_agg(tile || CASE WHEN sideways THEN '-' ELSE '' END, ' ' ORDER BY rw, u, det_id) FILTER (seat = {s}) AS r{s}, coalesce(bool_or(sideways) FILTER (seat = {s}), false) AS w{s}")} FROM rowed WHERE part = 'river' AND good GROUP BY frame),
ocell AS (SELECT game AS frame, {_seats("max(x) FILTER (rec = {s}) AS c{s}")} FROM (SELECT game, rec, array_to_string(list_transform(c, lambda q: q.l || CASE WHEN q.s THEN '-' ELSE '' END || CASE WHEN q.t <> '' THEN '+' || q.t ELSE '' END), ' ') AS x FROM ostrips) GROUP BY game),
conf AS (SELECT frame, string_agg(zone || '=' || s, ',' ORDER BY zone) AS confidence FROM (SELECT p.frame, {_ZONE} AS zone, min(p.score) AS s FROM placed p LEFT JOIN corners c ON c.frame = p.frame AND c.det_id = p.det_id GROUP BY ALL) WHERE zone IS NOT NULL GROUP BY frame),
off AS (SELECT frame, count(*) AS strays FROM (SELECT frame FROM placed WHERE part = 'stray' UNION ALL SELECT frame FROM corners WHERE NOT in_row) GROUP BY frame)
SELECT f.frame, coalesce(hand, '') AS hand, drawn, coalesce(dora, '') AS dora, {_seats("coalesce(r{s}, '') AS river_{s}, coalesce(w{s}, false) AS reach_{s}, coalesce(c{s}, '') AS strip_{s}")}, coalesce(confidence, '') AS confidence, coalesce(strays, 0) AS strays
FROM (SELECT DISTINCT frame FROM shots) f LEFT JOIN hand USING (frame) LEFT JOIN dora USING (frame) LEFT JOIN orv USING (frame) LEFT JOIN ocell USING (frame) LEFT JOIN conf USING (frame) LEFT JOIN off USING (frame)
""")
def p20_frames(t):
    mark = lambda c: F.when(c, "-").otherwise("")
    river = lambda s: F.array_join(F.transform(F.get("o_rivers", F.lit(s)), lambda x: F.concat(x["pai"], mark(x["sideways"]))), " ")
    strip = lambda s: F.array_join(F.transform(F.get("strips", F.lit(s)), lambda c: F.concat(
        c["label"], mark(c["sideways"]), F.coalesce(F.concat(F.lit("+"), c["stacked"]), F.lit("")))), " ")
    conf = F.array_join(F.transform(F.sort_array(F.map_entries("confidence")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    strays = F.size("strays").cast("long")
    return _observed(t).select("frame", F.array_join("o_hand", " ").alias("hand"), "drawn", F.array_join("dora", " ").alias("dora"),
                               *[c for s in range(4) for c in (river(s).alias(f"river_{s}"), F.get("o_reach", F.lit(s)).alias(f"reach_{s}"), strip(s).alias(f"strip_{s}"))],
                               conf.alias("confidence"), strays.alias("strays"))


@query("j19_observe_melds", ORACLES["j19_meld_parse"].replace("allstrips", "(SELECT game, rec, list_transform(c, lambda q: {'l': q.l, 's': q.s, 't': nullif(q.t, '')}) AS c FROM ostrips)"))
def j19_frames(t):
    """Sets of every frame's strips; a strip that can't be read is one row with its problem."""
    d = _observed(t).select(F.col("frame").alias("game"), F.posexplode(F.arrays_zip("strips", "o_melds", "unread")).alias("rec", "z")).filter(F.size("z.strips") > 0)
    d = d.withColumn("problem", F.col("z.unread"))
    m = d.select("game", "rec", "problem", F.posexplode_outer("z.o_melds").alias("no", "m"))
    return m.select("game", "rec", "no", "m.type", F.when(F.col("m").isNotNull(), F.array_join("m.tiles", " ")).alias("tiles"), "m.called", "m.added", F.col("m.rel").alias("from_rel"), "problem")
