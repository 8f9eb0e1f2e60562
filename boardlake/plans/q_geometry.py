"""Queries for geometry functions and board layout (M*, P5-P9, P20-P23, W16-W18, W24-W26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import geometry as G
from ..functions.num import r6, r9
from ..functions.sqltext import dbl, sql_list
from ..functions.tiles import lit_array
from ..operators import layout as L
from .proxies import CTE
from .registry import query

MT = G.table_matrices()
TN = sql_list(dims.TILES)


def _r(prefix: str, s, names=("x0", "y0", "x1", "y1")):
    return [r6(s[n]).alias(f"{prefix}{n}") for n in names]


def _proj_sql(x: str, y: str, m: tuple, axis: int) -> str:
    a = [dbl(v) for v in m]
    r = a[:3] if axis == 0 else a[3:6]
    return f"(({r[0]} * ({x}) + {r[1]} * ({y}) + {r[2]}) / ({a[6]} * ({x}) + {a[7]} * ({y}) + {a[8]}))"


CTE["shot"] = """
SELECT frame, l_linenumber AS ln, x0 * 19 AS x0, y0 * 11 AS y0, x1 * 13 AS x1, y1 * 9 AS y1 FROM bx
"""


def _shot(t):
    """Boxes spread over a whole screenshot."""
    return t.bx.select("frame", F.col("l_linenumber").alias("ln"), (F.col("x0") * 19).alias("x0"), (F.col("y0") * 11).alias("y0"),
                       (F.col("x1") * 13).alias("x1"), (F.col("y1") * 9).alias("y1"))


@query("m1_projective", f"""
WITH p AS (SELECT frame, ln, x0, y0, {_proj_sql('x0', 'y0', MT['full'], 0)} AS px, {_proj_sql('x0', 'y0', MT['full'], 1)} AS py,
  {_proj_sql('x0', 'y0', MT['square'], 0)} AS sx FROM shot)
SELECT frame, ln, round_even(px, 6) AS px, round_even(py, 6) AS py, round_even(sx, 6) AS sx,
  round_even({_proj_sql('px', 'py', MT['full_inv'], 0)}, 3) + 0e0 AS bx, round_even({_proj_sql('px', 'py', MT['full_inv'], 1)}, 3) + 0e0 AS "by" FROM p
""")
def m1(t):
    p = G.point(F.col("x0"), F.col("y0"))
    d = _shot(t).withColumns({"p": G.project(p, MT["full"]), "s": G.project(p, MT["square"])})
    b = G.project(F.col("p"), MT["full_inv"])
    return d.select("frame", "ln", r6(F.col("p.x")).alias("px"), r6(F.col("p.y")).alias("py"), r6(F.col("s.x")).alias("sx"),
                    (F.bround(b["x"], 3) + 0.0).alias("bx"), (F.bround(b["y"], 3) + 0.0).alias("by"))


CTE["quad"] = """
SELECT frame, l_linenumber AS ln, l_partkey, x0 AS ax, y0 AS ay, x1 AS bx_, y0 + l_linenumber AS by_, x1 + 3 AS cx, y1 AS cy, x0 + 2 AS dx, y1 + l_linenumber AS dy FROM bx
"""


def _quads(t):
    ln = F.col("l_linenumber")
    q = F.array(G.point(F.col("x0"), F.col("y0")), G.point(F.col("x1"), F.col("y0") + ln),
                G.point(F.col("x1") + 3, F.col("y1")), G.point(F.col("x0") + 2, F.col("y1") + ln))
    return t.bx.select("frame", ln.alias("ln"), "l_partkey", q.alias("q"))


@query("m2_quad_boxes", """
SELECT frame, ln, least(ax, bx_, cx, dx) AS x0, least(ay, by_, cy, dy) AS y0, greatest(ax, bx_, cx, dx) AS x1, greatest(ay, by_, cy, dy) AS y1,
  round_even((ax + bx_ + cx + dx) / 4, 6) AS mx, round_even((ay + by_ + cy + dy) / 4, 6) AS my,
  least(ax, bx_, cx, dx) + 3 AS ix0, greatest(ay, by_, cy, dy) - 2 AS iy1, round_even((ax + bx_ + cx + dx) / 4 - 64e0 / 2, 6) AS fx0
FROM quad
""")
def m2(t):
    d = _quads(t).withColumns({"b": G.bbox(F.col("q")), "c": G.center(F.col("q")), "i": G.bbox(G.inset(F.col("q"), 3, 4, 3, 2))})
    d = d.withColumn("f", G.bbox(G.centered_rect(F.col("c"), F.lit(64.0), F.lit(76.0))))
    return d.select("frame", "ln", "b.x0", "b.y0", "b.x1", "b.y1", r6(F.col("c.x")).alias("mx"), r6(F.col("c.y")).alias("my"),
                    F.col("i.x0").alias("ix0"), F.col("i.y1").alias("iy1"), r6(F.col("f.x0")).alias("fx0"))


@query("m3_iou", """
WITH s AS (SELECT *, x0 + l_linenumber AS u0, y0 + 4 AS v0, x1 + l_linenumber AS u1, y1 - 20 AS v1 FROM bx),
i AS (SELECT *, least(x1, u1) - greatest(x0, u0) AS iw, least(y1, v1) - greatest(y0, v0) AS ih FROM s)
SELECT frame, l_linenumber AS ln, CASE WHEN iw > 0 AND ih > 0 THEN round_even(iw * ih / ((x1 - x0) * (y1 - y0) + greatest(0, u1 - u0) * greatest(0, v1 - v0) - iw * ih), 6) ELSE 0e0 END AS iou FROM i
""")
def m3(t):
    ln = F.col("l_linenumber")
    other = {"x0": F.col("x0") + ln, "y0": F.col("y0") + 4, "x1": F.col("x1") + ln, "y1": F.col("y1") - 20}
    return t.bx.select("frame", ln.alias("ln"), r6(G.iou(G.box_cols(), other)).alias("iou"))


def _river_sql(mode: str, pos: int, x: str, y: str) -> str:
    r = G.river_axes(mode, pos)
    u = f"(({x} - {dbl(r['o'][0])}) * {dbl(r['u'][0])} + ({y} - {dbl(r['o'][1])}) * {dbl(r['u'][1])})"
    v = f"(({x} - {dbl(r['o'][0])}) * {dbl(r['v'][0])} + ({y} - {dbl(r['o'][1])}) * {dbl(r['v'][1])})"
    du = f"greatest(0e0, -{u}, {u} - {dbl(10 * r['pitch'])})"
    dv = "least(" + ", ".join(f"abs({v} - {dbl(o)})" for o in r["offs"]) + ")"
    return f"sqrt({du} * {du} + {dv} * {dv})"


def _strip_sql(mode: str, pos: int, x: str, y: str) -> str:
    s = dims.STRIP[mode][pos]
    dx, dy = f"({x} - {dbl(s['corner'][0])})", f"({y} - {dbl(s['corner'][1])})"
    a = f"({dx} * {dbl(s['along'][0])} + {dy} * {dbl(s['along'][1])})"
    c = f"({dx} * {dbl(s['cross'][0])} + {dy} * {dbl(s['cross'][1])})"
    da = f"greatest(0e0, -{a}, {a} - {dbl(16 * s['w'])})"
    dc = f"greatest(0e0, -{c}, {c} - {dbl(2.2 * s['d'])})"
    return f"sqrt({da} * {da} + {dc} * {dc})"


@query("m4_zone_distance", f"""
SELECT frame, ln, {', '.join(f"round_even({_river_sql('4p', s, 'x0', 'y0')}, 6) AS river{s}, round_even({_strip_sql('4p', s, 'x0', 'y0')}, 6) AS strip{s}" for s in range(4))} FROM shot
""")
def m4(t):
    cols = []
    for s in range(4):
        cols += [r6(G.river_distance(F.col("x0"), F.col("y0"), "4p", s)).alias(f"river{s}"),
                 r6(G.strip_distance(F.col("x0"), F.col("y0"), "4p", s)).alias(f"strip{s}")]
    return _shot(t).select("frame", "ln", *cols)


@query("m5_sideways", """
WITH e AS (SELECT frame, ln, bx_ - ax AS e0x, by_ - ay AS e0y, cx - bx_ AS e1x, cy - by_ AS e1y FROM quad),
l AS (SELECT *, sqrt(e0x * e0x + e0y * e0y) AS n0, sqrt(e1x * e1x + e1y * e1y) AS n1 FROM e),
p AS (SELECT *, CASE WHEN n0 >= n1 THEN e0x ELSE e1x END AS lx, CASE WHEN n0 >= n1 THEN e0y ELSE e1y END AS ly FROM l)
SELECT frame, ln, greatest(n0, n1) >= 1e-6 AND abs(lx) > abs(ly) AS sideways FROM p
""")
def m5(t):
    one, zero = F.lit(1.0), F.lit(0.0)
    return _quads(t).select("frame", "ln", G.long_edge_along(F.col("q"), one, zero, zero, one).alias("sideways"))


CTE["comp"] = """
SELECT frame, l_linenumber AS ln, CAST(x0 AS BIGINT) * 9 AS x0, CAST(y0 AS BIGINT) * 7 AS y0, CAST(x0 AS BIGINT) * 9 + 80 + CAST(l_quantity AS BIGINT) * 6 AS x1,
  CAST(y0 AS BIGINT) * 7 + 30 + 17 * l_linenumber AS y1 FROM bx
"""


def _comp(t):
    x0, y0 = F.col("x0").cast("long") * 9, F.col("y0").cast("long") * 7
    return t.bx.select("frame", F.col("l_linenumber").alias("ln"), x0.alias("x0"), y0.alias("y0"),
                       (x0 + 80 + F.col("l_quantity").cast("long") * 6).alias("x1"), (y0 + 30 + 17 * F.col("l_linenumber")).alias("y1"))


@query("m6_banner_box", """
SELECT frame, ln, (x0 + x1) // 2 - 125 AS x0, (y0 + y1) // 2 + 10 - 48 AS y0, (x0 + x1) // 2 + 125 AS x1, (y0 + y1) // 2 + 10 + 48 AS y1, (y0 + y1) // 2 - 48 AS plate_y0 FROM comp
""")
def m6(t):
    c = [F.col(n) for n in ("x0", "y0", "x1", "y1")]
    d = _comp(t).select("frame", "ln", G.banner(*c, dims.BANNER_DY).alias("b"), G.banner(*c, 0).alias("p"))
    return d.select("frame", "ln", "b.*", F.col("p.y0").alias("plate_y0"))


@query("m7_plate_filter", """
SELECT frame, ln, x1 - x0 AS w, y1 - y0 AS h FROM comp
WHERE (x1 - x0) * (y1 - y0) * 7 // 10 >= 5000 AND x1 - x0 > y1 - y0 AND x1 - x0 BETWEEN 120 AND 300 AND y1 - y0 BETWEEN 55 AND 130
""")
def m7(t):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    d = _comp(t).select("frame", "ln", w.alias("w"), h.alias("h"))
    return d.filter(G.plate_like(F.col("w"), F.col("h"), F.floor(F.col("w") * F.col("h") * 7 / 10)))


@query("m8_rigid_shift", """
SELECT frame, ln, ax - 5 * ln AS x0, ay + 2.5e0 AS y0, cx - 5 * ln AS x2, cy + 2.5e0 AS y2 FROM quad
""")
def m8(t):
    d = _quads(t).withColumn("s", G.shift_quad(F.col("q"), -5.0 * F.col("ln"), F.lit(2.5)))
    return d.select("frame", "ln", F.col("s")[0]["x"].alias("x0"), F.col("s")[0]["y"].alias("y0"), F.col("s")[2]["x"].alias("x2"), F.col("s")[2]["y"].alias("y2"))


@query("m9_visible_tiles", f"""
SELECT game, seq, array_to_string([pai] || list_transform(range(k % 4), lambda i: ({TN})[(k + i) % 37 + 1]) || CASE WHEN k % 2 = 0 THEN [pai, pai] ELSE [] END, ' ') AS tiles FROM ev
""")
def m9(t):
    k = F.col("k")
    none = F.array().cast("array<string>")
    river = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), k % 4 - 1)), lambda i: F.get(lit_array(dims.TILES), (k + i) % 37))).otherwise(none)
    melds = F.when(k % 2 == 0, F.array("pai", "pai")).otherwise(none)
    return t.ev.select("game", "seq", F.concat_ws(" ", L.visible_tiles(F.array("pai"), F.array(river), F.array(melds))).alias("tiles"))


@query("p5_relative_seat", """
SELECT game, seq, actor, target, (1 + actor) % 4 AS right_of, ((target - actor) % 4 + 4) % 4 AS rel, (3 + actor) % 4 AS relabelled,
  CASE WHEN k % 5 = 0 THEN NULL ELSE (actor + 2) % 4 END AS across FROM ev
""")
def p5(t):
    a, k = F.col("actor"), F.col("k")
    return t.ev.select("game", "seq", "actor", "target", G.seat_at(a, F.lit(1)).alias("right_of"), G.relative_seat(F.col("target"), a).alias("rel"),
                       G.seat_at(F.lit(3), a).alias("relabelled"), G.seat_at(F.when(k % 5 == 0, -1).otherwise(a), F.lit(2)).alias("across"))


@query("p6_box_algebra", """
WITH n AS (SELECT *, x0 / 1920 AS nx0, y0 / 1080 AS ny0, x1 / 1920 AS nx1, y1 / 1080 AS ny1 FROM shot)
SELECT frame, ln, round_even(nx0, 9) AS nx0, round_even(ny1, 9) AS ny1, CAST(round_even(nx0 * 1279, 0) AS BIGINT) AS px0, CAST(round_even(ny1 * 719, 0) AS BIGINT) AS py1,
  round_even((nx0 + nx1) / 2, 9) AS cx, round_even(ny1 - ny0, 9) AS h, round_even(ny0 + 0.1e0 * (ny1 - ny0), 9) AS ey0, round_even(nx1 - 0.05e0 * (nx1 - nx0), 9) AS ex1 FROM n
""")
def p6(t):
    d = _shot(t).withColumn("n", G.px_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    px, yo, er = G.to_pixels(F.col("n"), F.lit(1279), F.lit(719)), G.yolo(F.col("n")), G.erode(F.col("n"), top=0.1, right=0.05)
    return d.select("frame", "ln", r9(F.col("n.x0")).alias("nx0"), r9(F.col("n.y1")).alias("ny1"), px["x0"].alias("px0"), px["y1"].alias("py1"),
                    r9(yo["cx"]).alias("cx"), r9(yo["h"]).alias("h"), r9(er["y0"]).alias("ey0"), r9(er["x1"]).alias("ex1"))


CTE["reg"] = """
SELECT *, CASE WHEN r > 16e0 / 9 * 1.02e0 THEN (w - bw0) // 2 WHEN r < 16e0 / 9 * 0.98e0 THEN 5 ELSE 0 END AS ox,
  CASE WHEN r < 16e0 / 9 * 0.98e0 THEN 10 ELSE 0 END AS oy,
  CASE WHEN r > 16e0 / 9 * 1.02e0 THEN bw0 WHEN r < 16e0 / 9 * 0.98e0 THEN w - 10 ELSE w END AS bw, CASE WHEN r < 16e0 / 9 * 0.98e0 THEN h - 20 ELSE h END AS bh
FROM (SELECT frame, ln, x0, y0, x1, y1, w, h, CAST(w AS DOUBLE) / h AS r, CAST(round_even(h * 16e0 / 9, 0) AS BIGINT) AS bw0
  FROM (SELECT frame, ln, x0, y0, x1, y1, 1200 + CAST(x0 AS BIGINT) AS w, 720 + 20 * ln AS h FROM shot))
"""


def _region(t):
    d = _shot(t).withColumns({"w": 1200 + F.col("x0").cast("long"), "h": (720 + 20 * F.col("ln")).cast("long")})
    content = F.struct(F.lit(10).alias("top"), (F.col("h") - 10).alias("bottom"), F.lit(5).alias("left"), (F.col("w") - 5).alias("right"), F.lit(False).alias("degenerate"))
    return d.withColumn("r", G.board_region(F.col("w"), F.col("h"), content))


@query("p7_board_region", """
SELECT frame, ln, ox, oy, bw, bh, ox + CAST(round_even(x0 / 1920 * bw, 0) AS BIGINT) AS px0, oy + CAST(round_even(y1 / 1080 * bh, 0) AS BIGINT) AS py1,
  round_even((x0 - ox) / bw, 6) AS nx0 FROM reg
""")
def p7(t):
    b = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    d = _region(t).withColumns({"p": G.norm_to_px(F.col("r"), G.px_box(*b)), "n": G.px_to_norm(F.col("r"), F.struct("x0", "y0", "x1", "y1"))})
    return d.select("frame", "ln", "r.*", F.col("p.x0").alias("px0"), F.col("p.y1").alias("py1"), r6(F.col("n.x0")).alias("nx0"))


DX0, DY0, DX1, DY1 = dims.DORA_STRIP
HANDSQL = f"({dbl(dims.HAND_X0)} + i * {dbl(dims.HAND_W)} + CASE WHEN i = n - 1 AND n % 3 = 2 THEN {dbl(dims.HAND_GAP)} ELSE 0e0 END)"


@query("p8_slots", f"""
WITH h AS (SELECT game, seq, k % 14 + 1 AS n, unnest(range(k % 14 + 1)) AS i FROM ev)
SELECT game, seq, CAST(i AS INTEGER) AS i, round_even({HANDSQL}, 6) AS hx0, round_even({HANDSQL} + {dbl(dims.HAND_W)}, 6) AS hx1,
  round_even({dbl(DX0)} + (i % 5) * {dbl((DX1 - DX0) / 5)}, 6) AS dx0, round_even({dbl(DX0)} + (i % 5 + 1) * {dbl((DX1 - DX0) / 5)}, 6) AS dx1 FROM h
""")
def p8(t):
    n = F.col("k") % 14 + 1
    d = t.ev.select("game", "seq", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    h = L.hand_slot(F.col("i"), (F.col("i") == F.col("n") - 1) & (F.col("n") % 3 == 2))
    s = L.dora_slot(F.col("i") % 5)
    return d.select("game", "seq", "i", r6(h["x0"]).alias("hx0"), r6(h["x1"]).alias("hx1"), r6(s["x0"]).alias("dx0"), r6(s["x1"]).alias("dx1"))


FT = """
SELECT game, seq, k, k % 4 AS hero, k % 3 = 0 AS sanma, CASE WHEN k % 7 > 0 THEN (['E','S','W','N'])[k // 25 + 1] END AS bakaze, k % 5 AS kyoku,
  CASE WHEN k % 6 > 0 THEN k % 70 END AS lf, k % 8 > 0 AS inr, k % 3 AS kt, k % 5 AS hb, k // 4 % 4 - CASE WHEN k % 9 = 0 THEN 4 ELSE 0 END AS oya FROM ev
"""


@query("p9_field_texts", f"""
WITH s AS ({FT}),
f AS (SELECT game, seq, unnest(['score_self','score_right','score_across','score_left']) AS field, unnest([0,1,2,3]) AS i, hero, sanma, k FROM s)
SELECT game, seq, field, CAST(20000 + 100 * ((k * ((hero + i) % 4 + 1)) % 100) AS VARCHAR) AS text FROM f WHERE NOT (sanma AND i = (3 - hero) % 4)
UNION ALL SELECT game, seq, 'round_label', bakaze || kyoku FROM s WHERE bakaze IS NOT NULL AND kyoku > 0
UNION ALL SELECT game, seq, 'wall_count', '余' || lpad(CAST(lf AS VARCHAR), 2, '0') FROM s WHERE lf IS NOT NULL
UNION ALL SELECT game, seq, 'riichi_stick_count', 'x' || kt FROM s WHERE inr
UNION ALL SELECT game, seq, 'honba_count', 'x' || hb FROM s WHERE inr
UNION ALL SELECT game, seq, 'seat_wind_self', CASE WHEN sanma THEN (['E','S','W'])[(hero - oya + 12) % 3 + 1] ELSE (['E','S','W','N'])[(hero - oya + 12) % 4 + 1] END FROM s WHERE oya >= 0
""")
def p9(t):
    k = F.col("k")
    scores = F.array(*[20000 + 100 * ((k * (i + 1)) % 100) for i in range(4)])
    bakaze = F.when(k % 7 > 0, F.get(lit_array(dims.WINDS), F.floor(k / 25).cast("int")))
    oya = (F.floor(k / 4) % 4).cast("int") - F.when(k % 9 == 0, 4).otherwise(0)
    pairs = L.field_texts(k % 4, scores, bakaze, k % 5, F.when(k % 6 > 0, k % 70), k % 8 > 0, k % 3, k % 5, oya, k % 3 == 0)
    return t.ev.select("game", "seq", F.explode(pairs).alias("p")).select("game", "seq", "p.*")


@query("p20_observed", f"""
WITH r AS (SELECT game, seq, k, unnest([0, 1, 2, 3]) AS rel FROM ev),
a AS (SELECT *, (k + rel) % 4 AS s FROM r)
SELECT game, seq, rel, CASE WHEN (k + s) % 6 <> 5 THEN (((k + 2 * s) % 4 - s) % 4 + 4) % 4 END AS from_rel, k % (s + 2) = 0 OR k % (s + 3) = 0 AS reach,
  CASE WHEN rel > 0 THEN 13 - s END AS concealed, ({TN})[(k + s) % 37 + 1] AS pai,
  CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END AS n_hand
FROM a
""")
def p20(t):
    k = F.col("k")
    seats = range(4)
    d = t.ev.select(
        "game", "seq", (k % 4).alias("hero"), F.array("pai", F.lit("9s")).alias("hand"), F.when(k % 3 == 0, F.col("pai")).alias("drawn"),
        F.array(*[F.array(F.struct(F.get(lit_array(dims.TILES), (k + s) % 37).alias("pai"), (k % (s + 3) == 0).alias("sideways"))) for s in seats]).alias("rivers"),
        F.array(*[F.array(F.struct(F.get(lit_array(dims.CALL_EVENTS), (k + s) % 6).alias("type"), F.array("pai").alias("tiles"), F.lit("").alias("called"),
                                   F.lit("").alias("added"), ((k + 2 * s) % 4).alias("from_seat"))) for s in seats]).alias("melds"),
        F.array(*[k % (s + 2) == 0 for s in seats]).alias("reach"), F.array(*[F.lit(13 - s) for s in seats]).alias("concealed"))
    o = L.observed_row(d)
    return o.select("game", "seq", F.size("o_hand").alias("n_hand"), F.posexplode(F.arrays_zip("o_rivers", "o_melds", "o_reach", "o_concealed")).alias("rel", "z")).select(
        "game", "seq", "rel", F.get("z.o_melds", F.lit(0))["from_rel"].alias("from_rel"), F.col("z.o_reach").alias("reach"),
        F.col("z.o_concealed").alias("concealed"), F.get("z.o_rivers", F.lit(0))["pai"].alias("pai"), "n_hand")


FB = dims.FIELD_BOX_PX
CTE["lab"] = f"""
SELECT game, seq, k, k % 4 AS hero, list_transform(range(k % 14 + 1), lambda i: ({TN})[(k + i * 7) % 37 + 1]) AS hand, CASE WHEN k % 3 = 0 THEN ({TN})[(k + 7) % 37 + 1] END AS drawn,
  list_transform(range(k % 7), lambda i: ({TN})[(k + i) % 37 + 1]) AS dora, CASE WHEN k % 5 > 0 THEN 'E' END AS bakaze FROM ev
"""


@query("p21_label_frame", f"""
WITH h AS (SELECT *, list_contains(hand, drawn) AS tracked FROM lab),
t AS (SELECT *, CASE WHEN tracked THEN list_concat(hand[1:list_position(hand, drawn) - 1], hand[list_position(hand, drawn) + 1:len(hand)]) ELSE hand END AS rest FROM h),
r AS (SELECT game, seq, unnest(range(len(rest))) AS idx, unnest(rest) AS label, false AS dr FROM t WHERE tracked OR len(hand) % 3 = 1
  UNION ALL SELECT game, seq, len(rest), drawn, true FROM t WHERE tracked),
o AS (SELECT 'hand' AS zone, game, seq, idx, label, {dbl(dims.HAND_X0)} + idx * {dbl(dims.HAND_W)} + CASE WHEN dr THEN {dbl(dims.HAND_GAP)} ELSE 0e0 END AS x0 FROM r
  UNION ALL SELECT 'dora', game, seq, i, dora[i + 1], {dbl(DX0)} + i * {dbl((DX1 - DX0) / 5)} FROM (SELECT *, unnest(range(least(5, len(dora)))) AS i FROM lab)
  UNION ALL SELECT 'score', game, seq, i, CAST(20000 + 100 * ((k * ((hero + i) % 4 + 1)) % 100) AS VARCHAR),
    CASE i WHEN 0 THEN {dbl(FB['score_self'][0] / 1920)} WHEN 1 THEN {dbl(FB['score_right'][0] / 1920)} ELSE {dbl(FB['score_across'][0] / 1920)} END FROM (SELECT *, unnest([0, 1, 2]) AS i FROM lab)
  UNION ALL SELECT 'meta', game, seq, i, CASE i WHEN 0 THEN 'E' WHEN 1 THEN CAST(k % 4 AS VARCHAR) WHEN 2 THEN CAST(k % 5 AS VARCHAR) ELSE CAST(k % 3 AS VARCHAR) END,
    CASE i WHEN 0 THEN {dbl(920 / 1920)} WHEN 1 THEN {dbl(950 / 1920)} WHEN 2 THEN {dbl(250 / 1920)} ELSE {dbl(110 / 1920)} END FROM (SELECT *, unnest([0, 1, 2, 3]) AS i FROM lab WHERE bakaze IS NOT NULL))
SELECT zone, game, seq, CAST(idx AS INTEGER) AS idx, label, CAST(round_even(x0 * 1920, 0) AS BIGINT) AS px0,
  CASE WHEN zone IN ('hand', 'dora') THEN CAST(list_position({TN}, label) - 1 AS INTEGER) END AS cls FROM o
""")
def p21(t):
    k, tiles = F.col("k"), lit_array(dims.TILES)
    n_dora = k % 7
    d = t.ev.select(
        "game", "seq", (k % 4).alias("hero"), F.transform(F.sequence(F.lit(0), k % 14), lambda i: F.get(tiles, (k + i * 7) % 37)).alias("hand"),
        F.when(k % 3 == 0, F.get(tiles, (k + 7) % 37)).alias("drawn"),
        F.slice(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.get(tiles, (k + i) % 37)), F.lit(1), n_dora).alias("dora"),
        F.array(*[20000 + 100 * ((k * (i + 1)) % 100) for i in range(4)]).alias("scores"), F.when(k % 5 > 0, "E").alias("bakaze"),
        (k % 4).alias("kyoku"), (k % 5).alias("honba"), (k % 3).alias("kyotaku"), G.board_region(F.lit(1920), F.lit(1080)).alias("region"))
    r = L.label_rows(d, ["game", "seq"], ["hand", "dora", "score", "meta"])
    return r.select("zone", "game", "seq", "idx", "label", F.col("px.x0").alias("px0"), "cls")


def _records(t):
    """One nested annotation record per detected box."""
    p = lambda c: F.col(c).cast("int")
    px = F.array(p("x0"), p("y0"), p("x1"), p("y1"))
    quad = G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    ln = F.col("l_linenumber")
    tile = F.get(lit_array(dims.TILES), F.col("cls"))
    slot = F.struct(tile.alias("tile"), quad.alias("face_poly"), (ln == 2).alias("riichi"), F.when(ln == 3, False).alias("reliable"))
    meld = F.struct(tile.alias("tile"), quad.alias("poly"), (ln == 4).alias("sideways"), F.when(ln > 5, F.lit(True)).alias("reliable"))
    back = F.struct(F.lit("back").alias("tile"), quad.alias("poly"), F.when(ln == 1, False).alias("reliable"))
    flat = F.struct(tile.alias("tile"), px.alias("px_box"), (ln != 7).alias("reliable"))
    hud = F.struct(F.get(lit_array(dims.HUD), F.col("cls") % 19).alias("name"), F.when(ln != 6, px).alias("px_box"),
                   F.when(ln % 2 == 0, tile).alias("text"), F.when(ln == 5, False).alias("reliable"), (ln != 4).alias("text_reliable"))
    return t.bx.select("frame", "l_partkey", "l_suppkey", ln.alias("ln"), F.col("l_quantity").cast("int").alias("q"),
                       F.create_map(F.lit("0"), F.array(slot), F.lit("2"), F.array(slot, slot)).alias("discard_slots"),
                       F.create_map(F.lit("1"), F.array(meld)).alias("meld_boxes"), F.create_map(F.lit("3"), F.array(back)).alias("back_boxes"),
                       F.array(flat).alias("hand_boxes"), F.array(flat, flat).alias("dora_boxes"), F.array(hud).alias("hud_boxes"))


CTE["fbox"] = f"""
WITH t AS (SELECT *, ({TN})[cls + 1] AS tile, l_linenumber AS ln FROM bx)
SELECT frame, l_partkey, l_suppkey, ln, l_quantity, 'river' AS zone, tile, ln = 2 AS sideways, ln <> 3 AS reliable, x0, y1, false AS flat FROM t, (SELECT unnest(range(3)))
UNION ALL SELECT frame, l_partkey, l_suppkey, ln, l_quantity, 'meld', tile, ln = 4, true, x0, y1, false FROM t
UNION ALL SELECT frame, l_partkey, l_suppkey, ln, l_quantity, 'oppback', 'back', false, ln <> 1, x0, y1, false FROM t
UNION ALL SELECT frame, l_partkey, l_suppkey, ln, l_quantity, 'hand', tile, false, ln <> 7, x0, y1, true FROM t
UNION ALL SELECT frame, l_partkey, l_suppkey, ln, l_quantity, 'dora', tile, false, ln <> 7, x0, y1, true FROM t, (SELECT unnest(range(2)))
"""


@query("p22_flatten_boxes", """
SELECT frame, l_partkey, ln, zone, tile, sideways, reliable, x0, y1 FROM fbox
UNION ALL SELECT frame, l_partkey, l_linenumber, 'hud', NULL, NULL, l_linenumber <> 5, x0, y1 FROM bx WHERE l_linenumber <> 6
""")
def p22(t):
    rec = _records(t)
    b = L.flatten_boxes(rec, ["frame", "l_partkey", "ln"])
    xy = lambda i, f, j: F.coalesce(F.get("poly", F.lit(i))[f], F.get("px_box", F.lit(j)).cast("double"))
    tiles = b.select("frame", "l_partkey", "ln", "zone", "tile", "sideways", "reliable", xy(0, "x", 0).alias("x0"), xy(2, "y", 3).alias("y1"))
    h = L.flatten_hud(rec, ["frame", "l_partkey", "ln"])
    hud = h.select("frame", "l_partkey", "ln", F.lit("hud").alias("zone"), F.lit(None).cast("string").alias("tile"), F.lit(None).cast("boolean").alias("sideways"),
                   "reliable", F.get("px_box", F.lit(0)).cast("double").alias("x0"), F.get("px_box", F.lit(3)).cast("double").alias("y1"))
    return tiles.unionByName(hud)


@query("p23_crop_plan", f"""
WITH h AS (SELECT frame, l_partkey, l_linenumber AS ln, ({sql_list(dims.HUD)})[cls % 19 + 1] AS name, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1
  FROM bx WHERE l_linenumber IN (2)),
p AS (SELECT *, CAST(trunc((x1 - x0) * 0.15e0) AS INTEGER) AS px, CAST(trunc((y1 - y0) * 0.15e0) AS INTEGER) AS py FROM h)
SELECT 'reader' AS kind, frame, l_partkey, ln, greatest(0, x0 - px) AS cx0, greatest(0, y0 - py) AS cy0, least(120, x1 + px) AS cx1, least(110, y1 + py) AS cy1,
  CASE name WHEN 'score_across' THEN 180 WHEN 'score_left' THEN 270 WHEN 'score_right' THEN 90 ELSE 0 END AS rotation, name FROM p
UNION ALL SELECT 'tile', frame, l_partkey, ln, NULL, NULL, NULL, NULL, NULL, zone FROM fbox WHERE reliable AND NOT sideways AND zone <> 'oppback'
""")
def p23(t):
    rec = _records(t)
    h = L.flatten_hud(rec, ["frame", "l_partkey", "ln"])
    h = h.select("*", *[F.get("px_box", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    r = L.reader_crops(h, F.lit(120), F.lit(110)).select(F.lit("reader").alias("kind"), "frame", "l_partkey", "ln", "cx0", "cy0", "cx1", "cy1", "rotation", "name")
    none = F.lit(None).cast("int")
    b = L.tile_crops(L.flatten_boxes(rec, ["frame", "l_partkey", "ln"]))
    return r.unionByName(b.select(F.lit("tile").alias("kind"), "frame", "l_partkey", "ln", *[none.alias(c) for c in ("cx0", "cy0", "cx1", "cy1", "rotation")], F.col("zone").alias("name")))


CTE["grid"] = """
SELECT game, seq, k, CASE WHEN k % 2 = 0 THEN '4p' ELSE '3p' END AS mode, k % 4 AS pos, k // 4 AS idx, CASE WHEN k % 3 > 0 THEN k % 23 END AS side FROM ev
"""


def _grid_sql() -> str:
    out = []
    for m in ("4p", "3p"):
        for p in range(4):
            r = G.river_axes(m, p)
            fw, fh = dims.RIVER_FOOT[p]
            side = fh if abs(r["u"][0]) > abs(r["u"][1]) else fw
            ex = max(0.0, side - r["pitch"])
            o = r["offs"]
            off = f"CASE rw WHEN 0 THEN {dbl(o[0])} WHEN 1 THEN {dbl(o[1])} ELSE {dbl(o[2])} END"
            push = f"((CASE WHEN aft THEN {dbl(ex)} ELSE 0e0 END) + (CASE WHEN sd THEN {dbl(ex)} / 2 ELSE 0e0 END))"
            cs = [f"round_even({dbl(r['o'][a])} + eff * {dbl(r['colvec'][a])} + ({off}) * {dbl(r['v'][a])} + {dbl(r['u'][a])} * {push}, 6)" for a in (0, 1)]
            out.append(f"SELECT game, seq, line + 1 AS row, col + 1 AS col, sd AS sideways, {cs[0]} AS cx, {cs[1]} AS cy, "
                       f"CASE WHEN sd THEN {dbl(fh)} ELSE {dbl(fw)} END - 6 AS face_w FROM e WHERE mode = '{m}' AND pos = {p}")
    return " UNION ALL ".join(out)


@query("w16_river_layout", f"""
WITH l AS (SELECT *, idx // 6 AS line, idx % 6 AS col FROM grid),
e AS (SELECT *, least(line, 2) AS rw, CASE WHEN line >= 3 THEN 6 + (idx - 18) ELSE col END AS eff, coalesce(idx = side, false) AS sd,
  coalesce(side // 6 = line AND side % 6 < col, false) AS aft FROM l)
SELECT game, seq, row, col, sideways, cx, cy, round_even(face_w, 6) AS face_w FROM ({_grid_sql()})
""")
def w16(t):
    k = F.col("k")
    d = t.ev.select("game", "seq", F.when(k % 2 == 0, "4p").otherwise("3p").alias("mode"), (k % 4).alias("pos"), F.expr("k div 4").alias("idx"),
                    F.when(k % 3 > 0, k % 23).alias("sideways_idx"))
    d = L.river_layout(d).withColumn("b", G.bbox(F.col("face")))
    return d.select("game", "seq", "row", "col", "sideways", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"), r6(F.col("b.x1") - F.col("b.x0")).alias("face_w"))


CTE["cell"] = """
SELECT game, rec, row_number() OVER (PARTITION BY game, rec ORDER BY seq) - 1 AS idx, k % 3 = 0 AS sideways,
  k % 5 = 0 AND row_number() OVER (PARTITION BY game, rec ORDER BY seq) > 1 AS stacked, game % 4 AS pos, CASE WHEN game % 2 = 0 THEN '4p' ELSE '3p' END AS mode FROM ev
"""


def _cells(t):
    from ..operators.ordered import numbered, seq_chunk

    d = numbered(t.ev, ["game", "rec"], ["seq"], seq_chunk(), "rn")
    return d.select("game", "rec", (F.col("rn") - 1).alias("idx"), (F.col("k") % 3 == 0).alias("sideways"), ((F.col("k") % 5 == 0) & (F.col("rn") > 1)).alias("stacked"),
                    (F.col("game") % 4).alias("pos"), F.when(F.col("game") % 2 == 0, "4p").otherwise("3p").alias("mode"))


def _strip_case(field, mode_col="mode", pos_col="pos") -> str:
    whens = " ".join(f"WHEN {mode_col} = '{m}' AND {pos_col} = {p} THEN {dbl(field(dims.STRIP[m][p]))}" for m in ("4p", "3p") for p in range(4))
    return f"(CASE {whens} END)"


@query("w17_strip_layout", f"""
WITH w AS (SELECT *, CASE WHEN sideways THEN {_strip_case(lambda s: s['d'])} ELSE {_strip_case(lambda s: s['w'])} END AS aw,
  CASE WHEN sideways THEN {_strip_case(lambda s: s['w'])} ELSE {_strip_case(lambda s: s['d'])} END AS cd FROM cell),
p AS (SELECT *, sum(CASE WHEN stacked THEN 0e0 ELSE aw END) OVER (PARTITION BY game, rec ORDER BY idx ROWS UNBOUNDED PRECEDING) - aw AS a0,
  CASE WHEN stacked THEN cd ELSE 0e0 END AS c0, sum(CASE WHEN stacked THEN 0e0 ELSE aw END) OVER (PARTITION BY game, rec) AS length FROM w)
SELECT game, rec, idx, round_even(a0, 6) AS a0, round_even(c0 + cd, 6) AS c1, round_even(length, 6) AS length,
  round_even(least({_strip_case(lambda s: s['corner'][0])} + {_strip_case(lambda s: s['along'][0])} * a0 + {_strip_case(lambda s: s['cross'][0])} * c0,
    {_strip_case(lambda s: s['corner'][0])} + {_strip_case(lambda s: s['along'][0])} * (a0 + aw) + {_strip_case(lambda s: s['cross'][0])} * (c0 + cd)), 6) AS x0 FROM p
""")
def w17(t):
    cells = _cells(t)
    d = L.strip_layout(cells, ["game", "rec"]).join(L.strip_length(cells, ["game", "rec"]), ["game", "rec"])
    return d.select("game", "rec", "idx", r6(F.col("a0")).alias("a0"), r6(F.col("c1")).alias("c1"), r6(F.col("length")).alias("length"),
                    r6(G.bbox(F.col("quad"))["x0"]).alias("x0"))


@query("w18_meld_cells", f"""
WITH m AS (SELECT game, seq, type, k % 4 AS rel, CASE type WHEN 'nukidora' THEN ['N'] WHEN 'chi' THEN [pai, '7p', '8p'] WHEN 'pon' THEN [pai, pai, pai] ELSE [CASE WHEN k % 5 = 0 THEN '5mr' ELSE pai END, pai, pai, pai] END AS tiles,
  CASE WHEN type IN ('chi', 'pon', 'daiminkan', 'kakan') AND k % 7 > 0 THEN pai ELSE '' END AS called, CASE WHEN type = 'kakan' AND k % 3 > 0 THEN pai ELSE '' END AS added
  FROM ev WHERE type IN ('chi', 'pon', 'daiminkan', 'ankan', 'kakan', 'nukidora')),
r AS (SELECT *, CASE WHEN type = 'kakan' AND added <> '' THEN list_concat(tiles[1:list_position(tiles, added) - 1], tiles[list_position(tiles, added) + 1:len(tiles)]) ELSE tiles END AS r0 FROM m),
c AS (SELECT *, CASE WHEN called <> '' THEN called ELSE r0[1] END AS cl FROM r),
s AS (SELECT *, list_concat(r0[1:list_position(r0, cl) - 1], r0[list_position(r0, cl) + 1:len(r0)]) AS rest FROM c),
p AS (SELECT *, CASE WHEN type = 'chi' OR rel = 3 THEN 0 WHEN rel = 2 THEN 1 ELSE len(rest) END AS at_ FROM s),
x AS (SELECT game, seq, type, CASE WHEN type = 'ankan' THEN ['back', CASE WHEN tiles[1] LIKE '%r' AND tiles[1] <> tiles[2] THEN tiles[1] ELSE tiles[2] END, tiles[3], 'back']
  WHEN type = 'nukidora' THEN tiles
  ELSE list_concat(list_concat(rest[1:at_], [cl || '-' || CASE WHEN type = 'kakan' THEN '+' || CASE WHEN added <> '' THEN added ELSE cl END ELSE '' END]), rest[at_ + 1:len(rest)]) END AS cells FROM p)
SELECT game, seq, type, array_to_string(list_reverse(cells), ' ') AS cells FROM x
""")
def w18(t):
    k, pai, typ = F.col("k"), F.col("pai"), F.col("type")
    d = t.ev.filter(typ.isin(dims.CALL_EVENTS))
    tiles = F.when(typ == "nukidora", F.array(F.lit("N"))).when(typ == "chi", F.array(pai, F.lit("7p"), F.lit("8p"))) \
        .when(typ == "pon", F.array(pai, pai, pai)).otherwise(F.array(F.when(k % 5 == 0, "5mr").otherwise(pai), pai, pai, pai))
    called = F.when(typ.isin("chi", "pon", "daiminkan", "kakan") & (k % 7 > 0), pai).otherwise("")
    added = F.when((typ == "kakan") & (k % 3 > 0), pai).otherwise("")
    d = d.withColumns({"tiles": tiles, "called": called, "added": added})
    cells = L.meld_cells(typ, F.col("tiles"), F.col("called"), F.col("added"), k % 4)
    text = F.transform(cells, lambda c: F.concat(c["label"], F.when(c["sideways"], "-").otherwise(""), F.coalesce(F.concat(F.lit("+"), c["stacked"]), F.lit(""))))
    return d.select("game", "seq", "type", F.concat_ws(" ", text).alias("cells"))


@query("w24_indicator_slots", """
SELECT game, seq, CAST(i AS INTEGER) AS slot, i >= len(dora) AS is_back, CASE WHEN i >= len(dora) THEN 'back' ELSE dora[i + 1] END AS tile FROM (SELECT *, unnest(range(5)) AS i FROM lab)
""")
def w24(t):
    k, tiles = F.col("k"), lit_array(dims.TILES)
    dora = F.slice(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.get(tiles, (k + i) % 37)), F.lit(1), k % 7)
    return t.ev.select("game", "seq", F.explode(L.indicator_slots(dora)).alias("s")).select("game", "seq", "s.*")


def _pile(i: int) -> dict:
    p = dims.PILE_3P[i]
    n = (p["step"][0] ** 2 + p["step"][1] ** 2) ** 0.5
    return dict(x=p["anchor"][0], y=p["anchor"][1], sx=p["step"][0], sy=p["step"][1], ux=p["step"][0] / n, uy=p["step"][1] / n, w=p["foot"][0], h=p["foot"][1])


def _pile_case(f: str) -> str:
    return "(CASE pos " + " ".join(f"WHEN {i} THEN {dbl(_pile(i)[f])}" for i in range(4)) + " END)"


@query("w25_pile_layout", f"""
WITH c AS (SELECT game, seq, k, k % 4 AS pos, k % 5 AS n, unnest(range(-18, 19, 3)) AS off FROM ev WHERE k % 5 > 0),
f AS (SELECT *, unnest(range(n)) AS b FROM c),
m AS (SELECT game, seq, pos, n, off, avg((k * 7 + off * off + b * 13 * abs(off + 3)) % 101) AS mf FROM f GROUP BY ALL),
o AS (SELECT game, seq, pos, n, arg_max(off, (mf, -off)) AS off, max(mf) AS mean_fill FROM m GROUP BY ALL),
e AS (SELECT *, unnest(range(n)) AS kk FROM o)
SELECT game, seq, CAST(kk AS INTEGER) AS k, CAST(off AS INTEGER) AS "offset", round_even(mean_fill, 6) AS mean_fill,
  round_even({_pile_case('x')} + kk * {_pile_case('sx')} + off * {_pile_case('ux')}, 6) AS cx, round_even({_pile_case('y')} + kk * {_pile_case('sy')} + off * {_pile_case('uy')} - {_pile_case('h')} / 2, 6) AS y0 FROM e
""")
def w25(t):
    k = F.col("k")
    base = t.ev.filter(k % 5 > 0).select("game", "seq", "k", (k % 4).alias("pos"), (k % 5).alias("count"))
    c = base.withColumn("offset", F.explode(F.sequence(F.lit(-18), F.lit(18), F.lit(3)))) \
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    fill = (k * 7 + F.col("offset") * F.col("offset") + F.col("b") * 13 * F.abs(F.col("offset") + 3)) % 101
    best = L.best_offset(c.withColumn("fill", fill), ["game", "seq", "pos", "count"])
    d = L.pile_layout(best)
    return d.select("game", "seq", "k", "offset", r6(F.col("mean_fill")).alias("mean_fill"), r6(F.col("cx")).alias("cx"), r6(G.bbox(F.col("quad"))["y0"]).alias("y0"))


def _back_values() -> str:
    rows = []
    for pos, r in dims.BACK_ROW.items():
        ax, sign = r["axis"], r["sign"]
        quads = r["slots"]
        cs = [p[ax] for q in quads for p in q]
        anchor = max(cs) if sign < 0 else min(cs)
        for s, q in enumerate(quads):
            mv = sign * (max(abs(p[ax] - anchor) for p in q) - max(abs(p[ax] - anchor) for p in quads[12]))
            dr = [(x + (mv if ax == 0 else 0.0), y + (mv if ax == 1 else 0.0)) for x, y in r["drawn"]]
            rows.append(f"({pos}, {s}, {dbl(q[0][0])}, {dbl(q[2][1])}, {dbl(dr[0][0])}, {dbl(dr[2][1])})")
    return ", ".join(rows)


@query("w26_concealed_row", f"""
WITH tp(pos, slot, qx, qy, dx, dy) AS (VALUES {_back_values()}),
r AS (SELECT game, seq, k % 3 + 1 AS pos, k % 16 AS n, (k % 16) % 3 = 2 AS holding, k % 16 - CASE WHEN (k % 16) % 3 = 2 THEN 1 ELSE 0 END AS row_n FROM ev)
SELECT game, seq, pos, slot, false AS drawn, round_even(qx, 6) AS x, round_even(qy, 6) AS y FROM r JOIN tp USING (pos) WHERE row_n BETWEEN 1 AND 13 AND slot < row_n
UNION ALL SELECT game, seq, pos, slot + 1, true, round_even(dx, 6), round_even(dy, 6) FROM r JOIN tp USING (pos) WHERE row_n BETWEEN 1 AND 13 AND holding AND slot = row_n - 1
""")
def w26(t):
    k = F.col("k")
    d = L.concealed_row(t.ev.select("game", "seq", (k % 3 + 1).alias("pos"), (k % 16).alias("count")), L.back_template(t.spark))
    return d.select("game", "seq", "pos", "slot", "drawn", r6(F.get("quad", F.lit(0))["x"]).alias("x"), r6(F.get("quad", F.lit(2))["y"]).alias("y"))
