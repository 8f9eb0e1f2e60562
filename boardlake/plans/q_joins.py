"""Queries for joins and assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import geometry as G
from ..functions.num import r6
from ..functions.sqltext import dbl, sql_list
from ..functions.tiles import lit_array
from ..operators import assemble as A
from ..operators import layout as L
from ..operators import score as S
from ..operators.ordered import seq_chunk
from ..session import stage
from .proxies import CTE
from .q_geometry import TN, _river_sql, _strip_sql
from .registry import query

CTE["warp"] = f"""
SELECT frame, det_id, ({TN})[cls + 1] AS tile, x0 * 29 + 100 AS x, y0 * 23 AS y, l_quantity * 4 AS w, 20e0 * l_linenumber AS h FROM bx
"""


def _warp(t):
    """Detections spread over the flattened table."""
    x, y, w, h = F.col("x0") * 29 + 100, F.col("y0") * 23, F.col("l_quantity") * 4, 20.0 * F.col("l_linenumber")
    quad = G.rect(x - w / 2, y - h / 2, x + w / 2, y + h / 2)
    return t.bx.select("frame", "det_id", F.get(lit_array(dims.TILES), F.col("cls")).alias("tile"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), quad.alias("quad"))


ZONES = ", ".join(f"{{'d': CASE WHEN tile <> 'back' THEN {_river_sql('4p', s, 'x', 'y')} ELSE 1e18 END, 'o': {2 * s}}}, {{'d': {_strip_sql('4p', s, 'x', 'y')}, 'o': {2 * s + 1}}}" for s in range(4))


@query("j5_nearest_zone", f"""
WITH z AS (SELECT *, list_min([{ZONES}]) AS z FROM warp),
s AS (SELECT *, z.o // 2 AS seat, z.o % 2 = 1 AS strip FROM z)
SELECT frame, det_id, tile, round_even(z.d, 6) AS dist, CASE WHEN strip THEN 'meld' ELSE 'river' END AS kind, seat,
  CASE WHEN z.d > 60 THEN CASE WHEN tile = 'back' THEN 'ignored' ELSE 'stray' END
    WHEN tile = 'back' AND strip AND ((seat IN (1, 3) AND h > 1.15e0 * CASE seat WHEN 1 THEN 93.4e0 ELSE 93e0 END) OR (seat = 2 AND h > 1.15e0 * 92.2e0)) THEN 'standing' ELSE 'kept' END AS fate
FROM s
""")
def j5(t):
    return A.route(_warp(t), "4p").select("frame", "det_id", "tile", r6(F.col("dist")).alias("dist"), "kind", "seat", "fate")


@query("j6_overlap_dedup", """
WITH RECURSIVE o AS (SELECT frame, det_id, x0, y0, x1, y1, row_number() OVER (PARTITION BY frame ORDER BY score100 DESC, det_id) AS rn FROM bx),
r(frame, rn, kept) AS (SELECT frame, 1, [{'i': det_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}] FROM o WHERE rn = 1
  UNION ALL SELECT r.frame, r.rn + 1, CASE WHEN len(list_filter(kept, lambda k: least(k.x1, o.x1) > greatest(k.x0, o.x0) AND least(k.y1, o.y1) > greatest(k.y0, o.y0)
      AND (least(k.x1, o.x1) - greatest(k.x0, o.x0)) * (least(k.y1, o.y1) - greatest(k.y0, o.y0)) / ((k.x1 - k.x0) * (k.y1 - k.y0) + (o.x1 - o.x0) * (o.y1 - o.y0)
        - (least(k.x1, o.x1) - greatest(k.x0, o.x0)) * (least(k.y1, o.y1) - greatest(k.y0, o.y0))) >= 0.3e0)) > 0 THEN kept
    ELSE list_append(kept, {'i': o.det_id, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}) END
  FROM r JOIN o ON o.frame = r.frame AND o.rn = r.rn + 1),
l AS (SELECT frame, arg_max(kept, rn) AS kept FROM r GROUP BY frame)
SELECT frame, unnest(list_transform(kept, lambda k: k.i)) AS det_id FROM l
""")
def j6(t):
    d = t.bx.select("frame", "det_id", F.col("score100").alias("score"), "x0", "y0", "x1", "y1")
    return A.dedup_overlaps(d, "frame", "det_id", limit=0.3).select("frame", "det_id")


FIELDS = ["wall_count", "honba", "kyotaku"]


@query("j10_field_match", """
WITH w AS (SELECT game, seq, unnest(['wall_count', 'honba', 'kyotaku']) AS field, unnest([CASE WHEN k % 7 > 0 THEN CAST(k % 70 AS VARCHAR) END, CAST(k % 5 AS VARCHAR), CAST(k % 3 AS VARCHAR)]) AS want FROM ev),
g AS (SELECT game, seq, unnest(['wall_count', 'honba', 'kyotaku']) AS field, unnest([CAST((k % 70) - k % 3 AS VARCHAR), CASE WHEN k % 4 > 0 THEN CAST(k % 5 AS VARCHAR) END, CAST(k % 2 AS VARCHAR)]) AS got FROM ev WHERE seq % 9 > 0)
SELECT w.game, w.seq, w.field, CASE WHEN got IS NULL THEN 'missing' WHEN got = want OR (w.field = 'wall_count' AND abs(CAST(got AS INTEGER) - CAST(want AS INTEGER)) <= 1) THEN 'ok' ELSE 'err' END AS verdict
FROM w LEFT JOIN g USING (game, seq, field) WHERE want IS NOT NULL
""")
def j10(t):
    return _verdicts(t).select("game", "seq", "field", "verdict")


def _verdicts(t):
    k = F.col("k")
    txt = lambda c: c.cast("string")

    def long_(d, cols):
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value")) for f, c in zip(FIELDS, cols)]))
        return d.select("game", "seq", pairs.alias("p")).select("game", "seq", "p.*")

    truth = long_(t.ev, [F.when(k % 7 > 0, txt(k % 70)), txt(k % 5), txt(k % 3)]).filter(F.col("value").isNotNull())
    pred = long_(t.ev.filter(F.col("seq") % 9 > 0), [txt(k % 70 - k % 3), F.when(k % 4 > 0, txt(k % 5)), txt(k % 2)])
    return S.field_verdicts(pred, truth, ["game", "seq"], {"wall_count": 1})


@query("j11_zone_diff", f"""
SELECT game, seq, array_to_string(list_filter([CASE WHEN k % 3 = 0 THEN 'dora' END, CASE WHEN seat = target THEN NULL ELSE 'drawn' END, CASE WHEN k % 5 = 0 THEN 'hand' END], lambda z: z IS NOT NULL), ',') AS zones FROM ev
""")
def j11(t):
    k = F.col("k")
    a = F.struct(F.array("pai").alias("dora"), F.col("seat").alias("drawn"), F.array("pai", F.lit("9s"), F.lit("1m")).alias("hand"))
    b = F.struct(F.when(k % 3 == 0, F.array("pai", "pai")).otherwise(F.array("pai")).alias("dora"), F.col("target").alias("drawn"),
                 F.when(k % 5 == 0, F.array(F.lit("1m"), F.lit("9s"), F.lit("back"))).otherwise(F.array(F.lit("1m"), F.col("pai"), F.lit("9s"))).alias("hand"))
    d = t.ev.withColumns({"a": a, "b": b})
    return d.select("game", "seq", F.concat_ws(",", S.zone_diff(F.col("a"), F.col("b"), ["dora", "drawn"], ["hand"])).alias("zones"))


CTE["bagn"] = """
SELECT zone, pos, frame, name, count(*) FILTER (side = 'p') AS n_pred, count(*) FILTER (side = 'g') AS n_gt
FROM (SELECT zone, pos, frame, pred AS name, 'p' AS side FROM bag UNION ALL SELECT zone, pos, frame, gt, 'g' FROM bag) GROUP BY ALL
"""
CTE["bagm"] = """
SELECT zone, pos, frame, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(n_gt) AS BIGINT) AS n_gt, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(least(n_pred, n_gt)) AS BIGINT) AS correct_lenient
FROM (SELECT zone, pos, frame, CASE WHEN name LIKE '5_r' THEN left(name, 2) ELSE name END AS base, sum(n_pred) AS n_pred, sum(n_gt) AS n_gt, sum(least(n_pred, n_gt)) AS correct FROM bagn GROUP BY ALL) GROUP BY ALL
"""


def _bags(t):
    p = t.bag.select("zone", "pos", "frame", F.col("pred").alias("name"))
    g = t.bag.select("zone", "pos", "frame", F.col("gt").alias("name"))
    return p, g


@query("j12_multiset_match", "SELECT * FROM bagm")
def j12(t):
    return S.bag_match(*_bags(t), ["zone", "pos", "frame"])


@query("u3_multiset_difference", """
SELECT zone, name, CAST(sum(greatest(n_gt - n_pred, 0)) AS BIGINT) AS missed, CAST(sum(greatest(n_pred - n_gt, 0)) AS BIGINT) AS extra FROM bagn GROUP BY ALL
""")
def u3(t):
    return S.bag_counts(*_bags(t), ["zone", "pos", "frame"]).groupBy("zone", "name").agg(F.sum("missed").alias("missed"), F.sum("extra").alias("extra"))


CTE["calls"] = """
SELECT *, CASE WHEN rel = 3 THEN 0 WHEN rel = 2 THEN least(1, len(rest)) ELSE len(rest) END AS lo FROM (
SELECT game, rec, seq, type, base, red_of, CASE WHEN type = 'chi' THEN 3 ELSE k // 6 % 3 + 1 END AS rel, CASE WHEN type = 'kakan' THEN pai END AS stacked,
  CASE WHEN type = 'kakan' AND five THEN CASE WHEN pai = base AND red THEN red_of ELSE base END ELSE pai END AS claimed,
  CASE type WHEN 'chi' THEN list_transform(list_filter([rank + 1, rank + 2], lambda x: x <= 9), lambda x: CAST(x AS VARCHAR) || right(base, 1) || CASE WHEN x = 5 AND red THEN 'r' ELSE '' END)
    WHEN 'pon' THEN [base, CASE WHEN five AND pai = base AND red THEN red_of ELSE base END]
    WHEN 'kakan' THEN [base, CASE WHEN five AND pai = base AND NOT red THEN red_of ELSE base END]
    ELSE [base, base, CASE WHEN five AND pai = base THEN red_of ELSE base END] END AS rest
FROM (SELECT *, rtrim(pai, 'r') AS base, rtrim(pai, 'r') || 'r' AS red_of, pai LIKE '5%' AS five, k // 18 % 2 = 0 AS red, coalesce(TRY_CAST(left(pai, 1) AS INTEGER), 9) AS rank
  FROM ev WHERE type IN ('chi', 'pon', 'daiminkan', 'ankan', 'kakan')))
"""
CTE["allstrips"] = """
SELECT game, rec, flatten(list(cells ORDER BY seq)) AS c FROM (
SELECT game, rec, seq, CASE WHEN type = 'ankan' THEN [{'l': 'back', 's': false, 't': NULL}, {'l': base, 's': false, 't': NULL}, {'l': CASE WHEN base LIKE '5%' THEN red_of ELSE base END, 's': false, 't': NULL}, {'l': 'back', 's': false, 't': NULL}]
  ELSE list_reverse(list_concat(list_transform(rest[1:lo], lambda x: {'l': x, 's': false, 't': NULL}), [{'l': claimed, 's': true, 't': stacked}], list_transform(rest[lo + 1:], lambda x: {'l': x, 's': false, 't': NULL}))) END AS cells
FROM calls) GROUP BY ALL
"""


@query("j19_meld_parse", """
WITH RECURSIVE cut AS (SELECT game, rec, i AS lo, i + z AS till, z, c[i + 1:i + z] AS g
  FROM (SELECT game, rec, c, z, unnest(range(0, len(c) - z + 1)) AS i FROM allstrips, (VALUES (3), (4)) v(z))),
seen AS (SELECT *, list_transform(g, lambda x: rtrim(x.l, 'r')) AS b, list_filter(range(1, z + 1), lambda i: g[i].s) AS lying, list_transform(list_filter(g, lambda x: NOT x.s), lambda x: x.l) AS up FROM cut),
one AS (SELECT *, lying[1] AS pos, g[lying[1]] AS claim, len(list_distinct(b)) = 1 AS same, up = list_reverse_sort(up) AS sorted,
  list_sort(list_transform(b, lambda x: TRY_CAST(left(x, 1) AS INTEGER))) AS ranks, len(list_distinct(list_transform(b, lambda x: right(x, 1)))) = 1 AS suited FROM seen),
kind AS (SELECT *, CASE
  WHEN z = 4 AND len(lying) = 0 AND g[1].l = 'back' AND g[4].l = 'back' AND b[2] = b[3] AND b[2] <> 'back' AND g[2].l = b[2] AND (g[3].l <> b[3]) = (b[2] LIKE '5%') THEN 'ankan'
  WHEN len(lying) <> 1 OR NOT sorted THEN NULL
  WHEN same AND claim.t IS NOT NULL THEN CASE WHEN z = 3 AND rtrim(claim.t, 'r') = b[1] THEN 'kakan' END
  WHEN same THEN CASE WHEN z = 3 THEN 'pon' WHEN pos <> 2 THEN 'daiminkan' END
  WHEN z = 3 AND pos = 3 AND claim.t IS NULL AND suited AND ranks[2] = ranks[1] + 1 AND ranks[3] = ranks[1] + 2 THEN 'chi' END AS type FROM one),
meld AS (SELECT game, rec, lo, till, {'type': type,
  'tiles': array_to_string(CASE WHEN type = 'ankan' THEN [b[2], b[2], b[2], g[3].l] ELSE list_sort(list_filter(list_concat(list_transform(g, lambda x: x.l), [claim.t]), lambda x: x IS NOT NULL)) END, ' '),
  'called': CASE WHEN type = 'ankan' THEN '' ELSE claim.l END, 'added': coalesce(claim.t, ''),
  'rel': CASE WHEN type = 'ankan' THEN 0 WHEN pos = z THEN 3 WHEN pos = 1 THEN 1 ELSE 2 END} AS m FROM kind WHERE type IS NOT NULL),
walk AS (SELECT game, rec, CAST(0 AS BIGINT) AS lo, CAST([] AS STRUCT("type" VARCHAR, tiles VARCHAR, called VARCHAR, added VARCHAR, rel INTEGER)[]) AS melds FROM allstrips
  UNION ALL SELECT w.game, w.rec, m.till, list_append(w.melds, m.m) FROM walk w JOIN meld m ON m.game = w.game AND m.rec = w.rec AND m.lo = w.lo),
fin AS (SELECT s.game, s.rec, count(w.lo) AS ways, any_value(w.melds) AS melds FROM allstrips s LEFT JOIN walk w ON w.game = s.game AND w.rec = s.rec AND w.lo = len(s.c) GROUP BY ALL)
SELECT game, rec, CAST(no - 1 AS INTEGER) AS no, melds[no].type AS type, melds[no].tiles AS tiles, melds[no].called AS called, melds[no].added AS added, melds[no].rel AS from_rel, NULL AS problem
FROM (SELECT *, unnest(range(1, len(melds) + 1)) AS no FROM fin WHERE ways = 1)
UNION ALL SELECT game, rec, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN ways = 0 THEN 'unparsable' ELSE 'ambiguous' END FROM fin WHERE ways <> 1
""")
def j19(t):
    """Every call: all five types and all tiles. A chi that has no higher tiles draws only those there are, so its strip is broken."""
    k, typ, pai = F.col("k"), F.col("type"), F.col("pai")
    base, five, red = F.regexp_replace(pai, "r$", ""), pai.startswith("5"), F.expr("k div 18") % 2 == 0
    reds = F.concat(base, F.lit("r"))
    rank = F.coalesce(F.substring(pai, 1, 1).try_cast("int"), F.lit(9))
    up = lambda n: F.concat((rank + n).cast("string"), F.substring(pai, 2, 1), F.when((rank + n == 5) & red, "r").otherwise(""))
    plain = five & (pai == base)  # the red five is in the hand, or drawn later
    chi = F.when(rank <= 7, F.array(pai, up(1), up(2))).when(rank == 8, F.array(pai, up(1))).otherwise(F.array(pai))
    pon = F.array(base, F.when(plain & red, reds).otherwise(base), pai)
    kan = F.array(base, base, F.when(plain, reds).otherwise(base), pai)
    tiles = F.array_sort(F.when(typ == "chi", chi).when(typ == "pon", pon).when((typ == "ankan") & five, F.array(base, base, base, reds)).otherwise(kan))
    called = F.when(typ == "ankan", "").when((typ == "kakan") & five, F.when(plain & red, reds).otherwise(base)).otherwise(pai)
    rel = F.when(typ == "chi", 3).otherwise(F.expr("k div 6") % 3 + 1)
    d = t.ev.filter(typ.isin("chi", "pon", "daiminkan", "ankan", "kakan"))
    cells = L.meld_cells(typ, tiles, called, F.when(typ == "kakan", pai).otherwise(""), rel)
    # a strip holds one record's calls
    strips = d.select("game", "rec", "seq", cells.alias("cells")).groupBy("game", "rec").agg(F.array_sort(F.collect_list(F.struct("seq", "cells"))).alias("s"))
    strips = strips.select("game", "rec", F.flatten(F.transform("s", lambda x: x["cells"])).alias("cells"))
    p = A.parse_strips(strips, ["game", "rec"], A.meld_hypotheses(t.spark))
    return p.select("game", "rec", "problem", F.posexplode_outer("melds").alias("no", "m")).select(
        "game", "rec", "no", "m.type", F.concat_ws(" ", "m.tiles").alias("tiles"), "m.called", "m.added", F.col("m.rel").alias("from_rel"), "problem").withColumn(
        "tiles", F.when(F.col("type").isNotNull(), F.col("tiles")))


def _river_case(f) -> str:
    return "(CASE seat " + " ".join(f"WHEN {s} THEN {f(G.river_axes('4p', s), s)}" for s in range(4)) + " END)"


CTE["rvr"] = f"""
SELECT *, abs(v - ofs[1]) AS d0, abs(v - ofs[2]) AS d1, abs(v - ofs[3]) AS d2 FROM (
SELECT frame, det_id, seat, {_river_case(lambda r, s: f"(x - {dbl(r['o'][0])}) * {dbl(r['u'][0])} + (y - {dbl(r['o'][1])}) * {dbl(r['u'][1])}")} AS u,
  {_river_case(lambda r, s: f"(x - {dbl(r['o'][0])}) * {dbl(r['v'][0])} + (y - {dbl(r['o'][1])}) * {dbl(r['v'][1])}")} AS v,
  {_river_case(lambda r, s: "[" + ", ".join(dbl(o) for o in r['offs']) + "]")} AS ofs, {_river_case(lambda r, s: dbl(r['pitch']))} AS pitch
FROM (SELECT *, CAST(det_id % 4 AS INTEGER) AS seat FROM warp))
"""
CTE["rvp"] = """
SELECT *, CASE WHEN off_grid THEN NULL ELSE u - lag(CASE WHEN off_grid THEN NULL ELSE u END IGNORE NULLS) OVER w END AS gap,
  CAST(sum(CASE WHEN off_grid THEN 0 ELSE 1 END) OVER (PARTITION BY frame, seat, "row" ORDER BY u, det_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pos_in_row
FROM (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS "row", least(d0, d1, d2) > 0.5e0 * (ofs[2] - ofs[1]) AS off_grid FROM rvr)
WINDOW w AS (PARTITION BY frame, seat, "row" ORDER BY u, det_id)
"""


def _river(t):
    d = _warp(t).withColumn("seat", (F.col("det_id") % 4).cast("int"))
    return A.river_rows(d, ["frame", "seat"], "4p")


@query("w19_river_rows", """
SELECT 'det' AS what, frame, seat, det_id, "row", off_grid, CASE WHEN off_grid THEN NULL ELSE pos_in_row END AS pos_in_row, round_even(gap, 6) AS gap, NULL AS not_full, NULL AS too_many, NULL AS off_origin, NULL AS hole FROM rvp
UNION ALL SELECT 'river', frame, seat, count(*) FILTER (off_grid), NULL, NULL, NULL, NULL,
  CAST(count(*) FILTER (NOT off_grid AND "row" = 1) > 0 AND count(*) FILTER (NOT off_grid AND "row" = 0) <> 6 AS BIGINT) + CAST(count(*) FILTER (NOT off_grid AND "row" = 2) > 0 AND count(*) FILTER (NOT off_grid AND "row" = 1) <> 6 AS BIGINT),
  CAST(count(*) FILTER (NOT off_grid AND "row" = 0) > 6 AS BIGINT) + CAST(count(*) FILTER (NOT off_grid AND "row" = 1) > 6 AS BIGINT),
  coalesce(CAST(abs(min(CASE WHEN NOT off_grid AND "row" = 0 THEN u END)) > 0.6e0 * max(pitch) AS BIGINT), 0) + coalesce(CAST(abs(min(CASE WHEN NOT off_grid AND "row" = 1 THEN u END)) > 0.6e0 * max(pitch) AS BIGINT), 0)
    + coalesce(CAST(abs(min(CASE WHEN NOT off_grid AND "row" = 2 THEN u END)) > 0.6e0 * max(pitch) AS BIGINT), 0),
  count(*) FILTER (gap > 1.5e0 * pitch) FROM rvp GROUP BY frame, seat
""")
def w19(t):
    d = stage(_river(t), "river_rows")
    none = lambda c, ty: F.lit(None).cast(ty).alias(c)
    rows = d.select(F.lit("det").alias("what"), "frame", "seat", "det_id", "row", "off_grid", F.when(~F.col("off_grid"), F.col("pos_in_row")).alias("pos_in_row"),
                    r6(F.col("gap")).alias("gap"), *[none(c, "long") for c in ("not_full", "too_many", "off_origin", "hole")])
    c = A.river_checks(d, ["frame", "seat"])
    checks = c.select(F.lit("river").alias("what"), "frame", "seat", F.col("off_grid").alias("det_id"), none("row", "int"), none("off_grid", "boolean"),
                      none("pos_in_row", "long"), none("gap", "double"), "not_full", "too_many", "off_origin", "hole")
    return rows.unionByName(checks)


@query("w20_strip_cells", """
WITH RECURSIVE r0 AS (SELECT l_orderkey AS frame, CAST(round(l_extendedprice * 100) AS BIGINT) AS det_id, CAST(l_partkey % 97 AS DOUBLE) * 4 AS a, CAST(l_suppkey % 89 AS DOUBLE) AS c, CAST(l_partkey % 38 AS INTEGER) AS label FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY a, det_id) AS rn FROM r0),
h(frame, rn, ha, hno, hid) AS (SELECT frame, 1, a, 0, det_id FROM o WHERE rn = 1
  UNION ALL SELECT o.frame, CAST(o.rn AS INTEGER), CASE WHEN o.a - h.ha < 28e0 THEN h.ha ELSE o.a END, CASE WHEN o.a - h.ha < 28e0 THEN h.hno ELSE h.hno + 1 END, CASE WHEN o.a - h.ha < 28e0 THEN h.hid ELSE o.det_id END
  FROM h JOIN o ON o.frame = h.frame AND o.rn = h.rn + 1),
m AS (SELECT h.frame, h.hno, o.det_id = h.hid AS is_head, o.rn, o.a, o.c, o.label FROM h JOIN o ON o.frame = h.frame AND o.rn = h.rn),
g AS (SELECT frame, hno, max(a) FILTER (is_head) AS a, max(c) FILTER (is_head) AS hc, max(label) FILTER (is_head) AS hl, arg_max(c, rn) FILTER (NOT is_head) AS jc, arg_max(label, rn) FILTER (NOT is_head) AS jl FROM m GROUP BY frame, hno)
SELECT frame, CAST(hno AS BIGINT) AS idx, a, CASE WHEN jl IS NULL OR jc > hc THEN hl ELSE jl END AS label, CASE WHEN jl IS NULL THEN hl % 2 = 0 ELSE true END AS sideways,
  CASE WHEN jl IS NULL THEN NULL WHEN jc > hc THEN jl ELSE hl END AS stacked FROM g
""")
def w20(t):
    d = t.bx.select("frame", "det_id", (F.col("x0") * 4).alias("a"), F.col("y0").alias("c"), F.col("cls").alias("label"), (F.col("cls") % 2 == 0).alias("sideways"))
    return A.strip_cells(d, ["frame"], 70.0)


@query("w21_hand_row", """
SELECT frame, det_id, CAST(row_number() OVER w - 1 AS BIGINT) AS slot,
  coalesce(row_number() OVER w = count(*) OVER (PARTITION BY frame) AND count(*) OVER (PARTITION BY frame) >= 2 AND x0 - lag(x0) OVER w > 20, false) AS drawn
FROM bx WINDOW w AS (PARTITION BY frame ORDER BY x0, det_id)
""")
def w21(t):
    return A.hand_row(t.bx.select("frame", "det_id", "x0"), ["frame"], 20.0).select("frame", "det_id", "slot", "drawn")


@query("w22_row_rescue", """
WITH b AS (SELECT frame, det_id, (y0 + y1) / 2 AS cy, y1 - y0 AS h FROM bx), m AS (SELECT frame, median(cy) AS my, median(h) AS mh FROM b GROUP BY frame)
SELECT frame, det_id, abs(cy - my) < 0.6e0 * mh AS in_row FROM b JOIN m USING (frame)
""")
def w22(t):
    d = t.bx.select("frame", "det_id", ((F.col("y0") + F.col("y1")) / 2).alias("cy"), (F.col("y1") - F.col("y0")).alias("h"))
    return A.row_rescue(d, ["frame"]).select("frame", "det_id", "in_row")


@query("w23_best_path", f"""
WITH s AS (SELECT conv_id, turn, (turn * 7 + length(text)) % 4 AS c1, (turn + length(text)) % 13 AS c2 FROM conversations),
l AS (SELECT conv_id, turn, c1 AS cls, length(role) % 5 AS sc FROM s JOIN conversations USING (conv_id, turn) UNION ALL SELECT conv_id, turn, c2, 4 FROM s),
b AS (SELECT conv_id, turn, arg_max(cls, sc * 100 - cls) AS cls FROM l GROUP BY ALL),
p AS (SELECT *, lag(cls) OVER (PARTITION BY conv_id ORDER BY turn) AS pv FROM b)
SELECT conv_id, coalesce(string_agg((string_split('0123456789-x余', ''))[cls], '' ORDER BY turn) FILTER (cls <> 0 AND cls IS DISTINCT FROM pv), '') AS text FROM p GROUP BY conv_id
""")
def w23(t):
    c = t.raw("conversations").withColumn("n", F.length("text"))
    a = c.select("conv_id", "turn", ((F.col("turn") * 7 + F.col("n")) % 4).alias("cls"), (F.length("role") % 5).alias("score"))
    b = c.select("conv_id", "turn", ((F.col("turn") + F.col("n")) % 13).alias("cls"), F.lit(4).alias("score"))
    return A.best_path(a.unionByName(b), ["conv_id"], "turn", "cls", "score", dims.READER_CHARS, seq_chunk("turn"))


CTE["hud"] = f"""
SELECT frame, det_id, ({sql_list(dims.HUD)})[l_partkey % 19 + 1] AS name, x0 * 3 + 7 AS cx, y0 * 5 AS cy,
  CASE l_partkey % 19 WHEN 4 THEN 'E' || CAST(l_linenumber % 4 + 1 AS VARCHAR) WHEN 5 THEN '余' || CAST(l_suppkey AS VARCHAR) WHEN 6 THEN 'S' WHEN 7 THEN 'x' || CAST(l_linenumber AS VARCHAR) WHEN 8 THEN 'xx' || CAST(l_linenumber AS VARCHAR)
    ELSE CASE WHEN l_linenumber = 3 THEN '1-x' ELSE CAST(l_suppkey * 100 AS VARCHAR) END END AS text FROM bx
"""


def _hud(t):
    p, ln = F.col("l_partkey") % 19, F.col("l_linenumber").cast("string")
    text = (F.when(p == 4, F.concat(F.lit("E"), (F.col("l_linenumber") % 4 + 1).cast("string"))).when(p == 5, F.concat(F.lit("余"), F.col("l_suppkey").cast("string")))
            .when(p == 6, "S").when(p == 7, F.concat(F.lit("x"), ln)).when(p == 8, F.concat(F.lit("xx"), ln))
            .otherwise(F.when(F.col("l_linenumber") == 3, "1-x").otherwise((F.col("l_suppkey") * 100).cast("string"))))
    return t.bx.select("frame", "det_id", F.get(lit_array(dims.HUD), p.cast("int")).alias("name"), (F.col("x0") * 3 + 7).alias("cx"), (F.col("y0") * 5).alias("cy"), text.alias("text"))


@query("p13_stripped_int", "SELECT frame, det_id, TRY_CAST(ltrim(text, '余x') AS INTEGER) AS n FROM hud")
def p13(t):
    return _hud(t).select("frame", "det_id", A.stripped_int(F.col("text"), "余x").alias("n"))


@query("p14_marker_seat", """
WITH a AS (SELECT frame, coalesce(arg_max({'x': cx, 'y': cy}, det_id) FILTER (name = 'round_label'), arg_min({'x': cx, 'y': cy}, det_id) FILTER (name = 'wall_count')) AS a FROM hud GROUP BY frame),
s AS (SELECT a.frame, CASE WHEN a.a IS NULL OR h.cx IS NULL THEN NULL WHEN abs(h.cy - a.a.y) >= abs(h.cx - a.a.x) THEN CASE WHEN h.cy > a.a.y THEN 'self' ELSE 'across' END
  ELSE CASE WHEN h.cx > a.a.x THEN 'right' ELSE 'left' END END AS s FROM a LEFT JOIN (SELECT * FROM hud WHERE name = 'reach_stick') h USING (frame))
SELECT frame, coalesce(bool_or(s = 'self'), false) AS reach_self, coalesce(bool_or(s = 'right'), false) AS reach_right, coalesce(bool_or(s = 'across'), false) AS reach_across, coalesce(bool_or(s = 'left'), false) AS reach_left FROM s GROUP BY frame
""")
def p14(t):
    return A.attribute_markers(_hud(t), "frame", "det_id")


@query("p15_hud_assembly", f"""
SELECT frame, {', '.join(f"TRY_CAST(arg_max(text, det_id) FILTER (name = '{f}') AS INTEGER) AS {f}" for f in dims.SCORE_FIELDS)},
  arg_max(text, det_id) FILTER (name = 'round_label') AS round_label, TRY_CAST(ltrim(arg_max(text, det_id) FILTER (name = 'wall_count'), '余') AS INTEGER) AS wall_count,
  TRY_CAST(ltrim(arg_max(text, det_id) FILTER (name = 'riichi_stick_count'), 'x') AS INTEGER) AS kyotaku, TRY_CAST(ltrim(arg_max(text, det_id) FILTER (name = 'honba_count'), 'x') AS INTEGER) AS honba,
  arg_max(text, det_id) FILTER (name = 'seat_wind_self') AS seat_wind_self,
  coalesce(string_agg(name, ',' ORDER BY list_position({sql_list(dims.HUD)}, name)) FILTER (name LIKE 'btn_%'), '') AS buttons FROM hud GROUP BY frame
""")
def p15(t):
    return A.assemble_hud(_hud(t), "frame", "det_id").withColumn("buttons", F.concat_ws(",", "buttons"))


@query("a21_zone_confidence", """
SELECT frame, string_agg(zone || '=' || s, ',' ORDER BY zone) AS confidence FROM (SELECT frame, 'z' || CAST(l_linenumber % 3 AS VARCHAR) AS zone, min(score100) AS s FROM bx GROUP BY ALL) GROUP BY frame
""")
def a21(t):
    d = t.bx.select("frame", F.concat(F.lit("z"), (F.col("l_linenumber") % 3).cast("string")).alias("zone"), F.col("score100").alias("score"))
    d = A.zone_confidence(d, "frame")
    return d.select("frame", F.concat_ws(",", F.transform(F.map_entries("confidence"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))).alias("confidence"))
