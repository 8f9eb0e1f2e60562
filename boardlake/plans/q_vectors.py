"""Queries for the feature-vector operators (V1-V10, A17, F22) on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.num import r6
from ..operators import vectors as V
from ..operators.ordered import seq_chunk
from .proxies import CTE
from .registry import query

W = H = 8  # a 64-element vector is read as an 8x8 picture

CTE["pix"] = """
SELECT key, game, list_transform(v, lambda x: CAST(floor(abs(x) * 2000) AS BIGINT) % 256) AS p FROM vec
"""


def _pix(t):
    return t.vec.select("key", "game", F.transform("v", lambda x: F.floor(F.abs(x) * 2000) % 256).alias("p"))


@query("v1_coverage", """
WITH c AS (SELECT key, p AS b, list_reverse(p) AS g, list_concat(p[33:64], p[1:32]) AS r FROM pix),
s AS (SELECT key, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN least(b[i], g[i], r[i]) >= 70 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) / 64 AS face,
  list_sum(list_transform(range(1, 65), lambda i: CASE WHEN r[i] - b[i] >= 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) / 64 AS back,
  list_sum(list_transform(range(1, 65), lambda i: CASE WHEN b[i] > 60 OR g[i] > 110 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) / 64 AS live FROM c)
SELECT key, round_even(face, 6) AS face, round_even(back, 6) AS back, round_even(live, 6) AS live, face >= 0.35 OR back >= 0.35 AS present FROM s
""")
def v1(t):
    b, g, r = F.col("p"), F.reverse("p"), F.concat(F.slice("p", 33, 32), F.slice("p", 1, 32))
    d = _pix(t).select("key", b.alias("b"), g.alias("g"), r.alias("r"))
    d = d.select("key", V.face_share(F.col("b"), F.col("g"), F.col("r"), 70).alias("face"),
                 V.back_share(F.col("b"), F.col("r")).alias("back"),
                 V.array_mean(V.mask_rule("live", F.col("b"), F.col("g"))).alias("live"))
    return d.select("key", r6(F.col("face")).alias("face"), r6(F.col("back")).alias("back"), r6(F.col("live")).alias("live"),
                    V.present(F.col("face"), F.col("back")).alias("present"))


CTE["pairs"] = """
SELECT a.key, a.game, a.p AS a, CASE WHEN a.key % 17 = 0 THEN b.p[1:60] ELSE b.p END AS b FROM pix a JOIN pix b ON b.key = a.key - a.key % 2
"""


def _pairs(t):
    d = _pix(t)
    mate = d.select(F.col("key").alias("_k"), F.col("p").alias("_b"))
    j = d.withColumn("_k", F.col("key") - F.col("key") % 2).join(mate, "_k")
    return j.select("key", "game", F.col("p").cast("array<double>").alias("a"),
                    F.when(F.col("key") % 17 == 0, F.slice("_b", 1, 60)).otherwise(F.col("_b")).cast("array<double>").alias("b"))


@query("v2_mean_abs_diff", """
SELECT key, CASE WHEN len(a) <> len(b) THEN 1e9::DOUBLE ELSE round_even(CAST(list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) AS DOUBLE) / 64, 6) END AS dist FROM pairs
""")
def v2(t):
    return _pairs(t).select("key", r6(V.mean_abs_diff(F.col("a"), F.col("b"))).alias("dist"))


def _v3_sql() -> str:
    parts = []
    for x0, y0, x1, y1 in dims.STABILITY_REGIONS.values():
        xs, ys = range(int(x0 * W), int(x1 * W)), range(int(y0 * H), int(y1 * H))
        idx = [y * W + x + 1 for y in ys for x in xs]
        if idx:
            parts.append(f"CAST(list_sum(list_transform({idx}, lambda i: abs(a[i] - b[i]))) AS DOUBLE) / {len(idx)}")
    return f"SELECT key, CASE WHEN len(a) <> len(b) THEN 1e9::DOUBLE ELSE round_even(greatest({', '.join(parts)}), 6) END AS dist FROM pairs"


@query("v3_region_diff", _v3_sql())
def v3(t):
    return _pairs(t).select("key", r6(V.region_diff(F.col("a"), F.col("b"), W, H)).alias("dist"))


@query("v4_extent", """
WITH a AS (SELECT key, list_filter(range(64), lambda i: p[i + 1] >= 230) AS ix FROM pix)
SELECT key, greatest(0, list_min(list_transform(ix, lambda i: i % 8)) - 1) AS x0, greatest(0, list_min(list_transform(ix, lambda i: i // 8)) - 1) AS y0,
  least(8, list_max(list_transform(ix, lambda i: i % 8)) + 2) AS x1, least(8, list_max(list_transform(ix, lambda i: i // 8)) + 2) AS y1
FROM a WHERE len(ix) >= 4 UNION ALL SELECT key, NULL, NULL, NULL, NULL FROM a WHERE len(ix) < 4
""")
def v4(t):
    return _pix(t).select("key", V.extent(F.col("p"), W, H, 230, 1, 4).alias("b")).select("key", "b.*")


@query("v5_content_bounds", """
WITH m AS (SELECT key, list_filter(range(8), lambda r: list_sum(list_transform(range(8), lambda c: p[r * 8 + c + 1])) / 8.0 >= 130) AS rr,
  list_filter(range(8), lambda c: list_sum(list_transform(range(8), lambda r: p[r * 8 + c + 1])) / 8.0 >= 130) AS cc FROM pix),
o AS (SELECT *, len(rr) > 0 AND len(cc) > 0 AND list_max(rr) + 1 - list_min(rr) >= 4 AND list_max(cc) + 1 - list_min(cc) >= 4 AS ok FROM m)
SELECT key, CASE WHEN ok THEN list_min(rr) ELSE 0 END AS top, CASE WHEN ok THEN list_max(rr) + 1 ELSE 8 END AS bottom,
  CASE WHEN ok THEN list_min(cc) ELSE 0 END AS "left", CASE WHEN ok THEN list_max(cc) + 1 ELSE 8 END AS "right", NOT coalesce(ok, false) AS degenerate FROM o
""")
def v5(t):
    d = _pix(t).select("key", F.col("p").cast("array<double>").alias("p"))
    return d.select("key", V.content_bounds(F.col("p"), W, H, 130).alias("b")).select("key", "b.*")


@query("v6_dark_line", """
WITH m AS (SELECT key, v, list_position(v, list_min(v)) AS i FROM (SELECT key, list_transform(v, lambda x: abs(x)) AS v FROM vec)),
d AS (SELECT *, (v[i - 1] - v[i + 1]) / (2e0 * (v[i - 1] - 2 * v[i] + v[i + 1]) + 1e-9) AS d FROM m)
SELECT key, round_even(key - 10 + CASE WHEN i > 1 AND i < 64 THEN (i - 1) + greatest(-1e0, least(1e0, d)) ELSE i - 1 END, 6) AS pos,
  round_even(greatest(v[1], v[64]) - v[i], 6) AS contrast FROM d
""")
def v6(t):
    p = F.transform("v", lambda x: F.abs(x))
    d = t.vec.select("key", V.dark_line(p, F.col("key"), 10).alias("d"))
    return d.select("key", r6(F.col("d.pos")).alias("pos"), r6(F.col("d.contrast")).alias("contrast"))


@query("v7_face_edge", """
WITH q AS (SELECT key, game, CASE WHEN key % 2 = 0 THEN a ELSE list_reverse(a) END AS q FROM (SELECT key, game, list_transform(v, lambda x: abs(x)) AS a FROM vec)),
g AS (SELECT *, list_transform(range(0, 48), lambda j: list_sum(q[j + 13:j + 17]) / 5 - list_sum(q[j + 1:j + 12]) / 12) AS g FROM q),
i AS (SELECT *, list_position(g, list_max(g)) - 1 + 12 - 0.5e0 AS pos FROM g)
SELECT key, round_even(key - 14 + CASE WHEN key % 2 = 0 THEN pos ELSE 63 - pos END, 6) AS pos, round_even(list_max(g), 6) AS gain FROM i
""")
def v7(t):
    p = F.transform("v", lambda x: F.abs(x))
    up, down = V.face_edge(p, F.col("key"), 1, 14), V.face_edge(p, F.col("key"), -1, 14)
    d = t.vec.select("key", F.when(F.col("key") % 2 == 0, up).otherwise(down).alias("e"))
    return d.select("key", r6(F.col("e.pos")).alias("pos"), r6(F.col("e.gain")).alias("gain"))


CTE["vbox"] = """
SELECT frame % (SELECT count(*) FROM vec) AS key, frame, l_linenumber AS ln, x0 / 12 - 1.5e0 AS x1, y0 / 11 - 1.5e0 AS y1, x1 / 14 AS x2, y1 / 13 AS y2 FROM bx
"""


def _vbox(t):
    n = t.vec.count()  # every vector is read by some frame
    return t.bx.select((F.col("frame") % n).alias("key"), "frame", F.col("l_linenumber").alias("ln"), (F.col("x0") / 12 - 1.5).alias("x1"),
                       (F.col("y0") / 11 - 1.5).alias("y1"), (F.col("x1") / 14).alias("x2"), (F.col("y1") / 13).alias("y2"))


@query("v8_box_mean", """
WITH c AS (SELECT b.frame, b.ln, p, greatest(0, least(8, CAST(trunc(x1) AS INTEGER))) AS xa, greatest(0, least(8, CAST(trunc(x2) AS INTEGER))) AS xb,
  greatest(0, least(8, CAST(trunc(y1) AS INTEGER))) AS ya, greatest(0, least(8, CAST(trunc(y2) AS INTEGER))) AS yb FROM vbox b JOIN pix USING (key)),
l AS (SELECT *, list_filter(range(64), lambda i: i % 8 >= xa AND i % 8 < xb AND i // 8 >= ya AND i // 8 < yb) AS idx FROM c)
SELECT frame, ln, CASE WHEN len(idx) > 0 THEN round_even(CAST(list_sum(list_transform(idx, lambda i: p[i + 1])) AS DOUBLE) / len(idx), 6) ELSE 0e0 END AS fill FROM l
""")
def v8(t):
    m = _pix(t).select("key", V.integral(F.col("p").cast("array<double>"), W, H).alias("p"))
    d = _vbox(t).join(m, "key")
    f = V.box_mean(F.col("p"), W, H, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return d.select("frame", "ln", r6(f).alias("fill"))


@query("v9_best_shift", """
WITH m AS (SELECT key, p FROM pix),
s AS (SELECT key, p, list_transform(range(-6, 7, 2), lambda s: list_sum(list_transform(range(28, 36), lambda i: p[i + s + 1]))) AS c FROM m),
o AS (SELECT *, (list_position(c, list_max(c)) - 1) * 2 - 6 AS cover_off FROM s),
f AS (SELECT *, list_transform([0, least(0, cover_off), greatest(0, cover_off), 3], lambda s: p[28 + s + 1] + p[35 + s + 1]) AS fs,
  [0, least(0, cover_off), greatest(0, cover_off), 3] AS cs FROM o),
u AS (SELECT key, cover_off, unnest(fs) AS sc, unnest(cs) AS off FROM f)
SELECT key, any_value(cover_off) AS cover_off, arg_max(off, sc * 100 - abs(off) * 2 - CASE WHEN off > 0 THEN 1 ELSE 0 END) AS off, CAST(max(sc) AS DOUBLE) AS score FROM u GROUP BY key
""")
def v9(t):
    d = _pix(t).select("key", F.col("p").cast("array<double>").alias("p"))
    offs = F.array(*[F.lit(s) for s in range(-6, 7, 2)])
    cover = V.best_shift(offs, lambda s: V._sum(F.slice("p", s + 29, F.lit(8))))
    d = d.withColumn("cover_off", cover["off"])
    c = F.array_distinct(F.array(F.lit(0), F.col("cover_off"), F.lit(3)))
    best = V.best_candidate(c, lambda s: F.get("p", s + 28) + F.get("p", s + 35))
    return d.withColumn("b", best).select("key", F.col("cover_off").cast("long").alias("cover_off"),
                                          F.col("b.off").cast("long").alias("off"), F.col("b.score").alias("score"))


CTE["bgr"] = """
WITH n AS (SELECT key, game, v, row_number() OVER (PARTITION BY game ORDER BY key) - 1 AS rn, count(*) OVER (PARTITION BY game) AS n FROM vec WHERE key % 3 <> 0),
k AS (SELECT DISTINCT game, CAST(floor(i * (CAST(n AS DOUBLE) / 31)) AS BIGINT) AS rn FROM n, (SELECT unnest(range(31)) AS i) WHERE n > 31),
s AS (SELECT * FROM n WHERE n <= 31 OR EXISTS (SELECT 1 FROM k WHERE k.game = n.game AND k.rn = n.rn)),
c AS (SELECT game, unnest(v) AS x, unnest(range(1, 65)) AS pos, count(*) OVER (PARTITION BY game) AS m FROM s)
SELECT game, pos, median(x) AS med FROM c WHERE m >= 8 GROUP BY game, pos
"""


def _background(t):
    clean = t.vec.filter(F.col("key") % 3 != 0)
    return V.group_background(clean, "game", "key", seq_chunk("key"))


@query("a17_group_background", "SELECT game, CAST(pos - 1 AS INTEGER) AS pos, round_even(med, 6) AS med FROM bgr")
def a17(t):
    return _background(t).select("game", F.posexplode("background").alias("pos", "m")).select("game", "pos", r6(F.col("m")).alias("med"))


@query("v10_overlay_share", """
WITH x AS (SELECT key, game, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM vec)
SELECT key, round_even(CAST(count(*) FILTER (abs(x - med) > 0.1e0) AS DOUBLE) / count(*), 6) AS share FROM x JOIN bgr USING (game, pos) GROUP BY key
""")
def v10(t):
    d = t.vec.join(_background(t), "game")
    return d.select("key", r6(V.overlay_share(F.col("v"), F.col("background"), 0.1)).alias("share"))


@query("f22_sorting_suspect", """
WITH s AS (SELECT key, list_transform(range(31), lambda j: v[j * 2 + 1]) AS m, list_transform(range(31), lambda j: abs(v[j * 2 + 2])) AS d, v[63] AS em, abs(v[64]) AS ed FROM vec),
t AS (SELECT *, list_median(m) AS mm, list_median(d) AS md FROM s)
SELECT key, len(list_filter(range(1, 32), lambda i: abs(m[i] - em) + abs(d[i] - ed) < 0.7e0 * (abs(m[i] - mm) + abs(d[i] - md)))) > 0 AS suspect FROM t
""")
def f22(t):
    slots = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda j: F.struct(
        F.get("v", j * 2).alias("mean"), F.abs(F.get("v", j * 2 + 1)).alias("std")))
    empty = F.struct(F.get("v", F.lit(62)).alias("mean"), F.abs(F.get("v", F.lit(63))).alias("std"))
    return t.vec.select("key", V.sorting_suspect(slots, empty).alias("suspect"))
