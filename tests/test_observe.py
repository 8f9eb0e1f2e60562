"""Screens with known boards: boxes are drawn on the flattened table, moved to the screen and read again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardlake import dims
from boardlake.functions import geometry as G
from boardlake.operators import assemble as A
from boardlake.operators import gates
from boardlake.operators import observe as O
from boardlake.session import stage

SCHEMA = ("frame int, det_id int, tile string, score int, x0 double, y0 double, x1 double, y1 double, quad array<struct<x: double, y: double>>, "
          "region struct<ox: long, oy: long, bw: long, bh: long>, frame_w int, frame_h int")
BACK = np.array(G.table_matrices()["full_inv"]).reshape(3, 3)


class Screen:
    def __init__(self, frame, ox=0):
        self.frame, self.ox, self.rows = frame, ox, []

    def px(self, tile, x0, y0, x1, y1, quad=None, score=90):
        quad = quad or [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        self.rows.append((self.frame, len(self.rows), tile, score, float(x0), float(y0), float(x1), float(y1), [(float(a), float(b)) for a, b in quad],
                          (self.ox, 0, 1920, 1080), 1920 + 2 * self.ox, 1080))

    def table(self, tile, o, u, v, a, c, wide, high, score=90):
        """A box of ``wide`` along u and ``high`` along v, centred at (a, c) of the zone."""
        o, u, v = (np.array(z, float) for z in (o, u, v))
        flat = [o + (a + i * wide / 2) * u + (c + j * high / 2) * v for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        scr = [BACK @ np.array([*p, 1.0]) for p in flat]
        q = [(p[0] / p[2] + self.ox, p[1] / p[2]) for p in scr]
        xs, ys = [p[0] for p in q], [p[1] for p in q]
        self.px(tile, min(xs), min(ys), max(xs), max(ys), q, score)

    def river(self, seat, tiles, lying=()):
        r = G.river_axes("4p", seat)
        for i, t in enumerate(tiles):
            w, h = (92, 66) if i in lying else (66, 92)
            self.table(t, r["o"], r["u"], r["v"], (i % 6) * r["pitch"], r["offs"][i // 6], w, h)

    def strip(self, seat, cells):
        s = dims.STRIP["4p"][seat]
        for i, c in enumerate(cells):
            label, lies = c.rstrip("-").split("+")[0].rstrip("-"), "-" in c
            w, h = (s["d"], s["w"]) if lies else (s["w"], s["d"])
            self.table(label, s["corner"], s["along"], s["cross"], (i + 0.5) * s["w"], s["d"] / 2, w, h, 70)
            if "+" in c:
                self.table(c.split("+")[1], s["corner"], s["along"], s["cross"], (i + 0.5) * s["w"], 1.6 * s["d"], w, h, 60)


@pytest.fixture(scope="module")
def screens(spark):
    sig = {(r.type, r.rel, tuple(r.tiles), r.called): r.sig.split(" ") for r in A.meld_hypotheses(spark).collect()}
    one = Screen(1)
    one.river(0, ["1m", "2m", "3m"], lying=(1,))
    one.river(2, ["E"] * 7)
    one.strip(1, sig["pon", 2, ("7p", "7p", "7p"), "7p"] + sig["chi", 3, ("1s", "2s", "3s"), "2s"])
    one.strip(3, next(v for (t, rel, tiles, c), v in sig.items() if t == "kakan" and tiles == ("9s",) * 4 and rel == 1))
    for i, t in enumerate(["9p", "1p", "N"]):
        one.px(t, 223 + i * 95 + (60 if i == 2 else 0), 930, 313 + i * 95 + (60 if i == 2 else 0), 1070)
    one.px("5mr", 60, 50, 90, 90, score=40)
    one.px("W", 40, 52, 55, 90)
    one.px(None, 900, 400, 950, 430, score=10)
    wide = Screen(2, ox=240)
    wide.river(3, ["1p", "2p", "9p", "9m"])
    wide.strip(0, ["1m", "1m"])
    for x, y, t in ((30, 60, "2s"), (75, 62, "1s"), (120, 61, "3s"), (60, 190, "4s")):
        wide.px(t, x, y, x + 35, y + 50)
    stray = Screen(3)
    stray.px("C", 5, 600, 35, 640)
    stray.px("back", 1880, 600, 1910, 640)
    d = spark.createDataFrame(one.rows + wide.rows + stray.rows, SCHEMA)
    return {r.frame: r for r in O.observe(d, "frame", "det_id", "4p").collect()}, d


def test_zones_of_a_frame(screens):
    r = screens[0][1]
    assert (r.o_hand, r.drawn, r.dora) == (["9p", "1p"], "N", ["W", "5mr"])
    assert [(t.pai, t.sideways) for t in r.o_rivers[0]] == [("1m", False), ("2m", True), ("3m", False)]
    assert [t.pai for t in r.o_rivers[2]] == ["E"] * 7 and r.o_rivers[1] == [] and r.o_reach == [True, False, False, False]
    assert [(m.type, m.rel, m.called, m.added) for m in r.o_melds[1]] == [("pon", 2, "7p", ""), ("chi", 3, "2s", "")]
    assert [(m.type, m.rel, m.called, m.added) for m in r.o_melds[3]] == [("kakan", 1, "9s", "9s")]
    assert r.confidence["dora"] == 40 and r.confidence["hud"] == 10 and r.confidence["meld1"] == 70 and r.confidence["meld3"] == 60
    assert r.problems == []


def test_wide_frames_hold_their_indicators_in_the_corner(screens):
    r = screens[0][2]
    assert r.dora == ["2s", "1s", "3s"] and r.o_hand == [] and r.drawn is None
    assert [t.pai for t in r.o_rivers[3]] == ["1p", "2p", "9p", "9m"]
    assert r.problems == ["stray detection 4s (off dora row)", "seat0 meld strip unparsable"]
    assert r.o_melds[0] == [] and [c.label for c in r.strips[0]] == ["1m", "1m"]


def test_strays(screens):
    r = screens[0][3]
    assert len(r.problems) == 1 and r.problems[0].startswith("stray detection C (") and r.problems[0].endswith("px off-zone)")
    assert r.o_rivers == [[]] * 4 and r.confidence == {}


def test_flow_equals_its_parts(spark, screens):
    """Rivers and strips of the flow against the operators that work on long tables."""
    p = stage(O.place(screens[1], "4p"), "placed")
    rows = A.river_rows(p.filter("part = 'river'").drop("row", "u"), ["frame", "seat"], "4p").filter("NOT off_grid")
    want = {}
    for r in rows.orderBy("frame", "seat", "row", "pos_in_row").collect():
        want.setdefault((r.frame, r.seat), []).append(r.tile)
    assert want == {(f, s): [t.pai for t in o.o_rivers[s]] for f, o in screens[0].items() for s in range(4) if o.o_rivers[s]}
    for seat in range(4):
        d = p.filter((F.col("part") == "meld") & (F.col("seat") == seat)).select("frame", "det_id", F.col("u").alias("a"), F.col("v").alias("c"), F.col("tile").alias("label"), "sideways")
        cells = {}
        for r in A.strip_cells(d, ["frame"], dims.STRIP["4p"][seat]["w"]).orderBy("frame", "idx").collect():
            cells.setdefault(r.frame, []).append((r.label, r.sideways, r.stacked))
        assert cells == {f: [tuple(c) for c in o.strips[seat]] for f, o in screens[0].items() if o.strips[seat]}


def test_rules_read_the_observed_board(spark, screens):
    d = O.observe(screens[1], "frame", "det_id", "4p")
    none = F.lit(None)
    sets = F.transform("o_melds", lambda s: F.transform(s, lambda m: F.struct(m["type"].alias("type"), m["tiles"].alias("tiles"), m["called"].alias("called"),
                                                                           m["added"].alias("added"), m["rel"].alias("from_rel"))))
    d = d.withColumns({"o_melds": sets, "o_concealed": F.array_repeat(none.cast("int"), 4), "scores": none.cast("array<int>"), "kyotaku": none.cast("int"), "left_tiles": none.cast("int")})
    told = {r.frame: r.violations for r in gates.check_observed(d).collect()}
    assert "hero hand 2 + 3*0 melds != 13" in told[1] and "tile E seen 7>4 times across visible zones" in told[1]
    assert "no dora marker visible" in told[3] and "no dora marker visible" not in told[2]


def _plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_boxes_are_placed_without_lambdas(spark, screens):
    """A lambda is interpreted, box by box."""
    assert "lambda" not in _plan(O.place(screens[1], "4p").select("part", "seat", "row", "u", "v", "off", "sideways", "dist"))


def test_a_strip_of_two_cells_is_told_and_sets_are_only_read_when_taken(spark, screens):
    d = O.observe(screens[1], "frame", "det_id", "4p")
    assert "Join" not in _plan(d.select("o_hand", "o_rivers", "strips", "strays")) and "Join" in _plan(d.select("o_melds"))
    got = {r.frame: r for r in d.select("frame", "strays", "unread", "o_melds").collect()}
    assert got[2].strays == ["stray detection 4s (off dora row)"] and got[2].unread == ["unparsable", None, None, None] and got[2].o_melds == [[]] * 4
    assert got[1].strays == [] and got[1].unread == [None] * 4 and len(got[3].strays) == 1
