"""Where every tile of a board state is drawn: grid, strips, rows and label rows
(P8, P9, P20-P23, W16-W18, W24-W26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.geometry import norm_to_px, rect, relative_seat, river_axes
from ..functions.tiles import class_id, lit_array, lit_map
from .ordered import Run, scan, seq_chunk

SLOT_CHUNK = 64  # slots per chunk; every legal row or strip fits into one


def _per_seat(mode: Column, pos: Column, make) -> Column:
    """Pick a struct of constants by (mode, pos)."""
    out = None
    for m in ("4p", "3p"):
        for p in range(4):
            hit = (mode == m) & (pos == p)
            out = F.when(hit, make(m, p)) if out is None else out.when(hit, make(m, p))
    return out


def _floats(**values) -> Column:
    return F.struct(*[F.lit(float(v)).alias(k) for k, v in values.items()])


def _norm_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


# --- P8 ---------------------------------------------------------------------------------


def dora_slot(i: Column, n: int = dims.MAX_DORA) -> Column:
    """Normalised box of indicator slot i."""
    x0, y0, x1, y1 = dims.DORA_STRIP
    w = (x1 - x0) / n
    return _norm_box(x0 + i * w, F.lit(y0), x0 + (i + 1) * w, F.lit(y1))


def hand_slot(i: Column, drawn: Column) -> Column:
    """Normalised box of hand slot i; the drawn tile stands apart."""
    x = dims.HAND_X0 + i * dims.HAND_W + F.when(drawn, dims.HAND_GAP).otherwise(0.0)
    return _norm_box(x, F.lit(dims.HAND_Y0), x + dims.HAND_W, F.lit(dims.HAND_Y0 + dims.HAND_H))


# --- W16 --------------------------------------------------------------------------------


def _grid_constants(mode: str, pos: int) -> Column:
    r = river_axes(mode, pos)
    (fw, fh) = dims.RIVER_FOOT[pos]
    side = fh if abs(r["u"][0]) > abs(r["u"][1]) else fw  # a sideways tile swaps width and height
    return _floats(ox=r["o"][0], oy=r["o"][1], cx=r["colvec"][0], cy=r["colvec"][1], ux=r["u"][0], uy=r["u"][1],
                   vx=r["v"][0], vy=r["v"][1], o0=r["offs"][0], o1=r["offs"][1], o2=r["offs"][2],
                   fw=fw, fh=fh, extra=max(0.0, side - r["pitch"]))


def river_layout(tiles: DataFrame) -> DataFrame:
    """Centre and face quad of each visible discard in the flattened table.

    Input: ``mode, pos, idx, sideways_idx``.  Six tiles per row; tiles past the 18th lengthen
    the third row; tiles after a sideways one in its row move on by the extra width.
    """
    g = _per_seat(F.col("mode"), F.col("pos"), _grid_constants)
    d = tiles.withColumn("_g", g)
    i, cols = F.col("idx"), dims.GRID_COLS
    line, col = F.floor(i / cols), i % cols
    over = line >= 3
    row = F.when(over, 2).otherwise(line)
    eff = F.when(over, cols + (i - 18)).otherwise(col)
    s = F.col("sideways_idx")
    is_side = F.coalesce(i == s, F.lit(False))
    after = F.coalesce((F.floor(s / cols) == line) & (s % cols < col), F.lit(False))
    push = F.when(after, F.col("_g.extra")).otherwise(0.0) + F.when(is_side, F.col("_g.extra") / 2).otherwise(0.0)
    off = F.when(row == 0, F.col("_g.o0")).when(row == 1, F.col("_g.o1")).otherwise(F.col("_g.o2"))
    cx = F.col("_g.ox") + eff * F.col("_g.cx") + off * F.col("_g.vx") + F.col("_g.ux") * push
    cy = F.col("_g.oy") + eff * F.col("_g.cy") + off * F.col("_g.vy") + F.col("_g.uy") * push
    w = F.when(is_side, F.col("_g.fh")).otherwise(F.col("_g.fw"))
    h = F.when(is_side, F.col("_g.fw")).otherwise(F.col("_g.fh"))
    n = dims.FACE_INSET
    d = d.withColumns({"row": (line + 1).cast("long"), "col": (col + 1).cast("long"), "sideways": is_side, "cx": cx, "cy": cy, "_w": w, "_h": h})
    quad = rect(F.col("cx") - F.col("_w") / 2, F.col("cy") - F.col("_h") / 2, F.col("cx") + F.col("_w") / 2, F.col("cy") + F.col("_h") / 2)
    face = rect(F.col("cx") - F.col("_w") / 2 + n, F.col("cy") - F.col("_h") / 2 + n,
                F.col("cx") + F.col("_w") / 2 - n, F.col("cy") + F.col("_h") / 2 - n)
    return d.withColumns({"quad": quad, "face": face}).drop("_g", "_w", "_h")


# --- W17, W18 ---------------------------------------------------------------------------


def remove_one(tiles: Column, item: Column) -> Column:
    """Drop the first occurrence of ``item``."""
    at = F.array_position(tiles, item) - 1
    return F.when(F.array_contains(tiles, item), F.filter(tiles, lambda _, i: i != at)).otherwise(tiles)


def _cell(label: Column, sideways: bool, stacked: Column | None = None) -> Column:
    return F.struct(label.alias("label"), F.lit(sideways).alias("sideways"),
                    (F.lit(None).cast("string") if stacked is None else stacked).alias("stacked"))


def meld_cells(mtype: Column, tiles: Column, called: Column, added: Column, rel: Column, corner_walk: bool = True) -> Column:
    """Cells of one meld in drawing order.

    The claimed tile lies sideways at the place that names the seat it came from; an added
    tile is stacked on it; a closed kan shows back, face, face, back with the red five in view.
    ``corner_walk`` reverses the owner's left-to-right order.
    """
    reds = F.filter(tiles, lambda t: t.endswith("r"))
    a, b = F.get(tiles, F.lit(1)), F.get(tiles, F.lit(2))
    red = F.get(reds, F.lit(0))
    hidden = red.isNotNull() & ~F.coalesce(red == a, F.lit(False)) & ~F.coalesce(red == b, F.lit(False))
    first = F.when(hidden, red).otherwise(F.coalesce(a, F.lit("?")))
    second = F.when(hidden, F.coalesce(b, a, red)).otherwise(F.coalesce(b, F.lit("?")))
    ankan = F.array(_cell(F.lit("back"), False), _cell(first, False), _cell(second, False), _cell(F.lit("back"), False))
    side = F.transform(tiles, lambda t: _cell(t, False))

    is_kakan = mtype == "kakan"
    rest = F.when(is_kakan & (added != ""), remove_one(tiles, added)).otherwise(tiles)
    claimed = F.when(called != "", called).otherwise(F.coalesce(F.get(rest, F.lit(0)), F.lit("?")))
    rest = remove_one(rest, claimed)
    n = F.size(rest)
    at = F.when((mtype == "chi") | (rel == 3), 0).when(rel == 2, F.least(F.lit(1), n)).otherwise(n)
    stacked = F.when(is_kakan, F.when(added != "", added).otherwise(claimed))
    flat = F.transform(rest, lambda t: _cell(t, False))
    open_ = F.concat(F.slice(flat, F.lit(1), at), F.array(_cell(claimed, True, stacked)), F.slice(flat, at + 1, n))
    cells = F.when(mtype == "ankan", ankan).when(mtype == "nukidora", side).otherwise(open_)
    return F.reverse(cells) if corner_walk else cells


def _strip_constants(mode: str, pos: int) -> Column:
    s = dims.STRIP[mode][pos]
    return _floats(x=s["corner"][0], y=s["corner"][1], ax=s["along"][0], ay=s["along"][1],
                   cx=s["cross"][0], cy=s["cross"][1], w=s["w"], d=s["d"])


def strip_layout(cells: DataFrame, keys: list[str], along_offset: float = 0.0) -> DataFrame:
    """Boxes of meld cells along a strip.

    Input: ``keys``, ``mode, pos, idx, sideways, stacked`` (boolean: shares the slot of the cell
    before it).  Sideways cells take the tile's depth along the strip, upright ones its width.
    """
    d = cells.withColumn("_s", _per_seat(F.col("mode"), F.col("pos"), _strip_constants))
    aw = F.when(F.col("sideways"), F.col("_s.d")).otherwise(F.col("_s.w"))
    cd = F.when(F.col("sideways"), F.col("_s.w")).otherwise(F.col("_s.d"))
    d = d.withColumns({"_aw": aw, "_cd": cd})
    step = F.when(F.col("stacked"), 0.0).otherwise(F.col("_aw"))
    d = scan(d, keys, ["idx"], [Run("_end", "sum", step)], seq_chunk("idx", SLOT_CHUNK))
    a0 = F.col("_end") - F.col("_aw") + along_offset
    c0 = F.when(F.col("stacked"), F.col("_cd")).otherwise(0.0)
    d = d.withColumns({"a0": a0, "a1": a0 + F.col("_aw"), "c0": c0, "c1": c0 + F.col("_cd")})

    def at(a: str, c: str) -> tuple[Column, Column]:
        return (F.col("_s.x") + F.col("_s.ax") * F.col(a) + F.col("_s.cx") * F.col(c),
                F.col("_s.y") + F.col("_s.ay") * F.col(a) + F.col("_s.cy") * F.col(c))

    (xa, ya), (xb, yb) = at("a0", "c0"), at("a1", "c1")
    return d.withColumn("quad", rect(F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb))) \
        .drop("_s", "_aw", "_cd", "_end")


def strip_length(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Total length of a strip along its axis."""
    s = _per_seat(F.col("mode"), F.col("pos"), _strip_constants)
    step = F.when(F.col("stacked"), 0.0).when(F.col("sideways"), s["d"]).otherwise(s["w"])
    return cells.groupBy(*keys).agg(F.sum(step).alias("length"))


# --- W24, W25, W26 ----------------------------------------------------------------------


def indicator_slots(dora: Column) -> Column:
    """The fixed number of slots; revealed indicators first, backs after."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims.MAX_DORA - 1)), lambda i: F.struct(
        i.alias("slot"), (i >= F.size(dora)).alias("is_back"),
        F.when(i >= F.size(dora), "back").otherwise(F.get(dora, i)).alias("tile")))


def _pile_constants(pos: int) -> Column:
    p = dims.PILE_3P[pos]
    n = (p["step"][0] ** 2 + p["step"][1] ** 2) ** 0.5
    return _floats(x=p["anchor"][0], y=p["anchor"][1], sx=p["step"][0], sy=p["step"][1],
                   ux=p["step"][0] / n, uy=p["step"][1] / n, w=p["foot"][0], h=p["foot"][1])


def pile_layout(piles: DataFrame) -> DataFrame:
    """One box per side tile: anchor + k * step, slid by ``offset`` along the pile.

    Input: ``pos, count, offset``.
    """
    c = None
    for p in range(4):
        c = F.when(F.col("pos") == p, _pile_constants(p)) if c is None else c.when(F.col("pos") == p, _pile_constants(p))
    d = piles.filter(F.col("count") > 0).withColumn("_c", c)
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1)))
    cx = F.col("_c.x") + F.col("k") * F.col("_c.sx") + F.col("offset") * F.col("_c.ux")
    cy = F.col("_c.y") + F.col("k") * F.col("_c.sy") + F.col("offset") * F.col("_c.uy")
    d = d.withColumns({"cx": cx, "cy": cy})
    hw, hh = F.col("_c.w") / 2, F.col("_c.h") / 2
    return d.withColumn("quad", rect(F.col("cx") - hw, F.col("cy") - hh, F.col("cx") + hw, F.col("cy") + hh)).drop("_c")


def best_offset(fills: DataFrame, keys: list[str]) -> DataFrame:
    """The offset with the highest mean fill, the smallest one on ties.

    Input: ``keys, offset, fill`` with one row per box and candidate offset.
    """
    per = fills.groupBy(*keys, "offset").agg(F.avg("fill").alias("mean_fill"))
    return per.groupBy(*keys).agg(F.max(F.struct("mean_fill", (-F.col("offset")).alias("_o"))).alias("_b")) \
        .select(*keys, (-F.col("_b._o")).alias("offset"), F.col("_b.mean_fill").alias("mean_fill"))


def back_template(spark: SparkSession) -> DataFrame:
    """The measured slot quads of the opponents' rows.

    Rows: ``pos, slot, quad, drawn_quad``; ``drawn_quad`` is where the drawn tile stands when
    ``slot`` is the last of the row.  A measured table of the same shape may be used instead.
    """
    rows = []
    for pos, r in dims.BACK_ROW.items():
        last = dims.BACK_SLOTS - 1
        quads = r["slots"]
        ax, sign = r["axis"], r["sign"]
        coords = [p[ax] for q in quads for p in q]
        anchor = max(coords) if sign < 0 else min(coords)
        reach = [max(abs(p[ax] - anchor) for p in q) for q in quads]
        for s, q in enumerate(quads):
            move = sign * (reach[s] - reach[last])
            shift = (move, 0.0) if ax == 0 else (0.0, move)
            drawn = [(x + shift[0], y + shift[1]) for x, y in r["drawn"]]
            rows.append((pos, s, q, drawn))
    pts = "array<struct<x: double, y: double>>"
    return spark.createDataFrame(rows, f"pos int, slot int, quad {pts}, drawn_quad {pts}")


def concealed_row(rows: DataFrame, template: DataFrame) -> DataFrame:
    """Slots of a concealed row of ``count`` tiles, and the separated draw.

    Input: keys, ``pos, count``.  With ``count mod 3 = 2`` the last tile stands apart and rides
    the row's moving end.
    """
    holding = F.col("count") % 3 == 2
    d = rows.withColumns({"holding": holding, "row_n": F.col("count") - F.when(holding, 1).otherwise(0)})
    d = d.filter(F.col("row_n").between(1, dims.BACK_SLOTS))
    d = d.join(F.broadcast(template), "pos").filter(F.col("slot") < F.col("row_n"))  # 39 fixed rows
    last = F.col("holding") & (F.col("slot") == F.col("row_n") - 1)
    plain = F.struct(F.col("slot").alias("slot"), F.lit(False).alias("drawn"), F.col("quad").alias("quad"))
    apart = F.struct((F.col("slot") + 1).alias("slot"), F.lit(True).alias("drawn"), F.col("drawn_quad").alias("quad"))
    d = d.withColumn("_b", F.explode(F.when(last, F.array(plain, apart)).otherwise(F.array(plain))))
    return d.drop("slot", "quad", "drawn_quad").select("*", "_b.*").drop("_b")


# --- P9, P20-P23 ------------------------------------------------------------------------


def field_texts(hero: Column, scores: Column, bakaze: Column, kyoku: Column, left: Column, in_round: Column,
                kyotaku: Column, honba: Column, oya: Column, sanma: Column) -> Column:
    """(field, text) pairs the screen must show; unknown fields are left out."""
    def pair(name: str, text: Column, keep: Column) -> Column:
        return F.when(F.coalesce(keep, F.lit(False)), F.struct(F.lit(name).alias("field"), text.alias("text")))

    rel_empty = F.when(sanma, F.pmod(3 - hero, F.lit(4)))
    out = []
    for i, name in enumerate(dims.SCORE_FIELDS):
        seat = F.pmod(hero + i, F.lit(4))
        shown = (hero >= 0) & scores.isNotNull() & ~F.coalesce(rel_empty == i, F.lit(False))
        out.append(pair(name, F.get(scores, seat.cast("int")).cast("string"), shown))
    out.append(pair("round_label", F.concat(bakaze, kyoku.cast("string")), bakaze.isNotNull() & (kyoku > 0)))
    padded = F.when(left < 10, F.concat(F.lit("0"), left.cast("string"))).otherwise(left.cast("string"))
    out.append(pair("wall_count", F.concat(F.lit("余"), padded), left.isNotNull()))
    out.append(pair("riichi_stick_count", F.concat(F.lit("x"), kyotaku.cast("string")), in_round))
    out.append(pair("honba_count", F.concat(F.lit("x"), honba.cast("string")), in_round))
    rel = hero - oya
    wind = F.when(sanma, F.get(lit_array(dims.WINDS), F.pmod(rel, F.lit(3)).cast("int"))) \
        .otherwise(F.get(lit_array(dims.WINDS), F.pmod(rel, F.lit(4)).cast("int")))
    out.append(pair("seat_wind_self", wind, (hero >= 0) & (oya >= 0)))
    return F.filter(F.array(*out), lambda p: p.isNotNull())


def label_rows(states: DataFrame, keep: list[str], zones: list[str]) -> DataFrame:
    """Label rows of a frame: hand, indicators, scores and round texts.

    Input: ``keep``, ``hand, drawn, dora, scores, hero, bakaze, kyoku, honba, kyotaku, region``.
    A hand shows when it is settled (size mod 3 = 1) or its draw is tracked.
    """
    hand, drawn = F.col("hand"), F.col("drawn")
    tracked = drawn.isNotNull() & (drawn != "?") & F.array_contains(hand, drawn)
    known = (F.col("hero") >= 0) & (F.size(hand) > 0) & ~F.array_contains(hand, "?")
    row = "array<struct<zone: string, idx: int, label: string, kind: string, box: struct<x0: double, y0: double, x1: double, y1: double>>>"

    def made(zone: str, i: Column, label: Column, kind: str, box: Column) -> Column:
        return F.struct(F.lit(zone).alias("zone"), i.cast("int").alias("idx"), label.cast("string").alias("label"),
                        F.lit(kind).alias("kind"), box.alias("box"))

    def run(tiles: Column) -> Column:
        return F.transform(tiles, lambda t, i: made("hand", i, t, "tile", hand_slot(i, F.lit(False))))

    rest = remove_one(hand, drawn)
    apart = F.array(made("hand", F.size(rest), drawn, "tile", hand_slot(F.size(rest), F.lit(True))))
    none = F.array().cast(row)
    parts = {"hand": F.when(known & tracked, F.concat(run(rest), apart)).when(known & (F.size(hand) % 3 == 1), run(hand)).otherwise(none)}
    parts["dora"] = F.transform(F.slice("dora", 1, dims.MAX_DORA), lambda d, i: made("dora", i, d, "tile", dora_slot(i)))

    def field(name: str) -> Column:
        x0, y0, x1, y1 = dims.FIELD_BOX_PX[name]
        return _norm_box(F.lit(x0 / dims.REF_W), F.lit(y0 / dims.REF_H), F.lit(x1 / dims.REF_W), F.lit(y1 / dims.REF_H))

    seen = ["score_self", "score_right", "score_across"]
    score = F.array(*[made("score", F.lit(i), F.get("scores", F.pmod(F.col("hero") + i, F.lit(4)).cast("int")), "text", field(n))
                      for i, n in enumerate(seen)])
    parts["score"] = F.when(F.col("hero") >= 0, score).otherwise(none)
    texts = [("bakaze", "round_wind"), ("kyoku", "round_number"), ("honba", "honba"), ("kyotaku", "riichi_sticks")]
    meta = F.array(*[made("meta", F.lit(i), F.col(c), "text", field(n)) for i, (c, n) in enumerate(texts)])
    parts["meta"] = F.when(F.col("bakaze").isNotNull(), meta).otherwise(none)
    rows = F.concat(*[F.coalesce(parts[z].cast(row), none) for z in zones])
    # the outer form keeps the rows from being built twice, once to see whether there are any
    d = states.select(*keep, "region", F.explode_outer(rows).alias("_r")).filter(F.col("_r").isNotNull()).select(*keep, "region", "_r.*")
    return d.withColumns({"px": norm_to_px(F.col("region"), F.col("box")),
                          "cls": F.when(F.col("kind") == "tile", class_id(F.col("label")))}).drop("region")


def flatten_boxes(records: DataFrame, keep: list[str]) -> DataFrame:
    """One row per tile box of an annotation record; ``reliable`` counts as true if absent."""
    row = ("struct<zone: string, tile: string, poly: array<struct<x: double, y: double>>, px_box: array<int>, "
           "sideways: boolean, reliable: boolean>")

    def flat(zone: str, boxes: Column, poly: str | None, px: str | None, side: str | None) -> Column:
        return F.transform(F.coalesce(boxes, F.array()), lambda b: F.struct(
            F.lit(zone).alias("zone"), b["tile"].alias("tile"), (b[poly] if poly else F.lit(None)).alias("poly"),
            (b[px] if px else F.lit(None)).alias("px_box"),
            (F.coalesce(b[side], F.lit(False)) if side else F.lit(False)).alias("sideways"),
            F.coalesce(b["reliable"], F.lit(True)).alias("reliable")).cast(row))

    def all_of(m: str) -> Column:
        return F.flatten(F.map_values(m))

    rows = F.concat(flat("river", all_of("discard_slots"), "face_poly", None, "riichi"),
                    flat("meld", all_of("meld_boxes"), "poly", None, "sideways"),
                    flat("oppback", all_of("back_boxes"), "poly", None, None),
                    flat("hand", F.col("hand_boxes"), None, "px_box", None),
                    flat("dora", F.col("dora_boxes"), None, "px_box", None))
    # the outer form keeps the rows from being built twice, once to see whether there are any
    d = records.select(*keep, F.posexplode_outer(rows).alias("box_id", "_b")).filter(F.col("_b").isNotNull())
    return d.select(*keep, "box_id", "_b.*")


def flatten_hud(records: DataFrame, keep: list[str]) -> DataFrame:
    """One row per HUD box; boxes without a place are dropped."""
    d = records.select(*keep, F.explode("hud_boxes").alias("_h")).select(*keep, "_h.*")
    return d.filter(F.col("px_box").isNotNull()).withColumn("reliable", F.coalesce("reliable", F.lit(True)))


def reader_crops(hud: DataFrame, w: Column, h: Column, pad: float = 0.15) -> DataFrame:
    """Padded, clipped crop rectangle and rotation of every readable HUD box."""
    b = {k: F.col(k).cast("double") for k in ("x0", "y0", "x1", "y1")}
    px, py = ((b["x1"] - b["x0"]) * pad).cast("int"), ((b["y1"] - b["y0"]) * pad).cast("int")
    d = hud.filter(F.col("reliable") & F.col("text").isNotNull() & F.col("text_reliable"))
    return d.withColumns({
        "cx0": F.greatest(F.lit(0), F.col("x0") - px), "cy0": F.greatest(F.lit(0), F.col("y0") - py),
        "cx1": F.least(w, F.col("x1") + px), "cy1": F.least(h, F.col("y1") + py),
        "rotation": F.coalesce(lit_map(dims.FIELD_ROTATION)[F.col("name")], F.lit(0))})


def tile_crops(boxes: DataFrame) -> DataFrame:
    """Boxes that yield a classifier crop: reliable, upright, not an opponent's row."""
    return boxes.filter(F.col("reliable") & ~F.col("sideways") & (F.col("zone") != "oppback"))


def observed_row(d: DataFrame) -> DataFrame:
    """P20: what the screen shows of a board state, seats counted from the hero.

    Input: ``hero, hand, drawn, dora`` and per-seat arrays ``rivers`` (visible tiles with
    ``pai, sideways``), ``melds`` (``type, tiles, called, added, from_seat``), ``reach`` and
    ``concealed``.  Side tiles are not melds; a reach shows by its sideways tile or its stick.
    """
    hero = F.col("hero")
    base = F.substring("drawn", 1, 2)
    hand = F.when(F.col("drawn").isNull(), F.col("hand")) \
        .when(F.array_contains("hand", F.col("drawn")), remove_one(F.col("hand"), F.col("drawn"))) \
        .when(F.col("drawn").endswith("r"), remove_one(F.col("hand"), base)).otherwise(F.col("hand"))
    rels = F.sequence(F.lit(0), F.lit(3))

    def at(name: str, r: Column) -> Column:
        return F.get(name, F.pmod(hero + r, F.lit(4)).cast("int"))

    melds = F.transform(rels, lambda r: F.transform(F.filter(at("melds", r), lambda m: m["type"] != "nukidora"), lambda m: F.struct(
        m["type"].alias("type"), m["tiles"].alias("tiles"), m["called"].alias("called"), m["added"].alias("added"),
        relative_seat(m["from_seat"], F.pmod(hero + r, F.lit(4))).alias("from_rel"))))
    reach = F.transform(rels, lambda r: at("reach", r) | F.exists(at("rivers", r), lambda t: t["sideways"]))
    concealed = F.transform(rels, lambda r: F.when(r > 0, at("concealed", r)))
    return d.withColumns({"o_hand": hand, "o_rivers": F.transform(rels, lambda r: at("rivers", r)), "o_melds": melds,
                          "o_reach": reach, "o_concealed": concealed})


def visible_tiles(hand: Column, rivers: Column, melds: Column) -> Column:
    """M9: the hero's hand, every visible river and every meld as one list."""
    return F.concat(hand, F.flatten(rivers), F.flatten(melds))
