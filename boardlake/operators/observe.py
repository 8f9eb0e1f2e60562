"""Raw detections of a screenshot to one observed board per frame (J5, W19-W22, J19, P14, P15, A21 as one flow).

A detection is placed by expressions of its own row: HUD, indicator strip, hand, river, meld strip, held for a row in the
corner of a wide frame, or dropped. Then the parts of a frame meet once; a row is as large as the frame it describes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import geometry as G
from ..functions.num import half_even_int
from ..session import stage
from .assemble import meld_hypotheses, parse_strips, route

SEATS = range(4)


def _by_seat(value, seat: Column | None = None) -> Column:
    """A fixed value that depends on the row's seat."""
    seat = F.col("seat") if seat is None else seat
    out = F.when(seat == 0, F.lit(float(value(0))))
    for s in (1, 2, 3):
        out = out.when(seat == s, F.lit(float(value(s))))
    return out


def _axes(mode: str, strip: bool) -> dict[str, Column]:
    """Origin and unit axes of the zone that a detection was routed to."""
    if strip:
        names = {"o": "corner", "u": "along", "v": "cross"}
        return {f"{k}{'xy'[i]}": _by_seat(lambda s, n=n, i=i: dims.STRIP[mode][s][n][i]) for k, n in names.items() for i in (0, 1)}
    return {f"{k}{'xy'[i]}": _by_seat(lambda s, k=k, i=i: G.river_axes(mode, s)[k][i]) for k in "ouv" for i in (0, 1)}


def place(dets: DataFrame, mode: str) -> DataFrame:
    """Adds ``part`` of each detection and where it lies in its zone, without a shuffle.

    Input: ``tile`` (null for a HUD class), ``x0, y0, x1, y1`` in pixels, ``region`` (as `geometry.board_region`), ``frame_w, frame_h``
    and, if there is one, ``quad`` (an oriented box in pixels). ``part``: hud, dora, hand, river, meld, corner (held for a row of indicators
    in a wide frame), stray, ignored, standing. ``seat``; ``u, v`` along and across the zone's axis; ``sideways``: the long edge runs along it.
    ``off`` is what a river's tile is away from its row, ``row`` the nearest one.
    """
    reg, back = F.col("region"), F.col("tile") == "back"
    axes, given = {"x": ("ox", "bw", dims.REF_W), "y": ("oy", "bh", dims.REF_H)}, "quad" in dets.columns
    # Corner by corner in plain columns: lambdas are interpreted, and structs are copied by every projection above them.
    corners = {f"{i}{a}": c for i, xy in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))) for a, c in zip("xy", xy)}
    px = {k: F.when(F.col("quad").isNull(), F.col(c)).otherwise(F.get("quad", F.lit(int(k[0])))[k[1]]) if given else F.col(c) for k, c in corners.items()}
    norm = lambda c, a: (c - reg[axes[a][0]]) / reg[axes[a][1]]
    d = dets.withColumns({f"_f{k}": norm(c, k[1]) * axes[k[1]][2] for k, c in px.items()} | {f"_n{c}": norm(F.col(c), c[0]) for c in ("x0", "y0", "x1", "y1")})
    moved = [G.project(G.point(F.col(f"_f{i}x"), F.col(f"_f{i}y")), G.table_matrices()["full"]) for i in SEATS]
    d = d.withColumns({f"_q{i}{a}": moved[i][a] for i in SEATS for a in "xy"} | {
        "_ncx": (F.col("_nx0") + F.col("_nx1")) / 2, "_ncy": (F.col("_ny0") + F.col("_ny1")) / 2, "_nh": F.col("_ny1") - F.col("_ny0")})
    quad = F.array(*[G.point(F.col(f"_q{i}x"), F.col(f"_q{i}y")) for i in SEATS])
    c = G.center(quad)
    d = route(d.drop("quad", *[f"_f{k}" for k in px]).withColumns({"x": c["x"], "y": c["y"]}), mode, quad)
    ncx, ncy = F.col("_ncx"), F.col("_ncy")
    sx0, sy0, sx1, sy1 = dims.DORA_STRIP
    above = ncx.between(sx0, sx1) & ncy.between(sy0, sy1)
    upright = ~back & (F.col("_nh") >= dims.HAND_MIN_H) & (ncy >= dims.HAND_Y0 - dims.HAND_SLACK)
    wide_x, wide_y = dims.WIDE_CORNER
    corner = (reg["ox"] > 0) & ((F.col("x0") + F.col("x1")) / 2 < wide_x * F.col("frame_w")) & ((F.col("y0") + F.col("y1")) / 2 < wide_y * F.col("frame_h"))
    part = (F.when(F.col("tile").isNull(), "hud").when(above, F.when(back, "ignored").otherwise("dora")).when(upright, "hand")
            .when(F.col("fate") == "kept", F.col("kind")).when((F.col("fate") == "stray") & corner, "corner").otherwise(F.col("fate")))
    river, strip = _axes(mode, False), _axes(mode, True)
    d = d.withColumn("part", part).withColumns({f"_{k}": F.when(F.col("kind") == "meld", strip[k]).otherwise(river[k]) for k in river})
    dx, dy = F.col("x") - F.col("_ox"), F.col("y") - F.col("_oy")
    d = d.withColumns({"u": dx * F.col("_ux") + dy * F.col("_uy"), "v": dx * F.col("_vx") + dy * F.col("_vy"),
                       "sideways": G.long_edge_along(quad, F.col("_ux"), F.col("_uy"), F.col("_vx"), F.col("_vy"))})
    offs = [F.col("v") - _by_seat(lambda s, r=r: G.river_axes(mode, s)["offs"][r]) for r in range(3)]
    near = F.least(*[F.abs(o) for o in offs])
    d = d.withColumn("row", F.when(F.abs(offs[0]) == near, 0).when(F.abs(offs[1]) == near, 1).otherwise(2))
    d = d.withColumn("off", F.when(F.col("row") == 0, offs[0]).when(F.col("row") == 1, offs[1]).otherwise(offs[2]))
    d = d.withColumn("quad", quad)
    return d.drop("kind", "fate", *[f"_{k}" for k in river], *[c for c in d.columns if c[:2] in ("_n", "_q")])


def _text(c: Column) -> Column:
    return half_even_int(c).cast("string")


def _river_said(mode: str, seat: int) -> Column:
    """What is wrong with a seat's river. ``_good{seat}, _bad{seat}`` are its tiles in reading order, ``_line{seat}{r}`` the good ones of a row."""
    axes = G.river_axes(mode, seat)
    pitch, name = axes["pitch"], f"seat{seat} river "
    said = [F.transform(f"_bad{seat}", lambda t: F.concat(F.lit(f"{name}det off-grid (row residual "), _text(t["off"]), F.lit("px)")))]

    def hole(r: int):
        return lambda g: F.concat(F.lit(f"{name}row{r} hole (gap "), _text(g), F.lit("px)"))

    for r in range(3):
        row = F.col(f"_line{seat}{r}")
        n, first = F.size(row), F.get(row, F.lit(0))["at"]
        if r:
            before = F.size(f"_line{seat}{r - 1}")
            said.append(F.array(F.when((n > 0) & (before != dims.GRID_COLS), F.lit(f"{name}row{r} occupied but row{r - 1} not full"))))
        if r < 2:
            said.append(F.array(F.when(n > dims.GRID_COLS, F.concat(F.lit(f"{name}row{r} has "), n.cast("string"), F.lit(">6 tiles")))))
        said.append(F.array(F.when(F.abs(first) > 0.6 * pitch, F.concat(F.lit(f"{name}row{r} starts off-origin ("), _text(first), F.lit("px)")))))
        gaps = F.zip_with(F.slice(row, 2, F.greatest(n, F.lit(1))), F.slice(row, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b["at"] - a["at"])
        said.append(F.transform(F.filter(gaps, lambda g: g > 1.5 * pitch), hole(r)))
    return _unless_empty(f"_river{seat}", F.array_compact(F.concat(*said)), "array<string>")


def _unless_empty(tiles: str, value: Column, kind: str) -> Column:
    """Most zones of a frame hold nothing, and what reads a zone is interpreted."""
    return F.when(F.size(tiles) == 0, F.array().cast(kind)).otherwise(value)


def _cells(mode: str, seat: int) -> Column:
    """W20 inside a frame: a seat's strip from its corner, tiles that share a slot stacked."""
    near = 0.4 * dims.STRIP[mode][seat]["w"]
    kind = "array<struct<a: double, c: double, first: string, label: string, sideways: boolean, stacked: string>>"

    def step(acc: Column, t: Column) -> Column:
        head = F.get(acc, F.size(acc) - 1)
        up = t["off"] > head["c"]
        joined = F.struct(head["a"].alias("a"), head["c"].alias("c"), head["first"].alias("first"), F.when(up, head["first"]).otherwise(t["tile"]).alias("label"),
                          F.lit(True).alias("sideways"), F.when(up, t["tile"]).otherwise(head["first"]).alias("stacked"))
        own = F.struct(t["at"].alias("a"), t["off"].alias("c"), t["tile"].alias("first"), t["tile"].alias("label"), t["sideways"].alias("sideways"), F.lit(None).cast("string").alias("stacked"))
        joins = F.coalesce(t["at"] - head["a"] < near, F.lit(False))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(own))).cast(kind)

    cells = F.transform(F.aggregate(f"_meld{seat}", F.array().cast(kind), step), lambda c: F.struct(c["label"].alias("label"), c["sideways"].alias("sideways"), c["stacked"].alias("stacked")))
    return _unless_empty(f"_meld{seat}", cells, "array<struct<label: string, sideways: boolean, stacked: string>>")


def _middle(values: Column) -> Column:
    n, v = F.size(values), F.array_sort(values)
    return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2


def observe(dets: DataFrame, frame: str, det_id: str, mode: str) -> DataFrame:
    """One row per frame: ``o_hand, drawn, dora, o_rivers, o_melds, o_reach, strips, confidence, strays, unread, problems``.

    Input as `place`, with a frame key, a unique ``det_id`` (ties in place go by it) and ``score``. Rivers and sets are arrays by seat,
    ``strips`` the cells that sets were read from, ``unread`` why a seat's strip has no sets, ``confidence`` the lowest score per zone, ``strays`` what could
    not be placed, ``problems`` all that could not be placed or read, in order of seats.
    `gates.check_observed` tells what a readable board breaks; the HUD's fields come from `assemble.assemble_hud`. Frames without
    any detection have no row. A column that the caller does not take is not computed.
    """
    p, part, seat, zero = place(dets, mode), F.col("part"), F.col("seat"), F.lit(0.0)
    corner, on_table = part == "corner", part.isin("river", "meld")
    kind = F.when(part == "hand", 0).when(part == "dora", 1).when(corner, 2).when(part == "river", 3).when(part == "meld", 4).when(part == "stray", 5)
    nx = (F.col("x0") - F.col("region.ox")) / F.col("region.bw")
    at = F.when(part.isin("hand", "dora"), nx).when(corner, (F.col("x0") + F.col("x1")) / 2).when(on_table, F.col("u")).otherwise(zero)
    off = F.when(part == "river", F.col("off")).when(part == "meld", F.col("v")).when(corner, (F.col("y0") + F.col("y1")) / 2).when(part == "stray", F.col("dist"))
    lies = F.when(on_table, F.col("sideways"))
    tile = F.struct(kind.alias("kind"), F.when(on_table, seat).otherwise(0).alias("seat"), F.when(part == "river", F.col("row")).otherwise(0).alias("row"), at.alias("at"),
                    F.col(det_id).alias("id"), F.col("tile").alias("tile"), lies.alias("sideways"), off.alias("off"),
                    F.when(corner, F.col("y1") - F.col("y0")).alias("h"), F.when(corner, F.col("score")).alias("score"))
    zones = ["dora", "hand", "hud", *[f"{k}{s}" for k in ("meld", "river") for s in SEATS]]  # in order of names
    zone = F.when(part == "dora", 0).when(part == "hand", 1).when(part == "hud", 2).when(part == "meld", 3 + seat).when(part == "river", 7 + seat)
    p = p.select(frame, "score", zone.alias("_zone"), F.when(kind.isNotNull(), tile).alias("_tile"))
    # A frame's boxes meet once, in one list that is sorted by kind, seat, row and place.
    g = p.groupBy(frame).agg(F.sort_array(F.collect_list("_tile")).alias("_all"), *[F.min(F.when(F.col("_zone") == i, F.col("score"))).alias(f"_s_{z}") for i, z in enumerate(zones)])
    of = lambda i, s=0: F.filter("_all", lambda t: (t["kind"] == i) & (t["seat"] == s))
    g = g.withColumns({f"_meld{s}": of(4, s) for s in SEATS}).withColumns({f"_strip{s}": _cells(mode, s) for s in SEATS})
    g = stage(g.drop(*[f"_meld{s}" for s in SEATS]), "frames")  # read by the strips and by the frames
    g = g.withColumns({"_hand": of(0), "_dora": of(1), "_corner": of(2), "_stray": of(5)} | {f"_river{s}": of(3, s) for s in SEATS})
    names = lambda a: F.transform(a, lambda t: t["tile"])
    n = F.size("_hand")
    apart = (n >= 2) & (F.get("_hand", n - 1)["at"] - F.get("_hand", n - 2)["at"] > dims.HAND_W + 0.5 * dims.HAND_GAP)
    g = g.withColumn("_apart", F.coalesce(apart, F.lit(False)))
    # Indicators that a wide frame shows in its corner form one row.
    mid, tall = _middle(F.transform("_corner", lambda t: t["off"])), _middle(F.transform("_corner", lambda t: t["h"]))
    held = F.size("_corner") > 0
    g = g.withColumns({"_mid": F.when(held, mid), "_tall": F.when(held, tall)})
    in_row = lambda t: F.abs(t["off"] - F.col("_mid")) < 0.6 * F.col("_tall")
    g = g.withColumns({"_row": F.filter("_corner", in_row), "_loose": F.filter("_corner", lambda t: ~in_row(t))})
    g = g.withColumn("_s_dora", F.least("_s_dora", F.array_min(F.transform("_row", lambda t: t["score"]))))
    limit = [0.5 * (o[1] - o[0]) for o in (G.river_axes(mode, s)["offs"] for s in SEATS)]
    good = lambda s: lambda t: F.abs(t["off"]) <= limit[s]
    bad = lambda s: lambda t: F.abs(t["off"]) > limit[s]
    line = lambda r: lambda t: t["row"] == r
    g = g.withColumns({f"_good{s}": F.filter(f"_river{s}", good(s)) for s in SEATS} | {f"_bad{s}": F.filter(f"_river{s}", bad(s)) for s in SEATS})
    g = g.withColumns({f"_line{s}{r}": F.filter(f"_good{s}", line(r)) for s in SEATS for r in range(3)})
    river = lambda s: F.transform(f"_good{s}", lambda t: F.struct(t["tile"].alias("pai"), t["sideways"].alias("sideways")))
    # Sets have three cells at least; shorter strips are told without being read.
    cells = [F.struct(F.lit(s).alias("seat"), F.col(f"_strip{s}").alias("cells")) for s in SEATS]
    strips = g.select(frame, F.explode(F.filter(F.array(*cells), lambda c: F.size(c["cells"]) >= 3)).alias("_c")).select(frame, "_c.*")
    read = parse_strips(strips, [frame, "seat"], meld_hypotheses(dets.sparkSession))
    read = read.groupBy(frame).agg(*[F.max(F.when(F.col("seat") == s, F.struct("melds", "problem"))).alias(f"_m{s}") for s in SEATS])
    no_sets = F.array().cast(read.schema["_m0"].dataType["melds"].dataType)
    g = g.join(read, frame, "left")
    unread = lambda s: F.when(F.size(f"_strip{s}").between(1, 2), F.lit("unparsable")).otherwise(F.col(f"_m{s}.problem"))
    wrong = [F.concat(_river_said(mode, s), F.array_compact(F.array(F.when(unread(s).isNotNull(), F.concat(F.lit(f"seat{s} meld strip "), unread(s)))))) for s in SEATS]
    strays = F.transform("_stray", lambda t: F.concat(F.lit("stray detection "), t["tile"], F.lit(" ("), _text(t["off"]), F.lit("px off-zone)")))
    loose = F.transform("_loose", lambda t: F.concat(F.lit("stray detection "), t["tile"], F.lit(" (off dora row)")))
    conf = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(z).alias("zone"), F.col(f"_s_{z}").alias("s")) for z in zones]), lambda e: e["s"].isNotNull()))
    return g.select(
        frame, names(F.when(F.col("_apart"), F.slice("_hand", 1, F.greatest(n - 1, F.lit(0)))).otherwise(F.col("_hand"))).alias("o_hand"),
        F.when(F.col("_apart"), F.get("_hand", n - 1)["tile"]).alias("drawn"), F.concat(names(F.col("_dora")), names(F.col("_row"))).alias("dora"),
        F.array(*[river(s) for s in SEATS]).alias("o_rivers"),
        F.array(*[F.coalesce(f"_m{s}.melds", no_sets) for s in SEATS]).alias("o_melds"),
        F.array(*[F.exists(f"_good{s}", lambda t: t["sideways"]) for s in SEATS]).alias("o_reach"),
        F.array(*[F.col(f"_strip{s}") for s in SEATS]).alias("strips"), conf.alias("confidence"), F.concat(strays, loose).alias("strays"),
        F.array(*[unread(s) for s in SEATS]).alias("unread"), F.concat(strays, loose, *wrong).alias("problems"))
