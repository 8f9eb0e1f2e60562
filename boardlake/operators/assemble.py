"""Detections to an observed board: routing, duplicates, rivers, strips, HUD
(J5, J6, J19, W19-W23, P14, P15, A21)."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.geometry import box_cols, corners, iou, river_axes, river_distance, strip_distance
from ..functions.tiles import lit_array
from ..session import stage
from .layout import meld_cells
from .ordered import Run, greedy_islands, group_quantiles, scan

# --- J5 ---------------------------------------------------------------------------------


def route(dets: DataFrame, mode: str, quad: Column | None = None) -> DataFrame:
    """Closest of the eight zones of each table detection, and its fate.

    Input: ``x, y`` (centre), ``tile`` and ``quad`` (a column, or given as an expression).  A tile back only fits meld strips; the first zone
    wins ties, seats in order, river before strip.  Fates: ``kept``; ``stray`` (too far from any
    zone); ``ignored`` (a stray back, which is expected); ``standing`` (an upright back of an
    opponent's hand that reached a strip).  The eight distances are plain expressions of the
    row, so no join is needed.
    """
    x, y, back = F.col("x"), F.col("y"), F.col("tile") == "back"
    quad = F.col("quad") if quad is None else quad
    far = {}
    for s in range(4):
        far[f"_d{2 * s}"] = F.when(~back, river_distance(x, y, mode, s)).otherwise(F.lit(1e18))
        far[f"_d{2 * s + 1}"] = strip_distance(x, y, mode, s)
    d = dets.withColumns(far).withColumn("dist", F.least(*far))
    zone = F.lit(7)
    for i in range(6, -1, -1):
        zone = F.when(F.col(f"_d{i}") == F.col("dist"), i).otherwise(zone)
    d = d.withColumn("_zone", zone)
    seat, strip = F.floor(F.col("_zone") / 2).cast("int"), F.col("_zone") % 2 == 1
    upright = F.lit(False)
    for s in (1, 2, 3):
        cfg = dims.STRIP[mode][s]
        ax = cfg["along"] if s in (1, 3) else cfg["cross"]
        upright = upright | ((seat == s) & (_reach(quad, ax) > 1.15 * cfg["d"]))
    fate = (F.when(F.col("dist") > dims.ZONE_LIMIT, F.when(back, "ignored").otherwise("stray"))
            .when(back & strip & upright, "standing").otherwise("kept"))
    return d.withColumns({"kind": F.when(strip, "meld").otherwise("river"), "seat": seat, "fate": fate}).drop("_zone", *far)


def _reach(quad: Column, axis: tuple[float, float]) -> Column:
    """Extent of the quad along an axis."""
    along = [a * axis[0] + b * axis[1] for a, b in zip(corners(quad, "x"), corners(quad, "y"))]
    return F.greatest(*along) - F.least(*along)


# --- J6 ---------------------------------------------------------------------------------

FOLD_LIMIT = 512  # boxes of one frame that are compared inside one row


def dedup_overlaps(dets: DataFrame, frame: str, det_id: str, limit: float = dims.OVERLAP_IOU,
                   fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Of boxes that overlap by at least ``limit``, keep the better one, whatever the class.

    Boxes are visited from the best score down (``det_id`` breaks ties, then the other columns) and kept unless they
    overlap one that is already kept.  Every row is judged by itself, so a ``det_id`` may come twice.
    Identical boxes collapse before anything is gathered.  Frames of usual size are folded in one row each;
    larger ones are settled in rounds on a grid, so no frame has to fit into one task.
    """
    cols, box = dets.columns, ["x0", "y0", "x1", "y1"]
    solid = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    more = [c for c in cols if c not in (frame, det_id, "score", *box)]
    pr = F.struct((-F.col("score")).alias("s"), F.col(det_id).alias("i"), *box, *more)
    best = dets.filter(solid).groupBy(frame, *box).agg(F.min(pr).alias("pr"))
    sizes = best.groupBy(frame).agg(F.count(F.lit(1)).alias("_n"))
    big = sizes.filter(F.col("_n") > fold_limit).select(frame)
    if big.isEmpty():
        kept = _fold(best, frame, limit)
    else:
        kept = _fold(best.join(big, frame, "left_anti"), frame, limit).unionByName(
            _settle(best.join(big, frame, "left_semi"), frame, limit))
    back = {frame: F.col(frame), det_id: F.col("pr.i"), "score": -F.col("pr.s")} | {c: F.col("pr")[c] for c in (*box, *more)}
    return kept.select(*[back[c].alias(c) for c in cols]).unionByName(dets.filter(~solid).select(*cols))


def _fold(best: DataFrame, frame: str, limit: float) -> DataFrame:
    d = best.groupBy(frame).agg(F.array_sort(F.collect_list("pr")).alias("_all"))
    none = F.slice("_all", 1, 0)

    def fields(c: Column) -> dict[str, Column]:
        return {k: c[k] for k in ("x0", "y0", "x1", "y1")}

    kept = F.aggregate("_all", none, lambda acc, b: F.when(
        F.exists(acc, lambda k: iou(fields(k), fields(b)) >= limit), acc).otherwise(F.concat(acc, F.array(b))))
    return d.select(frame, F.explode(kept).alias("pr"))


def _settle(best: DataFrame, frame: str, limit: float, prefix: int = FOLD_LIMIT) -> DataFrame:
    """Frames too large for one row, settled in rounds.

    A round first visits the best ``prefix`` undecided boxes of each frame in order, then keeps
    every box that is the best of its whole neighbourhood, and after each step drops what
    overlaps the kept ones.  The first step clears crowded places, the second works on all
    places at once; both only keep what the plain order would keep.  Boxes that overlap enough
    have similar size and nearby corners, so each box sits in one grid cell (by size class and
    corner) and a kept box looks only into the cells such a partner can be in.
    """
    t = limit
    m = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    box = ["x0", "y0", "x1", "y1"]

    def cell(size_class: Column, v: Column) -> Column:
        return F.floor(v / ((1 - t) * F.pow(F.lit(2.0), size_class + 1))).cast("long")

    und = best.withColumn("_lv", F.floor(F.log2(m)).cast("int"))
    und = und.withColumns({"_cx": cell(F.col("_lv"), F.col("x0")), "_cy": cell(F.col("_lv"), F.col("y0"))})
    und = stage(und.select(frame, "pr", *box, "_lv", "_cx", "_cy"), "boxes")
    here = [frame, "_lv", "_cx", "_cy"]

    def looks(d: DataFrame) -> DataFrame:
        e = d.select(frame, F.col("pr").alias("_pr"), m.alias("_m"), *[F.col(c).alias(f"_{c}") for c in box])
        lo, hi = F.floor(F.log2(F.col("_m") * t)).cast("int"), F.floor(F.log2(F.col("_m") / t)).cast("int")
        e = e.withColumn("_lv", F.explode(F.sequence(lo, hi)))
        r = (1 - t) * F.greatest(F.col("_m"), F.least(F.col("_m") / t, F.pow(F.lit(2.0), F.col("_lv") + 1)))
        e = e.withColumn("_r", r)
        for axis, name in (("_x0", "_cx"), ("_y0", "_cy")):
            e = e.withColumn(name, F.explode(F.sequence(cell(F.col("_lv"), F.col(axis) - F.col("_r")),
                                                        cell(F.col("_lv"), F.col(axis) + F.col("_r")))))
        return e

    def without(d: DataFrame, decided: DataFrame, keep: DataFrame) -> DataFrame:
        near = d.join(looks(keep), here).filter(iou(box_cols("_"), box_cols()) >= t).select(frame, "pr")
        out = near.unionByName(decided.select(frame, "pr")).distinct()
        return stage(d.join(out, [frame, "pr"], "left_anti").select(*d.columns), "undecided")

    kept = None
    while True:
        order = Window.partitionBy(frame).orderBy("pr")
        first = stage(und.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= prefix).drop("_n"), "first")
        if first.isEmpty():
            return kept
        won = stage(first.join(_fold(first, frame, t), [frame, "pr"], "left_semi").select(*first.columns), "won")
        kept = won.select(frame, "pr") if kept is None else kept.unionByName(won.select(frame, "pr"))
        und = without(und, first, won)
        tops = und.groupBy(*here).agg(F.min("pr").alias("_top"))
        heads = und.join(tops, here).filter(F.col("pr") == F.col("_top")).drop("_top")
        rule = looks(heads).join(tops, here).groupBy(frame, "_pr").agg(F.min("_top").alias("_top"))
        rule = rule.filter(F.col("_pr") == F.col("_top")).select(frame, F.col("_pr").alias("pr"))
        won = stage(heads.join(rule, [frame, "pr"], "left_semi").select(*und.columns), "won")
        kept = kept.unionByName(won.select(frame, "pr"))
        und = without(und, won, won)


# --- W19 --------------------------------------------------------------------------------


def river_rows(dets: DataFrame, keys: list[str], mode: str, seat: str = "seat") -> DataFrame:
    """Row, order and offset of each river detection.

    Input: ``keys`` (with the seat), ``x, y`` and a unique ``det_id``.  ``off_grid`` marks
    detections too far from any row; they take no place in the order.
    """
    axes = {c: None for c in ("ox", "oy", "ux", "uy", "vx", "vy", "o0", "o1", "o2", "pitch")}
    for s in range(4):
        r = river_axes(mode, s)
        vals = dict(zip(axes, (*r["o"], *r["u"], *r["v"], *r["offs"], r["pitch"])))
        for c, v in vals.items():
            hit = F.col(seat) == s
            axes[c] = F.when(hit, F.lit(float(v))) if axes[c] is None else axes[c].when(hit, F.lit(float(v)))
    d = dets.withColumns({f"_{c}": v for c, v in axes.items()})
    dx, dy = F.col("x") - F.col("_ox"), F.col("y") - F.col("_oy")
    d = d.withColumns({"u": dx * F.col("_ux") + dy * F.col("_uy"), "_v": dx * F.col("_vx") + dy * F.col("_vy")})
    d = d.withColumns({f"_r{i}": F.abs(F.col("_v") - F.col(f"_o{i}")) for i in range(3)})
    best = F.least("_r0", "_r1", "_r2")
    d = d.withColumns({"row": F.when(F.col("_r0") == best, 0).when(F.col("_r1") == best, 1).otherwise(2),
                       "off_grid": best > 0.5 * (F.col("_o1") - F.col("_o0")), "pitch": F.col("_pitch")})
    d = d.drop(*[f"_{c}" for c in axes], "_v", "_r0", "_r1", "_r2")
    good = ~F.col("off_grid")
    runs = [Run("pos_in_row", "sum", F.when(good, 1).otherwise(0)), Run("_prev", "last", F.when(good, F.col("u")), inclusive=False)]
    d = scan(d, keys + ["row"], ["u", "det_id"], runs, F.floor(F.col("u") / 16))
    gap = F.when(good, F.col("u") - F.col("_prev"))
    return d.withColumn("gap", gap).drop("_prev")


def river_checks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counted complaints per river: off_grid, not_full, too_many, off_origin, hole."""
    good = ~F.col("off_grid")
    aggs = [F.count_if(F.col("off_grid")).alias("off_grid"), F.max("pitch").alias("_p")]
    for r in range(3):
        here = good & (F.col("row") == r)
        aggs += [F.count_if(here).alias(f"_n{r}"), F.min(F.when(here, F.col("u"))).alias(f"_u{r}")]
    aggs.append(F.count_if(F.col("gap") > 1.5 * F.col("pitch")).alias("hole"))
    d = rows.groupBy(*keys).agg(*aggs)
    n = [F.col(f"_n{r}") for r in range(3)]
    as_int = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    return d.select(
        *keys, "off_grid",
        (as_int((n[1] > 0) & (n[0] != dims.GRID_COLS)) + as_int((n[2] > 0) & (n[1] != dims.GRID_COLS))).alias("not_full"),
        (as_int(n[0] > dims.GRID_COLS) + as_int(n[1] > dims.GRID_COLS)).alias("too_many"),
        sum((as_int(F.abs(F.col(f"_u{r}")) > 0.6 * F.col("_p")) for r in range(1, 3)), as_int(F.abs(F.col("_u0")) > 0.6 * F.col("_p"))).alias("off_origin"),
        "hole")


# --- W20 --------------------------------------------------------------------------------


def strip_cells(dets: DataFrame, keys: list[str], width) -> DataFrame:
    """Merge strip detections that share a slot into one cell.

    Input: ``keys``, ``a`` (along), ``c`` (across), ``label, sideways`` and ``det_id``.
    A detection closer than 0.4 tile widths to the cell's first one joins it; the higher of the
    two is stacked on the lower, and the last to join decides.  Rows of a cell with the first one's
    ``det_id`` are that detection again: its largest values hold.  Which cell a place falls into
    depends on places alone, so only distinct places are walked.
    """
    near = 0.4 * width
    places = dets.groupBy(*keys, "a").agg(F.min("det_id").alias("_first")).withColumn("_at", F.col("a"))
    cut = greedy_islands(places, keys, "a", "_at", near, near, F.floor(F.col("a") / 16))
    heads = F.max(F.when(F.col("is_head"), F.col("_first"))).over(Window.partitionBy(*keys, "head_no"))
    cut = cut.select(*keys, "a", "head_no", heads.alias("_head"))
    again = F.col("det_id") == F.col("_head")
    cells = dets.join(cut, [*keys, "a"]).groupBy(*keys, "head_no").agg(
        *[F.max(F.when(again, F.col(c))).alias(f"h_{c}") for c in ("a", "c")], F.max(F.when(again, F.struct("label", "sideways"))).alias("h"),
        F.max(F.when(~again, F.struct("a", "det_id", "c", "label", "sideways"))).alias("j"))
    up = F.col("j.c") > F.col("h_c")
    alone = F.col("j").isNull()
    return cells.select(
        *keys, (F.col("head_no") - 1).alias("idx"), F.col("h_a").alias("a"),
        F.when(alone | up, F.col("h.label")).otherwise(F.col("j.label")).alias("label"),
        F.when(alone, F.col("h.sideways")).otherwise(True).alias("sideways"),
        F.when(alone, F.lit(None)).when(up, F.col("j.label")).otherwise(F.col("h.label")).alias("stacked"))


# --- J19 --------------------------------------------------------------------------------


def meld_hypotheses(spark: SparkSession) -> DataFrame:
    """Every meld a group of cells can mean, made by rule, with the cells it is drawn as."""
    def variants(base: str, n: int):
        kinds = [base, base + "r"] if base[0] == "5" and len(base) == 2 else [base]
        return [sorted(c) for c in combinations_with_replacement(kinds, n)]

    bases = [t for t in dims.TILES if t not in dims.RED_FIVES and t != "back"]
    rows = []
    for b in bases:
        five = b[0] == "5" and len(b) == 2
        rows.append(("ankan", sorted([b + "r"] + [b] * 3) if five else [b] * 4, "", "", 0))
        for rel in (1, 2, 3):
            for mtype, n in (("daiminkan", 4), ("pon", 3)):
                rows += [(mtype, v, c, "", rel) for v in variants(b, n) for c in sorted(set(v))]
            rows += [("kakan", sorted(v + [add]), c, add, rel) for v in variants(b, 3) for c in sorted(set(v))
                     for add in variants(b, 1)[0] + (variants(b, 1)[1] if five else [])]
    for suit in "mps":
        for r in range(1, 8):
            forms = [[]]
            for x in range(r, r + 3):
                names = [f"{x}{suit}"] + ([f"5{suit}r"] if x == 5 else [])
                forms = [f + [n] for f in forms for n in names]
            rows += [("chi", sorted(f), c, "", 3) for f in forms for c in f]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                              "hyp int, type string, tiles array<string>, called string, added string, rel int")
    cells = meld_cells(F.col("type"), F.col("tiles"), F.col("called"), F.col("added"), F.col("rel"))
    d = d.withColumn("sig", F.concat_ws(" ", F.transform(cells, _cell_text)))
    first = d.groupBy("sig").agg(F.min("hyp").alias("hyp"))
    return d.join(first, ["sig", "hyp"]).withColumn("size", F.size(F.split("sig", " ")))


def _cell_text(c: Column) -> Column:
    return F.concat(c["label"], F.when(c["sideways"], "-").otherwise(""), F.coalesce(F.concat(F.lit("+"), c["stacked"]), F.lit("")))


def parse_strips(strips: DataFrame, keys: list[str], hypotheses: DataFrame) -> DataFrame:
    """Read each strip as melds whose drawing equals its cells.

    Input: ``keys`` and ``cells`` (array of label/sideways/stacked in corner order; a strip's
    cells are spaced apart along a line of fixed length, so the array is short).  All ways to
    cut the strip into groups of four and three are counted; only a single way is accepted,
    otherwise ``melds`` is null and ``problem`` says why.
    """
    texts = strips.select(*keys, F.transform("cells", _cell_text).alias("_t"))
    texts = texts.withColumn("_n", F.size("_t"))
    starts = texts.filter(F.col("_n") >= 3).select(*keys, "_n", "_t", F.explode(F.sequence(F.lit(0), F.col("_n") - 3)).alias("_i"))
    cuts = starts.withColumn("size", F.explode(F.array(F.lit(4), F.lit(3)))).filter(F.col("_i") + F.col("size") <= F.col("_n"))
    cuts = cuts.withColumn("sig", F.concat_ws(" ", F.slice("_t", F.col("_i") + 1, F.col("size"))))
    hyp = F.broadcast(hypotheses.select("sig", F.struct("type", "tiles", "called", "added", "rel").alias("meld")))  # made by rule, about 1,400 rows
    edges = cuts.join(hyp, "sig").groupBy(*keys).agg(
        F.collect_list(F.struct((F.col("_i") + F.col("size")).alias("to"), F.col("_i").alias("at"), "meld")).alias("_e"))
    d = texts.join(edges, keys, "left")
    path = "struct<ways: int, melds: array<struct<type: string, tiles: array<string>, called: string, added: string, rel: int>>>"
    zero = F.struct(F.lit(1).alias("ways"), F.array().alias("melds")).cast(path)
    none = F.struct(F.lit(0).alias("ways"), F.array().alias("melds")).cast(path)

    def step(acc: Column, j: Column) -> Column:
        into = F.filter(F.coalesce("_e", F.array().cast(edges.schema["_e"].dataType)), lambda e: (e["to"] == j) & (acc[e["at"]]["ways"] > 0))
        ways = F.least(F.lit(2), F.aggregate(into, F.lit(0), lambda s, e: s + acc[e["at"]]["ways"]))
        e0 = F.get(into, F.lit(0))
        node = F.struct(ways.alias("ways"), F.concat(acc[e0["at"]]["melds"], F.array(e0["meld"])).alias("melds")).cast(path)
        return F.concat(acc, F.array(F.when(F.size(into) > 0, node).otherwise(none)))

    table = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_n"))), F.array(zero), step)
    d = d.withColumn("_end", F.get(table, F.col("_n")))
    ok = F.col("_end.ways") == 1
    return d.select(*keys, F.when(ok, F.col("_end.melds")).alias("melds"), F.when(ok, F.lit(None)).when(F.col("_end.ways") > 1, "ambiguous")
                    .otherwise("unparsable").alias("problem"))


# --- W21, W22, W23 ----------------------------------------------------------------------


def hand_row(dets: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Hand tiles by x; the last one is the drawn tile if it stands apart.

    Input: ``keys``, ``x0`` and a unique ``det_id``.
    """
    d = scan(dets, keys, ["x0", "det_id"], [Run("slot", "sum", F.lit(1)), Run("_n", "total", F.lit(1)),
                                            Run("_prev", "last", F.col("x0"), inclusive=False)], F.floor(F.col("x0") / 16))
    last = (F.col("slot") == F.col("_n")) & (F.col("_n") >= 2)
    apart = F.coalesce(last & (F.col("x0") - F.col("_prev") > gap), F.lit(False))
    return d.withColumns({"slot": F.col("slot") - 1, "drawn": apart}).drop("_n", "_prev")


def row_rescue(dets: DataFrame, keys: list[str], width: float = 16.0) -> DataFrame:
    """Which held detections form one row: within 0.6 median heights of the median y.

    Input: ``keys``, ``cx, cy, h``.
    """
    chunk = lambda c: F.floor(F.col(c) / width)
    my = group_quantiles(dets, keys, "cy", {"med_y": 0.5}, chunk("cy"))
    mh = group_quantiles(dets, keys, "h", {"med_h": 0.5}, chunk("h"))
    d = dets.join(my, keys).join(mh, keys)
    return d.withColumn("in_row", F.abs(F.col("cy") - F.col("med_y")) < 0.6 * F.col("med_h"))


def best_path(steps: DataFrame, keys: list[str], step: str, cls: str, score: str, alphabet: str, chunk: Column) -> DataFrame:
    """Best class per step, repeats collapsed, blanks (class 0) dropped, read as text.

    Input rows are (keys, step, class, score); the lower class wins ties.
    """
    best = steps.groupBy(*keys, step).agg(F.max(F.struct(score, (-F.col(cls)).alias("_c"))).alias("_b"))
    best = best.select(*keys, step, (-F.col("_b._c")).alias(cls))
    d = scan(best, keys, [step], [Run("_prev", "last", F.col(cls), inclusive=False)], chunk)
    kept = d.filter((F.col(cls) != 0) & ~F.col(cls).eqNullSafe(F.col("_prev")))
    chars = lit_array(list(alphabet))
    text = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.get(chars, (F.col(cls) - 1).cast("int")).alias("t")))).alias("_t"))
    text = text.select(*keys, F.array_join(F.transform("_t", lambda x: x["t"]), "").alias("text"))
    return best.select(*keys).distinct().join(text, keys, "left").withColumn("text", F.coalesce("text", F.lit("")))


# --- P13-P15, A21 -----------------------------------------------------------------------


def stripped_int(s: Column, strip: str = "") -> Column:
    """Integer after dropping leading ``strip`` characters, null if it is none."""
    return _try_int(F.ltrim(s, F.lit(strip)) if strip else s)


def _try_int(s: Column) -> Column:
    t = F.trim(s)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))


def marker_seat(dx: Column, dy: Column) -> Column:
    """Side of the anchor a marker lies on; the larger offset decides."""
    return F.when(F.abs(dy) >= F.abs(dx), F.when(dy > 0, "self").otherwise("across")) \
        .otherwise(F.when(dx > 0, "right").otherwise("left"))


def attribute_markers(dets: DataFrame, frame: str, order: str) -> DataFrame:
    """Which seats show a marker, per frame.

    The anchor is the last ``round_label``, else the first ``wall_count``; without one nothing
    is attributed.  Input: ``name, cx, cy`` and the detection order.
    """
    at = F.struct("cx", "cy")
    main = F.max_by(F.when(F.col("name") == "round_label", at), F.when(F.col("name") == "round_label", F.col(order)))
    fall = F.min_by(F.when(F.col("name") == "wall_count", at), F.when(F.col("name") == "wall_count", F.col(order)))
    anchors = dets.groupBy(frame).agg(F.coalesce(main, fall).alias("_a"))
    sticks = dets.filter(F.col("name") == "reach_stick").select(frame, "cx", "cy")
    seat = marker_seat(F.col("cx") - F.col("_a.cx"), F.col("cy") - F.col("_a.cy"))
    d = anchors.join(sticks, frame, "left").withColumn("_s", F.when(F.col("_a").isNotNull() & F.col("cx").isNotNull(), seat))
    return d.groupBy(frame).agg(*[F.coalesce(F.bool_or(F.col("_s") == p), F.lit(False)).alias(f"reach_{p}") for p in dims.SEAT_POS])


def assemble_hud(dets: DataFrame, frame: str, order: str) -> DataFrame:
    """One row per frame with the fields read; the last read wins, buttons in class order.

    Input: ``name, text`` and the detection order.
    """
    def last(name: str) -> Column:
        hit = F.col("name") == name
        return F.max_by(F.when(hit, F.col("text")), F.when(hit, F.col(order)))

    btn = F.when(F.col("name").startswith("btn_"), F.struct(F.array_position(lit_array(dims.HUD), F.col("name")).alias("r"), F.col("name").alias("n")))
    return dets.groupBy(frame).agg(
        *[_try_int(last(f)).alias(f) for f in dims.SCORE_FIELDS], last("round_label").alias("round_label"),
        stripped_int(last("wall_count"), "余").alias("wall_count"), stripped_int(last("riichi_stick_count"), "x").alias("kyotaku"),
        stripped_int(last("honba_count"), "x").alias("honba"), last("seat_wind_self").alias("seat_wind_self"),
        F.transform(F.array_sort(F.collect_list(btn)), lambda b: b["n"]).alias("buttons"))


def zone_confidence(dets: DataFrame, frame: str) -> DataFrame:
    """Lowest score per zone as a map."""
    z = dets.groupBy(frame, "zone").agg(F.min("score").alias("s"))
    return z.groupBy(frame).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("zone", "s")))).alias("confidence"))
