"""Rules and gates that keep bad frames and boxes out of a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.tiles import base_tile, class_id, lit_array, tile_name
from .ordered import group_quantiles

# --- X3: rule packs ---------------------------------------------------------------------

Rule = tuple[str, Column, Column]


def failed(rules: Sequence[Rule]) -> Column:
    """Messages of the rules that a row breaks; all rules become one projection."""
    return F.filter(F.array(*[F.when(bad, message) for _, bad, message in rules]), lambda m: m.isNotNull())


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


# --- F6 ---------------------------------------------------------------------------------


def copies_over_limit(zone_rows: DataFrame, keys: list[str], tile: str = "tile") -> DataFrame:
    """tiles seen more than four times over the visible zones of a state.

    ``zone_rows`` has one row per visible tile; called discards are listed once, in the meld.
    """
    d = zone_rows.filter(F.col(tile).isNotNull() & ~F.col(tile).isin("?", "")).withColumn("_b", base_tile(F.col(tile)))
    n = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 4)
    return n.select(*keys, _text("tile ", F.col("_b"), " seen ", F.col("_n"), ">4 times across visible zones").alias("message"))


def state_rules(hero: Column, n_hand: Column, n_melds: Column, concealed: Column) -> Column:
    """hand size against melds, and concealed counts below zero."""
    total = n_hand + 3 * n_melds
    rules = [("hand", (hero >= 0) & (n_hand > 0) & ~total.isin(13, 14),
              _text("hero hand ", n_hand, " + 3*", n_melds, " melds = ", total, " not in 13/14"))]
    for s in range(4):
        c = F.get(concealed, F.lit(s))
        rules.append((f"seat{s}", c < 0, _text(f"seat {s} concealed count ", c, " < 0")))
    return failed(rules)


def check_invariants(states: DataFrame, zone_rows: DataFrame, keys: list[str]) -> DataFrame:
    """every violation message of every state, one row each."""
    own = states.select(*keys, F.explode(state_rules(F.col("hero"), F.col("n_hand"), F.col("n_melds"), F.col("concealed"))).alias("message"))
    return own.unionByName(copies_over_limit(zone_rows, keys))


# --- F7 ---------------------------------------------------------------------------------


def check_observed(states: DataFrame) -> DataFrame:
    """adds ``violations``, the messages of each observed state.

    Reads ``o_hand, drawn, o_rivers, o_melds, dora, o_concealed, o_reach, scores, kyotaku,
    left_tiles``; HUD fields may be null and are then not checked.  Lists that several rules read
    are columns of their own, so they are built once per row.
    """
    nothing = F.array().cast("array<string>")
    valid = lit_array(dims.TILES)
    d = states.withColumns({"_tiles_river": F.flatten("o_rivers"), "_all_melds": F.flatten("o_melds"), "_own": F.get("o_melds", F.lit(0))})
    seen = F.concat("o_hand", F.when(F.col("drawn").isNotNull(), F.array("drawn")).otherwise(nothing), F.col("_tiles_river")["pai"],
                    F.flatten(F.col("_all_melds")["tiles"]), "dora")
    d = d.withColumn("_seen", F.array_remove(F.array_remove(seen, "back"), ""))
    d = d.withColumn("_odd", F.size(F.array_except("_seen", valid)) > 0)
    known = F.when(F.col("_odd"), F.filter("_seen", lambda p: F.array_contains(valid, p))).otherwise(F.col("_seen"))
    # equal tiles stand together once sorted, so a fifth copy sits four places after the first
    d = d.withColumn("_bases", F.array_sort(F.transform(known, base_tile)))
    d = d.withColumn("_fifth", F.array_distinct(F.filter("_bases", lambda b, i: F.get("_bases", i + 4) == b)))
    d = d.withColumns({"_n_river": F.size("_tiles_river"), "_n_hand": F.size("o_hand"), "_n_own": F.size("_own"), "_n_dora": F.size("dora"),
                       "_n_kans": F.size(F.filter("_all_melds", lambda m: m["type"].isin(dims.KAN_TYPES))),
                       "_n_reach": F.size(F.array_remove("o_reach", False))})
    unknown = F.when(F.col("_odd"), F.transform(F.filter("_seen", lambda p: ~F.array_contains(valid, p)), lambda p: _text("unknown tile name '", p, "'"))).otherwise(nothing)
    many = F.when(F.size("_fifth") > 0, F.transform("_fifth", lambda b: _text(
        "tile ", b, " seen ", F.size("_bases") - F.size(F.array_remove("_bases", b)), ">4 times across visible zones"))).otherwise(nothing)

    n_hand, n_own, n_dora, n_kans, n_reach = (F.col(c) for c in ("_n_hand", "_n_own", "_n_dora", "_n_kans", "_n_reach"))
    drawn, sticks, left = F.col("drawn"), F.col("kyotaku"), F.col("left_tiles")
    total = n_hand + 3 * n_own
    pending = (total == 14) & drawn.isNull() & (n_own > 0) & F.coalesce(F.get("_own", n_own - 1)["type"].isin("chi", "pon"), F.lit(False))
    rules: list[Rule] = [
        ("hand_size", (total != 13) & ~pending, _text("hero hand ", n_hand, " + 3*", n_own, " melds != 13")),
        ("dora_none", n_dora == 0, F.lit("no dora marker visible")),
        ("dora_kans", (n_dora > 0) & (n_dora - 1 > n_kans), _text(n_dora, " dora markers but only ", n_kans, " kans")),
    ]
    for r in (1, 2, 3):
        c, n = F.get("o_concealed", F.lit(r)), F.size(F.get("o_melds", F.lit(r)))
        want = 13 - 3 * n
        rules.append((f"concealed{r}", (c != want) & (c != want + 1), _text(f"seat {r} concealed ", c, " != ", want, "(+1) for ", n, " melds")))
    declared = F.lit(False)
    for r in range(4):
        tiles = F.get("o_rivers", F.lit(r))
        newest = F.get(tiles, F.size(tiles) - 1)["sideways"]
        declared = declared | (F.get("o_reach", F.lit(r)) & F.coalesce(newest, F.lit(False)))
    rules.append(("sticks", (sticks < n_reach) & ~((sticks == n_reach - 1) & declared), _text("kyotaku ", sticks, " < visible riichi count ", n_reach)))
    points = F.aggregate("scores", F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("_points", points)
    points = F.col("_points")
    rules.append(("points", points + 1000 * sticks != 100000, _text("scores sum ", points, " + 1000*", sticks, " kyotaku != 100000")))
    wall = 70 - F.col("_n_river") - n_kans - F.when(drawn.isNotNull(), 1).otherwise(0)
    rules.append(("wall", F.abs(wall - left) > 1, _text("wall count ", left, " vs predicted ", wall, " (>1 off)")))
    for r in range(4):
        rules.append((f"riichi{r}", F.get("o_reach", F.lit(r)) & F.exists(F.get("o_melds", F.lit(r)), lambda m: m["type"] != "ankan"),
                      F.lit(f"seat {r} riichi with open melds")))
    sources = [F.when(F.size(F.get("o_melds", F.lit(r))) > 0, _sources(F.get("o_melds", F.lit(r)), r)).otherwise(nothing) for r in range(4)]
    d = d.withColumn("violations", F.concat(unknown, many, failed(rules), *sources))
    return d.select(*states.columns, "violations")


def violation_rows(checked: DataFrame, keep: list[str]) -> DataFrame:
    """one row per message.

    The outer form keeps the optimizer from asking for "has any message" first, which would
    build the messages a second time, inlined.
    """
    return checked.select(*keep, F.explode_outer("violations").alias("message")).filter(F.col("message").isNotNull())


def _sources(melds: Column, r: int) -> Column:
    """Messages about melds whose claimed tile cannot come from the seat it names."""
    bad = F.transform(F.filter(melds, lambda m: m["type"].isin(dims.CLAIM_EVENTS) & ~m["from_rel"].isin(1, 2, 3)),
                      lambda m: _text(f"seat {r} ", m["type"], " from_rel ", m["from_rel"], " invalid"))
    chi = F.transform(F.filter(melds, lambda m: (m["type"] == "chi") & (m["from_rel"] != 3)),
                      lambda m: _text(f"seat {r} chi from_rel ", m["from_rel"], " != 3 (kamicha only)"))
    return F.concat(bad, chi)


# --- F9-F11 -----------------------------------------------------------------------------


def verdict(probs: Column, gt: Column, felt: Column, tau: float = dims.TAU) -> Column:
    """box verdict (ok, pred, conf, reason).

    Bad if the top class is not the truth and the truth's probability is below ``tau``; an empty
    cell is bad before anything is scored.
    """
    top = (F.array_position(probs, F.array_max(probs)) - 1).cast("int")
    conf = F.coalesce(F.get(probs, class_id(gt)), F.lit(0.0))
    pred = tile_name(top)
    ok = (pred == gt) | (conf >= tau)

    def row(o, p, c, why):
        return F.struct(o.alias("ok"), p.alias("pred"), c.alias("conf"), F.lit(why).alias("reason"))

    return F.when(felt, row(F.lit(False), F.lit(""), F.lit(0.0), "empty_felt")) \
        .when(ok, row(F.lit(True), pred, conf, "")).otherwise(row(F.lit(False), pred, conf, "mismatch"))


def decide(n_bad: Column, max_bad: int = dims.MAX_BAD) -> Column:
    """what a frame with that many bad boxes gets."""
    return F.when(n_bad == 0, "keep").when(n_bad <= max_bad, "drop_boxes").otherwise("drop_frame")


def gate_boxes(boxes: DataFrame, frame: str, max_bad: int = dims.MAX_BAD) -> DataFrame:
    """decision per frame and fate of each box.

    Input: ``ok, sideways``.  Sideways boxes are never judged, never counted and never dropped.
    The per-frame counts are aggregated before they are joined back.
    """
    judged = ~F.col("sideways")
    per = boxes.groupBy(frame).agg(F.count_if(judged & ~F.col("ok")).alias("n_bad")).withColumn("decision", decide(F.col("n_bad"), max_bad))
    d = boxes.join(per, frame)
    drop = judged & ((F.col("decision") == "drop_frame") | ((F.col("decision") == "drop_boxes") & ~F.col("ok")))
    return d.withColumn("dropped", drop)


# --- F12-F18 ----------------------------------------------------------------------------


def unlabeled_button(flags: Column) -> Column:
    """an offered button could not be located."""
    return F.exists(flags, lambda f: f == "count_mismatch")


def row_moving(flags: Column) -> Column:
    """an opponent's row was being sorted or held."""
    return F.exists(flags, lambda f: f.endswith("backs_sorting") | f.endswith("backs_holding"))


def wide_screen(w: Column, h: Column) -> Column:
    """the frame is 16:9 within 0.02."""
    return F.abs(w.cast("double") / h - 16 / 9) <= 0.02


def fill_gate(slots: DataFrame, keys: list[str]) -> DataFrame:
    """reliability of river slots by fill.

    Input: ``keys`` (frame and ``pos``), ``idx, fill, is_last_actor``.  An empty newest discard
    of the last actor is not rendered yet; any other empty slot is low confidence.
    """
    newest = slots.groupBy(*keys).agg(F.max("idx").alias("_newest"))
    d = slots.join(newest, keys)
    low = F.col("fill") < dims.FILL_OK
    fresh = F.col("is_last_actor") & (F.col("idx") == F.col("_newest"))
    where = _text("pos", F.col("pos"), ":river[", F.col("idx"), "]:")
    flag = F.when(low & fresh, _text(where, "unrendered")) \
        .when(low, _text(where, "low_fill=", F.format_string("%.2f", F.bround(F.col("fill").cast("double"), 2))))
    return d.withColumns({"reliable": ~low, "unrendered": low & fresh, "low_conf": low & ~fresh, "flag": flag}).drop("_newest")


def hand_gate(boxes: DataFrame, frame: str, step: float = 1 / 1024) -> DataFrame:
    """F16: the whole hand is unreliable if its median fill is low or it follows a deal.

    Input: ``fill, suspect`` (same value for a frame).
    """
    med = group_quantiles(boxes, [frame], "fill", {"_med": 0.5}, F.floor(F.col("fill") / step))
    d = boxes.join(med, frame)
    flag = F.when(F.col("_med") < dims.HAND_FILL_OK, "hand:unrendered").when(F.col("suspect"), "hand:deal_unsorted")
    return d.withColumns({"reliable": flag.isNull(), "flag": flag}).drop("_med")


def text_gate(text: Column, in_score_window: Column) -> Column:
    """a text box is readable unless the frame is inside the score animation."""
    return text.isNull() | ~in_score_window


def marker_gate(fill: Column, in_reach_window: Column) -> Column:
    """a dim marker counts as missing only inside the reach window."""
    return ~(in_reach_window & (fill < dims.MARKER_FILL_OK))


# --- F19-F21 ----------------------------------------------------------------------------


def label_problems(images: DataFrame, labels: DataFrame, want: int) -> DataFrame:
    """what is wrong with each game's labels, null if nothing.

    Input: ``images(game, stem)`` and ``labels(game, stem, text)``.  The first row that is not
    blank tells a file's format.
    """
    first = F.element_at(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1)
    first = F.when(F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")) > 0, first)
    fields = F.size(F.split(F.trim(first), r"\s+"))
    bad = first.isNotNull() & (fields != want)
    lab = labels.groupBy("game").agg(F.count(F.lit(1)).alias("n_lab"), F.min(F.when(bad, F.struct("stem", fields.alias("n")))).alias("_bad"))
    img = images.groupBy("game").agg(F.count(F.lit(1)).alias("n_img"))
    d = img.join(lab, "game", "full_outer").na.fill(0, ["n_img", "n_lab"])
    kind = "OBB" if want == 9 else "HBB"
    problem = (F.when(F.col("n_img") == 0, "no yolo/images")
               .when(F.col("n_img") != F.col("n_lab"), _text("truncated: ", F.col("n_img"), " images vs ", F.col("n_lab"), " labels"))
               .when(F.col("_bad").isNotNull(), _text(F.col("_bad.stem"), ".txt: ", F.col("_bad.n"), f"-field rows (want {want} for {kind})")))
    return d.select("game", "n_img", "n_lab", problem.alias("problem"))


def require_clean(problems: DataFrame) -> DataFrame:
    """stop the job at the first broken game."""
    return problems.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(_text(F.col("game"), ": ", F.col("problem")))))


FUNNEL = ["deal", "call", "violation", "unreadable", "letterbox", "sorting"]


def drop_reason(flags: dict[str, Column]) -> Column:
    """first gate, in build order, that drops a frame; null if it stays."""
    out = None
    for name in FUNNEL:
        bad = F.coalesce(flags[name], F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def funnel(frames: DataFrame) -> DataFrame:
    """frames per outcome, and what the box-level gates took from the kept ones.

    Input: ``reason, n_bad, max_bad, n_upright, button_mismatch``.
    """
    kept = F.col("reason").isNull()
    whole = kept & (F.col("n_bad") > F.col("max_bad"))
    some = kept & (F.col("n_bad") > 0) & ~whole
    return frames.groupBy(F.coalesce("reason", F.lit("labeled")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(whole).alias("occluded_frames"),
        F.coalesce(F.sum(F.when(some, F.col("n_bad"))), F.lit(0)).alias("occluded_boxes"),
        F.count_if(kept & F.col("button_mismatch")).alias("button_dropped"),
        F.count_if(kept & ~F.col("button_mismatch")).alias("detector_frames"))


def limit_gate(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """metric against its limit; no evidence fails.

    Input rows: ``metric, value, n``.
    """
    cases = None
    for name, top in limits.items():
        hit = F.col("metric") == name
        cases = F.when(hit, F.lit(float(top))) if cases is None else cases.when(hit, F.lit(float(top)))
    d = metrics.withColumn("limit", cases)
    return d.withColumn("passed", F.coalesce((F.col("n") > 0) & (F.col("value") <= F.col("limit")), F.lit(False)))
