"""Predictions against truth: bags, fields, zones, average precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.geometry import box_cols, iou
from ..functions.num import ratio, seeded_hash
from ..functions.tiles import base_tile
from .ordered import Run, group_quantiles, scan

# --- multisets --------------------------------------------------------------------------


def bag_counts(pred: DataFrame, gt: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Per key and name the number predicted, expected, matched, missed and extra.

    Both sides are stacked and counted together, so one aggregation with map-side combine
    replaces a full outer join.
    """
    rows = pred.select(*keys, name, F.lit(1).alias("_p"), F.lit(0).alias("_g")).unionByName(
        gt.select(*keys, name, F.lit(0).alias("_p"), F.lit(1).alias("_g")))
    d = rows.groupBy(*keys, name).agg(F.sum("_p").alias("n_pred"), F.sum("_g").alias("n_gt"))
    return d.withColumns({"correct": F.least("n_pred", "n_gt"),
                          "missed": F.greatest(F.col("n_gt") - F.col("n_pred"), F.lit(0)),
                          "extra": F.greatest(F.col("n_pred") - F.col("n_gt"), F.lit(0))})


def bag_match(pred: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """Matches per key, strict and with red fives counted as plain ones.

    A key's names, each once with its counts, are one short list, so what a task keeps of it does not
    wait in two more aggregations.
    """
    d = bag_counts(pred, gt, keys).select(*keys, F.struct(base_tile(F.col("name")).alias("b"), F.col("n_pred").alias("p"), F.col("n_gt").alias("g")).alias("_x"))
    d = d.groupBy(*keys).agg(F.collect_list("_x").alias("_x"))
    total = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + f(x))
    less = lambda x: F.least(x["p"], x["g"])
    bases = F.array_distinct(F.transform("_x", lambda x: x["b"]))

    def lenient(b: Column) -> Column:
        same = F.filter("_x", lambda x: x["b"].eqNullSafe(b))
        return F.least(total(same, lambda x: x["p"]), total(same, lambda x: x["g"]))

    return d.select(*keys, total(F.col("_x"), lambda x: x["p"]).alias("n_pred"), total(F.col("_x"), lambda x: x["g"]).alias("n_gt"),
                    total(F.col("_x"), less).alias("correct"), F.aggregate(bases, F.lit(0).cast("long"), lambda s, b: s + lenient(b)).alias("correct_lenient"))


def tally(matches: DataFrame, zone: str, pos: str) -> DataFrame:
    """Recall, precision and lenient recall per zone and per zone and position."""
    sums = [F.sum(c).alias(c) for c in ("n_gt", "n_pred", "correct", "correct_lenient")]
    d = matches.groupingSets([(F.col(zone),), (F.col(zone), F.col(pos))], zone, pos).agg(*sums, F.grouping(pos).alias("all_pos"))
    return d.withColumns({"recall": ratio(F.col("correct"), F.col("n_gt")), "precision": ratio(F.col("correct"), F.col("n_pred")),
                          "recall_lenient": ratio(F.col("correct_lenient"), F.col("n_gt"))})


def histogram34(tiles: DataFrame, keys: list[str], tile: str) -> DataFrame:
    """Counts per plain tile with zeros filled in.

    Tiles are counted first, so a key's list holds each of its tiles once; the columns are read from it
    after the last shuffle, and no task keeps all columns of all its keys.
    """
    names = dims.TILES[:34]
    d = tiles.groupBy(*keys, F.array_position(F.array(*[F.lit(t) for t in names]), base_tile(F.col(tile))).cast("int").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    d = d.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("_b") > 0, F.struct("_b", "_n")))).alias("_m"))
    return d.select(*keys, *[F.coalesce(F.try_element_at("_m", F.lit(i + 1)), F.lit(0).cast("long")).alias(t) for i, t in enumerate(names)])


# --- fields and zones -------------------------------------------------------------------


def field_verdicts(pred: DataFrame, truth: DataFrame, keys: list[str], tolerance: dict[str, int] | None = None) -> DataFrame:
    """``ok``, ``err`` or ``missing`` for every field the truth knows.

    Input rows are (keys, field, value).  ``tolerance`` lists numeric fields and the slack allowed.
    """
    d = truth.withColumnRenamed("value", "want").join(pred.withColumnRenamed("value", "got"), keys + ["field"], "left")
    same = F.col("got") == F.col("want")
    for name, slack in (tolerance or {}).items():
        off = F.abs(F.col("got").try_cast("int") - F.col("want").try_cast("int")) <= slack
        same = same | ((F.col("field") == name) & F.coalesce(off, F.lit(False)))
    return d.withColumn("verdict", F.when(F.col("got").isNull(), "missing").when(same, "ok").otherwise("err"))


def field_rates(verdicts: DataFrame, frame: list[str]) -> tuple[DataFrame, DataFrame]:
    """A10: exact-match rate per field, and the rate of frames with every field right."""
    ok = F.col("verdict") == "ok"
    fields = verdicts.groupBy("field").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("hit"))
    frames = verdicts.groupBy(*frame).agg(F.bool_and(ok).alias("_all")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_all")).alias("hit"))
    rate = ratio(F.col("hit"), F.col("total"))
    return fields.withColumn("rate", rate), frames.withColumn("rate", rate)


def zone_diff(a: Column, b: Column, ordered: list[str], unordered: list[str] = ()) -> Column:
    """Names of the zones in which two states differ."""
    checks = [F.when(~a[z].eqNullSafe(b[z]), z) for z in ordered]
    checks += [F.when(~F.array_sort(a[z]).eqNullSafe(F.array_sort(b[z])), z) for z in unordered]
    return F.filter(F.array(*checks), lambda z: z.isNotNull())


def reject_category(message: Column) -> Column:
    """Category of one violation message; the first hit in the fixed order decides."""
    out = F.when(message.contains(dims.REJECT_CATEGORIES[0][0]), dims.REJECT_CATEGORIES[0][1])
    for text, cat in dims.REJECT_CATEGORIES[1:]:
        out = out.when(message.contains(text), cat)
    return out.otherwise("other")


def reject_counts(violations: DataFrame, frame: str, message: str) -> DataFrame:
    """Number of frames per category."""
    d = violations.select(frame, reject_category(F.col(message)).alias("category")).distinct()
    return d.groupBy("category").agg(F.count(F.lit(1)).alias("frames"))


def audit(results: DataFrame) -> DataFrame:
    """Outcome counts of a round trip.

    Input: ``skipped`` (reason or null), ``feasible``, ``zones`` (differing zones).
    """
    outcome = (F.when(F.col("skipped").isNotNull(), F.concat(F.lit("skipped_"), F.col("skipped")))
               .when(~F.col("feasible"), "infeasible").when(F.size("zones") > 0, "mismatch").otherwise("ok"))
    return results.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How often two reaction tables give the same type and tile; a missing reaction is an error."""
    j = a.select(*keys, F.struct("type", "pai").alias("_a")).join(b.select(*keys, F.struct("type", "pai").alias("_b")), keys, "left")
    gone = F.col("_a.type").isNull() | F.col("_b").isNull() | F.col("_b.type").isNull()
    same = F.col("_a.type").eqNullSafe(F.col("_b.type")) & F.col("_a.pai").eqNullSafe(F.col("_b.pai"))
    return j.agg(F.count_if(gone).alias("errors"), F.count_if(~gone & same).alias("agree"), F.count_if(~gone & ~same).alias("disagree"))


# --- classes ----------------------------------------------------------------------------


def class_accuracy(pairs: DataFrame) -> DataFrame:
    """Accuracy per true class. Input: ``gt, pred``."""
    d = pairs.groupBy("gt").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gt") == F.col("pred")).alias("correct"))
    return d.withColumn("acc", ratio(F.col("correct"), F.col("n")))


def confusions(pairs: DataFrame) -> DataFrame:
    """Counts of wrong (true, predicted) pairs."""
    return pairs.filter(F.col("gt") != F.col("pred")).groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))


def top_confusions(pairs: DataFrame, n: int, per_pair: int, key: str, seed: int = 0) -> DataFrame:
    """K1: the n most frequent confusions with up to ``per_pair`` examples each, in seeded order."""
    top = confusions(pairs).orderBy(F.desc("n"), "gt", "pred").limit(n)
    ex = pairs.join(F.broadcast(top), ["gt", "pred"])  # at most n rows
    w = Window.partitionBy("gt", "pred").orderBy(seeded_hash(seed, F.col(key)), key)
    return ex.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_pair)


def worst_classes(pairs: DataFrame, k: int) -> DataFrame:
    """K2: the k classes with the lowest accuracy."""
    return class_accuracy(pairs).orderBy("acc", "gt").limit(k)


def any_of_agreement(rows: DataFrame, zone: str) -> DataFrame:
    """A5: share of rows whose truth is among the candidates. Input: ``gt, cands``."""
    hit = F.array_contains("cands", F.col("gt"))
    return rows.groupBy(zone).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("correct")) \
        .withColumn("agree", ratio(F.col("correct"), F.col("n")))


def mismatch_examples(rows: DataFrame, zone: str, order: list[str], at_most: int) -> DataFrame:
    """A5: the first mismatches of each zone. The rank limit is applied before the shuffle."""
    bad = rows.filter(~F.array_contains("cands", F.col("gt")))
    w = Window.partitionBy(zone).orderBy(*order)
    return bad.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= at_most)


def inverse_frequency(rows: DataFrame, cls: str) -> DataFrame:
    """Sample weight one over the class count."""
    n = rows.groupBy(cls).agg((1.0 / F.count(F.lit(1))).alias("weight"))
    return rows.join(n, cls)


# --- A18 --------------------------------------------------------------------------------


def gate_report(verdicts: DataFrame, frame: str, max_bad: int = dims.MAX_BAD) -> DataFrame:
    """Frames per bad-box count (5 stands for more) and per decision. Input: ``ok``."""
    per = verdicts.groupBy(frame).agg(F.count_if(~F.col("ok")).alias("bad"))
    decision = F.when(F.col("bad") == 0, "keep").when(F.col("bad") <= max_bad, "drop_boxes").otherwise("drop_frame")
    return per.groupBy(F.least(F.col("bad"), F.lit(5)).alias("bad"), decision.alias("decision")).agg(F.count(F.lit(1)).alias("frames"))


def confidence_percentiles(verdicts: DataFrame, step: float = 1 / 4096) -> DataFrame:
    """Percentiles of the true class's probability for passed and failed boxes."""
    return group_quantiles(verdicts.select("ok", "conf"), ["ok"], "conf", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, F.floor(F.col("conf") / step))


# --- A20 --------------------------------------------------------------------------------

def overlap_pairs(dets: DataFrame, gts: DataFrame, keys: list[str], t: float) -> DataFrame:
    """Pairs of distinct boxes in the same group that overlap by at least ``t`` (above 0).

    Such boxes share at least ``t`` of either side, so their sides differ by a factor of ``1 / t``
    at most and their centres by a fixed part of the first box's sides. The first box looks into the
    cells around its centre on the grid of its own size class, about two; the second lies by its
    centre in one cell of each grid a partner may look into. Groups of any size never pair all
    with all. Boxes carry ``x0..y1`` and ``_d`` / ``_g`` payloads; boxes without extent overlap nothing.
    """
    slack = 1 + 1e-6  # overlap by exactly t must not fall to rounding
    reach = (1 - t) * max(1.0, 0.5 / t) * slack  # of a box's side: how far a partner's centre may be
    side = lambda c: F.pow(F.lit(2.0), F.col(c) + 3) * max(reach, 1e-3)

    def boxes(df: DataFrame, p: str, payload: str) -> DataFrame:
        df = df.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
        return df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("x0", "y0", "x1", "y1")], payload,
                         F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("_m"))

    level = lambda v: F.floor(F.log2(v)).cast("int")
    d = boxes(dets, "d", "_d").withColumn("_lv", level(F.col("_m"))).drop("_m")
    g = boxes(gts, "g", "_g").withColumn("_lv", F.explode(F.sequence(level(F.col("_m") * (t / slack)), level(F.col("_m") * (slack / t))))).drop("_m")
    for axis, cell in (("x", "_cx"), ("y", "_cy")):
        lo, hi = F.col(f"d_{axis}0"), F.col(f"d_{axis}1")
        at = lambda v: F.floor(v / side("_lv")).cast("long")
        d = d.withColumn(cell, F.explode(F.sequence(at((lo + hi) / 2 - (hi - lo) * reach), at((lo + hi) / 2 + (hi - lo) * reach))))
        g = g.withColumn(cell, at((F.col(f"g_{axis}0") + F.col(f"g_{axis}1")) / 2))
    near = d.join(g, keys + ["_lv", "_cx", "_cy"]).withColumn("iou", iou(box_cols("d_"), box_cols("g_")))
    return near.filter(F.col("iou") >= t).select(*keys, "_d", "_g", "iou")


def match_detections(dets: DataFrame, gts: DataFrame, t: float = 0.5) -> DataFrame:
    """True or false positive for every detection.

    Each detection points at the truth box of its class it overlaps best; each truth box accepts
    the best-scored detection, and one that comes second there is a miss even if another box
    would do, which pairing by descending overlap would grant.  Copies of a box share one
    candidate, so they never pair up.
    Input: ``frame, cls, x0..y1`` and ``det_id, score`` or ``gt_id``.
    """
    keys, place = ["frame", "cls"], ["x0", "y0", "x1", "y1"]
    rank = F.struct((-F.col("score")).alias("s"), F.col("det_id").alias("i"))
    d = dets.groupBy(*keys, *place).agg(F.min(rank).alias("_d"))
    g = gts.groupBy(*keys, *place).agg(F.min("gt_id").alias("_g"))
    pairs = overlap_pairs(d, g, keys, t)
    best = pairs.groupBy(*keys, "_d").agg(F.max(F.struct("iou", (-F.col("_g")).alias("_n"))).alias("_b"))
    taken = best.groupBy(*keys, (-F.col("_b._n")).alias("gt_id")).agg(F.min("_d").alias("_d"))
    tp = taken.select("frame", F.col("_d.i").alias("det_id"), F.lit(1).alias("tp"))
    return dets.join(tp, ["frame", "det_id"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))


def average_precision(matched: DataFrame, gts: DataFrame, score: str, chunk: Column) -> DataFrame:
    """Area under the precision envelope per class.

    Detections of equal score form one point of the curve.  ``score`` is an integer column that
    grows with confidence; ``chunk`` must not decrease with ``-score``.
    """
    n = gts.groupBy("cls").agg(F.count(F.lit(1)).alias("n_gt"))
    pts = matched.groupBy("cls", (-F.col(score)).alias("_neg")).agg(F.sum("tp").alias("_tp"), F.count(F.lit(1)).alias("_n"))
    c = scan(pts, ["cls"], ["_neg"], [Run("_ctp", "sum", F.col("_tp")), Run("_cn", "sum", F.col("_n"))], chunk)
    c = c.withColumns({"_p": F.col("_ctp") / F.col("_cn"), "_rev": -F.col("_neg")})
    c = scan(c, ["cls"], ["_rev"], [Run("_env", "max", F.col("_p"))], -chunk)
    ap = c.groupBy("cls").agg(F.sum(F.col("_env") * F.col("_tp")).alias("_s"))
    d = n.join(ap, "cls", "left")
    return d.select("cls", "n_gt", F.coalesce(F.col("_s") / F.col("n_gt"), F.lit(0.0)).alias("ap"))


def grouped_ap(ap: DataFrame) -> DataFrame:
    """Mean over tile classes and over HUD classes."""
    kind = F.when(F.col("cls") < len(dims.TILES), "tile").otherwise("hud")
    return ap.groupBy(kind.alias("kind")).agg(F.avg("ap").alias("map"), F.count(F.lit(1)).alias("classes"))


def button_rates(rows: DataFrame) -> DataFrame:
    """A10: exact button sets on all frames, and on frames that show buttons. Input: ``want, got`` as text."""
    same = F.col("want") == F.col("got")
    d = rows.select(F.explode(F.array(F.struct(F.lit("buttons").alias("field"), F.lit(True).alias("use")),
                                      F.struct(F.lit("button_recall").alias("field"), (F.col("want") != "").alias("use")))).alias("_f"), same.alias("_s"))
    d = d.filter("_f.use").groupBy(F.col("_f.field").alias("field")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_s")).alias("hit"))
    return d.withColumn("rate", ratio(F.col("hit"), F.col("total")))
