"""Agreement of noisy measurements per round, and robust fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..session import stage
from .ordered import Run, group_quantiles, numbered, scan

CELL = 64  # measured values per chunk step
FOLD_POINTS = 64  # distinct points of one group that are compared inside one row


def _chunk(col: str) -> Column:
    return F.floor(F.col(col) / CELL)


def box_sums(points: DataFrame, keys: list[str], x: str, y: str, weight: str, tol: float, fold_limit: int = FOLD_POINTS) -> DataFrame:
    """For every distinct point the weight of all points within ``tol`` on both axes.

    Groups of up to ``fold_limit`` distinct points are settled in one row each, larger ones by blocks of ranks.
    """
    pts = stage(points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.sum(weight).alias("_w")), "points")
    big = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > fold_limit).select(*keys)
    if big.isEmpty():
        return _near_sums(pts, keys, x, y, tol)
    big = stage(big, "large")
    return _near_sums(pts.join(big, keys, "left_anti"), keys, x, y, tol).unionByName(_block_sums(pts.join(big, keys, "left_semi"), keys, x, y, tol))


def _near_sums(pts: DataFrame, keys: list[str], x: str, y: str, tol: float) -> DataFrame:
    """Groups of few points: each against all of its group, inside the row."""
    d = pts.groupBy(*keys).agg(F.collect_list(F.struct(x, y, "_w")).alias("_p"))
    d = d.select(*keys, "_p", F.explode("_p").alias("_q")).select(*keys, "_p", F.col("_q")[x].alias(x), F.col("_q")[y].alias(y))
    near = lambda p: (F.abs(p[x] - F.col(x)) <= tol) & (F.abs(p[y] - F.col(y)) <= tol)
    zero = F.lit(0).cast(pts.schema["_w"].dataType)
    return d.select(*keys, x, y, F.aggregate("_p", zero, lambda s, p: F.when(near(p), s + p["_w"]).otherwise(s)).alias("mass"))


def _block_sums(pts: DataFrame, keys: list[str], x: str, y: str, tol: float) -> DataFrame:
    """Two-dimensional range sums without pairs: the x range of a point is a span of ranks, which
    splits into at most two power-of-two blocks per level; every point belongs to one block per
    level; inside a block a running sum over y answers the y range.  A group of n points costs
    about n log n rows, and no block has to sit in one task.
    """
    xs = pts.select(*keys, x).distinct()
    asks = F.explode(F.array(F.struct(F.lit(0).alias("side"), (F.col(x) - tol).alias("at")),
                             F.struct(F.lit(1).alias("side"), F.col(x).cast("double").alias("at")),
                             F.struct(F.lit(2).alias("side"), (F.col(x) + tol).alias("at"))))
    r = xs.withColumn("_a", asks).select(*keys, x, F.col("_a.side").alias("_side"), F.col("_a.at").alias("_at"))
    r = scan(r, keys, ["_at", "_side", x], [Run("_cnt", "sum", F.when(F.col("_side") == 1, 1).otherwise(0))], _chunk("_at"))
    spans = r.groupBy(*keys, x).agg(
        F.max(F.when(F.col("_side") == 0, F.col("_cnt"))).alias("_lo"), F.max(F.when(F.col("_side") == 1, F.col("_cnt") - 1)).alias("_rank"),
        F.max(F.when(F.col("_side") == 2, F.col("_cnt"))).alias("_hi"))
    d = pts.join(spans, keys + [x])
    total = xs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(total, keys).withColumn("_top", F.ceil(F.log2(F.col("_n").cast("double"))).cast("int"))
    levels = F.sequence(F.lit(0), F.col("_top"))
    own = d.select(*keys, x, y, F.explode(F.transform(levels, lambda l: F.struct(
        l.alias("lv"), F.floor(F.col("_rank") / F.pow(F.lit(2.0), l)).alias("node")))).alias("_b"), "_w")
    own = own.select(*keys, "_b.lv", "_b.node", x, y, F.col(y).cast("double").alias("_at"), F.lit(1).alias("_side"), "_w")

    def blocks(l: Column) -> Column:
        lo = F.ceil(F.col("_lo") / F.pow(F.lit(2.0), l))
        hi = F.floor(F.col("_hi") / F.pow(F.lit(2.0), l))
        left = F.when((lo < hi) & (lo % 2 == 1), F.struct(l.alias("lv"), lo.alias("node")))
        right = F.when((lo < hi) & (hi % 2 == 1), F.struct(l.alias("lv"), (hi - 1).alias("node")))
        return F.array(left, right)

    want = F.filter(F.flatten(F.transform(levels, blocks)), lambda b: b.isNotNull())
    ends = F.array(F.struct(F.lit(0).alias("side"), (F.col(y) - tol).alias("at")), F.struct(F.lit(2).alias("side"), (F.col(y) + tol).alias("at")))
    q = d.select(*keys, x, y, F.explode(want).alias("_b")).withColumn("_e", F.explode(ends))
    q = q.select(*keys, "_b.lv", "_b.node", x, y, F.col("_e.at").alias("_at"), F.col("_e.side").alias("_side"), F.lit(0).cast(d.schema["_w"].dataType).alias("_w"))
    s = scan(own.unionByName(q), keys + ["lv", "node"], ["_at", "_side", x, y], [Run("_run", "sum", F.col("_w"))], _chunk("_at"))
    part = F.when(F.col("_side") == 2, F.col("_run")).when(F.col("_side") == 0, -F.col("_run")).otherwise(0)
    return s.groupBy(*keys, x, y).agg(F.sum(part).alias("mass"))


def round_consensus(samples: DataFrame, keys: list[str], order: str, tol: float = dims.CLUSTER_TOL) -> DataFrame:
    """Score-weighted centre of the dominant cluster of offsets per round and position.

    Input: ``d_along, d_cross, score, n_feat``; scores carry at most two decimals and are summed
    as integers.  Only confident samples count.  The first sample, by ``order``, with the most
    score around it leads; too few samples or too small a share give null.
    """
    good = F.coalesce((F.col("n_feat") >= dims.MIN_FEATURES) & (F.col("score") > 0), F.lit(False))
    weight = F.when(good, F.bround(F.col("score").cast("double") * 100, 0).cast("long"))
    d = samples.select(*keys, good.alias("_good"), weight.alias("_w"), F.when(good, F.col(order)).alias("_first"), *[F.when(good, F.col(c)).alias(c) for c in ("d_along", "d_cross")])
    # The samples are read once; equal offsets collapse, and one row holds what is not confident.
    pts = stage(d.groupBy(*keys, "_good", "d_along", "d_cross").agg(F.sum("_w").alias("_w"), F.min("_first").alias("_first"), F.count(F.lit(1)).alias("_c")), "offsets")
    sure = pts.filter("_good")
    mass = box_sums(sure, keys, "d_along", "d_cross", "_w", tol)
    lead = mass.join(sure.select(*keys, "d_along", "d_cross", "_first"), keys + ["d_along", "d_cross"]).groupBy(*keys).agg(
        F.max(F.struct(F.col("mass"), (-F.col("_first")).alias("_o"), "d_along", "d_cross")).alias("_lead"))
    size = pts.groupBy(*keys).agg(F.sum(F.when(F.col("_good"), F.col("_c")).otherwise(0)).alias("n"))
    near = (F.abs(F.col("d_along") - F.col("_lead.d_along")) <= tol) & (F.abs(F.col("d_cross") - F.col("_lead.d_cross")) <= tol)
    w = F.col("_w")
    c = sure.join(lead, keys).groupBy(*keys).agg(
        F.sum(w).alias("_all"), F.sum(F.when(near, w)).alias("_in"),
        F.sum(F.when(near, w * F.col("d_along"))).alias("_a"), F.sum(F.when(near, w * F.col("d_cross"))).alias("_c"))
    d = size.join(c, keys, "left")
    share = F.col("_in").cast("double") / F.col("_all")
    ok = (F.col("n") >= dims.MIN_ROUND_FRAMES) & (share >= dims.MIN_ROUND_SHARE)
    return d.select(*keys, "n", F.when(ok, F.bround(F.col("_a").cast("double") / F.col("_in"), 1)).alias("d_along"),
                    F.when(ok, F.bround(F.col("_c").cast("double") / F.col("_in"), 1)).alias("d_cross"),
                    F.when(ok, F.bround(share, 3)).alias("conf"))


def dominant(values: DataFrame, keys: list[str], col: str, tol: float = dims.CLUSTER_TOL) -> DataFrame:
    """Median and share of the densest run of values within ``tol`` of one of them."""
    counts = values.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
    asks = F.array(F.struct(F.lit(0).alias("side"), (F.col(col) - tol).alias("at"), F.lit(0).cast("long").alias("c")),
                   F.struct(F.lit(1).alias("side"), F.col(col).cast("double").alias("at"), F.col("_c").alias("c")),
                   F.struct(F.lit(2).alias("side"), (F.col(col) + tol).alias("at"), F.lit(0).cast("long").alias("c")))
    r = counts.withColumn("_a", F.explode(asks)).select(*keys, col, F.col("_a.side").alias("_side"), F.col("_a.at").alias("_at"), F.col("_a.c").alias("_c"))
    r = scan(r, keys, ["_at", "_side", col], [Run("_run", "sum", F.col("_c"))], _chunk("_at"))
    part = F.when(F.col("_side") == 2, F.col("_run")).when(F.col("_side") == 0, -F.col("_run")).otherwise(0)
    dens = r.groupBy(*keys, col).agg(F.sum(part).alias("_in"))
    best = dens.groupBy(*keys).agg(F.max(F.struct("_in", (-F.col(col)).alias("_v"))).alias("_b"), F.count(F.lit(1)).alias("_distinct"))
    members = values.join(best, keys).filter(F.abs(F.col(col) + F.col("_b._v")) <= tol)
    med = group_quantiles(members, keys, col, {"center": 0.5}, _chunk(col))
    n = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    d = n.join(best, keys).join(med, keys)
    return d.select(*keys, "n", F.bround(F.col("center").cast("double"), 1).alias("center"),
                    F.bround(F.col("_b._in").cast("double") / F.col("n"), 3).alias("share"))


def uniformity(values: DataFrame, keys: list[str], value: list[str]) -> DataFrame:
    """How many distinct placements a round holds, and whether it has none; null is a value too."""
    known = F.col(value[0]).isNotNull()
    d = values.groupBy(*keys).agg(F.count_distinct(F.when(known, F.struct(*value))).alias("_n"), F.max((~known).cast("int")).alias("_null"))
    return d.select(*keys, (F.col("_n") + F.col("_null")).alias("n_values"), ((F.col("_n") == 0) & (F.col("_null") == 1)).alias("low_conf"))


def uniformity_report(per_round: DataFrame) -> DataFrame:
    """Rounds checked, rounds that are not uniform, rounds without a placement."""
    d = per_round.agg(F.count(F.lit(1)).alias("rounds"), F.count_if(F.col("n_values") != 1).alias("nonuniform"), F.count_if(F.col("low_conf")).alias("low_conf"))
    return d.withColumn("low_share", F.try_divide(F.col("low_conf").cast("double"), F.col("rounds").cast("double")))


SALTS = 16  # tasks that a group's pairs meet its few figures in


def _told(pairs: DataFrame, figures: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Each pair with the figures of its group; a group's pairs are dealt over several tasks, so a large one is not sorted in one."""
    salt = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    dealt = pairs.withColumn("_salt", F.pmod(F.hash(F.col(x), F.col(y)), F.lit(SALTS)))
    return dealt.join(figures.withColumn("_salt", salt), keys + ["_salt"]).drop("_salt")


def _line(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``_a, _b`` of the least-squares line of each group and ``_n``, its rows; a pair stands for ``_c`` rows. Sums are taken about the means."""
    c, both = F.col("_c"), F.col(x).isNotNull() & F.col(y).isNotNull()
    mean = lambda v: F.sum(F.when(both, c * F.col(v).cast("double"))) / F.sum(F.when(both, c))
    m = pairs.groupBy(*keys).agg(F.sum(c).alias("_n"), mean(x).alias("_mx"), mean(y).alias("_my"))
    dx, dy = F.when(both, F.col(x) - F.col("_mx")), F.when(both, F.col(y) - F.col("_my"))
    s = _told(pairs, m, keys, x, y).groupBy(*keys).agg(
        F.sum(c * dx * dx).alias("_xx"), F.sum(c * dx * dy).alias("_xy"), *[F.max(v).alias(v) for v in ("_n", "_mx", "_my")])
    slope = F.when(F.col("_xx") != 0, F.col("_xy") / F.col("_xx"))
    return s.select(*keys, "_n", slope.alias("_a"), (F.col("_my") - slope * F.col("_mx")).alias("_b"))


def robust_line(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", passes: int = 2, band: float = 4.0, at_least: int = 8) -> DataFrame:
    """Least-squares line per group after dropping residuals far from their median.

    Groups that are too small get slope 1 and the median offset.  A pass that would leave too
    few points is not applied.  Equal pairs collapse first and are counted on.
    """
    all_ = stage(pairs.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_c")), "pairs")
    d, c = all_, F.col("_c")
    for _ in range(passes):
        r = _told(d, stage(_line(d, keys, x, y), "fit"), keys, x, y).withColumn("_r", F.col(y) - (F.col("_a") * F.col(x) + F.col("_b")))
        r = stage(r.select(*keys, x, y, "_c", "_r"), "residuals")
        med = stage(group_quantiles(r, keys, "_r", {"_m": 0.5}, _chunk("_r"), "_c"), "medians")
        r = _told(r, med, keys, x, y).withColumn("_keep", F.abs(F.col("_r") - F.col("_m")) < band)
        r = stage(r.select(*keys, x, y, "_c", "_keep"), "judged")
        left = r.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("_keep"), c)), F.lit(0)).alias("_k"))
        d = stage(_told(r, left, keys, x, y).filter(F.col("_keep") | (F.col("_k") < at_least)).select(*keys, x, y, "_c"), "kept")
    last = stage(_line(d, keys, x, y).withColumnRenamed("_n", "n_used"), "fit")
    e = F.pow(F.col(y) - (F.col("_a") * F.col(x) + F.col("_b")), F.lit(2.0))
    err = _told(d, last, keys, x, y).groupBy(*keys).agg(F.sqrt(F.sum(c * e) / F.sum(F.when(e.isNotNull(), c))).alias("rmse"))
    off = stage(group_quantiles(all_.withColumn("_o", F.col(y) - F.col(x)), keys, "_o", {"_off": 0.5}, _chunk("_o"), "_c"), "offsets")
    out = all_.groupBy(*keys).agg(F.sum(c).alias("n")).join(last, keys).join(stage(err, "errors"), keys).join(off, keys)
    small = F.col("n") < at_least
    return out.select(*keys, "n", F.when(small, F.col("n")).otherwise(F.col("n_used")).alias("n_used"), F.when(small, 1.0).otherwise(F.col("_a")).alias("slope"),
                      F.when(small, F.col("_off").cast("double")).otherwise(F.col("_b")).alias("intercept"), F.when(small, 0.0).otherwise(F.col("rmse")).alias("rmse"))


def offset_spread(samples: DataFrame, round_keys: list[str], pos: str, col: str) -> tuple[DataFrame, DataFrame]:
    """Median and deviation per position; mean deviation inside rounds and deviation across rounds."""
    med = group_quantiles(samples, [pos], col, {"median": 0.5}, _chunk(col))
    dev = samples.groupBy(pos).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(col).alias("sigma"))
    per = samples.groupBy(*round_keys, pos).agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop(col).alias("_s"), F.avg(col).alias("_m"))
    rounds = per.agg(F.avg(F.when(F.col("_n") >= 2, F.col("_s"))).alias("within"), F.stddev_pop("_m").alias("across"), F.count(F.lit(1)).alias("rounds"))
    return dev.join(med, pos), rounds


def pile_centers(comps: DataFrame, keys: list[str]) -> DataFrame:
    """Face centres of each pile sample: separated faces, or one merged run split evenly.

    Input: ``keys, comp_id, want, cx, cy, ux, uy`` (unit step direction), ``extent, face``.
    Samples that show another number of faces are skipped.
    """
    d = comps.join(comps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    t = F.col("cx") * F.col("ux") + F.col("cy") * F.col("uy")
    apart = d.filter(F.col("_n") == F.col("want")).withColumn("_t", t)
    apart = numbered(apart, keys, ["_t", "comp_id"], _chunk("_t"), "_k").select(*keys, (F.col("_k") - 1).cast("int").alias("k"), "cx", "cy")
    want, ext, face = F.col("want"), F.col("extent"), F.col("face")
    merged = d.filter((F.col("_n") == 1) & (want > 1) & ext.between(0.75 * want * face, 1.30 * want * face))
    step = ext / want
    merged = merged.withColumn("k", F.explode(F.sequence(F.lit(0), want.cast("int") - 1)))
    shift = F.col("k") * step - (ext / 2 - step / 2)
    merged = merged.select(*keys, "k", (F.col("cx") + shift * F.col("ux")).alias("cx"), (F.col("cy") + shift * F.col("uy")).alias("cy"))
    return apart.unionByName(merged)


def pile_fit(centers: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Median and deviation of the first centre and of the steps between centres, per position."""
    d = scan(centers, keys, ["k"], [Run("_px", "last", F.col("cx"), inclusive=False), Run("_py", "last", F.col("cy"), inclusive=False)], _chunk("k"))
    d = d.withColumns({"sx": F.col("cx") - F.col("_px"), "sy": F.col("cy") - F.col("_py")})
    heads = d.filter(F.col("k") == 0)
    steps = d.filter(F.col("k") > 0)
    out = heads.groupBy(pos).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("cx").alias("anchor_sd_x"), F.stddev_pop("cy").alias("anchor_sd_y"))
    for src, col, name in ((heads, "cx", "anchor_x"), (heads, "cy", "anchor_y"), (steps, "sx", "step_x"), (steps, "sy", "step_y")):
        out = out.join(group_quantiles(src, [pos], col, {name: 0.5}, _chunk(col)), pos, "left")
    return out.join(steps.groupBy(pos).agg(F.stddev_pop("sx").alias("step_sd_x"), F.stddev_pop("sy").alias("step_sd_y")), pos, "left")


def apply_overrides(boxes: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Offset of each box from its round's consensus, clamped; none makes the box unreliable."""
    o = overrides.select(*keys, F.col("d_along").alias("_a"), F.col("d_cross").alias("_c"))
    d = boxes.join(o, keys, "left")
    clamp = lambda c: F.greatest(F.lit(-dims.SNAP_MAX), F.least(F.lit(dims.SNAP_MAX), F.col(c).cast("double")))
    has = F.col("_a").isNotNull()
    return d.withColumns({"shift_along": F.when(has, clamp("_a")).otherwise(0.0), "shift_cross": F.when(has, clamp("_c")).otherwise(0.0),
                          "reliable": has}).drop("_a", "_c")
