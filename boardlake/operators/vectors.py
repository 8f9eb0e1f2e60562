"""Feature-vector operators on ``array<double>`` columns.

A small picture is a row-major array of ``w * h`` values; all statistics stay inside the row,
so none of them shuffles.  Only the group background (A17) regroups, after it has cut every
group down to a fixed number of members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from .capture import spread_sample


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_mean(a: Column) -> Column:
    return F.try_divide(_sum(a), F.size(a).cast("double"))


def array_median(a: Column) -> Column:
    """Median with the mean of the two middle values for even sizes; null when empty."""
    s, n = F.array_sort(a), F.size(a)
    hi, lo = F.get(s, F.floor(n / 2).cast("int")), F.get(s, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def share(values: Column, predicate) -> Column:
    """V1: share of elements that meet ``predicate``; 0 for an empty array."""
    hits = F.size(F.filter(values, predicate)).cast("double")
    return F.coalesce(F.try_divide(hits, F.size(values).cast("double")), F.lit(0.0))


def face_share(b: Column, g: Column, r: Column, floor: int = 140) -> Column:
    """V1: share of pixels bright in every channel."""
    return share(F.arrays_zip(b.alias("b"), g.alias("g"), r.alias("r")),
                 lambda p: F.least(p["b"], p["g"], p["r"]) >= floor)


def back_share(b: Column, r: Column, margin: int = 60) -> Column:
    """V1: share of pixels whose red exceeds blue by the margin."""
    return share(F.zip_with(b, r, lambda x, y: y - x), lambda d: d >= margin)


def mask_rule(name: str, s: Column, v: Column) -> Column:
    """V1: 0/1 mask from saturation and value arrays: ``face``, ``back`` or ``live``."""
    rules = {
        "face": lambda a, b: (a < 70) & (b > 165),
        "back": lambda a, b: a > 70,
        "live": lambda a, b: (a > 60) | (b > 110),
    }
    return F.zip_with(s, v, lambda a, b: rules[name](a, b).cast("double"))


def present(face: Column, back: Column, least: float = 0.35) -> Column:
    return (face >= least) | (back >= least)


def mean_abs_diff(a: Column, b: Column) -> Column:
    """V2: mean absolute difference; vectors of different length are 1e9 apart."""
    diffs = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.when(F.size(a) != F.size(b), F.lit(dims.MISMATCH)).otherwise(array_mean(diffs))


def _inside(w: int, xa, ya, xb, yb):
    """Element predicate: the cell at index i lies in columns xa..xb and rows ya..yb."""
    return lambda _, i: (i % w >= xa) & (i % w < xb) & (F.floor(i / w) >= ya) & (F.floor(i / w) < yb)


def region_diff(a: Column, b: Column, w: int, h: int, regions: dict[str, tuple] | None = None) -> Column:
    """V3: the largest V2 over named regions; regions that cover no cell are skipped."""
    diffs = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    parts = []
    for x0, y0, x1, y1 in (regions or dims.STABILITY_REGIONS).values():
        xa, xb, ya, yb = int(x0 * w), int(x1 * w), int(y0 * h), int(y1 * h)
        if xb <= xa or yb <= ya:
            continue

        parts.append(array_mean(F.filter(diffs, _inside(w, xa, ya, xb, yb))))
    none = F.lit(dims.MISMATCH)
    best = none if not parts else parts[0] if len(parts) == 1 else F.greatest(*parts)
    return F.when(F.size(a) != F.size(b), none).otherwise(F.coalesce(best, none))


def extent(v: Column, w: int, h: int, floor: float, pad: int, least: int) -> Column:
    """V4: box around the cells at or above ``floor``, padded inside the picture; null if too few."""
    at = F.filter(F.transform(v, lambda x, i: F.when(x >= floor, i)), lambda i: i.isNotNull())
    xs, ys = F.transform(at, lambda i: i % w), F.transform(at, lambda i: F.floor(i / w).cast("int"))
    box = F.struct(
        F.greatest(F.lit(0), F.array_min(xs) - pad).alias("x0"), F.greatest(F.lit(0), F.array_min(ys) - pad).alias("y0"),
        F.least(F.lit(w), F.array_max(xs) + 1 + pad).alias("x1"), F.least(F.lit(h), F.array_max(ys) + 1 + pad).alias("y1"))
    return F.when(F.size(at) >= least, box)


def content_bounds(v: Column, w: int, h: int, floor: float, min_share: float = 0.5) -> Column:
    """V5: first and last row/column whose mean reaches ``floor``.

    The whole picture, marked degenerate, if nothing reaches it or the content is too small.
    """
    rows = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: array_mean(F.slice(v, r * w + 1, F.lit(w))))
    cols = F.transform(F.sequence(F.lit(0), F.lit(w - 1)),
                       lambda c: array_mean(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: F.get(v, r * w + c))))

    def hits(a: Column) -> Column:
        return F.filter(F.transform(a, lambda x, i: F.when(x >= floor, i)), lambda i: i.isNotNull())

    rr, cc = hits(rows), hits(cols)
    t, b, l, r = F.array_min(rr), F.array_max(rr) + 1, F.array_min(cc), F.array_max(cc) + 1
    ok = (F.size(rr) > 0) & (F.size(cc) > 0) & (b - t >= min_share * h) & (r - l >= min_share * w)
    return F.when(ok, F.struct(t.alias("top"), b.alias("bottom"), l.alias("left"), r.alias("right"), F.lit(False).alias("degenerate"))) \
        .otherwise(F.struct(F.lit(0).alias("top"), F.lit(h).alias("bottom"), F.lit(0).alias("left"), F.lit(w).alias("right"),
                            F.lit(True).alias("degenerate")))


def _first_at(p: Column, best: Column) -> Column:
    return (F.array_position(p, best) - 1).cast("int")


def dark_line(p: Column, pred: Column, r: int) -> Column:
    """V6: lowest point of a profile sampled from ``pred - r``, refined by a parabola.

    Returns (pos, contrast); contrast compares with the higher end of the profile.
    """
    n = F.size(p)
    i = _first_at(p, F.array_min(p))
    a, m, c = F.get(p, i - 1), F.get(p, i), F.get(p, i + 1)
    d = (a - c) / (2.0 * (a - 2 * m + c) + 1e-9)
    fine = F.when((i > 0) & (i < n - 1), i + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d))).otherwise(i.cast("double"))
    contrast = F.greatest(F.get(p, F.lit(0)), F.get(p, n - 1)) - m
    return F.when(n >= 5, F.struct((pred - r + fine).alias("pos"), contrast.alias("contrast"))) \
        .otherwise(F.struct(pred.cast("double").alias("pos"), F.lit(0.0).alias("contrast")))


def face_edge(p: Column, pred: Column, inside: int, r: int) -> Column:
    """V7: strongest rise from a long plateau before to a short plateau after.

    ``inside=-1`` reads the profile from its far end.  Profiles too short for two plateaus use
    the steepest single step.
    """
    n = F.size(p)
    q = F.reverse(p) if inside < 0 else p
    kb = F.least(F.lit(12), F.greatest(F.lit(3), F.floor(n / 3))).cast("int")
    ka = F.least(F.lit(5), F.greatest(F.lit(2), F.floor(n / 4))).cast("int")
    long_ = n >= kb + ka + 2
    gains = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - kb - ka)),
                        lambda j: array_mean(F.slice(q, j + kb + 1, ka)) - array_mean(F.slice(q, j + 1, kb)))
    steps = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 2)), lambda j: F.get(q, j + 1) - F.get(q, j))
    g = F.when(long_, gains).otherwise(steps)
    i = _first_at(g, F.array_max(g))
    pos = F.when(long_, i + kb - 0.5).otherwise(i + 0.5)
    if inside < 0:
        pos = (n - 1) - pos
    return F.when(n >= 5, F.struct((pred - r + pos).alias("pos"), F.array_max(g).alias("gain"))) \
        .otherwise(F.struct(pred.cast("double").alias("pos"), F.lit(0.0).alias("gain")))


def integral(v: Column, w: int, h: int) -> Column:
    """V8: sums over all boxes that start in the corner, as ``(w + 1) * (h + 1)`` values."""
    def row(acc: Column, r: Column) -> Column:
        line = F.aggregate(F.slice(v, r * w + 1, F.lit(w)), F.array(F.lit(0.0)),
                           lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        above = F.slice(acc, r * (w + 1) + 1, F.lit(w + 1))
        return F.concat(acc, F.zip_with(above, line, lambda p, q: p + q))

    return F.aggregate(F.sequence(F.lit(0), F.lit(h - 1)), F.array_repeat(F.lit(0.0), w + 1), row)


def box_mean(sums: Column, w: int, h: int, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """V8: mean inside a box after truncating and clipping its corners; 0 for an empty box.

    ``sums`` is the picture's ``integral``; with it every box costs four lookups.
    """
    def clip(c: Column, hi: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(hi), c.cast("int")))

    def at(x: Column, y: Column) -> Column:
        return F.get(sums, y * (w + 1) + x)

    xa, xb, ya, yb = clip(x1, w), clip(x2, w), clip(y1, h), clip(y2, h)
    n = (xb - xa) * (yb - ya)
    return F.when((xb > xa) & (yb > ya), (at(xb, yb) - at(xa, yb) - at(xb, ya) + at(xa, ya)) / n).otherwise(0.0)


def best_shift(offsets: Column, score) -> Column:
    """V9: first offset with the highest ``score(offset)``."""
    scored = F.transform(offsets, lambda s: F.struct(score(s).alias("score"), s.alias("off")))
    start = F.struct(F.lit(-1.0).alias("score"), F.lit(0).alias("off"))
    return F.aggregate(scored, start, lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))


def best_candidate(cands: Column, score, margin: float = 1e-9) -> Column:
    """V9: among candidate offsets, nearest to zero first, one that clearly beats the ones before."""
    near = F.transform(F.array_sort(F.transform(cands, lambda c: F.struct(F.abs(c).alias("a"), c.alias("off")))), lambda s: s["off"])
    scored = F.transform(near, lambda s: F.struct(score(s).alias("score"), s.alias("off")))
    start = F.struct(F.lit(None).cast("double").alias("score"), F.lit(0).alias("off"))
    return F.aggregate(scored, start, lambda a, x: F.when(a["score"].isNull() | (x["score"] > a["score"] + margin), x).otherwise(a))


def group_background(rows: DataFrame, key: str, order: str, chunk: Column | None, at_most: int = 31, at_least: int = 8) -> DataFrame:
    """Element-wise median over evenly spaced members of each group.

    Groups with fewer than ``at_least`` members have no background.  At most ``at_most`` members
    of a group travel, whatever its size.
    """
    some = spread_sample(rows.select(key, order, "v"), [key], [order], at_most, chunk)
    sized = some.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least).select(key)
    cells = some.join(sized, key, "left_semi").select(key, F.posexplode("v").alias("pos", "x"))
    meds = cells.groupBy(key, "pos").agg(F.median("x").alias("m"))
    return meds.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_c")) \
        .select(key, F.transform("_c", lambda c: c["m"]).alias("background"))


def overlay_share(v: Column, background: Column, delta: float) -> Column:
    """Share of elements further than ``delta`` from the group background."""
    return share(F.zip_with(v, background, lambda a, b: F.abs(a - b)), lambda d: d > delta)


def sorting_suspect(slots: Column, empty: Column) -> Column:
    """some slot of a row looks more like bare table than like the row's own median.

    ``slots`` is an array of (mean, std), ``empty`` the reference taken beside the row.
    """
    mm = array_median(F.transform(slots, lambda s: s["mean"]))
    ms = array_median(F.transform(slots, lambda s: s["std"]))

    def dist(s: Column, mean: Column, std: Column) -> Column:
        return F.abs(s["mean"] - mean) + F.abs(s["std"] - std)

    odd = F.exists(slots, lambda s: dist(s, empty["mean"], empty["std"]) < 0.7 * dist(s, mm, ms))
    return F.coalesce((F.size(slots) >= 3) & empty.isNotNull() & odd, F.lit(False))
