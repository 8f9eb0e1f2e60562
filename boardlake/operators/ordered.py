"""Ordered scans that never put one whole group into one task.

A running value over ``keys`` ordered by ``order`` is computed in two levels: every group is
cut into chunks along the order (``chunk`` is a column that never decreases along ``order``),
a window runs inside each chunk, one summary row per chunk is scanned across chunks, and the
carried value is joined back.  The result is the same for any choice of ``chunk``; the chunk
only bounds how many rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

SEQ_CHUNK = 1 << 16  # sequence numbers per chunk of a game log


@dataclass(frozen=True)
class Run:
    """One running value.

    kind: ``sum``/``max``/``min``/``last``/``list`` look back, ``next`` looks ahead (first value that is
    not null), ``total`` is the sum over the whole group. ``list`` gathers the values that are not null;
    only `segmented` takes it, `next` and `total` only `scan`.  ``inclusive`` says whether the
    current row takes part.
    """

    name: str
    kind: str
    col: Column
    inclusive: bool = True


def seq_chunk(col: str = "seq", size: int = SEQ_CHUNK) -> Column:
    """Chunk key for a log ordered by an integer sequence number."""
    return F.expr(f"`{col}` div {size}")


def _order_value(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _local(run: Run, back: WindowSpec, ahead: WindowSpec) -> Column:
    if run.kind == "sum":
        return F.sum(run.col).over(back)
    if run.kind == "max":
        return F.max(run.col).over(back)
    if run.kind == "min":
        return F.min(run.col).over(back)
    if run.kind == "last":
        return F.last(run.col, ignorenulls=True).over(back)
    if run.kind == "next":
        return F.last(run.col, ignorenulls=True).over(ahead)
    if run.kind == "list":
        return F.collect_list(run.col).over(back)
    raise ValueError(run.kind)


def _summary(run: Run, at: Column) -> Column:
    if run.kind in ("sum", "total"):
        return F.sum(run.col)
    if run.kind == "max":
        return F.max(run.col)
    if run.kind == "min":
        return F.min(run.col)
    picked = F.when(run.col.isNotNull(), at)
    return F.max_by(run.col, picked) if run.kind == "last" else F.min_by(run.col, picked)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], runs: Sequence[Run],
         chunk: Column | None) -> DataFrame:
    """Add the running columns ``runs`` to ``df``.

    ``order`` must name columns that order each group totally.  Pass ``chunk=None`` only for
    groups whose size is bounded by the data model.
    """
    keys, order = list(keys), list(order)
    if chunk is None:
        out = {}
        for r in runs:
            if r.kind == "total":
                out[r.name] = F.sum(r.col).over(Window.partitionBy(*keys))
            else:
                out[r.name] = _local(r, *_frames(keys, order, r.inclusive))
                if r.kind == "sum":
                    out[r.name] = F.coalesce(out[r.name], F.lit(0))
        return df.withColumns(out)

    df = df.withColumn("_chunk", chunk)
    parts = keys + ["_chunk"]
    at = _order_value(order)
    local = df.withColumns({f"_l_{r.name}": _local(r, *_frames(parts, order, r.inclusive))
                            for r in runs if r.kind != "total"})
    per_chunk = df.groupBy(*parts).agg(*[_summary(r, at).alias(f"_s_{r.name}") for r in runs])
    past, future = _frames(keys, ["_chunk"], inclusive=False)
    carries = []
    for r in runs:
        s = F.col(f"_s_{r.name}")
        if r.kind == "total":
            c = F.sum(s).over(Window.partitionBy(*keys))
        elif r.kind == "sum":
            c = F.sum(s).over(past)
        elif r.kind == "max":
            c = F.max(s).over(past)
        elif r.kind == "min":
            c = F.min(s).over(past)
        elif r.kind == "last":
            c = F.last(s, ignorenulls=True).over(past)
        else:
            c = F.last(s, ignorenulls=True).over(future)
        carries.append(c.alias(f"_c_{r.name}"))
    carried = per_chunk.select(*parts, *carries)
    joined = local.join(carried, parts, "left")
    final = {}
    for r in runs:
        here, came = F.col(f"_l_{r.name}"), F.col(f"_c_{r.name}")
        if r.kind == "total":
            final[r.name] = came
        elif r.kind == "sum":
            final[r.name] = F.coalesce(here, F.lit(0)) + F.coalesce(came, F.lit(0))
        elif r.kind == "max":
            final[r.name] = F.greatest(here, came)
        elif r.kind == "min":
            final[r.name] = F.least(here, came)
        else:
            final[r.name] = F.coalesce(here, came)
    drop = ["_chunk"] + [f"_l_{r.name}" for r in runs if r.kind != "total"] + [f"_c_{r.name}" for r in runs]
    return joined.withColumns(final).drop(*drop)


def segmented(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Column, runs: Sequence[Run], number: str,
              chunk: Column) -> DataFrame:
    """Add the running columns ``runs``, which begin anew at every row where ``start`` holds, and ``number``,
    how many such rows there were.

    The start is part of the running value, so the segments need not be numbered before they are scanned:
    one exchange by chunk serves all windows, and one summary row per chunk carries what its last segment
    holds to the chunks up to the next start. The result is the same for any choice of ``chunk``.
    """
    keys, order = list(keys), list(order)
    parts = keys + ["_chunk"]
    back, _ = _frames(parts, order, True)
    d = df.withColumn("_chunk", chunk).withColumn("_seg", F.sum(F.when(start, 1).otherwise(0)).over(back))
    names = [r.name for r in runs]
    with_own, without = (_frames(parts + ["_seg"], order, i) for i in (True, False))
    d = d.withColumns({f"_s_{r.name}": _local(r, *with_own) for r in runs})
    d = d.withColumns({f"_l_{r.name}": _local(r, *without) for r in runs if not r.inclusive})
    tip = F.struct("_seg", *[f"_s_{n}" for n in names])
    tips = d.groupBy(*parts).agg(F.max_by(tip, _order_value(order)).alias("_z")).select(*parts, "_z.*")
    # A chunk with a start begins a new stretch of chunks that share a segment.
    upto, past = _frames(keys, ["_chunk"], True)[0], _frames(keys, ["_chunk"], False)[0]
    tips = tips.withColumn("_before", F.coalesce(F.sum("_seg").over(past), F.lit(0))).withColumn("_stretch", F.sum(F.when(F.col("_seg") > 0, 1).otherwise(0)).over(upto))
    same = _frames(keys + ["_stretch"], ["_chunk"], True)[0]
    kinds = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True), "list": lambda c: F.collect_list(c)}
    held = {f"_h_{r.name}": kinds[r.kind](f"_s_{r.name}").over(same) for r in runs}
    held |= {f"_h_{r.name}": F.flatten(held[f"_h_{r.name}"]) for r in runs if r.kind == "list"}
    tips = tips.withColumns(held)
    before = Window.partitionBy(*keys).orderBy("_chunk")
    carried = tips.select(*parts, "_before", *[F.lag(f"_h_{n}").over(before).alias(f"_c_{n}") for n in names])
    joined = d.join(carried, parts, "left")
    first = F.col("_seg") == 0  # the segment goes on from the chunk before
    final = {number: F.col("_seg") + F.coalesce("_before", F.lit(0))}
    for r in runs:
        here, came = F.col(f"_s_{r.name}" if r.inclusive else f"_l_{r.name}"), F.when(first, F.col(f"_c_{r.name}"))
        if r.kind == "sum":
            final[r.name] = F.coalesce(here, F.lit(0)) + F.coalesce(came, F.lit(0))
        elif r.kind == "max":
            final[r.name] = F.greatest(here, came)
        elif r.kind == "min":
            final[r.name] = F.least(here, came)
        elif r.kind == "list":
            final[r.name] = F.concat(F.coalesce(came, F.slice(here, 1, 0)), here)
        else:
            final[r.name] = F.coalesce(here, came)
    return joined.withColumns(final).drop("_chunk", "_seg", "_before", *[f"_{p}_{n}" for n in names for p in "slc"])


def _frames(keys: Sequence[str], order: Sequence[str], inclusive: bool) -> tuple[WindowSpec, WindowSpec]:
    """Growing frames that look back and ahead.

    Looking ahead means looking back in the opposite order: a frame that shrinks towards the
    end would be evaluated anew for every row.
    """
    edge = 0 if inclusive else -1
    back = Window.partitionBy(*keys).orderBy(*order)
    ahead = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return back.rowsBetween(Window.unboundedPreceding, edge), ahead.rowsBetween(Window.unboundedPreceding, edge)


def clamped_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], deltas: dict[str, Column],
                chunk: Column | None, before: bool = False) -> DataFrame:
    """Running sums that stop at zero: ``x = max(x + delta, 0)`` along the order.

    With S the plain running sum, the clamped value is ``S - min(0, lowest S so far)``, so it
    needs only sums and minima and can be carried from chunk to chunk.  ``before`` also adds
    ``<name>_before``, the value ahead of the current row.
    """
    keys, order, names = list(keys), list(order), list(deltas)
    df = df.withColumn("_chunk", chunk if chunk is not None else F.lit(0))
    parts = keys + ["_chunk"]
    w = Window.partitionBy(*parts).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    running = {f"_s_{n}": F.sum(c).over(upto) for n, c in deltas.items()}
    lows = df.withColumns(running).withColumns({f"_m_{n}": F.min(f"_s_{n}").over(upto) for n in names})
    if before:
        lows = lows.withColumns({f"_p_{n}": F.min(f"_s_{n}").over(prior) for n in names})
    if chunk is None:
        out = lows.withColumns({f"_{p}_{n}": F.lit(0) for n in names for p in "bg"})
    else:
        # Only groups that go on in another chunk have something to carry.
        several = df.groupBy(*keys).agg(F.min("_chunk").alias("_a"), F.max("_chunk").alias("_z")).filter(F.col("_a") < F.col("_z")).select(*keys)
        per_chunk = df.join(several, keys, "left_semi").withColumns(running).groupBy(*parts).agg(
            *[F.sum(c).alias(f"_d_{n}") for n, c in deltas.items()],
            *[F.min(f"_s_{n}").alias(f"_k_{n}") for n in names])
        past = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        base = per_chunk.withColumns({f"_b_{n}": F.coalesce(F.sum(f"_d_{n}").over(past), F.lit(0)) for n in names})
        carried = base.select(*parts, *[f"_b_{n}" for n in names], *[
            F.min(F.col(f"_b_{n}") + F.col(f"_k_{n}")).over(past).alias(f"_g_{n}") for n in names])
        keyed = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in parts])
        out = lows.join(carried, parts, "left").withColumns({f"_b_{n}": F.coalesce(f"_b_{n}", F.when(keyed, 0)) for n in names})

    def value(n: str, s: Column, low: str) -> Column:
        base_n = F.col(f"_b_{n}")
        return base_n + s - F.least(F.lit(0), F.col(f"_g_{n}"), base_n + F.col(low))

    final = {n: value(n, F.col(f"_s_{n}"), f"_m_{n}") for n in names}
    if before:
        final |= {f"{n}_before": value(n, F.col(f"_s_{n}") - c, f"_p_{n}") for n, c in deltas.items()}
    return out.withColumns(final).drop("_chunk", *[f"_{p}_{n}" for n in names for p in "smpbg"])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None,
             name: str = "rn", total: str | None = None) -> DataFrame:
    """1-based position in each group, and optionally the group size."""
    runs = [Run(name, "sum", F.lit(1))]
    if total:
        runs.append(Run(total, "total", F.lit(1)))
    return scan(df, keys, order, runs, chunk)


def group_quantiles(df: DataFrame, keys: Sequence[str], col: str, quantiles: dict[str, float],
                    chunk: Column, weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation per group; ``median`` is ``0.5``.

    Equal values are counted together first, then a running count over the distinct values
    finds the ranks, so no group is gathered anywhere.  ``chunk`` must not decrease with ``col``.  A row stands for ``weight`` equal ones, if given.
    """
    keys = list(keys)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    ranks = scan(counts, keys, [col], [Run("_cum", "sum", F.col("_c")), Run("_n", "total", F.col("_c"))], chunk)
    aggs = []
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("_n") - 1)
        aggs += [F.min(F.when(F.col("_cum") > F.floor(at), F.col(col))).alias(f"_lo_{name}"),
                 F.min(F.when(F.col("_cum") > F.ceil(at), F.col(col))).alias(f"_hi_{name}")]
    got = ranks.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)
    out = {}
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out[name] = lo + (hi - lo) * (at - F.floor(at))
    return got.select(*keys, *[c.alias(n) for n, c in out.items()])


def greedy_islands(df: DataFrame, keys: Sequence[str], pos: str, tie: str, gap, span, chunk: Column) -> DataFrame:
    """Cut each group, ordered by ``pos``, into islands led by their first row.

    A gap of at least ``gap`` starts a new run.  Inside a run a head takes every row closer than
    ``span`` to it, and the first row beyond becomes the next head.  ``tie`` must be unique in
    a group.  Adds ``run`` (number of the gap-free run) and ``head_no`` (number of the island).

    Runs shorter than ``span`` have one head, found by windows alone.  Longer runs follow
    "first row beyond my span" pointers and double the pointers' reach in every pass, so the
    number of passes is logarithmic and no run has to sit in one task.
    """
    from ..session import stage

    keys, order = list(keys), [pos, tie]
    d = scan(df, keys, order, [Run("_prev", "last", F.col(pos), inclusive=False)], chunk)
    opens = F.col("_prev").isNull() | (F.col(pos) - F.col("_prev") >= gap)
    d = d.withColumn("_open", opens).drop("_prev")
    d = stage(scan(d, keys, order, [Run("run", "sum", F.when(F.col("_open"), 1).otherwise(0))], chunk), "runs")
    ends = d.groupBy(*keys, "run").agg(F.min(pos).alias("_a"), F.max(pos).alias("_z"))
    long_ = ends.filter(F.col("_z") - F.col("_a") >= span).select(*keys, "run")
    d = d.withColumn("_head", F.col("_open"))
    if not long_.isEmpty():
        heads = _chain(d.join(long_, keys + ["run"], "left_semi"), keys + ["run"], pos, tie, span, chunk)
        d = d.join(heads.withColumn("_more", F.lit(True)), keys + ["run", tie], "left") \
            .withColumn("_head", F.col("_open") | F.coalesce("_more", F.lit(False))).drop("_more")
    return scan(d, keys, order, [Run("head_no", "sum", F.when(F.col("_head"), 1).otherwise(0))], chunk) \
        .withColumnRenamed("_head", "is_head").drop("_open")


def _chain(rows: DataFrame, keys: list[str], pos: str, tie: str, span, chunk: Column) -> DataFrame:
    """Heads of the given runs: the first row, then the first row beyond each head's span."""
    from ..session import stage

    none = F.lit(None).cast(rows.schema[tie].dataType)
    # Made from one row, not by a union: Spark 4.1 takes a union of two reads of the same exchange for dealt by its keys,
    # also where adaptive execution has coalesced the reads differently, and then groups it wrongly.
    far = (F.col(pos) + span).alias(pos)
    kind = rows.select(far).schema[pos].dataType
    point = F.struct(F.col(pos).cast(kind).alias(pos), tie, F.lit(1).alias("_side"), F.col(tie).alias("_e"), none.alias("_b"))
    ask = F.struct(far, tie, F.lit(0).alias("_side"), none.alias("_e"), F.col(tie).alias("_b"))
    both = rows.select(*keys, F.inline(F.array(point, ask)))
    hop = scan(both, keys, [pos, "_side", tie], [Run("_nx", "next", F.col("_e"), inclusive=False)], chunk)
    jump = stage(hop.filter(F.col("_side") == 0).select(*keys, F.col("_b").alias(tie), F.col("_nx")), "hops")
    heads = stage(rows.groupBy(*keys).agg(F.min_by(tie, F.struct(pos, tie)).alias(tie)), "heads")
    while True:
        step = heads.join(jump, keys + [tie]).filter(F.col("_nx").isNotNull()).select(*keys, F.col("_nx").alias(tie))
        heads = stage(heads.unionByName(step).distinct(), "heads")
        far = jump.select(*keys, F.col(tie).alias("_nx"), F.col("_nx").alias("_nx2"))
        jump = stage(jump.join(far, keys + ["_nx"], "left").select(*keys, tie, F.col("_nx2").alias("_nx")), "jumps")
        if jump.filter(F.col("_nx").isNotNull()).isEmpty():
            return heads
