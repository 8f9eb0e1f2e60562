"""Mix sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, repeated up to ``max_repeats`` times. A copy's
virtual finish time is the source's words up to its end divided by the source's target. Copies are
range-sorted by finish time, their words are added up in that order and cut at the budget; a copy that
is in service across a slot of virtual time gives each slot its part, so a document in service at the cut gives the
words served so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running_total, stage, word_count

MAX_REPEATS = 3
#: Parts of a source's shuffled order; a window holds one part of one source.
PARTS = 4096
#: Slots of virtual time, the range partitions of the sort, until every queue has reached its target.
SLOTS = 4096


def cycle_weights(sources: DataFrame, source: str = "source", cycle: int = 3) -> DataFrame:
    """(source, weight): 1, 2, .. ``cycle``, repeating, by the source's code points, null last.

    Sources are compared by their UTF-8 bytes, which is code point order. One row per source: the
    size of a mixing plan, not of the data.
    """
    order = Window.orderBy(F.col(source).asc_nulls_last())
    return sources.select(source).distinct().select(source, ((F.row_number().over(order) - 1) % cycle + 1).cast("long").alias("weight"))


def fill_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): weighted shares of all sizes, none above
    ``max_repeats`` times the source's size, the excess shared again by weight.

    Sources stop in the order of size / weight, so the level at which the rest shares follows from
    running sums; no loop. With nothing to share every target is 0.
    """
    room = F.lit(max_repeats) * F.col("source_size")
    order = Window.orderBy(room.cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = (sizes.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum(room).over(before), F.lit(0)))
         .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("stops", F.col("left") * F.col("weight") > room * F.col("left_weight")))
    # The first source that doesn't stop sets the level of all after it.
    level = t.filter(~F.col("stops")).select(F.struct(
        (room.cast("double") / F.col("weight")).alias("o"), F.col("source").isNull().alias("z"), "source", "left", "left_weight").alias("s")).agg(F.min("s").alias("s"))
    out = t.crossJoin(F.broadcast(level.select("s.left", "s.left_weight").toDF("l", "lw")))  # one row
    return out.select("source", "source_size", "weight", F.when(F.col("stops"), room.cast("double")).otherwise(
        (F.col("l") * F.col("weight")).cast("double") / F.col("lw").cast("double")).alias("target"))


def _segments(queued: DataFrame, max_repeats: int, slots: int) -> DataFrame:
    """(source, slot, words, finish): the copies of all queues, cut where a slot of virtual time ends.

    A queue has given ``floor(slot * target / slots)`` words by the end of a slot. Nothing is asked of a queue
    beyond twice the time in which all reach their targets, since the budget is spent by then.
    """
    by = lambda k: F.floor(k.cast("double") * F.col("target") / slots)
    near = lambda w: F.ceil(w.cast("double") * slots / F.col("target"))
    copies = queued.filter("size > 0").select("source", "size", "target", F.explode(F.array(*[
        F.col("start") + F.lit(i) * F.col("source_size") for i in range(max_repeats)])).alias("_from"))
    copies = copies.withColumn("_till", F.col("_from") + F.col("size")).filter(F.col("_from") < 2 * F.col("target"))
    last = F.least(F.lit(2 * slots).cast("long"), near(F.col("_till")) + 1)
    cut = copies.withColumn("slot", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.least(near(F.col("_from") + 1) - 1, last)), last)))
    cut = cut.withColumn("_end", F.least("_till", by(F.col("slot")))).withColumn("words", F.col("_end") - F.greatest("_from", by(F.col("slot") - 1)))
    return cut.filter("words > 0").select("source", "slot", "words", (F.col("_end").cast("double") / F.col("target")).alias("finish"))


def served(queued: DataFrame, targets: DataFrame, budget: Column | int | None = None, max_repeats: int = MAX_REPEATS, slots: int = SLOTS) -> DataFrame:
    """(source, served): the words that each queue has given when all, in order of finish time, reach the budget.

    ``queued`` has ``source, size, start, source_size, target``, ``targets`` one row per source. The budget (default: all words) counts
    whole words, so it is at most the whole words of the targets. Words are summed per slot and source before they are sent on; slots before the
    budget's are taken whole, and the slot in which it ends is sorted by finish time, then source, null last, and cut.
    """
    words = F.sum(F.floor("target"))
    cap = targets.agg((words if budget is None else F.least(words, F.lit(budget).cast("long"))).alias("_cap"))
    sums = stage(_segments(queued, max_repeats, slots).groupBy("slot", "source").agg(F.sum("words").alias("words")), "mix-slots")
    order = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # one row per slot
    ends = sums.groupBy("slot").agg(F.sum("words").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(order), F.lit(0)))
    ends = ends.crossJoin(cap).select("slot", "_all", F.greatest(F.lit(0), F.least("_all", F.col("_cap") - F.col("_before"))).alias("_room"))  # cap: one row
    ends = stage(ends.filter("_room > 0"), "mix-ends")
    whole = sums.join(ends.filter("_room = _all").select("slot"), "slot").select("source", "words")
    part = _segments(queued, max_repeats, slots).join(ends.filter("_room < _all"), "slot")
    part = part.withColumn("_sub", F.floor(F.col("finish") * slots * PARTS)).withColumn("_last", F.col("source").isNull())
    part = running_total(part, ["slot"], "_sub", ["finish", "_last", "source"], "words", "_at")
    part = part.select("source", F.greatest(F.lit(0), F.least("words", F.col("_room") - F.col("_at"))).alias("words"))
    return whole.unionByName(part).groupBy("source").agg(F.sum("words").alias("served"))


def schedule(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: DataFrame | None = None,
             budget: Column | int | None = None, max_repeats: int = MAX_REPEATS, seed: str = "mix", keep: tuple[str, ...] = (), count: str | None = None) -> DataFrame:
    """One row per document: key, ``size``, ``source_size``, ``target``, ``start`` (words of its source
    before it), ``copies`` (array of virtual finish time and words taken, in queue order) and ``taken``.

    ``weights`` has (source, weight); by default sources weigh 1, 2, 3 in turn. ``budget`` (default:
    all words) cuts the sorted mix, see `served`. The order inside a source is by
    MD5 of seed and key, then key and size, so reruns agree. Null text has 0 words and takes none;
    null sources are one source; repeated rows are queued as many times as they come. Columns named
    in ``keep`` are carried along; all others are dropped, so clashing names do no harm. ``count`` names
    the number of equal rows that a row stands for: they are queued one behind another, ``size`` is the
    words of all of them, and their number is carried along as ``rows``.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), (word_count(F.col(text)) * (F.col(count) if count else F.lit(1))).alias("size"),
                       *([F.col(count).alias("rows")] if count else []), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    rows = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("_key").cast("string"), F.lit("null")))))
    rows = rows.withColumn("_part", (F.conv(F.substring("_h", 1, 6), 16, 10).cast("long") % PARTS))
    rows = rows.withColumn("_h", F.concat(F.lpad(F.col("_part").cast("string"), 6, "0"), F.col("_h")))
    rows = stage(rows, "mix-rows")  # texts are read once
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = weights if weights is not None else cycle_weights(sizes)
    w = weights.toDF("_s", "weight")
    targets = stage(fill_targets(sizes.join(w, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), max_repeats), "mix-targets")
    queued = running_total(rows, ["source"], "_part", ["_h", "_key", "size"], "size", "start")
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    queued = stage(queued.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-queues")
    gave = served(queued.select("source", "size", "start", "source_size", "target"), targets, budget, max_repeats)
    gave = stage(gave.select(F.col("source").alias("_s"), F.col("served").alias("_served")), "mix-served")
    out = queued.join(gave, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("_served", F.coalesce("_served", F.lit(0)))
    copies = F.array(*[F.struct(
        F.try_divide((F.col("start") + F.col("size") + F.lit(i) * F.col("source_size")).cast("double"), F.col("target")).alias("finish"),
        F.greatest(F.lit(0), F.least(F.col("size"), F.col("_served") - F.col("start") - F.lit(i) * F.col("source_size"))).cast("long").alias("words"))
        for i in range(max_repeats)])
    out = out.withColumn("copies", copies)
    taken = sum((F.col("copies")[i]["words"] for i in range(1, max_repeats)), F.col("copies")[0]["words"])
    return out.select(F.col("_key").alias(key), "source", "size", "source_size", "target", "start", "copies", taken.alias("taken"), *(["rows"] if count else []),
                      *[F.col(f"_keep_{c}").alias(c) for c in keep])


def mix(scheduled: DataFrame, whole: bool = False, slots: int = 4096) -> DataFrame:
    """The mix in order: one row per copy taken, with ``finish``, ``words`` and ``position``, the words
    of the mix before it.

    Since every queue is served at the rate of its target, words are spread evenly over virtual
    time: equal slots of it hold about equally many words, and positions are running sums over
    slots and inside a slot. Rows come range-sorted by position. ``whole`` keeps only copies
    that are taken to their end; of a row that stands for several, the words of those taken to their end.
    """
    n_cols = [c for c in scheduled.columns if c != "copies"]
    rows = scheduled.select(*n_cols, F.posexplode("copies").alias("copy", "_c")).select(
        *n_cols, "copy", F.col("_c.finish").alias("finish"), F.col("_c.words").alias("words"))
    if whole:
        one = F.expr("size div rows") if "rows" in n_cols else F.col("size")
        rows = rows.withColumn("words", F.col("words") - F.col("words") % F.nullif(one, F.lit(0)))
    rows = rows.filter(F.col("words") > 0)
    rows = rows.withColumn("_slot", F.floor(F.col("finish") * slots)).withColumn("_all", F.lit(0))
    out = running_total(rows, ["_all"], "_slot", ["finish", "source", n_cols[0], "copy"], "words", "position")
    return out.drop("_slot", "_all").repartitionByRange(F.col("position")).sortWithinPartitions("position")
