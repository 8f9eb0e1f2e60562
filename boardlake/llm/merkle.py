"""Merkle manifest of a dataset: one tree per group of rows, and one over the groups' subroots.

Rows become leaves in order of their key. Every ``FANOUT`` consecutive nodes of a level are a run and
hash to one node of the next. A level is read by lag and lead columns of a fixed offset, masked by
the node's slot in its run and by the run's length; the first child's row hashes the parent. Windows
hold aligned blocks of ``FANOUT ** LEVELS`` nodes, so a group of any size is spread over all tasks, and
one exchange serves ``LEVELS`` levels. The blocks' nodes are the next, much smaller table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

FANOUT = 3
#: Levels that one pass of windows climbs; a block has FANOUT ** LEVELS nodes.
LEVELS = 5
_PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else byte count, ``:`` and value in UTF-8."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lower-case hex SHA-256 of a row's fields in order."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with their ``place`` in group ``g`` (from 0) and ``n``, the group's size.

    Ranges of (group, order) are numbered apart and their counts scanned, so no group is one window.
    """
    ranges = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in order]
    # The range of a row is written down once: a rerun of lost tasks cannot deal it elsewhere.
    dealt = stage(nodes.repartitionByRange(ranges, F.col("g"), *keys).withColumn("range", F.spark_partition_id()), "merkle-ranges")
    group = Window.partitionBy("g")
    before = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("g", "range").agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.select("g", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("skip"), F.sum("rows").over(group).alias("n"))
    inside = Window.partitionBy("g", "range").orderBy(*keys)
    return stage(dealt.join(sizes, ["g", "range"]).withColumn("place", F.col("skip") + F.row_number().over(inside) - 1).drop("skip", "range"), "merkle-nodes")


def _climbed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (g, place, n, digest) with ``block``; ``up``, on a block's first row the digest of the node
    that covers the block; and ``path``, each row's (before, after) siblings by level, hex digests joined."""
    w = Window.partitionBy("g", "block").orderBy("place")
    down = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = nodes.withColumn("block", F.expr(f"place div {FANOUT ** LEVELS}")).withColumn("up", F.col("digest")).withColumn("left", F.col("n"))
    for level in range(LEVELS):
        step = FANOUT ** level
        slot = F.expr(f"place div {step} % {FANOUT}")
        run = F.least(F.lit(FANOUT), F.col("left") - F.expr(f"place div {step}") + slot)  # nodes in this node's run
        here = (F.col("place") % step == 0) & (F.col("left") > 1)
        before = F.concat(*[F.when(slot >= k, F.lag("up", k * step).over(w)).otherwise("") for k in range(FANOUT - 1, 0, -1)])
        after = F.concat(*[F.when(slot + k < run, F.lead("up", k * step).over(w)).otherwise("") for k in range(1, FANOUT)])
        rows = rows.withColumns({f"b{level}": F.when(here, before), f"a{level}": F.when(here, after)})
        parent = F.when(here & (slot == 0), F.sha2(F.concat("up", F.col(f"a{level}")), 256)).when(F.col("left") <= 1, F.col("up"))
        rows = rows.withColumn("up", parent).withColumn("left", F.expr(f"(left + {FANOUT - 1}) div {FANOUT}"))
    # A level's siblings stand on its node's first row and hold for all rows below that node.
    steps = [F.last(F.when(F.col(f"b{i}").isNotNull(), F.struct(F.col(f"b{i}").alias("before"), F.col(f"a{i}").alias("after"))), ignorenulls=True).over(down) for i in range(LEVELS)]
    return rows.withColumn("path", F.array_compact(F.array(*steps))).drop(*[f"{x}{i}" for i in range(LEVELS) for x in "ab"])


def _passes(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the tables above, the last with one row per group."""
    tables, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while len(tables) == 1 or most > 1:
        nodes = _climbed(tables[-1].select("g", "place", "n", "digest")).filter(F.col("place") % FANOUT ** LEVELS == 0)
        nodes = nodes.select("g", F.col("block").alias("place"), F.col("left").alias("n"), F.col("up").alias("digest"))
        tables.append(stage(nodes, "merkle-level"))
        most = reduce(lambda n, _: -(-n // FANOUT), range(LEVELS), most)
    return tables


def _down(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """The first table's rows with ``path`` up to the root and what ``top`` (g, block, path, ...) has for their group."""
    more = [c for c in top.columns if c not in ("g", "block", "path")]
    for nodes in reversed(tables[:-1]):
        above = top.withColumnRenamed("path", "further")
        rows = _climbed(nodes).join(above, ["g", "block"]).withColumn("path", F.concat("path", "further"))
        if nodes is tables[0]:
            return rows
        top = rows.select("g", F.col("place").alias("block"), "path", *more)


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "source", digest: str = "leaf", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, group, digest, carry..., path, subroot, root), one row per row of ``rows``.

    ``digest`` holds each row's leaf, hex. Leaves of a group ascend by key (nulls first, rows of one key
    by digest) and fold to its subroot; subroots ascend by group (null first, then by UTF-8 bytes) and
    fold to the root. ``path`` lists the sibling digests of each level, (before, after), from the leaf
    to the root. Null keys and groups are values like others, repeated rows are leaves of their
    own, an empty table gives no rows. Texts enter as digests, so their length does not matter. Other
    columns are not read; names cannot clash.
    """
    group_kind, key_kind = rows.schema[group].dataType, rows.schema[key].dataType
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # "-" sorts before "="
    own = F.struct(F.col(group).alias("group"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    leaves = rows.select(named.alias("g"), F.col(key).alias("key"), F.col(digest).alias("digest"), own.alias("carry"))
    lower = _passes(_placed(stage(leaves, "merkle-leaves"), ["key", "digest"]))
    subroots = lower[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    upper = _passes(_placed(subroots, ["name"]))
    top = upper[-1].select("g", F.col("place").alias("block"), F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    top = _down(upper, top).select(F.col("name").alias("g"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root")
    out = _down(lower, stage(top, "merkle-subroots"))
    return out.select(F.col("key").cast(key_kind).alias(key), F.col("carry.group").cast(group_kind).alias(group), F.col("digest").alias(digest),
                      *[F.col(f"carry.c{i}").alias(c) for i, c in enumerate(carry)], "path", "subroot", "root")


def proof(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from leaf to root and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings; equal to the manifest's unless the row was changed."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def verified(docs: DataFrame, tampered: Column, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             text: str = "text") -> DataFrame:
    """Build the manifest of ``docs`` and check every row against it: (key, leaf, subroot, root,
    proof_sha256, folded_root, verified).

    Rows where ``tampered`` holds are checked with the line ends of ``text`` deleted (a null
    condition or a null text changes nothing). ``columns`` enter the leaf in this order, integers in decimal, each null as ``-``; an empty text
    is ``0:``. Whole texts are hashed in place and never shuffled. Rows as in `manifest`.
    """
    changed = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text else F.col(c) for c in columns]
    given = F.when(tampered, leaf(*changed))
    leaves = docs.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf(*[F.col(c) for c in columns]).alias("leaf"), given.alias("given"))
    found = manifest(leaves, "key", "group", "leaf", ("given",)).withColumn("folded_root", folded(F.coalesce("given", "leaf"), F.col("path")))
    return found.select(F.col("key").alias(key), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
