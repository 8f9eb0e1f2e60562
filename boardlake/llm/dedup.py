"""Near-duplicate documents by min-max hashing.

Under every permutation a shingle set keeps its smallest and its largest hash, two signature
values for one hash evaluation. Bands of ``BAND_ROWS`` values make buckets; a bucket's documents are
compared with one of them on their full sets, and confirmed links are joined to components by star
contraction. Where a bucket isn't all connected by then, its documents meet again by their rarest
shingles, in rounds, until every pair that can be similar is compared or connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytetext as bt
from .common import stage

#: 40 bands of 6 values: a pair at similarity 0.8 misses every bucket with probability 5e-6.
BANDS = 40
BAND_ROWS = 6
PERCENT = 80
#: Documents of a bucket of rare shingles that the others meet in its first round; as many times more in each further one.
PIVOTS = 8
SEED = 20


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text index) of all ``n``-word shingles in order; a text of fewer words is one shingle."""
    data = bt.LOWER[data]
    starts, ends, owner = bt.spans(bt.SPACED[data], offsets)
    hashes = bt.block_hash(data, starts, ends)
    at, out = bt.grams(hashes, owner, n)
    of = owner[at]
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    first = np.searchsorted(owner, np.arange(len(offsets) - 1))
    extra_h, extra_o = [], []
    for m in range(1, n):
        few = np.flatnonzero(counts == m)
        if len(few):
            acc = np.full(len(few), np.uint64(m))
            for j in range(m):
                acc = acc * bt._BASE + hashes[first[few] + j]
            extra_h.append(bt.mix(acc ^ np.uint64(0x5851F42D4C957F2D)))
            extra_o.append(few)
    if extra_h:
        out, of = np.concatenate([out, *extra_h]), np.concatenate([of, *extra_o])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def signatures(hashes: np.ndarray, first: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """Band keys of the sets that start at ``first`` in ``hashes`` (no set may be empty)."""
    rng = np.random.default_rng(SEED)
    n = bands * rows // 2
    xor = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    mul = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.zeros((len(first), bands), np.uint64)
    half = rows // 2
    for i in range(n):
        h = (hashes ^ xor[i]) * mul[i]
        b = i // half
        for extreme in (np.minimum.reduceat(h, first), np.maximum.reduceat(h, first)):
            keys[:, b] = keys[:, b] * bt._BASE + bt.mix(extreme)
    return bt.mix(keys ^ np.arange(1, bands + 1, dtype=np.uint64) * bt._MIX)


def _sets(block: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes of each text in order of text, first of each text, set sizes)."""
    h, of = shingles(*bt.texts(block, "text"), n)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[new], of[new]
    sizes = np.bincount(of, minlength=block.num_rows)
    return h, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), sizes


def _summary(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in bt.blocks(batch, "text"):
                h, first, sizes = _sets(b, n)
                full = np.flatnonzero(sizes)
                same = np.zeros((2, b.num_rows), np.uint64)
                bands = np.zeros((b.num_rows, BANDS), np.uint64)
                if len(full):
                    # order-free digests of the set: equal sets, and only those, share both
                    same[0, full] = np.add.reduceat(bt.mix(h), first[full])
                    same[1, full] = np.bitwise_xor.reduceat(bt.mix(h ^ bt._BASE), first[full])
                    bands[full] = signatures(h, first[full])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * BANDS, pa.int32()), bt.signed(bands.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes.astype(np.int64)), bt.signed(same[0]), bt.signed(same[1]), flat],
                                                 ["id", "n_shingles", "sa", "sb", "bands"])

    return run


def _hash_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in bt.blocks(batch, "text"):
                h, first, _ = _sets(b, n)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), bt.signed(h))], ["id", "set"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``links`` (a, b), for every node in a link.

    Alternating star contraction: every node hooks its larger neighbours to the smallest one, then
    its smaller ones, until nothing changes. Each step is a written table.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    while True:
        # large star: larger neighbours of a node hang on the smallest of its neighbours and itself
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.withColumnRenamed("a", "u").join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = stage(small.filter("a <> b").distinct(), "links")
        # done when every node hangs on one root and no root hangs on another node
        twice = edges.groupBy("a").count().filter("count > 1").select("a")
        if twice.union(edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi")).isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= ``percent`` * union."""
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    both = F.size(F.array_intersect("sa", "sb"))
    sizes = F.size("sa") + F.size("sb")
    # The sizes alone rule out most pairs that cannot reach the similarity.
    fits = (100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb")))
    return pairs.join(right, "b").join(left, "a").filter(fits).filter(100 * both >= percent * (sizes - both)).select("a", "b")


def fits(percent: int) -> Column:
    """Whether two bucket rows (n, left of one, m, pivot_left of the other) can still be similar.

    The sizes must allow it, and so must the shingle they share, if it is the first in the order of both: the overlap is at most
    that one and what each has behind it. Pairs are met at their first common shingle, so none is lost.
    """
    small, large = F.least("n", "m"), F.greatest("n", "m")
    return (100 * small >= percent * large) & ((1 + F.least("left", "pivot_left")) * (100 + percent) >= percent * (F.col("n") + F.col("m")))


class Comparison:
    """Comparison of the documents of buckets on their full sets, and what is connected so far.

    Bucket rows are (bucket, rep, n, left): a document, its set's size, and how many of its shingles come behind the one that makes the bucket.
    """

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.links: DataFrame | None = None
        self.tried: DataFrame | None = None
        self.roots: DataFrame | None = None

    def mixed(self, buckets: DataFrame) -> DataFrame:
        """The rows of those buckets whose documents aren't all connected yet, with what they are connected to."""
        named = buckets.join(self.roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        several = named.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
        return stage(named.join(several, "bucket").select("bucket", "rep", "n", "left", "root"), "buckets")

    def connect(self, found: DataFrame) -> None:
        """Add links. Only new ones between unlike components are contracted; those found before are one table of roots."""
        self.links = found if self.links is None else self.links.union(found)
        if self.roots is None:
            self.roots = stage(components(found), "roots")
            return
        of = lambda c: self.roots.toDF(c, f"{c}_root")
        new = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        new = stage(new.filter("a <> b").distinct(), "root-links")
        if new.isEmpty():
            return
        joined = stage(components(new).toDF("of", "to"), "root-components")
        moved = self.roots.join(joined, F.col("root") == F.col("of"), "left").select("node", F.coalesce("to", "root").alias("root"))
        fresh = joined.toDF("node", "root").join(self.roots, "node", "left_anti")
        self.roots = stage(moved.unionByName(fresh), "roots")

    def compare(self, buckets: DataFrame, pivots: int) -> DataFrame:
        """Compare each bucket (rows of bucket, rep, root) with ``pivots`` of its documents; the rows still open.

        Pivots come from a bucket's smallest components first, so that a large one needs none of its
        own, and the best connected of them first, so that a family's centre comes early. A
        pivot leaves its bucket, as it has met all others; pairs that are connected or were
        compared in another bucket are left out.
        """
        ranked = buckets.withColumns({"same": F.lit(1).cast("long"), "degree": F.lit(0).cast("long")})
        if self.links is not None:
            degree = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
            same = buckets.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("same"))
            ranked = buckets.join(same, ["bucket", "root"]).join(degree, "rep", "left").fillna(0, ["degree"])
        best = F.struct("same", (-F.col("degree")).alias("d"), F.col("rep").alias("pivot"), F.col("root").alias("pivot_root"), F.col("n").alias("m"), F.col("left").alias("pivot_left"))
        lead = (ranked.groupBy("bucket").agg(F.min(best).alias("best")) if pivots == 1 else
                ranked.select("bucket", best.alias("best")).withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("best"))).filter(F.col("r") <= pivots))
        lead = stage(lead.select(F.col("bucket").alias("of"), "best.pivot", "best.pivot_root", "best.m", "best.pivot_left"), "pivots")
        meet = (F.col("bucket") == F.col("of")) & (F.col("root") != F.col("pivot_root")) & fits(self.percent)
        pairs = buckets.join(lead, meet).select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        found = stage(confirmed(pairs, self.sets, self.percent), "confirmed")
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        self.connect(found)
        done = lead.select(F.col("of").alias("bucket"), F.col("pivot").alias("rep"))
        return self.mixed(buckets.drop("root").join(done, ["bucket", "rep"], "left_anti"))

    def rare(self, buckets: DataFrame) -> DataFrame:
        """Finer buckets that hold every similar pair of the documents in ``buckets``.

        A passage that many documents share puts unlike ones in one bucket. Of two sets with
        similarity p %, each shares one of its rarest n - ceil(p % of n) + 1 shingles with the other's,
        so the buckets are those shingles, rarity counted among the documents that are left.
        """
        some = self.sets.join(buckets.select(F.col("rep").alias("id")).distinct(), "id")
        each = stage(some.select("id", F.size("set").alias("n"), F.explode("set").alias("bucket")), "open-shingles")
        known = stage(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("df")), "open-counts")
        place = F.row_number().over(Window.partitionBy("id").orderBy("df", "bucket"))  # one document's shingles
        first = F.col("n") - F.expr(f"({self.percent} * n + 99) div 100") + 1
        return each.join(known, "bucket").withColumn("place", place).filter((F.col("place") <= first) & (F.col("df") > 1)).select(
            "bucket", F.col("id").alias("rep"), "n", (F.col("n") - F.col("place")).alias("left"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept), one row per row of ``docs``.

    A document's set is its distinct ``words``-word shingles of A-Z lower-cased words between ASCII
    white space, or the whole sequence if it has fewer; documents are linked where 100 * intersection
    >= ``percent`` * union, and ``component_id`` is the smallest key reachable. Texts without words
    and nulls have an empty set, are linked with nothing and kept. Repeated rows share a component
    and are both kept if their key is the component's (a key stands for one text); null keys give
    component null and are kept. Only key and text are read. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    summary = stage(rows.mapInArrow(_summary(words), f"id {kind}, n_shingles long, sa long, sb long, bands array<long>"), "shingle-summary")
    # Equal sets collapse before anything is compared; only their smallest document goes on.
    known = summary.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = stage(known.groupBy("sa", "sb", "n_shingles").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")), "shingle-classes")
    banded = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count_distinct("rep").alias("n")).filter("n > 1").select("bucket")
    buckets = stage(banded.join(shared, "bucket").select("bucket", "rep", "n", F.col("n").alias("left")), "buckets")
    members = buckets.select(F.col("rep").alias("id")).distinct()
    sets = stage(rows.filter("id IS NOT NULL").join(members, "id").dropDuplicates(["id"]).mapInArrow(_hash_sets(words), f"id {kind}, set array<long>"), "sets")
    work = Comparison(sets, percent)
    left = work.compare(buckets.withColumn("root", F.col("rep")), 1)
    if not left.isEmpty():
        left, pivots = work.mixed(work.rare(left)), PIVOTS
        while not left.isEmpty():
            left = work.compare(left, pivots)
            pivots *= PIVOTS
    named = classes.select("sa", "sb", F.col("n_shingles").alias("n"), "rep").join(work.roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = stage(named.select("sa", "sb", "n", F.coalesce("root", "rep").alias("component")), "components")
    s = summary.select("id", "n_shingles", "sa", "sb")
    own = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    on = (s.sa == named.sa) & (s.sb == named.sb) & (s.n_shingles == named.n)
    out = s.filter(own).join(named, on, "left").select("id", "n_shingles", "component").union(s.filter(~own).select("id", "n_shingles", F.col("id")))
    return out.select(F.col("id").alias(key), "n_shingles", F.col("component").alias("component_id"),
                      (F.col("id").isNull() | (F.col("id") == F.col("component"))).alias("kept"))
