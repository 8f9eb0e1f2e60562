"""Removal of repeated substrings with suffix arrays.

A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller key.
Every such string has one smallest k-gram hash (its anchor), so equal strings meet at equal
anchors. Anchors that only one document has are dropped first. Around the others, documents give
their contexts (the strings with that anchor); equal contexts collapse, and where different ones
share strings, a suffix array over them tells which strings are equal and the smallest document
that has each. Exact copies of a text are settled by its digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import stage
from .suffixes import suffix_array

LENGTH = 50
GRAM = 16
#: Bytes of text per anchor bucket; a task sorts one bucket (about as many bytes) at a time.
BUCKET_BYTES = 16 << 20
#: Bytes of contexts that one suffix array takes in; contexts of one anchor stay together.
SUFFIX_BYTES = 32 << 10
#: Neighbours of a suffix array compared at a time.
COMPARED = 1 << 14
#: Rows of one context that wait in a task; contexts with more rows are joined.
WAITING = 256
_KEY = np.uint64((1 << 40) - 1)


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, text index, first start, last start) of the runs of strings with one anchor."""
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none
    prefix = bt.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    low = bt.span_hash(prefix, at, at + gram)
    width, have = length - gram + 1, 1
    while have < width:  # smallest of `width` neighbours, in doubling steps
        step = min(have, width - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    low = low[:n]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + length <= offsets[owner + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    low, owner = low[starts], owner[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return low[first], owner[first], starts[first], starts[last]


def _named(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 40-bit key in it) of anchor hashes."""
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), h & _KEY


def _packed(buckets: int, length: int):
    """One row per bucket and batch with the anchors of all its texts, five bytes a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, where, owners, whole, base = [], [], [], [], 0
            for b in bt.blocks(batch, "text"):
                data, offsets = bt.texts(b, "text")
                h, of, _, _ = anchor_runs(data, offsets, length)
                whole.append(bt.block_hash(data, offsets[:-1], offsets[1:]))
                bucket, key = _named(h, buckets)
                keys.append(key), where.append(bucket), owners.append(of + base)
                base += b.num_rows
            if not keys:
                continue
            key, bucket, of = np.concatenate(keys), np.concatenate(where), np.concatenate(owners)
            ids, whole = np.asarray(batch.column("id"), dtype=np.int64), np.concatenate(whole)
            order = np.argsort(bucket, kind="stable")
            key, bucket, of = key[order], bucket[order], of[order]
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else [], len(bucket)).astype(int)
            rows = []
            for lo, hi in zip(cut[:-1], cut[1:]):
                docs, at = np.unique(of[lo:hi], return_inverse=True)
                k = key[lo:hi]
                rows.append((int(bucket[lo]), ids[docs].tobytes(), whole[docs].tobytes(), (k & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (k >> np.uint64(32)).astype(np.uint8).tobytes(), at.astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6)]],
                                             ["bucket", "ids", "texts", "low", "high", "at"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, anchor) of the anchors that two different texts or more have; rows come sorted by bucket."""
    held: list[tuple] = []
    current = None

    def settle() -> Iterator[pa.RecordBatch]:
        key = np.concatenate([np.frombuffer(r[2], np.uint32).astype(np.uint64) | np.frombuffer(r[3], np.uint8).astype(np.uint64) << np.uint64(32) for r in held])
        doc, text = (np.concatenate([np.frombuffer(r[i], kind)[np.frombuffer(r[4], np.uint32)] for r in held]) for i, kind in ((0, np.int64), (1, np.uint64)))
        order = np.argsort(key, kind="stable")
        key, doc, text = key[order], doc[order], text[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        several = np.minimum.reduceat(text, first) < np.maximum.reduceat(text, first)
        keep = np.repeat(several, size)
        name = (key[keep] | np.uint64(current) << np.uint64(40)).view(np.int64)
        pairs = np.unique(np.stack([doc[keep], name]), axis=1) if keep.any() else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["id", "anchor"])

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("bucket", "ids", "texts", "low", "high", "at")]
        for bucket, *rest in zip(*cols):
            if bucket != current:
                if held:
                    yield from settle()
                held, current = [], bucket
            held.append(tuple(rest))
    if held:
        yield from settle()


def _contexts(buckets: int, length: int):
    """(anchor, ctx hash, id, start, ctx) of the shared anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in bt.blocks(batch, "text"):
                data, offsets = bt.texts(b, "text")
                h, of, first, last = anchor_runs(data, offsets, length)
                bucket, key = _named(h, buckets)
                name = key | bucket.astype(np.uint64) << np.uint64(40)
                lists = b.column("anchors")
                wanted = np.asarray(lists.flatten(), dtype=np.int64).view(np.uint64)
                whose = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
                salt = lambda a, o: bt.mix(a ^ bt.mix(o.astype(np.uint64) + np.uint64(1)))
                hit = np.flatnonzero(np.isin(salt(name, of), salt(wanted, whose)))
                lo, hi = first[hit], last[hit] + length
                sizes = hi - lo
                ends = np.append(0, np.cumsum(sizes))
                take = np.arange(ends[-1]) + np.repeat(lo - ends[:-1], sizes)
                raw = np.ascontiguousarray(data[take])
                ctx = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                ids = np.asarray(b.column("id"), dtype=np.int64)[of[hit]]
                yield pa.RecordBatch.from_arrays([bt.signed(name[hit]), bt.signed(bt.block_hash(raw, ends[:-1], ends[1:])), pa.array(ids),
                                                  pa.array((lo - offsets[of[hit]]).astype(np.int64)), ctx], ["anchor", "ctx", "id", "start", "bytes"])

    return run


def lowest(contexts: list[bytes], ids: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, the smallest document that has each of its strings.

    ``ids``: the smallest document of each context. Strings that no other context shares are
    settled at once; over the runs of the others, each taken once, a suffix array finds the equal ones.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    offsets = np.append(0, np.cumsum(sizes))
    data = np.frombuffer(b"".join(contexts), np.uint8)
    counts = sizes - length + 1
    base = np.append(0, np.cumsum(counts))
    of = np.repeat(np.arange(len(contexts)), counts)
    start = np.arange(base[-1]) - base[of] + offsets[of]
    low = ids[of].copy()
    _, back, times = np.unique(bt.span_hash(bt.prefix_hash(data), start, start + length), return_inverse=True, return_counts=True)
    shared = times[back] > 1
    del back, times
    fresh = np.append(True, (of[1:] != of[:-1]) | ~shared[:-1])
    over = np.append((of[1:] != of[:-1]) | ~shared[1:], True)
    pieces: dict[bytes, list] = {}
    for p, q in zip(np.flatnonzero(shared & fresh).tolist(), (np.flatnonzero(shared & over) + 1).tolist()):
        piece = data[start[p]:start[q - 1] + length].tobytes()
        entry = pieces.setdefault(piece, [ids[of[p]], []])
        entry[0] = min(entry[0], ids[of[p]])
        entry[1].append(p)
    if not pieces:
        return [low[a:b] for a, b in zip(base[:-1], base[1:])]
    # Symbols: bytes + 1, and 0 between pieces; strings over a 0 are not looked at.
    whole = b"\0".join(pieces)
    raw = np.frombuffer(whole, np.uint8)
    begins = np.append(0, np.cumsum([len(p) + 1 for p in pieces]))[:-1]
    lengths = np.array([len(p) for p in pieces], np.int64)
    symbols = raw.astype(np.int64) + 1
    symbols[(begins[1:] - 1)] = 0
    owner = np.repeat(np.arange(len(pieces)), lengths + 1)[:len(raw)]
    valid = np.arange(len(raw)) - begins[owner] + length <= lengths[owner]
    order = suffix_array(symbols)
    order = order[valid[order]]
    strings = sliding_window_view(raw, length)
    left, right = order[:-1], order[1:]
    same = np.zeros(len(left), bool)
    for at in range(0, len(left), COMPARED):
        part = slice(at, at + COMPARED)
        same[part] = (strings[left[part]] == strings[right[part]]).all(1)
    heads = np.flatnonzero(np.append(True, ~same))
    first = np.array([e[0] for e in pieces.values()], np.int64)[owner[order]]
    least = np.minimum.reduceat(first, heads)
    by_place = np.zeros(len(raw), np.int64)
    by_place[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
    for (piece, (_, places)), begin in zip(pieces.items(), begins):
        n = len(piece) - length + 1
        for p in places:
            low[p:p + n] = np.minimum(low[p:p + n], by_place[begin:begin + n])
    return [low[a:b] for a, b in zip(base[:-1], base[1:])]


def _resolve(length: int):
    """From contexts sorted by (anchor, ctx, id): (id, start, stop) of the bytes that go, with null anchor.

    Rows of a context wait until it is settled. A context with more than ``WAITING`` rows is written as its rows without
    bytes and one row with null id and the runs of strings that have one smallest document, to be joined.
    Strings that no row has from a smaller document are left out.
    """

    names = ["anchor", "ctx", "id", "start", "stop", "first", "last", "low"]

    def table(n: int, **cols) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(names, kinds)], names)

    def settle(items: list[list]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, int] = {}
        for x in items:
            groups[x[0]] = groups.get(x[0], 0) + 1
        alone = np.array([groups[x[0]] == 1 for x in items])
        least = np.array([x[3] for x in items], np.int64)
        # Runs of strings with one smallest document; a context alone with its anchor is one run.
        item, one = np.flatnonzero(~alone), np.flatnonzero(alone)
        lows = lowest([items[i][2] for i in item.tolist()], least[item], length) if len(item) else []
        low = np.concatenate(lows) if lows else np.zeros(0, np.int64)
        counts = np.array([len(x) for x in lows], np.int64)
        of = np.repeat(np.arange(len(item)), counts)
        head = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (of[1:] != of[:-1]))) if len(low) else np.zeros(0, np.int64)
        tail = np.append(head[1:], len(low))[:len(head)] - 1
        begin = (np.cumsum(counts) - counts)[of[head]]
        owner = np.concatenate([item[of[head]], one])
        first, last = np.concatenate([head - begin, np.zeros(len(one), np.int64)]), np.concatenate([tail - begin, np.array([len(items[i][2]) - length for i in one.tolist()], np.int64)])
        low = np.concatenate([low[head], least[one]])
        keep = np.flatnonzero(low < np.array([x[4] for x in items], np.int64)[owner])
        keep = keep[np.argsort(owner[keep], kind="stable")]
        owner, first, last, low = owner[keep], first[keep], last[keep], low[keep]
        cut = np.searchsorted(owner, np.arange(len(items) + 1))
        # Each row that waits meets the runs of its context.
        here = [i for i in np.unique(owner).tolist() if items[i][5] is not None]
        if here:
            rows = [items[i][5] for i in here]
            whose = np.repeat(here, [len(r[0]) for r in rows])
            ids, start = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
            times = np.diff(cut)[whose]
            row = np.repeat(np.arange(len(ids)), times)
            at = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + cut[whose][row]
            hit = low[at] < ids[row]
            row, at = row[hit], at[hit]
            yield table(len(row), id=ids[row], start=start[row] + first[at], stop=start[row] + last[at] + length)
        spread = [i for i in np.unique(owner).tolist() if items[i][5] is None]
        if spread:
            parts = [slice(cut[i], cut[i + 1]) for i in spread]
            yield table(len(spread), anchor=[items[i][0] for i in spread], ctx=[items[i][1] for i in spread],
                        **{n: [v[p].tolist() for p in parts] for n, v in (("first", first), ("last", last), ("low", low))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []  # [anchor, ctx, bytes, smallest id, largest id, (ids, starts) that wait] of whole anchors, not yet settled
        open_: list[list] = []  # of the anchor that is still read
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            anchor, ctx, ids, start = (np.asarray(b.column(c), dtype=np.int64) for c in ("anchor", "ctx", "id", "start"))
            new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (ctx[1:] != ctx[:-1])))
            sizes = np.diff(np.append(new, b.num_rows))
            now = np.repeat(sizes > WAITING, sizes)
            goes_on = bool(open_ and open_[-1][0] == anchor[0] and open_[-1][1] == ctx[0])  # from the batch before
            if goes_on:
                x, n = open_[-1], int(sizes[0])
                x[4] = int(ids[n - 1])
                if x[5] is not None and len(x[5][0]) + n <= WAITING:
                    x[5] = tuple(np.append(old, more[:n]) for old, more in zip(x[5], (ids, start)))
                else:
                    now[:n] = True
                    if x[5] is not None:
                        k = len(x[5][0])
                        yield table(k, anchor=[x[0]] * k, ctx=[x[1]] * k, id=x[5][0], start=x[5][1])
                        x[5] = None
            if now.any():
                yield table(int(now.sum()), anchor=anchor[now], ctx=ctx[now], id=ids[now], start=start[now])
            content = b.column("bytes").take(pa.array(new)).to_pylist()
            for i, n, c in list(zip(new.tolist(), sizes.tolist(), content))[goes_on:]:
                a = int(anchor[i])
                if open_ and open_[-1][0] != a:
                    if len(open_) > 1:
                        size += sum(len(y[2]) for y in open_)
                    done += open_
                    open_ = []
                    if size >= SUFFIX_BYTES or len(done) > 5000:
                        yield from settle(done)
                        done, size = [], 0
                open_.append([a, int(ctx[i]), c, int(ids[i]), int(ids[i + n - 1]), (ids[i:i + n].copy(), start[i:i + n].copy()) if n <= WAITING else None])
        if done or open_:
            yield from settle(done + open_)

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, a, n_removed, n_spans, kept_sha256) from texts and their removed runs."""
    for b in batches:
        out = []
        for text, runs in zip(b.column("text"), b.column("runs")):
            raw = (text.as_py() or "").encode()
            r = np.array([(x["s"].as_py(), x["e"].as_py()) for x in runs], np.int64)
            r = r[np.argsort(r[:, 0], kind="stable")]
            reach = np.maximum.accumulate(r[:, 1])
            head = np.flatnonzero(np.append(True, r[1:, 0] > reach[:-1]))
            s, e = r[head, 0], reach[np.append(head[1:], len(r)) - 1]
            kept = hashlib.sha256()
            at = 0
            for x, y in zip(s.tolist(), e.tolist()):
                kept.update(raw[at:x])
                at = y
            kept.update(raw[at:])
            out.append((int((e - s).sum()), len(s), kept.hexdigest(), list(zip(s.tolist(), e.tolist()))))
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("a"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()),
             pa.array([[{"s": s, "e": e} for s, e in x[3]] for x in out], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))],
            ["id", "a", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans), one row per row of ``docs``.

    ``spans`` are the removed runs of UTF-8 bytes (start, end exclusive), judged on the input;
    matches never cross documents. Null texts are empty; texts shorter than ``length`` stay whole, as
    do rows with a null key, which others aren't compared with either. Repeated rows have one key,
    neither is smaller, so both stay. The key must be an integer. Only key and text are read.
    """
    empty = hashlib.sha256(b"").hexdigest()
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    a, b = F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))
    known = stage(rows.select("id", a.alias("a"), b.alias("b"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    total = known.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    least = stage(known.filter("id IS NOT NULL").groupBy(F.col("a").alias("ra"), F.col("b").alias("rb")).agg(F.min("id").alias("rep")), "least-texts")
    known = stage(known.join(least, (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")), "left").withColumn("copy", F.coalesce(F.col("id") > F.col("rep"), F.lit(False)))
                  .select("id", "a", "n_bytes", "sha", "copy"), "marked-texts")
    usable = rows.filter("id IS NOT NULL").filter(F.octet_length("text") >= length)
    packed = usable.mapInArrow(_packed(buckets, length), "bucket long, ids binary, texts binary, low binary, high binary, at binary")
    n = max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shared = packed.repartition(min(n, buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "id long, anchor long")
    copies = known.filter("copy").select("id").distinct()
    # A document's anchors: at most one per byte of it.
    anchors = stage(shared.join(copies, "id", "left_anti").groupBy("id").agg(F.collect_list("anchor").alias("anchors")), "shared-anchors")
    context = usable.join(anchors, "id").mapInArrow(_contexts(buckets, length), "anchor long, ctx long, id long, start long, bytes binary")
    resolved = stage(context.repartition(n, "anchor").sortWithinPartitions("anchor", "ctx", "id")
                     .mapInArrow(_resolve(length), "anchor long, ctx long, id long, start long, stop long, first array<long>, last array<long>, low array<long>"), "contexts")
    near = resolved.filter("anchor IS NULL").select("id", F.struct(F.col("start").alias("s"), F.col("stop").alias("e")).alias("r"))
    settled = resolved.filter("id IS NULL").select("anchor", "ctx", "first", "last", "low")
    # Written tables on both sides: a context that very many documents have is split while it is joined.
    hits = resolved.filter("anchor IS NOT NULL AND id IS NOT NULL").select("anchor", "ctx", "id", "start").join(settled, ["anchor", "ctx"])
    hits = hits.select("id", "start", F.explode(F.filter(F.arrays_zip("first", "last", "low"), lambda x: x["low"] < F.col("id"))).alias("x"))
    runs = near.unionByName(hits.select("id", F.struct((F.col("start") + F.col("x.first")).alias("s"), (F.col("start") + F.col("x.last") + length).alias("e")).alias("r")))
    runs = stage(runs.groupBy("id").agg(F.collect_list("r").alias("runs")), "repeated-runs")
    shape = "id long, a long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:long,e:long>>"
    cut = usable.withColumn("a", a).join(runs, "id").dropDuplicates(["id", "a"]).mapInArrow(_finish, shape).withColumnsRenamed({"id": "i", "a": "x"})
    out = known.join(cut, (F.col("id") == F.col("i")) & (F.col("a") == F.col("x")), "left")
    gone = F.col("copy") & (F.col("n_bytes") >= length)
    return out.select(F.col("id").alias(key), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                      F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                      F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
                      F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_bytes").alias("e")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<s:long,e:long>>"))).alias("spans"))
