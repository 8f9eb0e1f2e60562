"""Removal of repeated word windows by recompression.

Words are renamed in rounds: runs of one symbol become a symbol, then neighbouring symbols of the
classes left and right become a pair. Names are hashes of what they stand for, so every task gives
equal parts the same name, and equal passages parse alike but for symbols near their edges. Each
symbol also carries the words its parse depends on: a window that holds them all holds the symbol
wherever it stands. So a window cannot repeat if one such symbol has no second text (Spark tells which
have). The windows that are left are cut into phrases at the boundaries of higher symbols, equal phrases collapse, and
only windows of unlike phrases are compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import stage

WINDOW = 13
#: Rounds after which two neighbouring symbols (about 3.7 words) tell whether a window can repeat.
ROUNDS = 2
#: Share of such neighbours, chosen by name, that are told: fewer cost less, more leave fewer windows open.
TOLD = 0.75
#: Rounds after which symbols (about 14 words) cut what may repeat into phrases.
PHRASE_ROUNDS = 9
#: Bytes of text per bucket of symbols; a task sorts one bucket at a time.
BUCKET_BYTES = 16 << 20
_KEY = np.uint64((1 << 32) - 1)


class Symbols(NamedTuple):
    """Symbols in order: name, words [start, end), words [low, high) that decide the parse, text."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    owner: np.ndarray

    def take(self, at) -> Symbols:
        return Symbols(*[x[at] for x in self])


def _reach(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Where the parse of the symbols before and after each begins and ends; outside the text at its edges."""
    same = s.owner[1:] == s.owner[:-1]
    before, after = s.start - 1, s.end + 1
    before[1:] = np.where(same, s.low[:-1], before[1:])
    after[:-1] = np.where(same, s.high[1:], after[:-1])
    return before, after


def runs(s: Symbols) -> Symbols:
    """Name each maximal run of one symbol. That it ends where it does depends on both neighbours."""
    fresh = np.ones(len(s.name), bool)
    fresh[1:] = (s.name[1:] != s.name[:-1]) | (s.owner[1:] != s.owner[:-1])
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(s.name)) - 1
    times = (tail - head + 1).astype(np.uint64)
    before, after = _reach(s)
    name = np.where(times > 1, bt.mix(s.name[head] * bt._BASE + times), s.name[head])
    return Symbols(name, s.start[head], s.end[tail], np.minimum(s.low[head], before[head]), np.maximum(s.high[tail], after[tail]), s.owner[head])


def pairs(s: Symbols, turn: int) -> Symbols:
    """Name each pair of a left and a right symbol; the classes are a bit of the name, new in each turn."""
    n = len(s.name)
    right = (bt.mix(s.name ^ bt.mix(np.array([2 * turn + 1], np.uint64))) >> np.uint64(63)).astype(bool)
    first = np.zeros(n, bool)
    first[:-1] = ~right[:-1] & right[1:] & (s.owner[1:] == s.owner[:-1])
    second = np.zeros(n, bool)
    second[1:] = first[:-1]
    before, after = _reach(s)
    name, end = s.name.copy(), s.end.copy()
    low = np.where(right & ~second, np.minimum(s.low, before), s.low)  # single: what stands before is no left symbol
    high = np.where(~right & ~first, np.maximum(s.high, after), s.high)
    f = np.flatnonzero(first)
    name[f] = bt.mix(s.name[f] * bt._BASE + bt.mix(s.name[f + 1] ^ np.uint64(turn + 1)))
    end[f] = s.end[f + 1]
    low[f], high[f] = np.minimum(s.low[f], s.low[f + 1]), np.maximum(s.high[f], s.high[f + 1])
    return Symbols(name, s.start, end, low, high, s.owner).take(~second)


def parse(words: np.ndarray, owner: np.ndarray, rounds: int = ROUNDS, after: Symbols | None = None, done: int = 0) -> Symbols:
    """Symbols of the texts after some rounds; ``after`` (from ``done`` rounds) goes on from there."""
    at = np.arange(len(words))
    s = after or Symbols(words, at, at + 1, at, at + 1, owner)
    for turn in range(done, rounds):
        if not len(s.name):
            break
        s = pairs(runs(s) if turn == 0 or after else s, turn)
    return s


class Words(NamedTuple):
    """The words of a block of texts: bytes, spans, text, two hashes, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    a: np.ndarray
    b: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, column: str = "text") -> Words:
        data, offsets = bt.texts(batch, column)
        start, end, owner = bt.spans(bt.SPACED[data], offsets)
        first = np.searchsorted(owner, np.arange(len(offsets)))
        return cls(data, start, end, owner, bt.block_hash(data, start, end), bt.block_hash(data, start, end, 1), first)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each text's whole word sequence."""
        out = np.zeros((2, len(self.first) - 1), np.uint64)
        full = np.flatnonzero(np.diff(self.first))
        if len(full):
            place = bt.mix((np.arange(len(self.owner)) - self.first[self.owner]).astype(np.uint64) + np.uint64(1))
            for i, h in enumerate((self.a, self.b)):
                out[i, full] = np.add.reduceat(bt.mix(h + place), self.first[:-1][full])
        return out[0], out[1]

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, two hashes) of all windows inside one text."""
        at, a = bt.grams(self.a, self.owner, length)
        return at, a, bt.grams(self.b, self.owner, length)[1]

    def kept(self, keep: np.ndarray) -> Iterator[memoryview]:
        """For each text its flagged words joined by one space."""
        w = np.flatnonzero(keep)
        sizes = self.end[w] - self.start[w] + 1
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(w) else 0) + np.repeat(self.start[w] - (ends - sizes), sizes)
        out = self.data[np.minimum(at, len(self.data) - 1)] if len(at) else np.zeros(0, np.uint8)
        out[ends - 1] = 0x20
        bounds = np.append(0, ends)[np.searchsorted(w, self.first)]
        view = memoryview(np.ascontiguousarray(out))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield view[lo:max(lo, hi - 1)]


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in bt.blocks(batch, "text"):
            w = Words.of(b)
            da, db = w.digests()
            sha = [hashlib.sha256(x).hexdigest() for x in w.kept(np.ones(len(w.owner), bool))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(w.first)), bt.signed(da), bt.signed(db), pa.array(sha, pa.string())], ["id", "n_words", "da", "db", "sha"])


def _telling(w: Words, s: Symbols, window: int) -> Symbols:
    """Neighbouring symbols whose parse a window can decide, of the names that are told."""
    at = np.flatnonzero(s.owner[1:] == s.owner[:-1])
    name = bt.mix(s.name[at] * bt._BASE + bt.mix(s.name[at + 1] ^ bt._MIX))
    both = Symbols(name, s.start[at], s.end[at + 1], np.minimum(s.low[at], s.low[at + 1]), np.maximum(s.high[at], s.high[at + 1]), s.owner[at])
    told = bt.mix(name) < np.uint64(int(TOLD * 2.0 ** 64))
    return both.take(np.flatnonzero(told & (both.high - both.low <= window) & (both.low >= w.first[both.owner]) & (both.high <= w.first[both.owner + 1])))


def _named(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32-bit key in it) of names. Names that fall together only leave windows open."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), h & _KEY


def _planes(x: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as differences, byte by byte, so that compression drops the empty bytes."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view(np.uint32).ravel(), dtype=np.uint64)


_PACKED = ["bucket", "ids", "texts", "keys", "known"]


def _packed(buckets: int, window: int):
    """One row per bucket and batch with the symbols of its texts: ids, text digests, keys.

    Of a symbol that one text has in several copies the smallest id goes on; of one that several texts of
    the batch have, two of them go on and the others' (id, symbol) are ``known``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            ids = np.asarray(batch.column("id"), dtype=np.int64)
            base = 0
            for b in bt.blocks(batch, "text"):
                w = Words.of(b)
                s = _telling(w, parse(w.a, w.owner), window)
                bucket, key = _named(s.name, buckets)
                got.append((bucket, key, ids[base + s.owner], w.digests()[0][s.owner]))
                base += b.num_rows
            if not got:
                continue
            bucket, key, of, text = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((of, text, key, bucket))
            bucket, key, of, text = bucket[order], key[order], of[order], text[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
            other = new.copy()
            other[1:] |= text[1:] != text[:-1]
            keep = np.flatnonzero(other)  # the smallest id of each text that has it
            bucket, key, of, text, new = bucket[keep], key[keep], of[keep], text[keep], new[keep]
            last = np.append(new[1:], True)[:len(new)]
            send = np.flatnonzero(new | last)
            rest = np.flatnonzero(~(new | last))
            cut = np.append(np.flatnonzero(np.append(True, bucket[send][1:] != bucket[send][:-1])) if len(send) else [], len(send)).astype(int)
            rows = []
            for lo, hi in zip(cut[:-1], cut[1:]):
                at = send[lo:hi]
                bk = int(bucket[at[0]])
                more = rest[bucket[rest] == bk] if len(rest) else rest
                names = key[more] | np.uint64(bk) << np.uint64(32)
                docs, place = np.unique(of[at], return_inverse=True)
                some = np.zeros(len(docs), np.uint64)
                some[place] = text[at]
                where = place.astype(np.uint16 if len(docs) < 1 << 16 else np.uint32)
                rows.append((bk, docs.tobytes(), some.tobytes(), _planes(key[at]) + where.tobytes(), np.stack([of[more].view(np.uint64), names]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5)]], _PACKED)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, symbol) of the symbols that two unlike texts or more have; rows come sorted by bucket."""
    held: list[tuple] = []
    current = None

    def settle() -> Iterator[pa.RecordBatch]:
        keys, docs, texts = [], [], []
        for _, ids, some, packed, _known in held:
            ids, some = np.frombuffer(ids, np.int64), np.frombuffer(some, np.uint64)
            wide = np.uint16 if len(ids) < 1 << 16 else np.uint32
            n = len(packed) // (4 + np.dtype(wide).itemsize)
            place = np.frombuffer(packed, wide, n, 4 * n)
            keys.append(_unplaned(packed, n)), docs.append(ids[place]), texts.append(some[place])
        key, doc, text = np.concatenate(keys), np.concatenate(docs), np.concatenate(texts)
        order = np.argsort(key, kind="stable")
        key, doc, text = key[order], doc[order], text[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        keep = np.repeat(np.minimum.reduceat(text, first) < np.maximum.reduceat(text, first), size)
        name = key[keep] | np.uint64(current) << np.uint64(32)
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), bt.signed(name)], ["id", "symbol"])

    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in _PACKED]):
            known = np.frombuffer(row[4], np.uint64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([bt.signed(known[0]), bt.signed(known[1])], ["id", "symbol"])
            if row[0] != current:
                if held:
                    yield from settle()
                held, current = [], row[0]
            held.append(row)
    if held:
        yield from settle()


def _phrases(buckets: int, window: int):
    """(id, text, start, n, pa, pb, ha, hb): the phrases of windows that may repeat, with their windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in bt.blocks(batch, "text"):
                w = Words.of(b)
                low = parse(w.a, w.owner)
                s = _telling(w, low, window)
                bucket, key = _named(s.name, buckets)
                salt = lambda h, o: bt.mix(h ^ bt.mix(o.astype(np.uint64) + np.uint64(1)))
                lists = b.column("symbols")
                have = np.asarray(lists.flatten(), dtype=np.int64).view(np.uint64)
                whose = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
                lone = ~np.isin(salt(key | bucket.astype(np.uint64) << np.uint64(32), s.owner), salt(have, whose))
                # a window that holds all a lone symbol depends on has no like in another text
                dead = np.zeros(len(w.owner) + 1, np.int64)
                np.add.at(dead, np.maximum(s.high[lone] - window, w.first[s.owner[lone]]), 1)
                np.add.at(dead, s.low[lone] + 1, -1)
                at, a, bb = w.windows(window)
                live = np.cumsum(dead)[at] == 0
                at, a, bb = at[live], a[live], bb[live]
                if not len(at):
                    continue
                edge = np.zeros(len(w.owner) + 1, bool)
                edge[parse(w.a, w.owner, PHRASE_ROUNDS, low, ROUNDS).start] = True
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | edge[at[1:]] | (w.owner[at[1:]] != w.owner[at[:-1]])
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(at)))
                place = bt.mix((np.arange(len(at)) - np.repeat(head, n)).astype(np.uint64) + np.uint64(1))
                digest = [bt.mix(np.add.reduceat(bt.mix(h + place), head)) for h in (a, bb)]
                of = w.owner[at[head]]
                # the windows of a phrase go with its first place in a text
                _, once = np.unique(np.stack([digest[0], of.astype(np.uint64)]), axis=1, return_index=True)
                again = np.ones(len(head), bool)
                again[once] = False
                sizes = np.where(again, 0, n)
                full = np.flatnonzero(np.repeat(~again, n))
                offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32), mask=np.append(again, False))
                ids = np.asarray(b.column("id"), dtype=np.int64)[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), bt.signed(w.digests()[0][of]), pa.array(at[head] - w.first[of]), pa.array(n), bt.signed(digest[0]), bt.signed(digest[1]),
                     pa.ListArray.from_arrays(offsets, bt.signed(a[full])),
                     pa.ListArray.from_arrays(offsets, pa.array((bb[full] >> np.uint64(32)).astype(np.uint32).view(np.int32)))], ["id", "text", "start", "n", "pa", "pb", "ha", "hb"])

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, n_removed, kept_sha256, spans) from texts and their removed runs of words."""
    for batch in batches:
        for b in bt.blocks(batch, "text"):
            w = Words.of(b)
            digest = w.digests()[0].view(np.int64)
            lists = b.column("runs")
            whose = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
            flat = lists.flatten()
            text, s, e = (np.asarray(flat.field(i), dtype=np.int64) for i in range(3))
            mine = text == digest[whose]
            s, e, base = s[mine], e[mine], w.first[whose[mine]]
            gone = np.zeros(len(w.owner) + 1, np.int64)
            np.add.at(gone, s + base, 1)
            np.add.at(gone, e + base, -1)
            gone = np.cumsum(gone)[:-1] > 0
            sha = [hashlib.sha256(x).hexdigest() for x in w.kept(~gone)]
            lo, hi, of = bt.spans(gone, w.first)
            rows = pa.StructArray.from_arrays([pa.array(lo - w.first[of]), pa.array(hi - w.first[of])], ["s", "e"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(b.num_rows + 1)).astype(np.int32)), rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(digest), pa.array(bt.per_text(gone, w.first)), pa.array(sha, pa.string()), spans],
                                             ["id", "text", "n_removed", "kept_sha256", "spans"])


_SPANS = "array<struct<s:long,e:long>>"


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, spans), one row per row of ``docs``.

    A word between ASCII white space goes if a window of ``window`` words over it also starts in a
    document with a smaller key; all is judged on the input. ``spans`` are the removed runs of words (start, end exclusive), ``kept_sha256``
    is the digest of the words that stay, joined by one space. Null and empty texts have no words; texts
    of fewer words stay whole, as do rows with a null key, which others aren't compared with
    either. Repeated rows have one key, neither is smaller, so both stay. Very long texts are read
    whole, one text's words at a time in memory. The key must be an integer. Only key and text are read,
    so other columns' names cannot clash. An empty table gives no rows.
    """
    empty = hashlib.sha256(b"").hexdigest()
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known = stage(rows.mapInArrow(_known, "id long, n_words long, da long, db long, sha string"), "word-sequences")
    # Copies of one word sequence are settled at once; the smallest goes on.
    least = known.filter("id IS NOT NULL").groupBy(F.col("da").alias("ra"), F.col("db").alias("rb")).agg(F.min("id").alias("rep"))
    known = known.join(least, (F.col("da") == F.col("ra")) & (F.col("db") == F.col("rb")), "left")
    known = stage(known.select("id", "n_words", "da", "sha", (F.coalesce(F.col("id") > F.col("rep"), F.lit(False)) & (F.col("n_words") >= window)).alias("copy")), "marked-sequences")
    usable = rows.filter("id IS NOT NULL").filter(F.octet_length("text") >= 2 * window - 1)
    buckets = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = usable.mapInArrow(_packed(buckets, window), "bucket long, ids binary, texts binary, keys binary, known binary")
    shared = packed.repartition(min(parts, buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "id long, symbol long")
    own = known.filter(F.col("id").isNotNull() & ~F.col("copy") & (F.col("n_words") >= window)).select("id").distinct()
    # A document's symbols: fewer than its words.
    lists = stage(own.join(shared.groupBy("id").agg(F.collect_list("symbol").alias("symbols")), "id", "left")
                  .select("id", F.coalesce("symbols", F.array().cast("array<long>")).alias("symbols")), "shared-symbols")
    shape = "id long, text long, start long, n long, pa long, pb long, ha array<long>, hb array<int>"
    phrases = stage(usable.join(lists, "id").mapInArrow(_phrases(buckets, window), shape), "phrases")
    first = stage(phrases.groupBy("pa", "pb").agg(F.min("id").alias("low"), F.any_value("ha", True).alias("ha"), F.any_value("hb", True).alias("hb")), "distinct-phrases")
    single = first.select("pa", "pb", "low", F.posexplode(F.arrays_zip("ha", "hb")).alias("at", "w")).select("pa", "pb", "low", "at", "w.ha", "w.hb")
    twice = single.groupBy("ha", "hb").agg(F.min("low").alias("first"), F.max("low").alias("last")).filter("first < last").select("ha", "hb", "first")
    # One phrase's windows: as many as its words.
    late = single.join(twice, ["ha", "hb"]).filter("low > first").groupBy("pa", "pb").agg(F.collect_list("at").alias("late"))
    found = stage(first.select("pa", "pb", "low").join(late, ["pa", "pb"], "left"), "settled-phrases")
    # Written tables on both sides: a phrase that very many documents have is split while it is joined.
    hits = phrases.select("id", "text", "start", "n", "pa", "pb").join(found, ["pa", "pb"]).filter("id > low OR late IS NOT NULL")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), (F.col("n") + window - 1).alias("e")))
    some = F.transform("late", lambda x: F.struct(x.cast("long").alias("s"), (x + window).cast("long").alias("e")))
    hits = hits.select("id", "text", "start", F.explode(F.when(F.col("id") > F.col("low"), whole).otherwise(some)).alias("r"))
    runs_of = hits.groupBy("id").agg(F.collect_list(F.struct("text", (F.col("start") + F.col("r.s")).alias("s"), (F.col("start") + F.col("r.e")).alias("e"))).alias("runs"))
    runs_of = stage(runs_of, "repeated-words")
    cut = usable.join(runs_of, "id").mapInArrow(_finish, f"id long, text long, n_removed long, kept_sha256 string, spans {_SPANS}")
    cut = cut.dropDuplicates(["id", "text"]).withColumnsRenamed({"id": "i", "text": "t"})
    out = known.join(cut, (F.col("id") == F.col("i")) & (F.col("da") == F.col("t")), "left")
    gone = F.col("copy")
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_words").alias("e")))
    return out.select(F.col("id").alias(key), "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                      F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
                      F.when(gone, all_of).otherwise(F.coalesce("spans", F.array().cast(_SPANS))).alias("spans"))
