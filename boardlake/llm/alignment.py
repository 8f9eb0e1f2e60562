"""Alignment of the tokens of two tokenizers over the same texts.

Both tokenizers end a token before a single space, so a block of texts is cut into words there, and each distinct word
is aligned once; texts with other white space around a space stay whole. The tokens of the words are
two Arrow lists of ids. Flattening them, with the index of the parent word, and
summing token lengths inside each word gives every token's end byte. An Acero hash join on (word, end) finds
where both tokenizers end a token; those places cut the tokens into groups. Between two neighbouring ends lie
exactly one token of each side, so every end is one link. Texts take the groups and links of their words.
``Table.group_by`` counts the links of a block, Spark merges the counts, and a second reading of the texts looks them up.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytetext as bt
from .common import stage

#: Bytes of text that are aligned at once (one text at least).
BLOCK_BYTES = 4 << 20
#: Partial counts a task holds before it hands them on.
HELD_PAIRS = 1 << 20
#: Commonest pairs that every task gets as a table (20 bytes each); all others are joined by Spark.
COMMON_PAIRS = 1 << 18
#: Fixed value: the split rule of the byte-level vocabulary.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space of any kind at the start, after a space, or a space at the end: no safe cut for both sides.
_UNSAFE = "^[{0}]| [{0}]| $".format("\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")


def byte_table() -> dict[str, int]:
    """Byte-level decoding: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """Byte-level BPE of a tokenizer JSON file; a token's id is its merge rank."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["id"] for x in spec["added_tokens"]}
        back = byte_table()
        ranks = {bytes(back[c] for c in entry): i for entry, i in spec["model"]["vocab"].items() if i not in special}
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self._encoding = tiktoken.Encoding("alignment", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(t) for t in texts]


class PieceBPE:
    """Sentence pieces with byte fallback. The model adds a space in front of what it is given."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode())
        names = [self._model.id_to_piece(i) for i in range(len(self.pieces))]
        # No piece has a space behind another character: words with the space before them are encoded alone.
        self.by_word = all("▁" not in p.lstrip("▁") for p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def _loaded(kind, path: str):
    return kind(path)


class Side(NamedTuple):
    """The tokens of a block's texts on one side: ids, parent texts and end bytes, texts in order."""

    ids: pa.Array
    parent: pa.Array
    end: np.ndarray
    first: np.ndarray


def _bytes_of(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, pa.large_binary())


def _side(lists: pa.ListArray, pieces: pa.Array) -> tuple[Side, np.ndarray, np.ndarray]:
    """(tokens, the bytes of all tokens, bytes of each text)."""
    ids = pc.list_flatten(lists)
    parent = pc.list_parent_indices(lists)
    joined = pc.take(pieces, ids)
    total = np.append(0, np.asarray(pc.cumulative_sum(pc.binary_length(joined)), dtype=np.int64))
    first = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
    end = total[1:] - total[first[:-1]][np.asarray(parent)] if len(ids) else np.zeros(0, np.int64)  # sums start again in each text
    offsets = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, 8 * joined.offset)
    raw = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if len(ids) else np.zeros(0, np.uint8)
    return Side(ids, parent, end, first), raw, np.diff(total[first])


class Aligned(NamedTuple):
    """Tokens of distinct words, the places in a and b of those that end together, links by word, and faithful words."""

    a: Side
    b: Side
    both_a: np.ndarray
    both_b: np.ndarray
    link_word: np.ndarray
    link: np.ndarray
    good: np.ndarray


def align(words: list[str], left, right) -> Aligned:
    """Align the tokens of some words, given without the space before them. Those that a side does not give back
    byte by byte have no tokens and aren't ``good``."""
    raw = [(" " + t).encode() for t in words]
    sizes = np.array([len(t) for t in raw], np.int64)
    whole = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.append(0, np.cumsum(sizes))
    lists = [left.encode([" " + t for t in words]), right.encode(words)]
    good = np.ones(len(words), bool)
    tables = [_bytes_of(t.pieces) for t in (left, right)]
    sides = []
    for ids, table in zip(lists, tables):
        side, said, lengths = _side(pa.array(ids, pa.list_(pa.int32())), table)
        sides.append(side)
        if (lengths == sizes).all():
            good[np.searchsorted(starts, np.flatnonzero(said != whole), side="right") - 1] = False
        else:
            at = np.append(0, np.cumsum(lengths))
            good &= lengths == sizes
            for i in np.flatnonzero(good):
                good[i] = (said[at[i]:at[i + 1]] == whole[starts[i]:starts[i + 1]]).all()
    if not good.all():
        sides = [_side(pa.array([x if g else [] for x, g in zip(ids, good)], pa.list_(pa.int32())), table)[0] for ids, table in zip(lists, tables)]
    a, b = sides
    keys = [(np.asarray(s.parent, dtype=np.int64) << 32) + s.end for s in (a, b)]
    tables = [pa.table({"key": k, n: np.arange(len(k))}) for k, n in zip(keys, ("a", "b"))]
    both = tables[0].join(tables[1], "key", join_type="inner", use_threads=False)
    both_a, both_b = (np.sort(np.asarray(both.column(n))) for n in ("a", "b"))
    # Every end is the end of one link: the tokens over the bytes before it.
    only = np.ones(len(keys[1]), bool)
    only[both_b] = False
    only = np.flatnonzero(only)
    link_a = np.append(np.arange(len(keys[0])), np.searchsorted(keys[0], keys[1][only]))
    link_b = np.append(np.searchsorted(keys[1], keys[0]), only)
    word = np.asarray(a.parent, dtype=np.int64)[link_a]
    order = np.argsort(word, kind="stable")
    link = np.asarray(a.ids, dtype=np.int64)[link_a] * len(right.pieces) + np.asarray(b.ids, dtype=np.int64)[link_b]
    return Aligned(a, b, both_a, both_b, word[order], link[order], good)


class Texts(NamedTuple):
    """The distinct words of a block, and each text's words in order: indices, offsets. Unfaithful texts have none."""

    found: Aligned
    words: pa.Array
    first: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, left, right) -> Texts:
        texts = pc.fill_null(column, "").cast(pa.large_string())
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
        odd = np.asarray(pc.match_substring_regex(texts, _UNSAFE)) if right.by_word else ~empty
        plain = np.flatnonzero(~odd & ~empty)
        odd = np.flatnonzero(odd)
        parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
        coded = pc.list_flatten(parts).dictionary_encode()
        found = align(coded.dictionary.to_pylist() + texts.take(pa.array(odd)).to_pylist(), left, right)
        n = np.zeros(len(texts), np.int64)
        n[plain], n[odd] = np.asarray(pc.list_value_length(parts)), 1
        words = np.zeros(n.sum(), np.int64)
        single = np.zeros(len(texts), bool)
        single[odd] = True
        lone = np.repeat(single, n)
        words[lone] = len(coded.dictionary) + np.arange(len(odd))
        words[~lone] = np.asarray(coded.indices)
        owner = np.repeat(np.arange(len(texts)), n)
        good = np.ones(len(texts), bool)
        good[owner[~found.good[words]]] = False
        keep = good[owner]
        return cls(found, pa.array(words[keep]), np.append(0, np.cumsum(np.where(good, n, 0))))

    def total(self, per_word: np.ndarray) -> np.ndarray:
        """Sum over each text's words."""
        sums = np.append(0, np.cumsum(per_word[np.asarray(self.words)]))
        return np.diff(sums[self.first])

    def links(self) -> pa.Table:
        """(text, pair, times): how often each text links each pair of ids."""
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        seen = pa.table({"key": owner << 32 | np.asarray(self.words)}).group_by("key", use_threads=False).aggregate([([], "count_all")])
        key, times = np.asarray(seen.column("key"), dtype=np.int64), np.asarray(seen.column("count_all"), dtype=np.int64)
        word = key & 0xFFFFFFFF
        first = np.searchsorted(self.found.link_word, np.arange(len(self.found.good) + 1))
        size = np.diff(first)[word]
        at = np.arange(size.sum()) + np.repeat(first[word] - (np.cumsum(size) - size), size)
        links = pa.table({"key": np.repeat(key >> 32, size) << 32 | self.found.link[at], "times": np.repeat(times, size)})
        links = links.group_by("key", use_threads=False).aggregate([("times", "sum")])
        key = np.asarray(links.column("key"), dtype=np.int64)
        return pa.table({"text": key >> 32, "pair": key & 0xFFFFFFFF, "times": links.column("times_sum")})


def _groups(found: Aligned, digits: list[pa.Array]) -> pa.Array:
    """The groups of each word, as ``a1,a2|b1;a3|b2;``."""
    sides, both = (found.a, found.b), (found.both_a, found.both_b)
    last = [np.zeros(len(s.ids), bool) for s in sides]
    for flags, at in zip(last, both):
        flags[at] = True
    group = [np.cumsum(x) - x for x in last]
    before = [np.append(0, np.cumsum(np.bincount(g, minlength=len(found.both_a)))) for g in group]
    # a group's tokens of one side stand before those of the other
    place = (np.arange(len(group[0])) + before[1][group[0]], np.arange(len(group[1])) + before[0][group[1] + 1])
    code = np.zeros(len(group[0]) + len(group[1]), np.int64)
    for i in (0, 1):
        code[place[i]] = np.asarray(sides[i].ids, dtype=np.int64) * 2 + last[i] + (0 if i == 0 else len(digits[0]))
    parts = pc.take(pa.concat_arrays(digits), pa.array(code))
    offsets = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1, 8 * parts.offset)
    bounds = np.ascontiguousarray(offsets[sides[0].first + sides[1].first])
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), parts.buffers()[2]])


def _written(texts: Texts, groups: pa.Array) -> list[str]:
    """Per text the digest of its groups; '' without tokens."""
    parts = pc.take(groups, texts.words)
    bounds = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1, 8 * parts.offset)[texts.first]
    body = memoryview(parts.buffers()[2] or b"")
    return [hashlib.sha256(body[lo:hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _digits(n: int, after: str) -> pa.Array:
    return pa.array([f"{i}{sep}".encode() for i in range(n) for sep in (",", after)], pa.large_binary())


def _merged(tables: list[pa.Table]) -> pa.Table:
    """Partial counts of pairs: in how many texts each is linked."""
    both = pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("docs", "sum")])
    return pa.table({"pair": both.column("pair"), "docs": both.column("docs_sum")})


class Pair:
    """The two tokenizers, given by their files; loaded once per task."""

    def __init__(self, left: str, right: str):
        self.paths = (left, right)

    def load(self):
        return _loaded(ByteBPE, self.paths[0]), _loaded(PieceBPE, self.paths[1])


def _counts(tokenizers: Pair):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = tokenizers.load()
        held: list[pa.Table] = []
        for batch in batches:
            for b in bt.blocks(batch, "text", BLOCK_BYTES):
                one = Texts.of(b.column("text"), left, right).links()
                held.append(_merged([pa.table({"pair": one.column("pair"), "docs": pa.array(np.ones(one.num_rows, np.int64))})]))
                if sum(t.num_rows for t in held) > HELD_PAIRS:
                    held = [_merged(held)]
                    if held[0].num_rows > HELD_PAIRS // 2:
                        yield from held.pop().combine_chunks().to_batches()
        if held:
            yield from _merged(held).combine_chunks().to_batches()

    return run


_SHAPE = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "pairs", "times"]


def _looked_up(tokenizers: Pair, common):
    """One row per text; what links it has of the common pairs is summed, the others are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = tokenizers.load()
        digits = [_digits(len(left.pieces), "|"), _digits(len(right.pieces), ";")]
        pair, docs, best = common.value
        table = pa.table({"pair": pair, "docs": docs, "best": best})
        for batch in batches:
            for b in bt.blocks(batch, "text", BLOCK_BYTES):
                n = b.num_rows
                texts = Texts.of(b.column("text"), left, right)
                found = texts.found
                links = texts.links().join(table, "pair", join_type="left outer", use_threads=False)
                text, times = (np.asarray(links.column(c), dtype=np.int64) for c in ("text", "times"))
                known = np.asarray(pc.is_valid(links.column("docs")))
                d = np.asarray(pc.fill_null(links.column("docs"), 0), dtype=np.int64) * times
                top = np.asarray(pc.fill_null(links.column("best"), False)) * times
                sums = [np.zeros(n, np.int64) for _ in range(3)]
                for out, value in zip(sums, (d, top, times)):
                    np.add.at(out, text, value)
                rest = np.flatnonzero(~known)
                rest = rest[np.argsort(text[rest], kind="stable")]
                offsets = pa.array(np.searchsorted(text[rest], np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, links.column(c).combine_chunks().take(pa.array(rest)).cast(pa.int64())) for c in ("pair", "times")]
                many = [np.diff(found.a.first), np.diff(found.b.first), np.bincount(np.asarray(found.a.parent, dtype=np.int64)[found.both_a], minlength=len(found.good))]
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), b.column("id"), *[pa.array(texts.total(m)) for m in many], pa.array(sums[2]),
                     pa.array(_written(texts, _groups(found, digits)), pa.string()), pa.array(sums[1]), pa.array(sums[0]), *lists], _SHAPE)

    return run


def _least_common(counts: DataFrame, limit: int) -> int:
    """The smallest power of two that at most ``limit`` pairs reach; at most 64 counts come to the driver."""
    sizes = sorted(counts.groupBy(F.floor(F.log2("docs")).alias("power")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    have, least = 0, 1 << 62
    for power, n in sizes:
        have += n
        if have > limit:
            break
        least = 1 << power
    return least


def alignment(docs: DataFrame, left: str, right: str, key: str = "doc_id", text: str = "text", common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    ``left`` is the file of a byte-level BPE that gets a space and the text, ``right`` a sentence-piece model
    that adds the space itself. A group runs to the next byte where tokens of both end; a link is a pair of tokens whose
    bytes overlap. ``count_sum`` sums, over the links, how many rows have the pair of ids linked; ``n_best`` counts the
    links whose pair no other pair of its left id exceeds. Null and empty texts, and those that a side does not give back
    byte by byte, have zeros and ''. Repeated rows count as often as they come; null keys are keys.
    Very long texts are aligned whole, one at a time in memory. Other columns are not read, so
    names cannot clash; an empty table gives no rows. ``common_pairs`` (at most so many counts are sent to the driver and
    to every task) changes no result: the pairs beyond are joined in Spark.
    """
    spark = docs.sparkSession
    tokenizers = Pair(left, right)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    wide = len(tokenizers.load()[1].pieces)
    counts = rows.select("text").mapInArrow(_counts(tokenizers), "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    # one window per left id: at most as many rows as the right vocabulary has entries
    one = Window.partitionBy(F.expr(f"pair div {wide}L"))
    counts = stage(counts.withColumn("best", F.col("docs") == F.max("docs").over(one)), "pair-counts")
    top = counts.filter(F.col("docs") >= _least_common(counts, common_pairs)).toArrow()
    common = spark.sparkContext.broadcast(tuple(top.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "docs", "best")))
    shape = (f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>")
    seen = stage(rows.mapInArrow(_looked_up(tokenizers, common), shape), "aligned")
    rare = seen.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), "p.times")
    rare = rare.join(counts, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("docs")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("tops"))
    out = seen.drop("pairs", "times").join(rare, "row", "left")
    return out.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("tops", F.lit(0))).alias("n_best"),
                      (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256")
