"""Vectorised work on the UTF-8 bytes of an Arrow batch of texts.

Every function takes the bytes of many texts at once with their offsets, so a task runs numpy
over blocks of about ``BLOCK_BYTES`` and never a Python loop per word. Nulls count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets): text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""
    col = batch.column(column)
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    elif pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary())
    col = pc.fill_null(col, b"")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def table(keep) -> np.ndarray:
    """Lookup of 256 flags: ``keep(byte)``."""
    return np.array([bool(keep(b)) for b in range(256)])


#: Bytes of words between white space.
SPACED = table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of the maximal runs of flagged bytes; runs end with their text."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~prev | first[:n]))
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~nxt | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * BLOCK_BYTES)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h ^= h >> np.uint64(29)
    h *= _BASE
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial of the bytes, from which `span_hash` reads the hash of any span."""
    up, _ = _power(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal bytes give equal hashes wherever they stand. For spans of fewer than
    1,024 bytes: a polynomial modulo 2**64 gives some longer regular spans equal hashes."""
    _, down = _power(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX)


def block_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each of some ascending spans that do not overlap: a sum over its bytes, each mixed with
    its place in the span. Unlike the polynomial of `span_hash` it has no pairs of long regular
    spans that agree; two seeds give independent hashes."""
    sizes = ends - starts
    salt = mix(np.array([2 * seed + 1], np.uint64))[0]
    out = sizes.astype(np.uint64) * _MIX + salt
    full = np.flatnonzero(sizes > 0)
    if len(full):
        sizes = sizes[full]
        first = np.cumsum(sizes) - sizes
        place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
        value = data[place + np.repeat(starts[full], sizes)].astype(np.uint64) | (place.astype(np.uint64) + np.uint64(1)) << np.uint64(8)
        out[full] += np.add.reduceat(mix(value ^ salt), first)
    return mix(out)


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each text has."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def grams(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the ``n`` consecutive words that lie within one text."""
    last = len(hashes) - n + 1
    if last <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = hashes[:last].copy()
    for j in range(1, n):
        acc = acc * _BASE + hashes[j:last + j]
    at = np.flatnonzero(owner[:last] == owner[n - 1:])
    return at, mix(acc[at])


def signed(h: np.ndarray) -> pa.Array:
    """64-bit hashes as a column of longs."""
    return pa.array(h.view(np.int64), pa.int64())
