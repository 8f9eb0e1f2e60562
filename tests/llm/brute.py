"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def near_duplicates(rows: list[tuple], words: int, percent: int = 80) -> dict:
    """id -> (set size, smallest id reachable)."""
    sets = {}
    for ident, text in rows:
        w = WORD.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
        sets[ident] = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter()
    for ids in holders.values():
        common.update(combinations(sorted(ids), 2))
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def quality_counts(text: str | None) -> dict[str, int]:
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def remove_repeats(rows: list[tuple], length: int) -> dict:
    """id -> (bytes, removed, spans, sha256 of what stays)."""
    texts = {i: (t or "").encode() for i, t in rows}
    first: dict[bytes, int] = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - length + 1):
            first.setdefault(texts[i][p:p + length], i)
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out
