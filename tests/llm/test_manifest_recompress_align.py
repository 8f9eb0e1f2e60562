"""Merkle manifest, recompression and token alignment against plain Python, also on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from boardlake.llm import alignment, merkle, recompress
from boardlake.llm.queries import TOKENIZERS
from tests.llm.test_operators import SHAPE, TEXTS

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
WORD = re.compile("[^\x20\x09-\x0D]+")


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r)))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every awkward kind, with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, s, None, "x", "y", 1, 2, 3, 4) for (i, t), s in zip(TEXTS, ["a", "b", None] * 5)], SHAPE)


# --- merkle ---


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def fields(*values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i - i % 3
        out.append(("".join(level[lo:i]), "".join(level[i + 1:lo + 3])))
        i //= 3
    return out


def manifest(rows):
    """Expected rows of `merkle.verified` for (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, fields(*r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (*_, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = path(trees[s], i) + path(top, k)
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                node = fields(*r[:4], r[4].replace("\n", ""))
            for b, a in steps:
                node = sha(b + node + a)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha("".join(b + a for b, a in steps)), node, node == top[-1][0]))
    return out


def test_manifest_equals_plain_trees(spark, odd):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = [(i, f"s{min(i % 7, 3)}" if i % 11 else None, "en", i, f"t{i}\nx") for i in range(900)] + [(5000, "alone", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert ordered(map(tuple, merkle.verified(docs, tampered).collect())) == ordered(manifest(rows))
    rows = [(i, s, None, None, t) for (i, t), s in zip(TEXTS, ["a", "b", None] * 5)]
    assert ordered(map(tuple, merkle.verified(odd, tampered).collect())) == ordered(manifest(rows))
    assert merkle.verified(odd.limit(0), tampered).collect() == []


# --- recompression ---


def repeated_words(rows, n=13):
    texts, first = defaultdict(list), {}
    for i, t in rows:
        texts[i].append(WORD.findall(t or ""))
    for i in sorted(x for x in texts if x is not None):
        for w in texts[i]:
            for p in range(len(w) - n + 1):
                first.setdefault(tuple(w[p:p + n]), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - n + 1 if i is not None else 0):
            if first[tuple(w[p:p + n])] < i:
                gone[p:p + n] = [True] * n
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def test_recompression_equals_brute_force(spark, odd):
    rng = random.Random(1)
    line = lambda c, lo, hi: " ".join(c + str(i) for i in range(lo, hi))
    rows = [(1, "a " * 40), (2, "a " * 60), (3, "b " + "a " * 14 + "c"), (4, None), (5, ""), (None, "a " * 30), (7, line("w", 0, 50)), (7, line("v", 0, 50)), (8, line("v", 20, 40)),
            (9, "x y " * 30), (10, "q x y " * 3 + "x y " * 20), (11, line("w", 0, 50)), (11, "new"), (12, line("w", 0, 50).replace(" ", "\n")), (13, line("w", 0, 13)), (14, line("w", 30, 43))]
    rows += [(100 + k, " ".join(rng.choice("abc") for _ in range(rng.randrange(5, 60)))) for k in range(200)]
    rows += [(1000 + k, " ".join(rng.choice("ab") for _ in range(rng.randrange(5, 200)))) for k in range(60)]
    for docs, given in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (odd, TEXTS)):
        assert ordered(tuple(r)[:4] for r in recompress.repeats(docs).collect()) == ordered(repeated_words(given))
    assert recompress.repeats(odd.limit(0)).collect() == []


# --- alignment ---


def aligned(rows):
    """Expected rows, from tokens of whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    back = alignment.byte_table()
    found, docs = [], Counter()
    for i, t in rows:
        got = None
        if t:
            a, b = left.encode(" " + t, add_special_tokens=False), right.encode(t)
            sides = [(a.ids, [bytes(back[c] for c in x) for x in a.tokens]),
                     (b, [bytes([int(p[3:5], 16)]) if right.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, right.id_to_piece(x)) for x in b)])]
            if all(b"".join(p) == (" " + t).encode() for _, p in sides):
                ends = [[sum(map(len, p[:0])) for _ in p] for _, p in sides]
                for k, (_, p) in enumerate(sides):
                    at = 0
                    for j, x in enumerate(p):
                        at += len(x)
                        ends[k][j] = at
                common = sorted(set(ends[0]) & set(ends[1]))
                groups = [[[x for x, e in zip(s[0], ends[k]) if lo < e <= hi] for k, s in enumerate(sides)] for lo, hi in zip([0, *common], common)] if len(a.ids) < 3000 else []
                spots = sorted(set(ends[0]) | set(ends[1]))
                links, ia, ib = [], 0, 0
                for e in spots:
                    links.append((sides[0][0][ia], sides[1][0][ib]))
                    ia, ib = ia + (ends[0][ia] == e), ib + (ends[1][ib] == e)
                got = (len(a.ids), len(b), groups, links)
                docs.update(set(links))
        found.append((i, got))
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    out = []
    for i, got in found:
        if got is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, groups, links = got
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, na, nb, len(groups), len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), sha(text)))
    return out


def test_alignment_equals_whole_text_tokens(spark, odd):
    rng = random.Random(5)
    spaces = [" ", "  ", "\n", "\t", "\xa0", "\x85", "　", "​", "\x1c"]
    pieces = ["word", "Hello", "it's", "123", "é漢", "ﬁ", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "!?", "naïve", "𐀀"]
    rows = [(k, "".join(rng.choice(rng.choice([spaces, [" "], pieces, pieces])) for _ in range(rng.randrange(1, 25)))) for k in range(150)]
    rows += [(None, "key less"), (None, None), (1000, ""), (1002, "a▁b"), (1003, " lead  two \n\n x "), (1003, "same id"), (1004, " "), (1005, "   ")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for common in (1 << 18, 5, 0):
        assert ordered(map(tuple, alignment.alignment(docs, A, B, common_pairs=common).collect())) == ordered(aligned(rows))
    some = [(i, t) for i, t in TEXTS if i not in (8, 9)]
    assert ordered(map(tuple, alignment.alignment(odd.filter("doc_id IS NULL OR doc_id NOT IN (8, 9)"), A, B).collect())) == ordered(aligned(some))
    assert alignment.alignment(odd.limit(0), A, B).collect() == []
