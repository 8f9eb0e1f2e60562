"""Secret scans over a trigram inverted index.

Each rule's pattern gives the Boolean trigram query that any of its matches must satisfy: an OR of clauses,
each an AND of the trigrams of one text that the pattern can ask for. The index holds postings (trigram, document)
of the trigrams that rules ask for; postings are intersected per clause, and only documents that
pass are verified with the regular expression. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stage


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if group ``group`` has ``min_length`` characters or more.

    Regular expressions must match the same in Java, RE2 and Python.
    """

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1

    def clauses(self) -> list[list[str]]:
        """The Boolean query: any clause, all of its trigrams. Empty if no trigram is mandatory."""
        return [list(c) for c in _query(self.pattern)[0]]

    @property
    def fold(self) -> bool:
        """Whether the clauses' letters match in either case (they are lower-case then)."""
        return _query(self.pattern)[1]


#: Texts that one stretch of a pattern is followed through; beyond, the stretch ends.
MAX_TEXTS = 64


class _Stretches:
    """Walks a parsed pattern and gathers its stretches: sets of texts one of which every match holds."""

    def __init__(self):
        self.done: list[set[tuple[str, bool]]] = []
        self.open: set[tuple[str, bool]] = {("", False)}

    def end(self) -> None:
        self.done.append(self.open)
        self.open = {("", False)}

    def put(self, texts: set[tuple[str, bool]]) -> None:
        """Go on with any of some texts (text, either case)."""
        if len(self.open) * len(texts) > MAX_TEXTS:
            self.end()
        if len(texts) > MAX_TEXTS:
            return self.end()
        self.open = {(a + b, f or g) for a, f in self.open for b, g in texts}

    def walk(self, nodes, fold: bool) -> None:
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                self.put({(chr(arg), fold)})
            elif name == "IN":
                chars = _chars(arg)
                self.put({(c, fold) for c in chars}) if chars else self.end()
            elif name == "SUBPATTERN":
                _, on, off, inner = arg
                self.walk(inner, (fold or bool(on & re.IGNORECASE)) and not off & re.IGNORECASE)
            elif name == "BRANCH":
                found = [_whole(x, fold) for x in arg[1]]
                self.put(set().union(*found)) if all(found) else self.end()
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, inner = arg
                texts = _whole(inner, fold)
                if texts and (low, int(high)) == (0, 1):
                    self.put(texts | {("", False)})
                else:  # what comes at least `low` times, then an open end
                    for _ in range(min(low, 8)):
                        self.walk(inner, fold)
                    if low != high or low > 8:
                        self.end()
            elif name == "AT":
                continue  # an anchor takes no character
            else:
                self.end()


def _chars(items) -> list[str]:
    """The characters of a small class; none for a large or negated one."""
    out: list[str] = []
    for op, arg in items:
        if str(op) == "LITERAL":
            out.append(chr(arg))
        elif str(op) == "RANGE" and arg[1] - arg[0] < 8:
            out += [chr(c) for c in range(arg[0], arg[1] + 1)]
        else:
            return []
    return out if len(out) <= 8 else []


def _whole(nodes, fold: bool) -> set[tuple[str, bool]]:
    """All texts of a part of a pattern, if they are few; none if it has an open end."""
    inner = _Stretches()
    inner.walk(nodes, fold)
    return inner.open if not inner.done else set()


@lru_cache(maxsize=None)
def _query(pattern: str) -> tuple[tuple[tuple[str, ...], ...], bool]:
    """(clauses, either case) of the stretch whose shortest text is longest; no clause if that has fewer than three characters."""
    walk = _Stretches()
    walk.walk(re._parser.parse(pattern), False)
    walk.end()
    best = max(walk.done, key=lambda texts: (min(len(t) for t, _ in texts), -len(texts)))
    if min(len(t) for t, _ in best) < 3:
        return (), False
    fold = any(f for _, f in best)
    texts = {t.lower() if fold else t for t, _ in best}
    every = {frozenset(t[i:i + 3] for i in range(len(t) - 2)) for t in texts}
    least = [c for c in every if not any(o < c for o in every)]  # a clause that another one covers says nothing
    return tuple(sorted(tuple(sorted(c)) for c in least)), fold


#: The kinds every scan reports, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)

SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans of ``rule`` in code points: leftmost non-overlapping matches, failing ones dropped.

    The pieces between matches and the matches give every start by a running sum.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    steps = F.zip_with(F.zip_with(F.split(text, rule.pattern, -1), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"))),
                       judged, lambda s, j: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), F.length(j).alias("judged")))
    steps = F.filter(steps, lambda s: s["len"].isNotNull())
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    walked = F.aggregate(steps, empty, lambda acc, s: F.struct(
        (acc["at"] + s["gap"] + s["len"]).alias("at"),
        F.when(s["judged"] >= rule.min_length, F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + s["gap"]).alias("start"), F.lit(number).alias("kind"), (acc["at"] + s["gap"] + s["len"]).alias("end")))))
        .otherwise(acc["out"]).alias("out")))
    return F.when(F.regexp(text, F.lit(rule.pattern)), walked["out"]).otherwise(F.array().cast(SPAN))


def postings(docs: DataFrame, rules: tuple[Rule, ...], key: str, text: str) -> DataFrame:
    """(trigram, k): the inverted index over the trigrams that ``rules`` ask for."""
    folded = sorted({t for r in rules if r.fold for c in r.clauses() for t in c})
    exact = sorted({t for r in rules if not r.fold for c in r.clauses() for t in c})
    lower = F.lower(F.col(text))  # a superset of what either case of ASCII letters can match
    hits = [F.when(F.contains(lower, F.lit(t)), F.lit(f"i:{t}")) for t in folded]
    hits += [F.when(F.contains(F.col(text), F.lit(t)), F.lit(f"c:{t}")) for t in exact]
    if not hits:
        hits = [F.lit(None).cast("string")]
    return (docs.select(row_key(F.col(key), F.col(text)).alias("k"), F.explode(F.array_compact(F.array(*hits))).alias("trigram")))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(k, rules): documents whose postings satisfy a clause of a rule, with the rules' numbers."""
    spark = index.sparkSession
    terms = [(n, c, ("i:" if r.fold else "c:") + t, len(clause)) for n, r in enumerate(rules) for c, clause in enumerate(r.clauses()) for t in clause]
    query = spark.createDataFrame(terms, "rule int, clause int, trigram string, need int")
    met = (index.join(F.broadcast(query), "trigram")  # a few rows per rule
           .groupBy("k", "rule", "clause", "need").agg(F.count_distinct("trigram").alias("n")).filter("n = need"))
    return met.groupBy("k").agg(F.collect_set("rule").alias("rules"))  # one number per rule at most


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): one row per document; spans as (start, kind number, end) in code points, end
    exclusive, by start, then kind as listed.

    Null and empty texts have no spans. Repeated rows each get their spans; null keys are fine.
    Only key and text are read, so other columns may have any names. Whole texts are scanned.
    """
    base = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    indexed = [(n, r) for n, r in enumerate(rules) if r.clauses()]
    full = [(n, r) for n, r in enumerate(rules) if not r.clauses()]
    none = F.array().cast(SPAN)
    scanned = base.select(F.col(key), row_key(F.col(key), F.col(text)).alias("k"),
                          F.concat(none, *[spans(F.col(text), r, n) for n, r in full]).alias("_full"))
    if indexed:
        found = stage(candidates(postings(base, rules, key, text), rules), "secret-candidates")
        passed = base.withColumn("k", row_key(F.col(key), F.col(text))).join(found, "k")
        checked = passed.select("k", F.concat(none, *[F.when(F.array_contains("rules", n), spans(F.col(text), r, n)).otherwise(none)
                                                      for n, r in indexed]).alias("_some")).filter(F.size("_some") > 0).dropDuplicates(["k"])
        scanned = scanned.join(checked, "k", "left")
    else:
        scanned = scanned.withColumn("_some", none)
    return scanned.select(key, F.sort_array(F.concat(F.col("_full"), F.coalesce(F.col("_some"), none))).alias("spans"))


def joined(found: Column, rules: tuple[Rule, ...] = BASE_RULES) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
