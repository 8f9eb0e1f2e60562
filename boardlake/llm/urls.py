"""URL filters by a sort-merge range join.

A host written with its labels reversed turns "this host and all its subdomains" into an
interval of keys. Rules and urls are cut into ranges of the key; a rule is sent to every range
that its interval meets. Inside a range everything is sorted, and one sweep keeps a stack of the
nested rule hosts whose intervals hold the current key; the deepest whose path fits decides.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys sampled to place the cuts between ranges; the sample decides balance only, never a result.
SAMPLE_PER_RANGE = 64
END = "\U0010ffff"


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): between the first ``://`` and ``/ ? #`` or the end, A-Z lower-cased; then up to ``? #``."""
    rest = (url or "").partition("://")[2]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return re.sub(r"[A-Z]+", lambda m: m[0].lower(), host), path


def reverse_host(host: str) -> str:
    """``www.example.com`` -> ``com.example.www.``; a host's subdomains have it as a prefix."""
    return ".".join(reversed(host.split("."))) + "."


def _keyed(cuts: list[str], salt: bool):
    """Map rows (id.., url) to their host, path, key and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls = b.column("id"), b.column("url").to_pylist()
            parts = [split_url(u) for u in urls]
            # Equal urls are spread by their id so that no key is a whole range.
            keys = [f"{reverse_host(h)}\x00{p}\x00{xxhash.xxh64_hexdigest(str(i))}" if salt else reverse_host(h)
                    for (h, p), i in zip(parts, ids.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(keys, pa.string()),
                 pa.array([bisect_right(cuts, k) for k in keys], pa.int32())], ["id", "host", "path", "key", "range"])

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, key, kind): rules (kind 0) open frames, urls (kind 1) read the stack."""
    stack: list[tuple[str, dict[str, tuple[str, str]]]] = []
    at = None
    for b in batches:
        out: list[tuple] = []
        cols = [b.column(c).to_pylist() for c in ("range", "key", "kind", "id", "host", "path", "verdict")]
        for rng, key, kind, ident, host, path, verdict in zip(*cols):
            if rng != at:
                stack, at = [], rng
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}))
                old = stack[-1][1].get(path)
                if old is None or verdict < old[1]:
                    stack[-1][1][path] = (host + path, verdict)
                continue
            hit = None
            for _, paths in reversed(stack):
                fits = [p for p in {path[:n] for n in {len(x) for x in paths}} if p in paths]
                if fits:
                    hit = paths[max(fits, key=len)]
                    break
            out.append((ident, host, path, *(hit or (None, None))))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], b.schema.field("id").type), *[pa.array([r[i] for r in out], pa.string()) for i in range(1, 5)]],
            ["id", "host", "path", "rule", "verdict"])


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """(key, host, path, rule, verdict), one row per row of ``urls``.

    ``rules`` has host, path and verdict. A rule fits its host and all its subdomains if the url's
    path starts with its path; the longest host wins, then the longest path. Of rules repeated with
    other verdicts the smaller by name holds (``allow``). Urls that no rule fits, null urls and
    urls without ``://`` (host and path empty) get rule null and ``default``. Rules with a null
    field are ignored. Repeated rows and null keys are kept; other columns are not read. Any
    number of rules will do; only the paths of rules that hold the current host are in memory.
    """
    spark = urls.sparkSession
    n = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = urls.select(F.col(key).alias("id"), F.col(url).alias("url"))
    ident = named.schema["id"].dataType.simpleString()
    shape = f"id {ident}, host string, path string, key string, range int"
    sample = named.orderBy(F.xxhash64("id", "url")).limit(SAMPLE_PER_RANGE * n).mapInArrow(_keyed([], True), shape)
    found = sorted(r[0] for r in sample.select("key").collect())  # bounded by SAMPLE_PER_RANGE * ranges
    cuts = sorted({found[i * len(found) // n] for i in range(1, n)}) if found else []
    placed = named.mapInArrow(_keyed(cuts, True), shape)
    first = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<string>")
    own = rules.select("host", "path", "verdict").dropna().withColumn("host", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    prefix = F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "."), F.lit("."))
    # A rule's interval is [prefix, prefix + END): it meets the ranges from its own to that of its end.
    own = (own.withColumn("key", prefix)
           .withColumn("lo", F.size(F.filter(first, lambda c: c <= F.col("key"))))
           .withColumn("hi", F.size(F.filter(first, lambda c: c < F.concat("key", F.lit(END)))))
           .withColumn("range", F.explode(F.sequence("lo", "hi"))))
    both = placed.select("range", "key", F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(
        own.select("range", "key", F.lit(0).alias("kind"), F.lit(None).cast(ident).alias("id"), "host", "path", "verdict"))
    swept = (both.repartition(n, "range").sortWithinPartitions("range", "key", "kind", "path")
             .mapInArrow(_sweep, f"id {ident}, host string, path string, rule string, verdict string"))
    return swept.select(F.col("id").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
