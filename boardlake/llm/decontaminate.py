"""Benchmark decontamination by winnowing.

Of every ``window`` consecutive k-gram hashes the smallest is kept, in documents and in benchmark
items alike, so a shared span of ``k + window - 1`` words always leaves a common fingerprint.
Fingerprints are joined; in documents that share one, hits are extended: every word window that
can hold a common k-gram is held against the benchmark's windows, and the words of those that
occur there are hit. ``k + window - 1`` is the length of a benchmark window, so none is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, row_key, stage

GRAM = 5
SPAN = 10
#: Rows of a benchmark-side table up to which it is sent to every executor (at most about 40 MB);
#: larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of a-z, 0-9 and characters beyond ASCII; null has none."""
    return F.filter(F.split(F.coalesce(lower_az(text), F.lit("")), NOT_WORD, -1), lambda w: w != "")


def gram_hashes(tokens: Column, n: int) -> Column:
    """Hash of the ``n`` words at every position (empty where there are fewer)."""
    parts = lambda i: F.xxhash64(F.lit(n), *[F.get(tokens, i + j) for j in range(n)])
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), parts)).otherwise(F.array().cast("array<bigint>"))


def winnow(hashes: Column, window: int) -> Column:
    """The smallest hash of each ``window`` consecutive ones."""
    if window == 1:
        return hashes
    mins = F.transform(F.sequence(F.lit(1), F.size(hashes) - window + 1), lambda i: F.array_min(F.slice(hashes, i, window)))
    return F.when(F.size(hashes) >= window, mins).otherwise(F.array().cast("array<bigint>"))


def classes(lengths: list[int], span: int = SPAN, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """(k, window, shortest, longest item) per class of item lengths; each guarantees its shortest item."""
    out = [(gram, span - gram + 1, span, 1 << 30)] if any(x >= span for x in lengths) else []
    middle = [x for x in lengths if gram <= x < span]
    if middle:
        out.append((gram, min(middle) - gram + 1, min(middle), span - 1))
    return out + [(x, 1, x, x) for x in sorted(set(lengths)) if 0 < x < gram]


def sized(df: DataFrame) -> DataFrame:
    """Mark a staged table for broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(key, n_words, n_hit, items, contaminated), one row per document; ``items`` sorted as strings.

    A benchmark window is ``span`` consecutive words of an item, or the whole of a shorter item that
    has words; a word inside any occurrence of a window is hit. Null and empty texts have no words
    and are clean; null item texts have no windows; repeated rows, null keys and repeated items are
    fine. Only the named columns are read. Empty tables give no rows or no hits.
    """
    items = stage(benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(item_text)).alias("w"))
                  .withColumn("n", F.size("w")).filter("n > 0"), "benchmark-words")
    lengths = [r[0] for r in items.select(F.least("n", F.lit(span)).alias("n")).distinct().collect()]  # at most `span` values
    kinds = classes(lengths, span, gram)
    base = docs.select(F.col(key), F.col(text), row_key(F.col(key), F.col(text)).alias("k"))
    counted = base.select(key, "k", F.size(words(F.col(text))).cast("long").alias("n_words"))
    if not kinds:
        return counted.select(key, "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))

    def fingerprints(df: DataFrame) -> DataFrame:
        """One row per distinct fingerprint ``h`` of each row's words; columns of their own keep each array computed once."""
        for k in sorted({k for k, _, _, _ in kinds}):
            df = df.withColumn(f"g{k}", gram_hashes(F.col("w"), k))
        return df.select("k", F.explode(F.array_distinct(F.concat(*[winnow(F.col(f"g{k}"), w) for k, w, _, _ in kinds]))).alias("h"))

    prints = sized(stage(fingerprints(items.withColumn("k", F.col("item"))).select("h").distinct(), "benchmark-prints"))
    sizes = sorted(set(lengths))
    windows = stage(items.select("item", F.explode(F.concat(*[
        F.when(F.col("n") >= span if s == span else F.col("n") == s, gram_hashes(F.col("w"), s)).otherwise(F.array().cast("array<bigint>"))
        for s in sizes])).alias("window")).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("of")), "benchmark-windows")

    shared = (fingerprints(base.select("k", words(F.col(text)).alias("w"))).join(prints, "h").groupBy("k").agg(F.collect_set("h").alias("found")))  # at most one per word of the document
    suspects = (base.select("k", text).join(stage(shared, "shared-prints"), "k").dropDuplicates(["k"])
                .select("k", "found", words(F.col(text)).alias("w")))

    def extended(k: int, size: int) -> Column:
        """(start, length, hash) of each window of ``size`` words that holds a k-gram found in the benchmark."""
        at = F.filter(F.transform(gram_hashes(F.col("w"), k), lambda h, i: F.when(F.array_contains("found", h), i)), lambda i: i.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(F.lit(0), i - (size - k)), i))))
        starts = F.filter(starts, lambda i: i + size <= F.size("w"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(size).alias("len"),
                                                      F.xxhash64(F.lit(size), *[F.get(F.col("w"), i + j) for j in range(size)]).alias("window")))

    tried = suspects.select("k", F.explode(F.concat(*[extended(k, s) for k, _, lo, hi in kinds for s in sizes if lo <= s <= hi])).alias("x"))
    hits = tried.select("k", "x.*").join(sized(windows), "window")
    # A document's hit windows: at most as many as it has words, times the lengths of short items.
    found = hits.groupBy("k").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("at"), F.collect_set("of").alias("of"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(acc["to"], s["start"]))).cast("long").alias("n"),
        F.greatest(acc["to"], s["start"] + s["len"]).alias("to"))
    found = found.select("k", F.aggregate("at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), step)["n"].alias("n_hit"),
                         F.array_sort(F.array_distinct(F.flatten("of"))).alias("items"))
    out = counted.join(found, "k", "left")
    return out.select(key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
