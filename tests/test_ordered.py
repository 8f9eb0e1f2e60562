"""Chunked scans give the same values as plain loops, whatever the chunk and however hot a key is."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from boardlake.operators.ordered import Run, clamped_sum, greedy_islands, group_quantiles, numbered, scan, seq_chunk


def hot_rows(seed: int, n: int = 300):
    """Rows of which more than a third belong to one key."""
    rnd = random.Random(seed)
    rows, seqs = [], list(range(n))
    for s in seqs:
        g = 0 if rnd.random() < 0.4 else rnd.randint(1, 6)
        rows.append((g, s, rnd.choice([-2, -1, -1, 1, 1, None, 3]), rnd.choice(["a", "b", None])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_scan_matches_loop(spark, size):
    rows = hot_rows(size)
    df = spark.createDataFrame(rows, "g int, seq long, d int, t string")
    runs = [Run("s", "sum", F.col("d")), Run("s0", "sum", F.col("d"), False), Run("mx", "max", F.col("d")), Run("mn", "min", F.col("d"), False),
            Run("la", "last", F.col("t")), Run("lag", "last", F.struct(F.col("t").alias("v")), False), Run("nx", "next", F.col("t"), False), Run("tot", "total", F.lit(1))]
    got = {(r.g, r.seq): r for r in scan(df, ["g"], ["seq"], runs, seq_chunk("seq", size)).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == g)
        for i, (_, seq, d, t) in enumerate(mine):
            r = got[(g, seq)]
            upto = [x[2] for x in mine[:i + 1] if x[2] is not None]
            prior = [x[2] for x in mine[:i] if x[2] is not None]
            assert r.s == sum(upto) and r.s0 == sum(prior)
            assert r.mx == (max(upto) if upto else None) and r.mn == (min(prior) if prior else None)
            assert r.la == next((x[3] for x in reversed(mine[:i + 1]) if x[3]), None)
            assert (r.lag.v if r.lag else None) == (mine[i - 1][3] if i else None)
            assert r.nx == next((x[3] for x in mine[i + 1:] if x[3]), None)
            assert r.tot == len(mine)


@pytest.mark.parametrize("size", [1, 5, 40, 10_000])
def test_clamped_sum_matches_loop(spark, size):
    rows = [(g, s, d or 0) for g, s, d, _ in hot_rows(100 + size)]
    df = spark.createDataFrame(rows, "g int, seq long, d int")
    for chunk in (seq_chunk("seq", size), None):
        got = {(r.g, r.seq): (r.x_before, r.x) for r in clamped_sum(df, ["g"], ["seq"], {"x": F.col("d")}, chunk, before=True).collect()}
        for g in {r[0] for r in rows}:
            x = 0
            for _, seq, d in sorted(r for r in rows if r[0] == g):
                before, x = x, max(x + d, 0)
                assert got[(g, seq)] == (before, x)


def test_numbered(spark):
    df = spark.createDataFrame([(1, s * 3) for s in range(20)], "g int, seq long")
    d = numbered(df, ["g"], ["seq"], seq_chunk("seq", 4), "rn", "n").collect()
    assert sorted((r.seq // 3 + 1, r.rn, r.n) for r in d) == [(i, i, 20) for i in range(1, 21)]


def test_quantiles_are_exact(spark):
    rnd = random.Random(3)
    rows = [(0 if rnd.random() < 0.5 else rnd.randint(1, 4), round(rnd.uniform(-5, 60), 2)) for _ in range(401)]
    df = spark.createDataFrame(rows, "g int, v double")
    for r in group_quantiles(df, ["g"], "v", {"med": 0.5, "p90": 0.9}, F.floor(F.col("v") / 3)).collect():
        vals = sorted(v for g, v in rows if g == r.g)
        assert r.med == pytest.approx(statistics.median(vals))
        at = 0.9 * (len(vals) - 1)
        lo = vals[int(at)]
        assert r.p90 == pytest.approx(lo + (vals[min(int(at) + 1, len(vals) - 1)] - lo) * (at - int(at)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_islands_match_loop(spark, seed):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(200):
        t += rnd.choice([0, 1, 1, 2, 3, 9])
        rows.append((0 if rnd.random() < 0.6 else 1, t, i))
    df = spark.createDataFrame(rows, "g int, pos long, id long")
    got = {r.id: r.head_no for r in greedy_islands(df, ["g"], "pos", "id", 8, 12, F.floor(F.col("pos") / 20)).collect()}
    for g in (0, 1):
        head, prev, no = None, None, 0
        for _, pos, i in sorted(r for r in rows if r[0] == g):
            if prev is None or pos - prev >= 8 or pos - head >= 12:
                head, no = pos, no + 1
            prev = pos
            assert got[i] == no


def test_greedy_islands_when_shuffle_reads_are_coalesced(spark):
    """Many small groups, whose exchanges adaptive execution reads in fewer and unlike parts."""
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "24k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        d = spark.range(30_000).select((F.col("id") % 6000).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(97)) * 4).cast("double").alias("pos")).distinct()
        got = greedy_islands(d.withColumn("at", F.col("pos")), ["g"], "pos", "at", 28.0, 28.0, F.floor(F.col("pos") / 16)).collect()
        rows = sorted((r.g, r.pos) for r in d.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    want, g, head, no = {}, None, None, 0
    for at in rows:
        if at[0] != g or at[1] - head >= 28:
            no = no + 1 if at[0] == g else 1
            g, head = at
        want[at] = no
    assert len(got) == len(want)
    assert {(r.g, r.pos): r.head_no for r in got} == want


def test_clamped_sum_carries_only_groups_that_cross_chunks(spark):
    """Groups inside one chunk are not summed a second time; values are those of one chunk, also for groups that cross."""
    rows = [(g, q, (7 * q * q + 3 * g) % 5 - 2) for g in range(6) for q in range(4 * g, 4 * g + (3 if g % 2 else 9))]
    d = spark.createDataFrame(rows, "g int, q int, x int")
    whole = clamped_sum(d, ["g"], ["q"], {"v": F.col("x")}, None, before=True)
    cut = clamped_sum(d, ["g"], ["q"], {"v": F.col("x")}, F.expr("q div 4"), before=True)
    assert sorted(map(tuple, cut.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert "LeftSemi" in cut._jdf.queryExecution().optimizedPlan().toString()
