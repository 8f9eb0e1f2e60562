"""Round consensus and robust fits against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from boardlake.operators import consensus as C

SCHEMA = "round int, pos int, seq long, d_along double, d_cross double, score double, n_feat int"


def loop(samples):
    conf = [(a, c, s) for _, a, c, s, n in samples if n >= 2 and s > 0]
    if len(conf) < 3:
        return None
    best, lead = -1, None
    for a, c, _ in conf:
        w = round(sum(s for x, y, s in conf if abs(x - a) <= 12 and abs(y - c) <= 12), 6)
        if w > best:
            best, lead = w, (a, c)
    inside = [(x, y, s) for x, y, s in conf if abs(x - lead[0]) <= 12 and abs(y - lead[1]) <= 12]
    total = sum(s for *_, s in conf)
    if best / total < 0.55:
        return None
    return sum(x * s for x, _, s in inside) / best, sum(y * s for _, y, s in inside) / best, best / total


@pytest.mark.parametrize("seed", [1, 2])
def test_consensus_matches_loop_with_a_hot_round(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(260):
        r = 0 if rnd.random() < 0.5 else rnd.randint(1, 20)
        a, c = rnd.choice([(10, 5), (10, 5), (-40, 30)])
        rows.append((r, 0, i, float(a + rnd.randint(-9, 9)), float(c + rnd.randint(-9, 9)), rnd.randint(0, 500) / 100, rnd.randint(0, 5)))
    got = {r["round"]: r for r in C.round_consensus(spark.createDataFrame(rows, SCHEMA), ["round", "pos"], "seq").collect()}
    for r in {x[0] for x in rows}:
        want = loop([(x[2], *x[3:]) for x in sorted(rows, key=lambda x: x[2]) if x[0] == r])
        g = got[r]
        if want is None:
            assert g.d_along is None and g.conf is None
        else:
            assert g.d_along == pytest.approx(want[0], abs=0.051) and g.d_cross == pytest.approx(want[1], abs=0.051) and g.conf == pytest.approx(want[2], abs=0.0006)


def test_consensus_examples(spark):
    def many(r, n, a, c, score=3.0, feat=4):
        return [(r, 0, 1000 * r + len(rows) + i, float(a), float(c), score, feat) for i in range(n)]

    rows = []
    rows += many(1, 17, 5, 2) + many(1, 1, 90, 2)
    rows += many(2, 3, 0, 0) + many(2, 3, 60, 0)
    rows += many(3, 2, 0, 0)
    rows += many(4, 5, 0, 0, feat=1)
    rows += many(5, 4, 0, 0) + many(5, 3, 0, 40)
    got = {r["round"]: r for r in C.round_consensus(spark.createDataFrame(rows, SCHEMA), ["round", "pos"], "seq").collect()}
    assert got[1].d_along == 5.0 and got[1].conf > 0.9
    assert got[2].d_along is None and got[3].d_along is None and got[4].d_along is None
    assert (got[5].d_along, got[5].d_cross) == (0.0, 0.0)


def test_box_sums_match_loop(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([0, 0, 0, 1]), rnd.randint(-120, 120) / 4, rnd.randint(-120, 120) / 4, rnd.randint(1, 9)) for _ in range(200)]
    d = spark.createDataFrame(rows, "g int, x double, y double, w long")
    for r in C.box_sums(d, ["g"], "x", "y", "w", 7.5).collect():
        assert r.mass == sum(w for g, x, y, w in rows if g == r.g and abs(x - r.x) <= 7.5 and abs(y - r.y) <= 7.5)


def test_groups_of_few_points_make_no_rows_of_rank_blocks(spark, monkeypatch):
    rnd, blocks = random.Random(5), []
    rows = [(rnd.choice([0, 0, 0, 0, 1, 2]), float(rnd.randint(-30, 30)), float(rnd.randint(-30, 30)), rnd.randint(1, 9)) for _ in range(150)]
    rows += [(3, None, 1.0, 5), (3, 1.0, None, 5), (3, 1.0, 1.0, 2)]
    d = spark.createDataFrame(rows, "g int, x double, y double, w long")
    by_blocks = C._block_sums

    def told(pts, *a):
        blocks.append({r.g for r in pts.select("g").distinct().collect()})
        return by_blocks(pts, *a)

    monkeypatch.setattr(C, "_block_sums", told)
    want = {(g, x, y): sum(w for h, a, b, w in rows if h == g and None not in (a, b) and abs(a - x) <= 12 and abs(b - y) <= 12) for g, x, y, _ in rows if None not in (x, y)}
    for limit, large in ((1000, []), (64, [{0}]), (2, [{0, 1, 2}])):
        blocks.clear()
        got = {(r.g, r.x, r.y): r.mass for r in C.box_sums(d, ["g"], "x", "y", "w", 12, limit).collect()}
        assert got == want and blocks == large


def test_dominant_cluster(spark):
    rows = [(1, float(v)) for v in (0, 1, 2, 30, 31, 32, 33)] + [(2, 4.0)]
    got = {r.k: (r.center, r.share) for r in C.dominant(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", 12).collect()}
    assert got == {1: (31.5, 0.571), 2: (4.0, 1.0)}


def test_robust_line_drops_outliers_and_small_groups_keep_the_median_offset(spark):
    rows = [(1, float(x), 2.0 * x + 1 + (50 if x == 7 else 0)) for x in range(30)] + [(2, float(x), x + 3.0) for x in range(4)]
    got = {r.k: r for r in C.robust_line(spark.createDataFrame(rows, "k int, x double, y double"), ["k"]).collect()}
    assert got[1].slope == pytest.approx(2.0) and got[1].intercept == pytest.approx(1.0) and got[1].n_used == 29
    assert (got[2].slope, got[2].intercept, got[2].rmse) == (1.0, 3.0, 0.0)


def test_robust_line_counts_equal_pairs_instead_of_carrying_them(spark, monkeypatch):
    rnd, kept = random.Random(4), []
    pairs = [(g, float(x), 3.0 * x - g + rnd.choice([0, 0, 1, 60])) for g in (1, 2) for x in range(12)]
    rows = [p for p in pairs for _ in range(rnd.randint(1, 40))] + [(1, None, 5.0), (2, 4.0, None)]
    write = C.stage

    def counted(d, name):
        out = write(d, name)
        kept.append(out.count())
        return out

    monkeypatch.setattr(C, "stage", counted)
    got = {r.k: r for r in C.robust_line(spark.createDataFrame(rows, "k int, x double, y double"), ["k"]).collect()}
    assert max(kept) <= len(set(rows))
    for g in (1, 2):
        d = [(x, y) for k, x, y in rows if k == g and x is not None and y is not None]

        def fit():
            mx, my = sum(x for x, _ in d) / len(d), sum(y for _, y in d) / len(d)
            a = sum((x - mx) * (y - my) for x, y in d) / sum((x - mx) ** 2 for x, _ in d)
            return a, my - a * mx

        for _ in range(2):
            a, b = fit()
            r = sorted(y - a * x - b for x, y in d)
            m = (r[(len(r) - 1) // 2] + r[len(r) // 2]) / 2
            near = [(x, y) for x, y in d if abs(y - a * x - b - m) < 4]
            d = near if len(near) >= 8 else d
        a, b = fit()
        assert got[g].n == sum(k == g for k, *_ in rows) and got[g].n_used == len(d)
        assert (got[g].slope, got[g].intercept) == (pytest.approx(a), pytest.approx(b)) and got[g].rmse == pytest.approx((sum((y - a * x - b) ** 2 for x, y in d) / len(d)) ** 0.5)


def test_uniformity_counts_null_as_a_value(spark):
    rows = [(1, 0, 1.0, 2.0), (1, 0, 1.0, 2.0), (2, 0, 1.0, 2.0), (2, 0, None, None), (3, 0, None, None)]
    d = C.uniformity(spark.createDataFrame(rows, "round int, pos int, a double, c double"), ["round", "pos"], ["a", "c"])
    assert {r["round"]: (r.n_values, r.low_conf) for r in d.collect()} == {1: (1, False), 2: (2, False), 3: (1, True)}
    r = C.uniformity_report(d).first()
    assert (r.rounds, r.nonuniform, r.low_conf) == (3, 1, 1)


def test_overrides_clamp_and_mark(spark):
    b = spark.createDataFrame([(1, 0), (2, 0)], "round int, pos int")
    o = spark.createDataFrame([(1, 0, 90.0, -3.0)], "round int, pos int, d_along double, d_cross double")
    got = {r["round"]: (r.shift_along, r.shift_cross, r.reliable) for r in C.apply_overrides(b, o, ["round", "pos"]).collect()}
    assert got == {1: (70.0, -3.0, True), 2: (0.0, 0.0, False)}
