"""Duplicates, strips, rivers, HUD, gates and average precision on small literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from boardlake import dims
from boardlake.operators import assemble as A
from boardlake.operators import gates as G
from boardlake.operators import layout as L
from boardlake.operators import score as S


def overlap(a, b):
    iw, ih = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if iw <= 0 or ih <= 0:
        return 0.0
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return iw * ih / (area(a) + area(b) - iw * ih)


def crowded(seed: int, n: int = 160):
    """One frame holds most boxes, with exact copies among them."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        frame = 0 if rnd.random() < 0.7 else rnd.randint(1, 5)
        x, y, w, h = rnd.randint(0, 60), rnd.randint(0, 60), rnd.choice([8, 20, 40, 90]), rnd.choice([10, 22, 41, 80])
        rows.append((frame, i, rnd.randint(0, 20) / 20, float(x), float(y), float(x + w), float(y + h)))
        if rnd.random() < 0.2:
            rows.append((frame, 1000 + i, rnd.randint(0, 20) / 20, *rows[-1][3:]))
    return rows + [(9, 5000, 0.5, 3.0, 3.0, 3.0, 9.0), (9, 5001, 0.4, 3.0, 3.0, 3.0, 9.0)]


@pytest.mark.parametrize("limit", [0.3, 0.8])
@pytest.mark.parametrize("fold_limit", [512, 4])
def test_dedup_keeps_the_greedy_choice(spark, limit, fold_limit):
    rows = crowded(int(limit * 10))
    d = spark.createDataFrame(rows, "frame int, det_id long, score double, x0 double, y0 double, x1 double, y1 double")
    got = {(r.frame, r.det_id) for r in A.dedup_overlaps(d, "frame", "det_id", limit, fold_limit).collect()}
    want = set()
    for f in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[2], r[1])):
            if all(overlap(k[3:], r[3:]) < limit for k in kept):
                kept.append(r)
                want.add((f, r[1]))
    assert got == want


@pytest.mark.parametrize("fold_limit", [512, 1])
def test_dedup_judges_boxes_that_share_an_id(spark, fold_limit):
    rows = [(1, 7, 0.9, 0.0, 0.0, 10.0, 10.0, "a"), (1, 7, 0.5, 1.0, 0.0, 11.0, 10.0, "b"), (1, 7, 0.4, 50.0, 50.0, 60.0, 60.0, "c"),
            (1, 8, 0.9, 0.0, 0.0, 10.0, 10.0, "d"), (2, 3, 0.7, 0.0, 0.0, 9.0, 9.0, "f"), (2, 3, 0.7, 0.0, 0.0, 9.0, 9.0, "e")]
    d = spark.createDataFrame(rows, "frame int, det_id long, score double, x0 double, y0 double, x1 double, y1 double, note string")
    got = A.dedup_overlaps(d, "frame", "det_id", 0.3, fold_limit)
    assert got.columns == d.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted([rows[0], rows[2], rows[5]])


def test_strip_cells_with_an_id_that_comes_twice(spark):
    rows = [(1, 5, 0.0, 1.0, "1m", False), (1, 5, 10.0, 2.0, "2m", True), (1, 6, 12.0, 1.0, "3m", False),  # one cell: 5 again, 6 joins
            (2, 4, 0.0, 1.0, "1m", False), (2, 9, 20.0, 0.0, "2m", False), (2, 4, 40.0, 1.0, "3m", True), (2, 9, 60.0, 0.0, "4m", False)]  # a long run
    d = spark.createDataFrame(rows, "frame int, det_id long, a double, c double, label string, sideways boolean")
    got = [tuple(r) for r in A.strip_cells(d, ["frame"], 70.0).orderBy("frame", "idx").collect()]
    assert got == [(1, 0, 10.0, "3m", True, "2m"), (2, 0, 0.0, "2m", True, "1m"), (2, 1, 40.0, "4m", True, "3m")]


def test_histogram_keeps_no_columns_of_all_tiles_while_it_counts(spark):
    d = spark.createDataFrame([(1, "5mr"), (1, "5m"), (1, "C"), (2, "back")], "frame int, tile string")
    h = S.histogram34(d, ["frame"], "tile")
    assert h.columns == ["frame", *dims.TILES[:34]]
    got = {r.frame: {c: r[c] for c in h.columns[1:] if r[c] != 0} for r in h.collect()}
    assert got == {1: {"5m": 2, "C": 1}, 2: {}}
    assert "pivotfirst" not in h._jdf.queryExecution().toString()


def test_bag_match_counts_names_once_and_gathers_them_once(spark):
    p = spark.createDataFrame([(1, "5m"), (1, "5m"), (1, "E"), (2, None)], "frame int, name string")
    g = spark.createDataFrame([(1, "5mr"), (1, "5m"), (1, "N"), (3, "1p")], "frame int, name string")
    m = S.bag_match(p, g, ["frame"])
    assert sorted(tuple(r) for r in m.collect()) == [(1, 3, 3, 1, 2), (2, 1, 0, 0, 0), (3, 0, 1, 0, 0)]
    assert m._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 4  # two of them, each in two steps


def test_matches_are_written_without_their_boxes(spark, monkeypatch):
    from boardlake.plans import all_queries, q_aggregates

    seen = {}
    monkeypatch.setattr(q_aggregates, "stage", lambda d, name: seen.setdefault(name, d))
    all_queries()[0]["a20_average_precision"](spark, "/root/testdata/sf0.001")
    assert seen["matched"].columns == ["cls", "score", "tp"]


CELL = "array<struct<label: string, sideways: boolean, stacked: string>>"


def strip(*cells):
    return [(c.split("+")[0].rstrip("-"), "-" in c or "+" in c, c.split("+")[1] if "+" in c else None) for c in cells]


def test_strips_parse_or_are_rejected(spark):
    cases = {
        "pon_left": (strip("1m", "1m", "1m-"), [("pon", "1m", 3)]),
        "pon_middle": (strip("1m", "1m-", "1m"), [("pon", "1m", 2)]),
        "chi_high": (strip("3m", "2m", "4m-"), [("chi", "4m", 3)]),
        "chi_out_of_order": (strip("2m", "3m", "4m-"), None),
        "chi_ok": (strip("4m", "3m", "2m-"), [("chi", "2m", 3)]),
        "closed_kan": (strip("back", "5m", "5mr", "back"), [("ankan", "", 0)]),
        "closed_kan_wrong_red": (strip("back", "5m", "5m", "back"), None),
        "added": (strip("7p", "7p", "7p+7p"), [("kakan", "7p", 3)]),
        "added_other_tile": (strip("7p", "7p", "7p+8p"), None),
        "two": (strip("N", "N", "N", "N-", "E-", "E", "E"), [("daiminkan", "N", 3), ("pon", "E", 1)]),
        "leftover": (strip("N", "N", "N-", "E"), None),
        "empty": ([], []),
    }
    d = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], f"id string, cells {CELL}")
    for r in A.parse_strips(d, ["id"], A.meld_hypotheses(spark)).collect():
        want = cases[r.id][1]
        if want is None:
            assert r.melds is None and r.problem == "unparsable", r.id
        else:
            assert [(m.type, m.called, m.rel) for m in r.melds] == want, r.id


def test_drawn_then_parsed_melds_agree(spark):
    h = A.meld_hypotheses(spark).cache()
    cells = L.meld_cells(F.col("type"), F.col("tiles"), F.col("called"), F.col("added"), F.col("rel"))
    p = A.parse_strips(h.select("hyp", cells.alias("cells")), ["hyp"], h)
    bad = p.join(h, "hyp").filter(F.col("melds").isNull() | (F.size("melds") != 1) | (F.col("melds")[0]["type"] != F.col("type"))
                                  | (F.col("melds")[0]["tiles"] != F.col("tiles")) | (F.col("melds")[0]["rel"] != F.col("rel")))
    assert h.count() > 600 and bad.count() == 0


def test_hand_and_marker_edges(spark):
    d = spark.createDataFrame([(1, i, float(i * 10)) for i in range(4)] + [(1, 4, 60.0), (2, 1, 5.0)], "frame int, det_id long, x0 double")
    rows = {(r.frame, r.det_id): (r.slot, r.drawn) for r in A.hand_row(d, ["frame"], 12.0).collect()}
    assert rows[(1, 4)] == (4, True) and rows[(1, 3)] == (3, False) and rows[(2, 1)] == (0, False)
    m = spark.createDataFrame([(5.0, 5.0), (5.0, -5.0), (6.0, -5.0), (-6.0, 5.0)], "dx double, dy double")
    assert [r[0] for r in m.select(A.marker_seat(F.col("dx"), F.col("dy"))).collect()] == ["self", "across", "right", "left"]
    t = spark.createDataFrame([("x3",), ("余09",), ("xx",), ("",), ("-2",), ("1-x",)], "s string")
    assert [r[0] for r in t.select(A.stripped_int(F.col("s"), "x余")).collect()] == [3, 9, None, None, -2, None]


def test_box_verdicts_and_frame_gate(spark):
    def probs(**kw):
        return [kw.get(t, 0.0) for t in dims.TILES]

    rows = [(1, 1, "1m", False, False, probs(**{"1m": 0.9})), (1, 2, "1m", False, False, probs(**{"2m": 0.9, "1m": 0.1})),
            (1, 3, "1m", False, False, probs(**{"2m": 0.5, "1m": 0.5})), (1, 4, "1m", True, False, probs(**{"2m": 1.0})), (1, 5, "1m", False, True, probs(**{"1m": 1.0})),
            (2, 6, "1m", False, False, probs(**{"2m": 1.0})), (2, 7, "1m", False, False, probs(**{"3m": 1.0})), (2, 8, "1m", False, False, probs(**{"4m": 1.0})),
            (2, 9, "1m", True, False, probs(**{"4m": 1.0})), (2, 10, "1m", False, False, probs(**{"1m": 1.0}))]
    d = spark.createDataFrame(rows, "frame int, id int, gt string, sideways boolean, felt boolean, probs array<double>")
    d = d.withColumn("v", G.verdict(F.col("probs"), F.col("gt"), F.col("felt"))).select("frame", "id", "sideways", "v.*")
    got = {r.id: (r.ok, r.reason, r.decision, r.dropped) for r in G.gate_boxes(d, "frame").collect()}
    assert got[1] == (True, "", "drop_boxes", False) and got[2] == (False, "mismatch", "drop_boxes", True) and got[3][0]
    assert got[4] == (False, "mismatch", "drop_boxes", False) and got[5] == (False, "empty_felt", "drop_boxes", True)
    assert got[6][2] == "drop_frame" and got[10][3] and not got[9][3]


def test_bags_count_copies_and_red_fives(spark):
    p = spark.createDataFrame([("z", 1, n) for n in ["1m", "1m", "5m", "N"]], "zone string, frame int, name string")
    g = spark.createDataFrame([("z", 1, n) for n in ["1m", "5mr", "E"]], "zone string, frame int, name string")
    r = S.bag_match(p, g, ["zone", "frame"]).first()
    assert (r.n_pred, r.n_gt, r.correct, r.correct_lenient) == (4, 3, 1, 2)


@pytest.mark.parametrize("t", [0.2, 0.5, 0.8])
def test_dense_overlap_pairs_equal_all_pairs(spark, t):
    rows = crowded(5, 120)
    d = spark.createDataFrame(rows, "frame int, det_id long, score double, x0 double, y0 double, x1 double, y1 double").withColumn("cls", F.lit(1))
    d1, g1 = d.withColumn("_d", F.col("det_id")), d.filter("det_id % 2 = 0 and x1 > x0").withColumn("_g", F.col("det_id"))
    d1 = d1.filter("x1 > x0")
    got = {(r._d, r._g) for r in S.overlap_pairs(d1, g1, ["frame", "cls"], t).collect()}
    boxes = [(r[0], r[1], r[3], r[4], r[5], r[6]) for r in rows if r[5] > r[3]]
    want = set()
    for f, i, ax0, ay0, ax1, ay1 in boxes:
        for g, j, bx0, by0, bx1, by1 in boxes:
            w, h = min(ax1, bx1) - max(ax0, bx0), min(ay1, by1) - max(ay0, by0)
            if f == g and j % 2 == 0 and w > 0 and h > 0 and w * h >= t * ((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - w * h):
                want.add((i, j))
    assert got == want and len(got) > 100


def test_overlap_of_exactly_the_limit_counts(spark):
    rows = [(1, i, x, 0.0, x + w, h) for i, (x, w, h) in enumerate([(0.0, 64.0, 64.0), (0.0, 32.0, 64.0), (32.0, 32.0, 64.0), (0.0, 64.0, 32.0), (-0.5, 64.5, 64.5), (7.0, 0.0, 9.0)])]
    d = spark.createDataFrame(rows, "frame int, id int, x0 double, y0 double, x1 double, y1 double")
    got = {(r._d, r._g) for r in S.overlap_pairs(d.withColumn("_d", F.col("id")), d.withColumn("_g", F.col("id")), ["frame"], 0.5).collect()}
    assert {(0, 1), (1, 0), (0, 2), (0, 3), (3, 0), (0, 4)} <= got and (1, 2) not in got and (1, 3) not in got and not any(5 in p for p in got)


def test_average_precision_by_hand(spark):
    g = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 20.0, 0.0, 30.0, 10.0)], "frame int, cls int, gt_id long, x0 double, y0 double, x1 double, y1 double")
    d = spark.createDataFrame([(1, 0, 1, 90, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 80, 1.0, 0.0, 11.0, 10.0), (1, 0, 3, 70, 20.0, 0.0, 30.0, 10.0)],
                              "frame int, cls int, det_id long, score int, x0 double, y0 double, x1 double, y1 double")
    m = S.match_detections(d, g)
    assert {r.det_id: r.tp for r in m.collect()} == {1: 1, 2: 0, 3: 1}
    ap = S.average_precision(m, g, "score", F.floor(F.col("_neg") / 5)).first()
    assert ap.ap == pytest.approx((1.0 + 2 / 3) / 2)
