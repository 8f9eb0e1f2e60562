"""Logs, manifests, discovery, splits, purges and live operators on small tables."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boardlake.functions import text as T
from boardlake.operators import capture as CP
from boardlake.operators import curate as K
from boardlake.operators import gates as G
from boardlake.session import fresh_path
from boardlake.sources import datasets as D
from boardlake.sources import records as R
from boardlake.streaming import pairs, replay_stream
from boardlake.streaming.run import drain_growing


def write_lines(spark, name, lines):
    path = fresh_path(spark, name)
    os.makedirs(path)
    with open(f"{path}/game7.jsonl", "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_log_header_blank_lines_and_missing_fields(spark):
    rec = {"seq": 3, "ts": 1.5, "flow_id": "f", "seat": 2, "last_op_step": 1, "syncing": False, "method": "m", "action_name": None,
           "raw_liqi": {"data": {"x": [1, 2]}}, "mjai": [{"type": "dora", "dora_marker": "1m"}, {"type": "chi", "consumed": ["1m", "2m"]}], "later_field": 9}
    path = write_lines(spark, "log", ['{"_schema": 1}', "", json.dumps(rec), '{"seq": 4, "mjai": []}'])
    d = R.read_records(spark, path).orderBy("seq")
    a, b = d.collect()
    assert a.game == "game7" and json.loads(a.raw_liqi) == {"data": {"x": [1, 2]}} and [e.type for e in a.mjai] == ["dora", "chi"] and a.mjai[1].consumed == ["1m", "2m"]
    assert (b.seq, b.mjai, b.meta, b.syncing, b.screenshot) == (4, [], {}, False, None)
    again = fresh_path(spark, "log")
    R.write_records(d, again)
    c = R.read_records(spark, again).orderBy("seq").collect()
    plain = lambda x: x.asDict(True) | {"game": 0, "raw_liqi": x.raw_liqi and json.loads(x.raw_liqi)}
    assert [plain(x) for x in c] == [plain(x) for x in (a, b)]


def test_discovery_stops_on_duplicates(spark):
    ok = [("/r/run_1/game1/game1.jsonl", 5), ("/r/run_1/game1.jsonl", 5), ("/r/run_1/game2.jsonl", 5), ("/r/session4.jsonl", 1), ("/r/run_2/run_2.jsonl", 1),
          ("/r/run_1/game3/game3.jsonl", 5), ("/r/run_1/game3/frames.jsonl", 0)]
    d = K.discover_games(spark.createDataFrame(ok, "path string, size int"), "/r/")
    assert {(r.name, r.frames_dir) for r in d.collect()} == {
        ("r_run_1_game1", "/r/run_1/game1"), ("r_run_1_game2", "/r/run_1/game2"), ("session4", "/r/session4"), ("r_run_2", "/r/run_2")}
    dup = spark.createDataFrame([("/r/run_1/game1.jsonl", 1), ("/r/run_1/game1.jsonl", 1)], "path string, size int")
    with pytest.raises(Exception, match="duplicate game name"):
        K.discover_games(dup, "/r").collect()
    listing = spark.createDataFrame(ok + [("/q/run_7/game1.jsonl", 3)], "path string, size int")
    assert {r.name for r in K.discover_games(listing, "/r", "/q/").collect()} == {"r_run_1_game1", "r_run_1_game2", "session4", "r_run_2", "q_run_7_game1"}
    with pytest.raises(Exception, match="no games below /none/"):
        K.discover_games(listing, "/r", "/none").collect()


def test_every_origin_of_a_name_is_told(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", "x")], "name string, origin string")
    assert sorted(tuple(r) for r in K.duplicate_names(rows, "name", "origin").collect()) == [("a", 3, "x"), ("a", 3, "y"), ("a", 3, "z")]


def test_names_and_folders(spark):
    rows = [("/d/s2/run_3/game1/game1.jsonl", "s2_run_3_game1", "/d/s2/run_3/game1"), ("/d/s2/run_3/game1.jsonl", "s2_run_3_game1", "/d/s2/run_3/game1"),
            ("/d/s2/run_3/run_3.jsonl", "s2_run_3", "/d/s2/run_3"), ("/d/s2/run_3.jsonl", "s2_run_3", "/d/s2/run_3"), ("/d/m/session5.jsonl", "session5", "/d/m/session5")]
    d = spark.createDataFrame(rows, "p string, n string, f string")
    for r in d.select("n", "f", T.game_name(F.col("p")).alias("gn"), T.frames_dir(F.col("p")).alias("fd")).collect():
        assert (r.gn, r.fd) == (r.n, r.f)


def test_manifest_takes_a_list_or_one_name(spark):
    games = spark.createDataFrame([("a", "a", "ai", "c", "f"), ("b", "b", "ai", "c", "f")], "name string, dir string, kind string, capture string, frames_dir string")
    path = fresh_path(spark, "m")
    D.write_manifest(games, ["b"], ["hbb"], path)
    assert {r.name: r.is_val for r in D.read_manifest(spark, path).collect()} == {"a": False, "b": True}
    old = write_lines(spark, "m", ['{"val": "a", "games": [{"name": "a"}, {"name": "b"}]}'])
    assert {r.name: r.is_val for r in D.read_manifest(spark, old).collect()} == {"a": True, "b": False}


def test_splits_are_disjoint_and_later_specs_win(spark):
    specs = T.holdout_specs(spark.createDataFrame([(0, "g1:*"), (1, "g2:E1.0"), (2, "g2:E2.0,E3.0"), (3, None), (4, "g3")], "ord int, spec string"))
    img = spark.createDataFrame([(g, i, k) for g in ("g1", "g2", "g3", "g4") for i, k in enumerate(["E1.0", "E2.0", "E3.0"])], "game string, seq int, round_key string")
    out = {(r.game, r.round_key): r.split for r in K.split_rows(img, specs).collect()}
    assert all(out[("g1", k)] == "val" for k in ("E1.0", "E2.0", "E3.0"))
    assert (out[("g2", "E1.0")], out[("g2", "E2.0")], out[("g2", "E3.0")]) == ("train", "val", "val")
    assert {out[("g3", "E1.0")], out[("g4", "E1.0")]} == {"train"}
    assert K.holdout_leaks(K.split_rows(img, specs), ["game", "round_key"]).count() == 0


def test_purge_and_import_twice_change_nothing(spark):
    rows = spark.createDataFrame([("g", 1, "crop"), ("g", 2, "crop"), ("h", 1, "label")], "game string, seq int, kind string")
    m = spark.createDataFrame([("g", 1)], "game string, seq int")
    once = K.purge(rows, m)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, K.purge(once, m).collect())) == [("g", 2, "crop"), ("h", 1, "label")]
    now = spark.createDataFrame([("g", "1", "a"), ("g", "2", "b")], "game string, stem string, text string")
    fix = spark.createDataFrame([("g__1", "x"), ("g__2", "b"), ("g__a__b", "n"), ("loose", "q")], "name string, text string")
    plan = K.classify_import(fix, now)
    assert {r.name: r.action for r in plan.collect()} == {"g__1": "update", "g__2": "unchanged", "g__a__b": "skip", "loose": "unmatched"}
    after = K.apply_import(now, K.classify_import(fix, now, True))
    assert {(r.stem, r.text) for r in after.collect()} == {("1", "x"), ("2", "b"), ("a__b", "n")}
    assert set(map(tuple, K.apply_import(after, K.classify_import(fix, after, True)).collect())) == set(map(tuple, after.collect()))


def test_crops_and_rows_align_or_the_frame_goes(spark):
    crops = [("g", 1, i * 5, c, b) for i, (c, b) in enumerate([("1m", False), ("2m", True), ("3m", False)])]
    crops += [("g", 2, 0, "1m", False), ("g", 2, 1, "2m", True), ("g", 3, 0, "1m", True), ("g", 4, 0, "1m", False)]
    labels = [("g", 1, i, c) for i, c in enumerate(["1m", "2m", "3m"])] + [("g", 2, i, c) for i, c in enumerate(["9m", "1m", "2m"])] + [("g", 3, 0, "1m"), ("g", 4, 0, "7m")]
    dec = [("g", 1, "drop_boxes"), ("g", 2, "drop_boxes"), ("g", 3, "drop_frame"), ("g", 4, "keep")]
    c, l = K.align_crops(spark.createDataFrame(crops, "game string, seq int, crop_idx int, cls string, bad boolean"),
                         spark.createDataFrame(labels, "game string, seq int, line_no long, cls string"), spark.createDataFrame(dec, "game string, seq int, decision string"))
    assert sorted((r.seq, r.cls) for r in c.collect()) == [(1, "1m"), (1, "3m"), (2, "1m"), (4, "1m")]
    assert sorted((r.seq, r.cls) for r in l.collect()) == [(1, "1m"), (1, "3m"), (4, "7m")]


def test_crops_are_numbered_once(spark):
    c = spark.createDataFrame([("g", 1, 0, "1m", False)], "game string, seq int, crop_idx int, cls string, bad boolean")
    l = spark.createDataFrame([("g", 1, 0, "1m")], "game string, seq int, line_no long, cls string")
    for d in K.align_crops(c, l, spark.createDataFrame([("g", 1, "keep")], "game string, seq int, decision string")):
        assert d.count() == 1 and "Window" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_json_annotations_can_be_compressed(spark, tmp_path):
    d = spark.createDataFrame([("g", s, ["occluded"] * 9) for s in range(500)], "game string, seq long, flags array<string>")
    sizes = {}
    for how in (None, "gzip"):
        path = str(tmp_path / f"a-{how}")
        D.write_annotations(d, path, "json", how)
        back = D.read_annotations(spark, path, "json").select("game", "seq", "flags")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()))
        sizes[how] = sum(f.stat().st_size for f in (tmp_path / f"a-{how}" / "game=g").glob("part-*"))
    assert 5 * sizes["gzip"] < sizes[None]


def test_a_small_batch_costs_no_frames(monkeypatch):
    import pandas as pd

    from boardlake.streaming import timers

    parts = [pd.DataFrame({"seq": [4, 2], "ts_us": [7, 7]}), pd.DataFrame({"seq": [3], "ts_us": [5]})]
    monkeypatch.setattr(pd, "concat", None)
    got = timers.in_order(iter(parts), ["seq", "ts_us"], lambda r: (r[1], r[0]))
    assert got == [(3, 5), (2, 7), (4, 7)] and type(got[0][0]) is int


def test_broken_games_stop_the_build(spark):
    img = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "game string, stem string")
    lab = spark.createDataFrame([("a", "1", "0 1 1 1 1\n"), ("b", "1", "\n0 1 1 1 1 1 1 1 1\n"), ("c", "1", "")], "game string, stem string, text string")
    p = G.label_problems(img, lab, 5)
    got = {r.game: r.problem for r in p.collect()}
    assert got["a"] == "truncated: 2 images vs 1 labels" and got["b"].startswith("1.txt: 9-field rows") and got["c"] == "no yolo/images"
    with pytest.raises(Exception, match="truncated"):
        G.require_clean(p.filter("game = 'a'")).collect()


def test_seat_metadata_needs_the_hero(spark):
    views = "array<struct<slot: int, item: int>>"
    rows = [(1, 10, [(9, 1, None, [(6, 1)]), (10, 2, 3, [(6, 5), (None, 7), (6, 8)])], [(0, 4, None)]), (2, 99, [(9, 1, None, [(6, 1)])], []), (3, None, [(9, 1, None, None)], [])]
    d = spark.createDataFrame(rows, f"game int, hero int, players array<struct<account: int, charid: int, skin: int, views: {views}>>, robots array<struct<account: int, charid: int, skin: int>>")
    got = {r.game: r for r in K.seat_metadata(d).collect()}
    assert got[1].table == {"6": 8} and got[1].hero_account == 10 and [c.robot for c in got[1].characters] == [False, False, True] and got[1].characters[0].skin == 0
    assert got[2].table == {} and got[2].hero_account is None and got[3].table == {}


def test_debounce_examples(spark):
    s = 1_000_000
    ev = [(1, 1, 0), (1, 2, 100_000), (1, 3, 500_000)] + [(2, i, i * 250_000) for i in range(12)]
    d = CP.debounce(spark.createDataFrame(ev, "game long, seq long, ts_us long"), 300_000, 2 * s)
    got = sorted(tuple(r) for r in d.select("game", "key", "capture_us", "capped").collect())
    assert got == [(1, 2, 400_000, False), (1, 3, 800_000, False), (2, 8, 2_000_000, True), (2, 11, 3_050_000, False)]


def test_extra_shots_fire_once_and_are_cancelled(spark):
    ev = [(1, 1, 0, True), (1, 2, 1_500_000, False), (1, 3, 9_000_000, True)]
    d = CP.extra_shots(spark.createDataFrame(ev, "game long, seq long, ts_us long, window boolean"), [600, 1200, 2400])
    assert sorted((r.seq, r.offset_ms) for r in d.collect()) == [(1, 600), (1, 1200), (3, 600), (3, 1200), (3, 2400)]


def test_live_replay_marks_late_events(spark):
    def ev(seq, idx, t, actor=None, n=0, kyotaku=None, scores=None):
        return (1, seq, idx, t, actor, n, kyotaku, scores)

    schema = "game long, seq long, ev_idx int, type string, actor int, n_consumed int, kyotaku int, scores array<int>"
    parts = [[ev(0, 0, "start_kyoku", kyotaku=1, scores=[25000] * 4), ev(1, 0, "tsumo", 0), ev(2, 0, "dahai", 0)],
             [ev(1, 0, "tsumo", 0), ev(3, 0, "reach_accepted", 2), ev(3, 1, "pon", 1, 2)]]
    rows = drain_growing([(spark.createDataFrame(p, schema),) for p in parts], replay_stream.replay, "snap").orderBy("seq", "late", "owed").collect()
    late = [r for r in rows if r.late]
    assert len(late) == 1 and late[0].seq == 1
    last = [r for r in rows if r.seq == 3 and r.owed == 1][0]
    assert (last.concealed, last.scores[2], last.sticks, last.reach, last.kyoku_ord) == ([13, 11, 13, 13], 24000, 2, [False, False, True, False], 1)


def test_live_replay_keeps_neighbouring_games_in_one_state(spark, monkeypatch):
    """Games of a shelf, also one without a number, do not touch each other; a shelf is one state."""
    from boardlake.streaming.run import drain, source

    schema = "game long, seq long, ev_idx int, type string, actor int, n_consumed int, kyotaku int, scores array<int>"
    rnd = random.Random(8)
    games = [0, 1, 2, 63, 64, -1, -70, None]
    kinds = ["start_kyoku", "tsumo", "dahai", "pon", "reach_accepted", "dora"]
    rows = []
    for g in games:
        for q in range(30):
            t = rnd.choice(kinds)
            rows.append((g, q, 0, t, None if t in ("start_kyoku", "dora") else rnd.randrange(4), 2, q % 3, [20000 + 100 * q] * 4 if t == "start_kyoku" else None))
    rnd.shuffle(rows)
    slices = [[r for r in rows if lo <= r[1] < lo + 10] + [r for r in rows if r[0] == 1 and r[1] == lo - 2] for lo in (0, 10, 20)]
    parts = [spark.createDataFrame(p, schema) for p in slices]
    monkeypatch.setattr(replay_stream, "ROWS_OUT", 7)
    shown = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    apart = shown(drain_growing([(p,) for p in parts], lambda s: replay_stream.replay(s, 1), "alone"))
    assert len(apart) == len(rows) + 2 and sum(r[-1] for r in apart) == 2
    into, out, check = (fresh_path(spark, n) for n in ("shelf-in", "shelf-out", "shelf-check"))
    for p in parts:
        p.write.mode("append").parquet(into)
        drain(replay_stream.replay(source(spark, into, p.schema)), out, check)
    assert shown(spark.read.parquet(out)) == apart
    assert spark.read.format("statestore").load(check).count() == 4  # 0 with -1, 64, -70 and null


def test_live_timers_lose_no_row_of_a_lagging_game(spark):
    from boardlake.streaming import timers

    sec = 1_000_000
    shape = "game long, seq long, ts_us long, window boolean, closing boolean"
    batches = [[(1, 1, 100 * sec, True, False), (1, 2, 101 * sec, False, False)], [(2, 1, 50 * sec, True, False), (2, 2, 51 * sec, True, False)],
               [(2, 1, 49 * sec, True, False), (1, 3, 200 * sec, False, True), (2, 3, 200 * sec, False, True)]]
    parts = [(spark.createDataFrame(b, shape),) for b in batches]
    got = drain_growing(parts, lambda s: timers.debounce(s, sec // 2, 10 * sec), "c").collect()
    assert sorted(tuple(r) for r in got if not r.late) == [(1, 1, 100 * sec, 100 * sec + sec // 2, False, False), (1, 2, 101 * sec, 101 * sec + sec // 2, False, False),
                                                          (2, 1, 50 * sec, 50 * sec + sec // 2, False, False), (2, 2, 51 * sec, 51 * sec + sec // 2, False, False)]
    assert [(r.game, r.key, r.start_us) for r in got if r.late] == [(2, 1, 49 * sec)]
    shots = drain_growing(parts, lambda s: timers.extra_shots(s, [500, 2000]), "s").collect()
    assert sorted((r.game, r.seq, r.offset_ms) for r in shots if not r.late) == [(1, 1, 500), (2, 1, 500), (2, 2, 500), (2, 2, 2000)]
    assert [(r.game, r.seq) for r in shots if r.late] == [(2, 1)]


def test_live_offers_drop_replays(spark):
    rows = [("f", 1, False, "2024-01-01 00:00:00"), ("f", 1, False, "2024-01-01 00:00:01"), ("f", 2, True, "2024-01-01 00:00:02"), ("g", 1, None, "2024-01-01 00:00:02")]
    d = spark.createDataFrame(rows, "flow_id string, seq long, syncing boolean, t string").withColumn("ts", F.to_timestamp("t"))
    parts = [(d.limit(2),), (d.filter("seq = 2 or flow_id = 'g'"),)]
    got = drain_growing(parts, lambda s: pairs.first_offers(s, "1 hour"), "o").collect()
    assert sorted((r.flow_id, r.seq) for r in got) == [("f", 1), ("g", 1)]


def test_late_games_are_reported(spark):
    d = spark.createDataFrame([("a", 0, 0), ("a", 1, 2), ("a", 2, 1), ("b", 0, 0), ("b", 1, 1)], "game string, arrival long, seq long")
    assert [tuple(r) for r in R.monotonic(d).collect()] == [("a", 1)]


def _picked_in_turn(frames, per_signature, total):
    """The rule as a loop: (game, seq) in the order of picking."""
    shapes, used, picks = {}, Counter(), []
    for game, seq, shape, interest in frames:
        shapes.setdefault((-interest, shape), {}).setdefault(game, []).append(seq)
    for (_, _), games in sorted(shapes.items()):
        for game in sorted(games, key=lambda g: (used[g], g))[:per_signature]:
            seqs = sorted(games[game])
            picks.append((game, seqs[len(seqs) // 2]))
        picks = picks[:total]
        used = Counter(g for g, _ in picks)
    return picks


@pytest.mark.parametrize(("per_signature", "total"), [(1, 5), (3, 17), (4, 400)])
def test_diverse_frames_count_every_pick(spark, per_signature, total):
    rng = random.Random(total)
    frames = []
    for seq in range(900):
        shape = min(int(rng.expovariate(0.2)), 30)
        frames.append((rng.choice("abcdefghij"[:3 + seq % 8]), seq, shape, shape % 7))
    d = spark.createDataFrame(frames, "game string, seq long, shape long, interest long")
    got = [(r.game, r.seq) for r in K.diverse_frames(d, ["shape"], per_signature, total).collect()]
    assert got == _picked_in_turn(frames, per_signature, total)
    assert K.diverse_frames(d.limit(0), ["shape"], per_signature, total).count() == 0


def test_label_text_keeps_the_tables_order_of_equal_ids(spark, tmp_path):
    """The SQL leaves equal ids open; a stable sort of the table settles them."""
    from boardlake.plans import all_queries

    rnd = random.Random(4)
    rows = [(rnd.randrange(6), rnd.randrange(500), rnd.randrange(300), rnd.randint(1, 7), float(rnd.randint(1, 50)), rnd.randint(1, 4) + 0.25, 0.05, 0.02, "A", "O") for _ in range(80)]
    shape = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
             "l_returnflag string, l_linestatus string")
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.frame: r for r in all_queries()[0]["s10_label_text"](spark, str(tmp_path)).collect()}
    for text in ("hbb", "obb"):
        classes = {f: [int(x.split()[0]) for x in r[text].splitlines()] for f, r in got.items()}
        assert classes == {f: [r[1] % 38 for r in sorted((r for r in rows if r[0] == f), key=lambda r: r[5])] for f in got}
    assert len(got) == 6
