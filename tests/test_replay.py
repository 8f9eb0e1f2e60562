"""Replay scans against a plain event loop on random, also illegal, logs, and on hand-made rounds."""

import random

import pytest
from pyspark.sql import functions as F

from boardlake import dims
from boardlake.operators import replay as R
from boardlake.operators.ordered import seq_chunk

SCHEMA = ("game long, seq long, ev_idx int, type string, actor int, target int, pai string, consumed array<string>, bakaze string, kyoku int, honba int, "
          "kyotaku int, oya int, dora_marker string, scores array<int>, tehais array<array<string>>")
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def row(game, seq, idx, type_, **kw):
    return tuple(dict(game=game, seq=seq, ev_idx=idx, type=type_, **kw).get(f) for f in FIELDS)


def random_log(seed: int):
    rnd = random.Random(seed)
    tiles = ["5m", "5mr", "1p", "N", "E", "5sr", "5s"]
    rows = []
    for game in (1, 2):
        for seq in range(120 if game == 1 else 40):
            for idx in range(rnd.choice([1, 1, 2, 3])):
                t = rnd.choice(["tsumo", "dahai", "dahai", "tsumo", "chi", "pon", "daiminkan", "ankan", "kakan", "nukidora", "reach", "reach_accepted", "dora"])
                if rnd.random() < 0.03:
                    t = "start_kyoku"
                pai, a = rnd.choice(tiles), rnd.randint(0, 3)
                n = {"chi": 2, "pon": 2, "daiminkan": 3, "ankan": 4, "kakan": 3}.get(t, 0)
                kw = dict(actor=a, target=rnd.randint(0, 3), pai=pai, consumed=[rnd.choice(tiles) for _ in range(n)])
                if t == "pon":
                    kw["consumed"] = [pai[:2], pai[:2]]
                if t == "start_kyoku":
                    kw = dict(bakaze="E", kyoku=1, honba=0, kyotaku=rnd.randint(0, 2), oya=0, dora_marker=pai, scores=[25000] * rnd.choice([3, 4]),
                              tehais=[[rnd.choice(tiles) for _ in range(4)] + ["?"] for _ in range(4)])
                if t == "dora":
                    kw = dict(dora_marker=pai)
                rows.append(row(game, seq, idx, t, **kw))
    return rows


class Loop:
    """Straightforward fold used as the expected result."""

    def __init__(self):
        self.start({"scores": [25000] * 4, "kyotaku": 0, "tehais": None}, 0, False)

    def start(self, e, no, real=True):
        self.no, self.concealed, self.scores = no, [13] * 4, list(e["scores"]) + [0] * (4 - len(e["scores"]))
        self.sticks, self.reach, self.side, self.owed, self.drawn = e["kyotaku"], [False] * 4, [0] * 4, -1, None
        self.n_dora = 1 if real else 0
        self.rivers, self.pend, self.pons = [[] for _ in range(4)], [False] * 4, [[] for _ in range(4)]
        self.hand = [t for t in e["tehais"][0] if t != "?"] if e["tehais"] else []

    def drop(self, t):
        for x in (t, t[:2] if t.endswith("r") else t):
            if x in self.hand:
                self.hand.remove(x)
                return

    def apply(self, e):
        """Returns (taken discard, matched pon) of claims and added kans."""
        t, a, at = e["type"], e["actor"], (e["seq"], e["ev_idx"])
        if t == "start_kyoku":
            self.start(e, self.no + 1)
        elif t == "tsumo":
            self.concealed[a] += 1
            if a == 0:
                self.hand.append(e["pai"])
                self.drawn = e["pai"]
        elif t == "dahai":
            self.concealed[a] -= 1
            self.rivers[a].append({"at": at, "called": False, "riichi": self.pend[a]})
            self.pend[a] = False
            if a == 0:
                self.drop(e["pai"])
                self.drawn = None
            if self.owed == a:
                self.owed = -1
        elif t == "reach":
            self.pend[a] = True
        elif t == "reach_accepted":
            self.reach[a], self.sticks = True, self.sticks + 1
            self.scores[a] -= 1000
        elif t == "dora":
            self.n_dora += 1
        else:
            took = None
            lost = e["consumed"] if t in ("chi", "pon", "daiminkan", "ankan") else ["N"] if t == "nukidora" else [e["pai"]]
            if t in ("chi", "pon", "daiminkan"):
                took = next((d for d in reversed(self.rivers[e["target"]]) if not d["called"]), None)
                if took:
                    took["called"] = True
            if t == "pon":
                self.pons[a].append((e["pai"][:2] if e["pai"][0] == "5" else e["pai"], at))
            if t == "kakan":
                base = e["pai"][:2] if e["pai"][0] == "5" else e["pai"]
                took = next((p for p in self.pons[a] if p[0] == base), None)
                if took:
                    self.pons[a].remove(took)
            self.concealed[a] -= len(lost)
            self.side[a] += t == "nukidora"
            if a == 0:
                self.drawn = None
                for x in lost:
                    self.drop(x)
            if t != "nukidora":
                self.owed = a
            return took
        return None


@pytest.fixture(scope="module", params=[11, 12])
def log(request, spark):
    rows = random_log(request.param)
    events = spark.createDataFrame(rows, SCHEMA)
    states, takes, rivers = {}, {}, {}
    for game in (1, 2):
        loop = Loop()
        for r in [dict(zip(FIELDS, x)) for x in sorted((x for x in rows if x[0] == game), key=lambda x: x[1:3])]:
            took = loop.apply(r)
            key = (game, r["seq"], r["ev_idx"])
            states[key] = dict(no=loop.no, concealed=list(loop.concealed), scores=list(loop.scores), sticks=loop.sticks, reach=list(loop.reach),
                               side=list(loop.side), owed=loop.owed, drawn=loop.drawn, hand=list(loop.hand), n_dora=loop.n_dora)
            takes[key] = took
            for s in range(4):
                rivers[(game, loop.no, s)] = [dict(d) for d in loop.rivers[s]]
    return events, states, takes, rivers


@pytest.mark.parametrize("size", [3, 10_000])
def test_running_scalars(log, size):
    events, states, _, _ = log
    ch = seq_chunk("seq", size)
    d = R.drawn_tile(R.owed_discard(R.seat_scalars(R.with_round(events, ch), ch), ch), F.lit(0), ch)
    for r in d.collect():
        s = states[(r.game, r.seq, r.ev_idx)]
        assert r.kyoku_ord == s["no"]
        assert [r[f"concealed_{i}"] for i in range(4)] == s["concealed"]
        assert [r[f"score_{i}"] for i in range(4)] == s["scores"]
        assert [r[f"reach_{i}"] for i in range(4)] == s["reach"] and [r[f"side_{i}"] for i in range(4)] == s["side"]
        assert (r.sticks, r.n_dora, r.owed, r.drawn) == (s["sticks"], s["n_dora"], s["owed"], s["drawn"])


@pytest.mark.parametrize("size", [1, 3, 17, 10_000])
def test_one_pass_equals_the_loop(log, size):
    events, states, _, _ = log
    for r in R.replayed(events, hero=F.lit(0), chunk=seq_chunk("seq", size)).collect():
        s = states[(r.game, r.seq, r.ev_idx)]
        assert r.kyoku_ord == s["no"]
        assert [r[f"concealed_{i}"] for i in range(4)] == s["concealed"] and [r[f"score_{i}"] for i in range(4)] == s["scores"]
        assert [r[f"reach_{i}"] for i in range(4)] == s["reach"] and [r[f"side_{i}"] for i in range(4)] == s["side"]
        assert (r.sticks, len(r.dora), r.owed, r.drawn, r.r_bakaze) == (s["sticks"], s["n_dora"], s["owed"], s["drawn"], "E" if s["no"] else None)


@pytest.mark.parametrize("size", [5, 10_000])
def test_hero_hand(log, size):
    events, states, _, _ = log
    ch = seq_chunk("seq", size)
    rows = R.hero_hand(R.hero_events(R.with_round(events, ch), F.lit(0)), ch).collect()
    assert rows
    for r in rows:
        want = sorted(states[(r.game, r.seq, r.ev_idx)]["hand"], key=dims.HAND_ORDER.index)
        assert r.hand == want


@pytest.mark.parametrize("size", [4, 10_000])
def test_claims_rivers_and_sideways(log, size):
    events, _, takes, rivers = log
    ch = seq_chunk("seq", size)
    rounds = R.with_round(events, ch)
    for r in R.claim_levels(rounds, ch).filter("type <> 'dahai'").collect():
        took = takes[(r.game, r.seq, r.ev_idx)]
        assert (r.takes_seq, r.takes_idx) == (took["at"] if took else (None, None))
    got = {}
    flags = {(r.game, r.seq, r.ev_idx): r.riichi for r in R.riichi_discards(rounds, ch).collect()}
    for r in R.river(rounds, ch).collect():
        got.setdefault((r.game, r.kyoku_ord, r.river_seat), []).append(r)
    for key, rows in got.items():
        want = rivers[key]
        rows.sort(key=lambda r: r.river_idx)
        assert [(r.seq, r.ev_idx) for r in rows] == [d["at"] for d in want]
        assert [r.called for r in rows] == [d["called"] for d in want]
        assert [flags[(r.game, r.seq, r.ev_idx)] for r in rows] == [d["riichi"] for d in want]
    changes = R.claim_levels(rounds, ch).select("game", "kyoku_ord", "river_seat", *R.ORDER, "type", "level", "takes_seq")
    d = changes.join(R.riichi_discards(rounds, ch).select("game", *R.ORDER, "riichi"), ["game", *R.ORDER], "left")
    sideways = {(r.game, r.kyoku_ord, r.river_seat, r.seq, r.ev_idx): r.sideways_idx for r in R.sideways_index(d, ["game", "kyoku_ord", "river_seat"], R.ORDER, ch).collect()}
    places = {(r.game, r.seq, r.ev_idx): r.visible_idx for rows in got.values() for r in rows}
    lying: dict = {}
    for r in sorted(d.collect(), key=lambda r: (r.game, r.kyoku_ord, r.seq, r.ev_idx)):
        key = (r.game, r.kyoku_ord, r.river_seat)
        tiles, state = lying.setdefault(key, ([], {"n": 0, "riichi": None}))
        if r.type == "dahai":
            if r.riichi and state["riichi"] is None:
                state["riichi"] = state["n"]
            tiles.append(state["n"])
            state["n"] += 1
            assert places[(r.game, r.seq, r.ev_idx)] == len(tiles) - 1
        elif r.takes_seq is not None:
            tiles.pop()
        want = None if state["riichi"] is None else next((i for i, n in enumerate(tiles) if n >= state["riichi"]), None)
        assert sideways[(*key, r.seq, r.ev_idx)] == want


def test_indicators_as_of_each_record(spark):
    start = dict(bakaze="E", kyoku=1, honba=0, kyotaku=0, oya=0, dora_marker="1m", scores=[25000] * 4)
    rows = [row(1, 0, 0, "start_kyoku", **start), row(1, 1, 0, "dahai", actor=0, pai="1m"), row(1, 2, 0, "dora", dora_marker="9p"), row(1, 2, 1, "dahai", actor=1, pai="2m"),
            row(1, 3, 0, "start_kyoku", **(start | {"dora_marker": "E"}))]
    got = R.replayed(spark.createDataFrame(rows, SCHEMA), ("dora",)).orderBy("seq", "ev_idx").collect()
    assert [r.dora for r in got] == [["1m"], ["1m"], ["1m", "9p"], ["1m", "9p"], ["E"]]


def test_added_kans(log):
    events, _, takes, _ = log
    ch = seq_chunk("seq", 6)
    rows = R.added_kans(R.with_round(events, ch), ch).collect()
    assert rows
    for r in rows:
        took = takes[(r.game, r.seq, r.ev_idx)]
        assert r.pon_seq == (took[1][0] if took else None)


def test_deal_window_survives_a_bundled_draw(spark):
    start = dict(bakaze="E", kyoku=1, honba=0, kyotaku=0, oya=0, dora_marker="1m", scores=[25000] * 4)
    rows = [row(1, 0, 0, "start_kyoku", **start), row(1, 0, 1, "tsumo", actor=0, pai="1m"), row(1, 1, 0, "dahai", actor=0, pai="1m"), row(1, 2, 0, "end_kyoku")]
    d = R.in_round(R.with_round(spark.createDataFrame(rows, SCHEMA)))
    got = [R for R in d.select("seq", "ev_idx", R.deal_window(F.col("open"), F.col("n_discards")).alias("deal")).orderBy("seq", "ev_idx").collect()]
    assert [r.deal for r in got] == [True, True, False, False]


def test_three_player_flag_is_sticky_and_needs_more_than_a_zero_score(spark):
    base = dict(bakaze="E", kyoku=1, honba=0, oya=0, dora_marker="1m")
    rows = [row(1, 0, 0, "start_kyoku", scores=[50000, 30000, 20000, 0], kyotaku=0, **base), row(1, 1, 0, "nukidora", actor=1),
            row(1, 2, 0, "start_kyoku", scores=[25000] * 4, kyotaku=0, **base), row(2, 0, 0, "start_kyoku", scores=[35000, 35000, 34000, 0], kyotaku=1, **base),
            row(3, 0, 0, "start_kyoku", scores=[35000, 35000, 35000], kyotaku=0, **base)]
    d = R.with_mode(spark.createDataFrame(rows, SCHEMA)).orderBy("game", "seq").collect()
    assert [r.sanma for r in d] == [False, True, True, True, True]


def test_wall_count_is_lost_when_its_record_starts_a_round(spark):
    rows = [(1, 0, 1, True, 69), (1, 1, 1, False, 68), (1, 2, 1, False, None), (1, 3, 2, True, 50), (1, 4, 2, False, None)]
    d = R.left_count(spark.createDataFrame(rows, "game int, seq long, kyoku_ord int, has_start boolean, c int"), "seq", F.col("c"))
    assert [r.left_tiles for r in d.orderBy("seq").collect()] == [None, 68, 68, None, None]


def test_windows_use_the_whole_record(spark):
    d = spark.createDataFrame([(["pon", "dora"], "dora"), (["dahai"], "dahai"), ([], "chi"), (["reach", "dahai"], "dahai")], "types array<string>, last string")
    got = d.select(R.in_window(F.col("types"), F.col("last"), dims.CALL_EVENTS).alias("c"), R.in_window(F.col("types"), F.col("last"), dims.REACH_EVENTS).alias("r")).collect()
    assert [(r.c, r.r) for r in got] == [(True, False), (False, False), (True, False), (False, True)]
