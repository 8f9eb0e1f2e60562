"""Board states against an event loop that folds every record, on random, also illegal, logs."""

import pytest
from pyspark.sql import functions as F

from boardlake import dims
from boardlake.operators import board as B
from boardlake.operators.ordered import seq_chunk
from boardlake.streaming import board_stream
from boardlake.streaming.run import STORE, drain_growing
from tests.test_replay import FIELDS, SCHEMA, random_log, row


def base(t):
    return t[:2] if t[0] == "5" else t


def order(tiles):
    return sorted(tiles, key=lambda t: dims.HAND_ORDER.index(t) if t in dims.HAND_ORDER else 999)


class Fold:
    """The board after each event, as plain lists."""

    def __init__(self):
        self.new(0, None, [])

    def new(self, no, dora, hand):
        self.no, self.dora, self.hand = no, [dora] if dora else [], [t for t in hand if t != "?"]
        self.rivers, self.sets, self.pend, self.actor = [[] for _ in range(4)], [[] for _ in range(4)], [False] * 4, -1

    def drop(self, t):
        for x in (t, base(t) if t.endswith("r") else t):
            if x in self.hand:
                self.hand.remove(x)
                return

    def apply(self, e):
        t, a = e["type"], e["actor"]
        if t == "start_kyoku":
            self.new(self.no + 1, e["dora_marker"], (e["tehais"] or [[]])[0])
        elif t == "dora":
            self.dora.append(e["dora_marker"])
        elif t == "reach":
            self.pend[a] = True
        elif t == "tsumo":
            self.hand += [e["pai"]] if a == 0 else []
        elif t == "dahai":
            self.rivers[a].append({"pai": e["pai"], "riichi": self.pend[a], "called": False})
            self.pend[a] = False
            if a == 0:
                self.drop(e["pai"])
        elif t in ("chi", "pon", "daiminkan"):
            taken = [d for d in self.rivers[e["target"]] if not d["called"]]
            if taken:
                taken[-1]["called"] = True
            self.sets[a].append([t, order([e["pai"], *e["consumed"]]), e["pai"], "", e["target"]])
        elif t == "ankan":
            self.sets[a].append([t, order(e["consumed"]), "", "", a])
        elif t == "kakan":
            own = next((m for m in self.sets[a] if m[0] == "pon" and base(m[2]) == base(e["pai"])), None)
            if own:
                own[0], own[1], own[3] = t, order([*own[1], e["pai"]]), e["pai"]
            else:
                self.sets[a].append([t, list(e["consumed"]), "", e["pai"], a])
        if a == 0 and t not in ("tsumo", "dahai", "reach", "reach_accepted"):
            for x in {"kakan": [e["pai"]], "nukidora": ["N"]}.get(t, e["consumed"] or []):
                self.drop(x)
        if t in ("tsumo", "dahai", *dims.CALL_EVENTS):
            self.actor = a

    def river(self, s):
        since = next((i for i, d in enumerate(self.rivers[s]) if d["riichi"]), None)
        side = None if since is None else next((i for i, d in enumerate(self.rivers[s]) if i >= since and not d["called"]), None)
        return [(d["pai"], d["riichi"], i == side) for i, d in enumerate(self.rivers[s]) if not d["called"]]


@pytest.mark.parametrize("seed, size", [(21, 10_000), (22, 7)])
def test_board_of_every_record(spark, seed, size):
    rows = random_log(seed)
    want = {}
    for game in (1, 2):
        fold = Fold()
        for e in [dict(zip(FIELDS, x)) for x in sorted((x for x in rows if x[0] == game), key=lambda x: x[1:3])]:
            fold.apply(e)
            want[game, e["seq"]] = (fold.no, [fold.river(s) for s in range(4)], [[tuple(map(str, m)) for m in s] for s in fold.sets], list(fold.dora), order(fold.hand), fold.actor)
    got = B.board_states(spark.createDataFrame(rows, SCHEMA), F.lit(0), chunk=seq_chunk("seq", size)).collect()
    assert len(got) == len(want)
    for r in got:
        rivers = [[(x.pai, x.riichi, x.sideways) for x in s] for s in r.rivers]
        sets = [[(m.type, str(m.tiles), m.called, m.added, str(m.from_seat)) for m in s] for s in r.melds]
        assert (r.kyoku_ord, rivers, sets, r.dora, r.hand, r.last_actor) == want[r.game, r.seq]


def test_hero_comes_from_the_log(spark):
    rows = [(1, 0, 0, "tsumo", None), (1, 1, 0, "start_game", 2), (1, 2, 0, "tsumo", None), (1, 9, 0, "start_game", 0), (2, 5, 0, "dahai", None)]
    d = B.with_hero(spark.createDataFrame(rows, "game int, seq long, ev_idx int, type string, id int"), seq_chunk("seq", 2))
    assert [r.hero for r in d.orderBy("game", "seq").collect()] == [-1, 2, 2, 0, -1]


def test_violations_tell_the_record(spark):
    start = dict(bakaze="E", kyoku=1, honba=0, kyotaku=0, oya=0, dora_marker="1m", scores=[25000] * 4, tehais=[["1m"] * 4 + ["9p"] * 9, [], [], []])
    rows = [row(1, 0, 0, "start_kyoku", **start), row(1, 1, 0, "dahai", actor=0, pai="1m"), row(1, 2, 0, "pon", actor=1, target=0, pai="1m", consumed=["1m", "1m"]), row(2, 0, 0, "tsumo", actor=1, pai="?")]
    d = B.board_states(spark.createDataFrame(rows, SCHEMA), F.lit(0))
    got = sorted((r.game, r.seq, r.message) for r in B.violations(d).collect())
    tile = "tile {} seen {}>4 times across visible zones".format
    assert got == sorted([(1, 0, tile("1m", 5)), (1, 1, tile("1m", 5)), (1, 2, tile("1m", 7)), *[(1, s, tile("9p", 9)) for s in range(3)],
                          *[(1, s, "hero hand 12 + 3*0 melds = 12 not in 13/14") for s in (1, 2)]])


def test_live_boards_equal_the_batch_and_late_events_lie_apart(spark):
    rows = random_log(23)
    slices = [[r for r in rows if lo <= r[1] < lo + 40] for lo in (0, 40, 80)]
    again = [r for r in rows if r[0] == 1 and r[1] in (3, 4)]  # a reconnect sends records once more
    parts = [slices[0], slices[1] + again, slices[2]]
    out = drain_growing([(spark.createDataFrame(p, SCHEMA),) for p in parts], lambda s: board_stream.boards(s, 0), "boards", apart="late", store=STORE)
    batch = B.board_states(spark.createDataFrame(rows, SCHEMA), F.lit(0))
    live = out.filter("NOT late")
    key = lambda r: (r["game"], r["seq"])
    want, got = [sorted((r.asDict(recursive=True) for r in d.collect()), key=key) for d in (batch, live)]
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for c in batch.columns:
            assert a[c] == b[c], (key(a), c)
    late = sorted((key(r), r.kyoku_ord) for r in out.filter("late").collect())
    at = max((r for r in want if r["game"] == 1 and r["seq"] < 80), key=key)
    assert late == [((1, s), at["kyoku_ord"]) for s in (3, 4)]


def test_live_boards_of_neighbouring_games_share_a_state(spark, monkeypatch):
    from boardlake.session import fresh_path
    from boardlake.streaming.run import drain, source

    rows = [(g + shift, *r[1:]) for shift in (0, 100) for r in random_log(5) for g in [r[0]]]
    parts = [spark.createDataFrame([r for r in rows if lo <= r[1] < lo + 60], SCHEMA) for lo in (0, 60)]
    monkeypatch.setattr(board_stream, "ROWS_OUT", 7)
    shown = lambda d: sorted(map(str, d.collect()))
    into, out, check = (fresh_path(spark, n) for n in ("shelf-in", "shelf-out", "shelf-check"))
    for p in parts:
        p.write.mode("append").parquet(into)
        live = board_stream.boards(source(spark, into, p.schema), 0)
        drain(live, out, check, store=STORE)
    alone = drain_growing([(p,) for p in parts], lambda s: board_stream.boards(s, 0, 1), "alone", store=STORE)
    assert shown(spark.read.schema(live.schema).parquet(out)) == shown(alone)
    assert len({r[0] for r in rows}) > 2
    states = spark.read.format("statestore").option("stateVarName", "boards").load(check)
    assert states.count() == len({r[0] // 64 for r in rows})


def test_live_hero_and_odd_events(spark):
    """A log without the fields of a deal: the seat comes from the log, events without an actor change no seat."""
    schema = "game long, seq long, ev_idx int, type string, actor int, pai string, id int"
    rows = [(1, 0, 0, "tsumo", 2, "1m", None), (1, 1, 0, "start_game", None, None, 2), (1, 2, 0, "tsumo", 2, "5mr", None), (1, 2, 1, "tsumo", 2, "?", None),
            (1, 3, 0, "dahai", None, "9p", None), (1, 4, 0, "dahai", 2, "5mr", None), (1, 5, 0, "kakan", 2, "N", None)]
    out = drain_growing([(spark.createDataFrame(rows, schema),)], board_stream.boards, "odd-boards", apart="late", store=STORE).orderBy("seq").collect()
    assert [(r.hero, r.hand, r.drawn, r.n_discards, r.owed) for r in out] == [
        (-1, [], None, 0, -1), (2, [], None, 0, -1), (2, ["5mr"], "5mr", 0, -1), (2, ["5mr"], "5mr", 1, -1), (2, [], None, 2, -1), (2, [], None, 2, 2)]
    assert out[-1].melds[2][0].asDict() == {"type": "kakan", "tiles": ["N"], "called": "", "added": "N", "from_seat": 2}
    assert out[-1].concealed == [13, 13, 14, 13]
