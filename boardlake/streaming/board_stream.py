"""Live boards: the whole board of every record while the log arrives (G1), kept for shelves of neighbouring games."""

from __future__ import annotations

import json
from collections import Counter, namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import dims
from .timers import ROWS_OUT, SHELF, by_game, in_order, shelved

#: What the processor reads of an event; columns that a log lacks are read as null.
EVENT = {"seq": "long", "ev_idx": "int", "type": "string", "actor": "int", "target": "int", "id": "int", "pai": "string", "consumed": "array<string>",
         "tsumogiri": "boolean", "dora_marker": "string", "scores": "array<int>", "tehais": "array<array<string>>", "kyotaku": "int",
         "left_count": "int", "bakaze": "string", "kyoku": "int", "honba": "int", "oya": "int"}
SCALARS = ("last_seq long, last_idx int, hero int, kyoku_ord long, open boolean, r_bakaze string, r_kyoku int, r_honba int, r_oya int, drawn string, "
           "declared array<boolean>, reach array<boolean>, scores array<int>, side array<int>, concealed array<int>, sticks int, owed int, "
           "last_actor int, left_tiles int, n_discards long")
_Event = namedtuple("_Event", EVENT)
MELD = "type string, tiles array<string>, called string, added string, from_seat int"
TILE = "pai string, tsumogiri boolean, riichi boolean, sideways boolean"


def _fields(struct: str) -> str:
    return ", ".join(c.replace(" ", ": ", 1) for c in struct.split(", "))


_RIVER, _SETS = f"rivers array<array<struct<{_fields(TILE)}>>>", f"melds array<array<struct<{_fields(MELD)}>>>"
_COLUMNS = ["game long", "seq long", "kyoku_ord long", "open boolean", "r_bakaze string", "r_kyoku int", "r_honba int", "r_oya int", "hero int",
            "hand array<string>", "drawn string", "dora array<string>", _RIVER, _SETS, "reach array<boolean>", "scores array<int>", "side array<int>",
            "concealed array<int>", "sticks int", "owed int", "last_actor int", "left_tiles int", "n_discards long", "late boolean"]
BOARD = ", ".join({_RIVER: "rivers string", _SETS: "melds string"}.get(c, c) for c in _COLUMNS)  # zones of structs leave Python as JSON
_NAMES = [c.split()[0] for c in SCALARS.split(", ")]
_json = json.JSONEncoder(separators=(",", ":")).encode
_RANK = {t: i for i, t in enumerate(dims.HAND_ORDER)}
_OWN = {t for t in dims.TILES if t != "back"}


def _known(value: Any) -> Any:
    """A field as Python value: null for what pandas uses in its place, whole numbers as such (no event has others)."""
    if value is None or type(value) in (int, str, bool) or hasattr(value, "__len__"):
        return value
    if type(value) is float:
        return int(value) if value == value else None
    if pd.isna(value):
        return None
    return bool(value) if pd.api.types.is_bool(value) else int(value)


def _base(tile: str) -> str:
    return tile[:2] if tile in dims.RED_FIVES else tile


def _shown(tiles: list[str]) -> list[str]:
    return sorted(tiles, key=lambda t: _RANK.get(t, 999))


class Board:
    """The zones of one game as they are between two events."""

    def __init__(self, scalars: dict, hand: Counter, laid: list[list], sets: list[list], dora: list[str]):
        self.s, self.hand, self.laid, self.sets, self.dora = scalars, hand, laid, sets, dora
        self._rivers, self._melds = [None] * 4, [None] * 4  # texts by seat, until something on them changes

    @staticmethod
    def new(hero: int) -> "Board":
        b = Board({"last_seq": -1, "last_idx": -1, "hero": hero, "kyoku_ord": 0}, Counter(), [], [], [])
        b.clear(False, None, None, None, None, [25000] * 4, 0)
        return b

    def clear(self, open_: bool, bakaze, kyoku, honba, oya, scores: list[int], sticks: int) -> None:
        self.s.update(open=open_, r_bakaze=bakaze, r_kyoku=kyoku, r_honba=honba, r_oya=oya, drawn=None, declared=[False] * 4, reach=[False] * 4,
                      scores=scores, side=[0] * 4, concealed=[13] * 4, sticks=sticks, owed=-1, last_actor=-1, left_tiles=None, n_discards=0)
        self.hand, self.laid, self.sets, self.dora = Counter(), [], [], []
        self._rivers, self._melds = [None] * 4, [None] * 4

    def take(self, tiles: list[str]) -> None:
        """Tiles leave the hero's hand; a red five that is not there takes a plain one, others that are not there change nothing."""
        for t in tiles:
            for held in (t, _base(t)):
                if self.hand[held] > 0:
                    self.hand[held] -= 1
                    break

    def apply(self, e: Any) -> None:
        """One event. Events without an actor change only the round, the indicators and the count."""
        s, t = self.s, e.type
        f = dict(zip(EVENT, map(_known, e)))
        consumed = list(f["consumed"]) if f["consumed"] is not None else []
        if t == "start_kyoku":
            points = [int(x) for x in f["scores"]] if f["scores"] is not None else []
            self.clear(True, f["bakaze"], f["kyoku"], f["honba"], f["oya"], (points + [0] * 4)[:4], int(f["kyotaku"] or 0))
            s["kyoku_ord"] += 1
            deal = f["tehais"] if f["tehais"] is not None else []
            if 0 <= s["hero"] < len(deal):
                self.hand.update(x for x in deal[s["hero"]] if x in _OWN)
        elif f["ev_idx"] == 0 and f["left_count"] is not None:
            s["left_tiles"] = int(f["left_count"])
        if t in ("start_kyoku", "dora") and f["dora_marker"] is not None:
            self.dora.append(f["dora_marker"])
        if t == "end_kyoku":
            s["open"] = False
        if t == "start_game" and f["id"] is not None:
            s["hero"] = int(f["id"])
        if t == "dahai":
            s["n_discards"] += 1
        a = f["actor"]
        if a is None or t == "start_kyoku":
            return
        self._act(int(a), t, f, consumed)

    def _act(self, a: int, t: str, f: dict, consumed: list[str]) -> None:
        s, pai, mine = self.s, f["pai"], a == self.s["hero"]
        if t in ("tsumo", "dahai", *dims.CALL_EVENTS):
            s["last_actor"] = a
        if t == "tsumo":
            s["concealed"][a] += 1
            if mine and pai in _OWN:
                self.hand[pai] += 1
            if mine and pai != "?":
                s["drawn"] = pai
        elif t == "reach":
            s["declared"][a] = True
        elif t == "reach_accepted":
            s["reach"][a] = True
            s["scores"][a] -= 1000
            s["sticks"] += 1
        elif t == "dahai":
            s["concealed"][a] -= 1
            self.laid.append([a, pai, bool(f["tsumogiri"]), s["declared"][a], False])
            self._rivers[a] = None
            s["declared"][a] = False
            if s["owed"] == a:
                s["owed"] = -1
        elif t in dims.CALL_EVENTS:
            s["concealed"][a] -= 1 if t in ("kakan", "nukidora") else len(consumed)
            if t == "nukidora":
                s["side"][a] += 1
            else:
                s["owed"] = a
                self._meld(a, t, f, consumed)
        if mine and t in ("dahai", *dims.CALL_EVENTS):
            s["drawn"] = None
            self.take({"dahai": [pai], "kakan": [pai], "nukidora": ["N"]}.get(t, consumed))

    def _meld(self, a: int, t: str, f: dict, consumed: list[str]) -> None:
        pai = f["pai"]
        self._melds[a] = None
        if t in dims.CLAIM_EVENTS:
            open_ = [d for d in self.laid if d[0] == f["target"] and not d[4]]
            if open_:
                open_[-1][4] = True
                self._rivers[f["target"]] = None
            self.sets.append([a, t, _shown([pai, *consumed]), pai, "", int(f["target"])])
        elif t == "ankan":
            self.sets.append([a, t, _shown(consumed), "", "", a])
        else:
            own = next((m for m in self.sets if m[0] == a and m[1] == "pon" and _base(m[3]) == _base(pai)), None)
            if own is None:
                self.sets.append([a, t, consumed or [pai], "", pai, a])
            else:
                own[1:5] = [t, _shown([*own[2], pai]), own[3], pai]

    def river(self, seat: int) -> list[dict]:
        mine = [d for d in self.laid if d[0] == seat]
        since = next((i for i, d in enumerate(mine) if d[3]), len(mine))
        side = next((i for i, d in enumerate(mine) if i >= since and not d[4]), -1)
        return [{"pai": d[1], "tsumogiri": d[2], "riichi": d[3], "sideways": i == side} for i, d in enumerate(mine) if not d[4]]

    def melds(self, seat: int) -> list[dict]:
        return [dict(zip(("type", "tiles", "called", "added", "from_seat"), m[1:])) for m in self.sets if m[0] == seat]

    def row(self, game: int, seq: int, late: bool) -> dict:
        out = {k: list(v) if isinstance(v, list) else v for k, v in self.s.items() if k not in ("last_seq", "last_idx", "declared")}
        out.update(game=game, seq=seq, hand=_shown(list(self.hand.elements())), dora=list(self.dora), rivers=self._text(self._rivers, self.river),
                   melds=self._text(self._melds, self.melds), late=late)
        return out

    @staticmethod
    def _text(seats: list[str | None], zone: Callable[[int], list[dict]]) -> str:
        """The zone of all seats as JSON."""
        for x, t in enumerate(seats):
            if t is None:
                shown = zone(x)
                seats[x] = _json(shown) if shown else "[]"
        return f"[{','.join(seats)}]"


class LiveBoard(StatefulProcessor):
    """The boards of a shelf of neighbouring games as one value, a JSON text that is read and written once a call."""

    def __init__(self, hero: int):
        self.hero = hero

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.boards = handle.getValueState("boards", "boards string")

    def _load(self) -> dict[int | None, Board]:
        if not self.boards.exists():
            return {}
        return {g: Board(dict(zip(_NAMES, s)), Counter(hand), *zones) for g, s, hand, *zones in json.loads(self.boards.get()[0])}

    def _save(self, held: dict[int | None, Board]) -> None:
        rows = [[g, [b.s[n] for n in _NAMES], {t: n for t, n in b.hand.items() if n > 0}, b.laid, b.sets, b.dora] for g, b in held.items()]
        self.boards.update((_json(rows),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, out = self._load(), []
        for game, events in by_game(key, in_order(rows, ["game", *EVENT], lambda r: (r[1], r[2]))):
            if game not in held:
                held[game] = Board.new(self.hero)
            b = held[game]
            for row in self._states(game, b, (_Event._make(r[1:]) for r in events)):
                out.append(row)
                if len(out) == ROWS_OUT:
                    yield _shown_rows(out)
                    out = []
        self._save(held)
        yield _shown_rows(out)

    @staticmethod
    def _states(game: int | None, b: Board, events: Iterator[Any]) -> Iterator[dict]:
        """A row per record after its last event, then the late records on the board as it is."""
        last, late, new = (b.s["last_seq"], b.s["last_idx"]), set(), False
        for e in events:
            at = (int(e.seq), int(e.ev_idx))
            if at <= last:
                late.add(at[0])
                continue
            if new and at[0] != last[0]:
                yield b.row(game, last[0], False)
            b.apply(e)
            last, new = at, True
        if new:
            yield b.row(game, last[0], False)
        b.s["last_seq"], b.s["last_idx"] = last
        for seq in sorted(late):
            yield b.row(game, seq, True)

    def close(self) -> None:
        pass


def _shown_rows(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _COLUMNS], dtype=object)


def boards(events: DataFrame, hero: int = -1, shelf: int = SHELF) -> DataFrame:
    """G1: the board after every record of a stream, with the columns of `board.board_states` and ``late``.

    ``hero`` is the player's seat until a ``start_game`` event tells it (column ``id``). A record's events land in one
    micro-batch. Events at or before the last one applied to their game change nothing: their record comes out once more with
    ``late`` set and the board as it is; write the two apart (`run.drain` with ``apart="late"``). ``shelf`` neighbouring games share a
    call and a state, which is as large as their boards; pass a shelf of one where single games bring many rows. Needs `run.STORE`.
    """
    lacks = {c: F.lit(None).cast(t) for c, t in EVENT.items() if c not in events.columns}
    d = events.withColumns(lacks) if lacks else events
    rows = shelved(d.select("game", *[F.col(c).cast(t).alias(c) for c, t in EVENT.items()]), list(EVENT), shelf).transformWithStateInPandas(
        LiveBoard(hero), BOARD, "append", "None")
    return rows.withColumns({c.split()[0]: F.from_json(c.split()[0], c.split(" ", 1)[1]) for c in (_RIVER, _SETS)})
