"""Live replay: one running state per game, kept for shelves of neighbouring games (G1)."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from .. import dims
from .timers import ROWS_OUT, SHELF, by_game, in_order, shelved

EVENT_COLUMNS = ["game", "seq", "ev_idx", "type", "actor", "n_consumed", "kyotaku", "scores"]
_Event = namedtuple("_Event", EVENT_COLUMNS)
SNAPSHOT = ("game long, seq long, kyoku_ord long, concealed array<int>, scores array<int>, reach array<boolean>, sticks int, "
            "n_dora int, owed int, late boolean")
STATE = ("games array<struct<game: long, last_seq: long, last_idx: int, kyoku_ord: long, concealed: array<int>, scores: array<int>, reach: array<boolean>, "
         "sticks: int, n_dora: int, owed: int>>")
_NAMES = ["last_seq", "last_idx", "kyoku_ord", "concealed", "scores", "reach", "sticks", "n_dora", "owed"]
_PER_SEAT = ("concealed", "scores", "reach")
_SHOWN = [c.split()[0] for c in SNAPSHOT.split(", ")]
FRESH = (-1, -1, 0, [13] * 4, [25000] * 4, [False] * 4, 0, 0, -1)


def _step(s: dict, e: Any) -> None:
    """Apply one event to the running values."""
    t = e.type
    if t == "start_kyoku":
        pts = [int(x) for x in e.scores]
        s.update(kyoku_ord=s["kyoku_ord"] + 1, concealed=[13] * 4, scores=pts + [0] * (4 - len(pts)), reach=[False] * 4,
                 sticks=int(e.kyotaku), n_dora=1, owed=-1)
        return
    if t == "dora":
        s["n_dora"] += 1
        return
    if pd.isna(e.actor):
        return
    a = int(e.actor)
    if t == "tsumo":
        s["concealed"][a] += 1
    elif t == "dahai":
        s["concealed"][a] -= 1
        if s["owed"] == a:
            s["owed"] = -1
    elif t in dims.CALL_EVENTS:
        s["concealed"][a] -= 1 if t in ("kakan", "nukidora") else int(e.n_consumed)
        if t in dims.OWED_EVENTS:
            s["owed"] = a
    elif t == "reach_accepted":
        s["reach"][a] = True
        s["scores"][a] -= 1000
        s["sticks"] += 1


def _advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held = {g[0]: tuple(g[1:]) for g in state.get[0]} if state.exists else {}
    out = []
    for game, events in by_game(key, in_order(frames, EVENT_COLUMNS, lambda r: (r[1], r[2]))):
        s = {k: list(v) if k in _PER_SEAT else v for k, v in zip(_NAMES, held.get(game, FRESH))}
        for e in map(_Event._make, events):
            late = (e.seq, e.ev_idx) <= (s["last_seq"], s["last_idx"])
            if not late:
                _step(s, e)
                s["last_seq"], s["last_idx"] = int(e.seq), int(e.ev_idx)
            out.append((game, int(e.seq), s["kyoku_ord"], list(s["concealed"]), list(s["scores"]), list(s["reach"]), s["sticks"], s["n_dora"], s["owed"], late))
            if len(out) == ROWS_OUT:
                yield pd.DataFrame(out, columns=_SHOWN, dtype=object)
                out = []
        held[game] = tuple(s[n] for n in _NAMES)
    state.update(([(g, *v) for g, v in held.items()],))
    yield pd.DataFrame(out, columns=_SHOWN, dtype=object)


def replay(events: DataFrame, shelf: int = SHELF) -> DataFrame:
    """G1: snapshot after every event of a stream.

    The state of a game is a few small arrays; ``shelf`` neighbouring games share a call and a state, and a micro-batch brings at
    most its own rows to a call. Pass a shelf of one where single games bring many rows. Events at or before the last one applied
    to their game are marked late and change nothing.
    """
    return shelved(events, EVENT_COLUMNS[1:], shelf).applyInPandasWithState(_advance, SNAPSHOT, STATE, "append", "NoTimeout")
