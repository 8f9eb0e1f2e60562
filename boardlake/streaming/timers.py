"""Screenshot timing over a live log.

Every game has its own clock, the time of its newest row, so a game that lags behind others loses
nothing. What a game still holds is released by its next row, by a closing row, or once it has been
idle for ``idle_ms`` of wall-clock time. Rows older than what their game has shown come out
marked ``late`` and change no state.

A game's rows of one micro-batch are handled in one call; bound a batch at its source
(``maxFilesPerTrigger``). State is a few numbers per game.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPTURE = "game long, key long, start_us long, capture_us long, capped boolean, late boolean"
PENDING = "open boolean, key long, start_us long, last_us long"
SHOT = "game long, seq long, offset_ms int, fire_us long, late boolean"
ARMED = "seq long, ts_us long, offsets array<int>"


def _stateful(rows: DataFrame, columns: list[str], run, shape: str, state: str, idle_ms: int | None) -> DataFrame:
    closing = F.col("closing") if "closing" in rows.columns else F.lit(False)
    d = rows.select(*columns, closing.alias("closing")).groupBy("game")
    return d.applyInPandasWithState(run, shape, state, "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")


def _frame(rows: list[tuple], shape: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in shape.split(", ")], dtype=object)


#: Neighbouring games that share a call and a state: a call costs some milliseconds, whatever it brings.
SHELF = 64
#: Rows that a call hands on at once.
ROWS_OUT = 8192


def shelved(events: DataFrame, columns: list[str], shelf: int):
    """The events grouped by shelves of ``shelf`` neighbouring game numbers, so that a state holds a bounded number of games."""
    return events.select(F.expr(f"game div {int(shelf)}").alias("shelf"), "game", *columns).groupBy("shelf")


def by_game(key: tuple, rows: list[tuple]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """A shelf's rows (game first) game by game, each game's in the order given; games without a number have a shelf of their own."""
    if key[0] is None or pd.isna(key[0]):
        yield None, iter(rows)
        return
    for game, own in groupby(sorted(rows, key=itemgetter(0)), key=itemgetter(0)):
        yield int(game), own


def in_order(frames: Iterator[pd.DataFrame], columns: list[str], by: Callable[[tuple], Any]) -> list[tuple]:
    """A game's rows of a micro-batch as plain tuples; they are few, and frames cost more than their rows."""
    return sorted((r for f in frames for r in zip(*[f[c].tolist() for c in columns])), key=by)


def debounce(events: DataFrame, quiet_us: int, cap_us: int, idle_ms: int | None = None) -> DataFrame:
    """One capture per quiet spell, or when a burst has run for ``cap_us``.

    Input ``game, seq, ts_us`` and perhaps ``closing``, true on a row that only ends its game. Late
    rows come out with their seq and time and without a capture.
    """
    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        open_, first, start, last = tuple(state.get) if state.exists else (False, 0, 0, -1)
        out: list[tuple] = []

        def emit() -> None:
            at = min(last + quiet_us, start + cap_us)
            out.append((key[0], first, start, at, start + cap_us < last + quiet_us, False))

        if state.hasTimedOut:
            if open_:
                emit()
            state.update((False, first, start, last))
        else:
            for seq, ts, closing in in_order(frames, ["seq", "ts_us", "closing"], lambda r: (r[1], r[0])):
                if ts < last:
                    out.append((key[0], seq, ts, None, None, True))
                    continue
                if open_ and (closing or ts - last >= quiet_us or ts > start + cap_us):
                    emit()
                    open_ = False
                if not closing:
                    first, start = (max(seq, first), start) if open_ else (seq, ts)
                    open_ = True
                last = ts
            state.update((open_, first, start, last))
            if idle_ms is not None and open_:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield _frame(out, CAPTURE)

    return _stateful(events, ["game", "seq", "ts_us"], run, CAPTURE, PENDING, idle_ms)


def extra_shots(armed: DataFrame, offsets_ms: list[int], idle_ms: int | None = None) -> DataFrame:
    """Planned extra screenshots; the next record of the game cancels the rest.

    Input ``game, seq, ts_us, window`` and perhaps ``closing``. Late rows (by seq) come out
    without an offset and arm nothing.
    """
    plan = sorted(offsets_ms)

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, at, held = tuple(state.get) if state.exists else (-1, 0, [])
        out: list[tuple] = []

        def fire(before: int | None) -> None:
            for off in held:
                if before is None or at + int(off) * 1000 < before:
                    out.append((key[0], seq, int(off), at + int(off) * 1000, False))

        if state.hasTimedOut:
            fire(None)
            state.update((seq, at, []))
        else:
            for n, ts, window, closing in in_order(frames, ["seq", "ts_us", "window", "closing"], lambda r: r[0]):
                if n < seq:
                    out.append((key[0], n, None, None, True))
                    continue
                fire(None if closing else ts)
                seq, at, held = n, ts, plan if window and not closing else []
            state.update((seq, at, list(held)))
            if idle_ms is not None and len(held):
                state.setTimeoutDuration(idle_ms)
        if out:
            yield _frame(out, SHOT)

    return _stateful(armed, ["game", "seq", "ts_us", "window"], run, SHOT, ARMED, idle_ms)
