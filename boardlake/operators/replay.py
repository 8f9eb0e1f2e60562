"""Event-log replay as ordered scans.

Input is an event table: ``game, seq, ev_idx, type`` and the fields of the event types.
A round starts at ``start_kyoku`` and replaces the whole state, so after the round number is
known every running value is a scan over (game, round).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.tiles import base_tile
from ..session import stage
from .ordered import Run, clamped_sum, scan, segmented, seq_chunk

ORDER = ["seq", "ev_idx"]
ROUND = ["game", "kyoku_ord"]


def explode_events(records: DataFrame, keep: tuple[str, ...] = ("game", "seq")) -> DataFrame:
    """One row per event, in the order the record holds them."""
    out = records.select(*keep, F.posexplode("mjai").alias("ev_idx", "_e"))
    return out.select(*keep, "ev_idx", "_e.*")


def is_board_change(types: Column) -> Column:
    """a record changes the board if any of its event types does."""
    return F.arrays_overlap(types, F.array(*[F.lit(t) for t in dims.BOARD_EVENTS]))


def three_player_sign(scores: Column, kyotaku: Column) -> Column:
    """F8: a round start that shows a three-player game."""
    total = F.aggregate(scores, F.lit(0).cast("long"), lambda a, x: a + x) + 1000 * kyotaku
    return (F.size(scores) == 3) | (total == 105000)


def with_round(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Number the rounds of each game and carry the round's attributes forward."""
    start = F.col("type") == "start_kyoku"
    attrs = F.struct(*[F.col(c).alias(c) for c in ("bakaze", "kyoku", "honba", "oya")])
    out = scan(events, ["game"], ORDER, [
        Run("kyoku_ord", "sum", F.when(start, 1).otherwise(0)),
        Run("_round", "last", F.when(start, attrs)),
    ], seq_chunk() if chunk is None else chunk)
    return out.withColumns({f"r_{c}": F.col(f"_round.{c}") for c in ("bakaze", "kyoku", "honba", "oya")}).drop("_round")


def with_mode(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """F8: three-player flag, sticky for the rest of the game."""
    sign = F.when((F.col("type") == "start_kyoku") & three_player_sign(F.col("scores"), F.col("kyotaku")), True)
    sign = F.when(F.col("type") == "nukidora", True).otherwise(F.coalesce(sign, F.lit(False)))
    return scan(events, ["game"], ORDER, [Run("sanma", "max", sign)], seq_chunk() if chunk is None else chunk)


def round_key(bakaze: Column, kyoku: Column, honba: Column) -> Column:
    """``E1.0`` style key; parts not known yet read ``None``/0 like the default state."""
    return F.concat(F.coalesce(bakaze, F.lit("None")), F.coalesce(kyoku, F.lit(0)).cast("string"), F.lit("."),
                    F.coalesce(honba, F.lit(0)).cast("string"))


def _consumed() -> Column:
    t = F.col("type")
    return (F.when(t.isin(dims.CLAIM_EVENTS) | (t == "ankan"), F.size("consumed"))
            .when(t.isin("kakan", "nukidora"), 1).otherwise(0))


def _seat_runs() -> list[Run]:
    t, actor = F.col("type"), F.col("actor")
    start = t == "start_kyoku"
    runs = []
    for s in range(4):
        mine = ~start & (actor == s)
        conceal = F.when(start, 13).when(mine & (t == "tsumo"), 1).when(mine & (t == "dahai"), -1) \
            .when(mine, -_consumed()).otherwise(0)
        score = F.when(start, F.coalesce(F.get("scores", F.lit(s)), F.lit(0))) \
            .when(mine & (t == "reach_accepted"), -1000).otherwise(0)
        runs += [Run(f"concealed_{s}", "sum", conceal), Run(f"score_{s}", "sum", score),
                 Run(f"side_{s}", "sum", F.when(mine & (t == "nukidora"), 1).otherwise(0)),
                 Run(f"reach_{s}", "max", mine & (t == "reach_accepted"))]
    return runs + [Run("sticks", "sum", F.when(start, F.col("kyotaku")).when(t == "reach_accepted", 1).otherwise(0)),
                   Run("n_dora", "sum", F.when(start | (t == "dora"), 1).otherwise(0))]


def _seat_values(d: DataFrame) -> DataFrame:
    first = F.col("kyoku_ord") == 0
    base = {}
    for s in range(4):
        base[f"concealed_{s}"] = F.col(f"concealed_{s}") + F.when(first, 13).otherwise(0)
        base[f"score_{s}"] = F.col(f"score_{s}") + F.when(first, 25000).otherwise(0)
        base[f"reach_{s}"] = F.coalesce(F.col(f"reach_{s}"), F.lit(False))
    return d.withColumns(base)


def seat_scalars(rounds: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Concealed count, score, side tiles and reach flag per seat, sticks and indicator count.

    One scan; before the first round start the default state applies (13 tiles, 25000 points).
    """
    return _seat_values(scan(rounds, ROUND, ORDER, _seat_runs(), seq_chunk() if chunk is None else chunk))


def _round_runs() -> list[Run]:
    start = F.col("type") == "start_kyoku"
    return [Run("_round", "last", F.when(start, F.struct(*[F.col(c).alias(c) for c in ("bakaze", "kyoku", "honba", "oya")])))]


def _dora_runs() -> list[Run]:
    turned = F.col("type").isin("start_kyoku", "dora")
    return [Run("dora", "list", F.when(turned, F.col("dora_marker")))]


#: What `replayed` can add; each is a set of running values and what follows from them.
_PARTS = ("round", "seats", "dora", "drawn", "owed", "open", "actor")


def replayed(events: DataFrame, parts: tuple[str, ...] = _PARTS, hero: Column | None = None, chunk: Column | None = None,
             more: tuple[Run, ...] = ()) -> DataFrame:
    """W1, W2, W7, W8 and the facts of F2 in one pass over the log of a game.

    ``round``: ``r_bakaze, r_kyoku, r_honba, r_oya`` of the round; ``seats``: as `seat_scalars`; ``dora``: the
    indicators turned so far, in order; ``drawn``: as `drawn_tile` (needs ``hero``); ``owed``: as `owed_discard`; ``open``: as `in_round`;
    ``actor``: the seat that acted last in the round, -1 before. ``kyoku_ord`` is always added. Every value begins anew with a round, so the round number needs no scan of its own.
    """
    t, start = F.col("type"), F.col("type") == "start_kyoku"
    runs: list[Run] = list(more)
    if "round" in parts:
        runs += _round_runs()
    if "seats" in parts:
        runs += _seat_runs()
    if "dora" in parts:
        runs += _dora_runs()
    if "drawn" in parts:
        runs += [Run("drawn", "last", _drawn_mark(hero))]
    if "owed" in parts:
        runs += _owed_runs()
    if "open" in parts:
        runs += _open_runs()
    if "actor" in parts:
        runs += [Run("last_actor", "last", F.when(t.isin("tsumo", "dahai", *dims.CALL_EVENTS), F.col("actor")))]
    d = segmented(events, ["game"], ORDER, start, runs, "kyoku_ord", seq_chunk() if chunk is None else chunk)
    if "round" in parts:
        d = d.withColumns({f"r_{c}": F.col(f"_round.{c}") for c in ("bakaze", "kyoku", "honba", "oya")}).drop("_round")
    if "seats" in parts:
        d = _seat_values(d)
    if "drawn" in parts:
        d = d.withColumn("drawn", F.nullif(F.col("drawn"), F.lit("")))
    if "owed" in parts:
        d = _owed_value(d)
    if "open" in parts:
        d = d.withColumn("open", F.coalesce("open", F.lit(False)))
    if "actor" in parts:
        d = d.withColumn("last_actor", F.coalesce("last_actor", F.lit(-1)))
    return d


def riichi_discards(rounds: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Discards with the flag "this seat declared reach since its previous discard"."""
    d = rounds.filter(F.col("type").isin("reach", "dahai"))
    d = scan(d, ROUND + ["actor"], ORDER, [Run("_before", "last", F.col("type"), inclusive=False)],
             seq_chunk() if chunk is None else chunk)
    d = d.withColumn("riichi", F.coalesce(F.col("_before") == "reach", F.lit(False))).drop("_before")
    return d.filter(F.col("type") == "dahai")


def claim_levels(rounds: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Pair every claim with the target's newest discard that is not called yet.

    A river is a stack: a discard pushes, a claim pops.  The height after a push equals the
    height before the pop that takes it, so within one (river, height) a claim directly follows
    the discard it takes.
    """
    ch = seq_chunk() if chunk is None else chunk
    d = rounds.filter(F.col("type").isin(["dahai"] + dims.CLAIM_EVENTS))
    push = F.col("type") == "dahai"
    d = d.withColumn("river_seat", F.when(push, F.col("actor")).otherwise(F.col("target")))
    d = clamped_sum(d, ROUND + ["river_seat"], ORDER, {"_h": F.when(push, 1).otherwise(-1)}, ch)
    d = stage(d.withColumn("_level", F.when(push, F.col("_h")).otherwise(F.col("_h") + 1)).drop("_h"), "levels")  # read by windows and by chunks
    me = F.struct("type", *ORDER, "actor")
    d = scan(d, ROUND + ["river_seat", "_level"], ORDER, [
        Run("_prev", "last", me, inclusive=False), Run("_next", "next", me, inclusive=False)], ch)
    taken = push & (F.col("_next.type") != "dahai")
    takes = ~push & (F.col("_prev.type") == "dahai")
    return d.withColumns({
        "called": F.coalesce(taken, F.lit(False)),
        "called_seq": F.when(taken, F.col("_next.seq")), "called_by": F.when(taken, F.col("_next.actor")),
        "takes_seq": F.when(takes, F.col("_prev.seq")), "takes_idx": F.when(takes, F.col("_prev.ev_idx")),
    }).drop("_prev", "_next").withColumnRenamed("_level", "level")


def river(rounds: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Discards of each seat with their order and their index in the visible river.

    ``visible_idx`` is the place at which the discard lies from its own record until a claim takes
    it at ``called_seq``: a claim only takes the top of the river, so what is below never moves.
    """
    ch = seq_chunk() if chunk is None else chunk
    d = claim_levels(rounds, chunk).filter(F.col("type") == "dahai")
    d = scan(d, ROUND + ["river_seat"], ORDER, [Run("river_idx", "sum", F.lit(1))], ch)
    return d.withColumns({"river_idx": F.col("river_idx") - 1, "visible_idx": F.col("level") - 1}).drop("level")


def sideways_index(changes: DataFrame, keys: list[str], order: list[str], chunk: Column | None) -> DataFrame:
    """After each change of a river, the visible index of its sideways tile.

    It is the first discard at or after the riichi discard that lies in the river as of that
    record; null before a riichi and while that tile is claimed and not yet replaced. Needs the
    rows of `claim_levels` with ``riichi`` on discards. The tile lies at the lowest level that the
    river has had room for since the riichi.
    """
    push = F.col("type") == "dahai"
    d = changes.withColumn("_h", F.col("level") - F.when(push, 0).otherwise(1))
    d = scan(d, keys, order, [Run("has_riichi", "max", push & F.col("riichi"))], chunk)
    floor = F.when(push & F.col("riichi"), F.col("_h")).when(F.col("has_riichi"), F.col("_h") + 1)
    d = scan(d, keys, order, [Run("_low", "min", floor)], chunk)
    at = F.when(F.col("_h") >= F.col("_low"), F.col("_low") - 1)
    return d.select(*keys, *order, F.coalesce("has_riichi", F.lit(False)).alias("has_riichi"), at.alias("sideways_idx"))


def hero_events(rounds: DataFrame, hero: Column) -> DataFrame:
    """The hero's hand changes as ``added``/``removed`` tile lists, one row per event."""
    t, mine = F.col("type"), F.col("actor") == hero
    none = F.array().cast("array<string>")
    has_deal = "tehais" in rounds.columns
    deal = F.filter(F.coalesce(F.get("tehais", hero), none), lambda x: x != "?") if has_deal else none
    added = F.when(t == "start_kyoku", deal).when(mine & (t == "tsumo") & (F.col("pai") != "?"), F.array("pai")).otherwise(none)
    removed = (F.when(~mine | (t == "start_kyoku"), none)
               .when(t.isin("dahai", "kakan"), F.array("pai"))
               .when(t.isin(dims.CLAIM_EVENTS) | (t == "ankan"), F.col("consumed"))
               .when(t == "nukidora", F.array(F.lit("N"))).otherwise(none))
    d = rounds.withColumns({"added": F.coalesce(added, none), "removed": F.coalesce(removed, none)})
    return d.filter((F.size("added") + F.size("removed") > 0) | (t == "start_kyoku"))


def hero_hand(changes: DataFrame, chunk: Column | None = None) -> DataFrame:
    """The hero's hand after each change, in on-screen order.

    The hand is one counter per tile.  Removing a tile that is not there is silently ignored,
    and a red five that is not there takes a plain five instead, so each counter is a running
    sum that stops at zero; the plain fives also take what the red fives missed.
    """
    ch = seq_chunk() if chunk is None else chunk
    plain = [t for t in dims.TILES if t not in dims.RED_FIVES and t != "back"]

    def count(col: str, tile: str) -> Column:
        # most lists lack most tiles; those are not copied
        return F.when(F.array_contains(col, tile), F.size(col) - F.size(F.array_remove(col, tile))).otherwise(0)

    red_cols = {f"n_{t}": count("added", t) - count("removed", t) for t in dims.RED_FIVES}
    d = stage(clamped_sum(changes, ROUND, ORDER, red_cols, ch, before=True), "red-fives")  # read by windows and by chunks
    missed = {t[:2]: count("removed", t) - (F.col(f"n_{t}_before") + count("added", t) - F.col(f"n_{t}"))
              for t in dims.RED_FIVES}
    plain_cols = {f"n_{t}": count("added", t) - count("removed", t) - missed.get(t, F.lit(0)) for t in plain}
    d = clamped_sum(d, ROUND, ORDER, plain_cols, ch)
    hand = F.flatten(F.array(*[F.array_repeat(F.lit(t), F.col(f"n_{t}").cast("int"))
                               for t in dims.HAND_ORDER if t != "?"]))
    return d.withColumn("hand", hand).drop(*red_cols, *[f"{c}_before" for c in red_cols], *plain_cols)


def _drawn_mark(hero: Column) -> Column:
    t, mine = F.col("type"), F.col("actor") == hero
    return (F.when(mine & (t == "tsumo") & (F.col("pai") != "?"), F.col("pai"))
            .when(mine & t.isin(["dahai"] + dims.CALL_EVENTS), F.lit("")))


def drawn_tile(rounds: DataFrame, hero: Column, chunk: Column | None = None) -> DataFrame:
    """The hero's separated draw; any hero discard, call or kan clears it."""
    d = scan(rounds, ROUND, ORDER, [Run("drawn", "last", _drawn_mark(hero))], seq_chunk() if chunk is None else chunk)
    return d.withColumn("drawn", F.nullif(F.col("drawn"), F.lit("")))


def _owed_runs() -> list[Run]:
    t, at = F.col("type"), F.struct(*ORDER)
    runs = [Run("_call", "last", F.when(t.isin(dims.OWED_EVENTS), F.struct(*ORDER, "actor")))]
    return runs + [Run(f"_d{s}", "last", F.when((t == "dahai") & (F.col("actor") == s), at)) for s in range(4)]


def _owed_value(d: DataFrame) -> DataFrame:
    call = F.struct(*[F.col(f"_call.{c}").alias(c) for c in ORDER])
    owed = F.lit(-1)
    for s in range(4):
        paid = F.coalesce(F.col(f"_d{s}") > call, F.lit(False))
        owed = F.when((F.col("_call.actor") == s) & ~paid, s).otherwise(owed)
    return d.withColumn("owed", owed).drop("_call", *[f"_d{s}" for s in range(4)])


def owed_discard(rounds: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Seat that owes a discard after a call or kan, -1 if none."""
    return _owed_value(scan(rounds, ROUND, ORDER, _owed_runs(), seq_chunk() if chunk is None else chunk))


def record_summary(rounds: DataFrame, keys: list[str]) -> DataFrame:
    """Event-type set, last event and round of each record."""
    at = F.struct(*ORDER)
    return rounds.groupBy(*keys).agg(
        F.array_sort(F.collect_set("type")).alias("types"),
        F.max_by("type", at).alias("last_event"),
        F.max("kyoku_ord").alias("kyoku_ord"),
        F.max(F.col("type") == "start_kyoku").alias("has_start"))


def left_count(records: DataFrame, order: str, count: Column, chunk: Column | None = None) -> DataFrame:
    """Wall count carried forward within the round.

    The count is written before the record's events, so a record that starts a round loses it.
    """
    ch = seq_chunk(order) if chunk is None else chunk
    kept = F.when(~F.col("has_start"), count)
    return scan(records, ROUND, [order], [Run("left_tiles", "last", kept)], ch)


def _open_runs() -> list[Run]:
    t = F.col("type")
    flag = F.when(t == "start_kyoku", True).when(t == "end_kyoku", False)
    return [Run("open", "last", flag), Run("n_discards", "sum", F.when(t == "dahai", 1).otherwise(0))]


def in_round(rounds: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Running facts the window predicates need: round open, discards so far."""
    d = scan(rounds, ROUND, ORDER, _open_runs(), seq_chunk() if chunk is None else chunk)
    return d.withColumn("open", F.coalesce("open", F.lit(False)))


def deal_window(open_: Column, n_discards: Column) -> Column:
    """a round is open and nobody has discarded yet."""
    return open_ & (n_discards == 0)


def in_window(types: Column, last_event: Column, events: list[str]) -> Column:
    """the record's type set, or the last event if the set says nothing."""
    hit = F.arrays_overlap(types, F.array(*[F.lit(e) for e in events]))
    return F.coalesce(hit, F.lit(False)) | F.coalesce(last_event.isin(events), F.lit(False))


def call_pending(open_: Column, owed: Column) -> Column:
    """a round is open and a seat owes a discard."""
    return open_ & (owed >= 0)


def added_kans(rounds: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Every added kan with the triple it upgrades, or none.

    Triples of one (seat, base tile) wait in a queue; an added kan takes the oldest one left.
    """
    ch = seq_chunk() if chunk is None else chunk
    pon = F.col("type") == "pon"
    keys = ROUND + ["actor", "base"]
    d = rounds.filter(F.col("type").isin("pon", "kakan")).withColumn("base", base_tile(F.col("pai")))
    d = clamped_sum(d, keys, ORDER, {"_free": F.when(pon, 1).otherwise(-1)}, ch, before=True)
    d = d.withColumn("_hit", ~pon & (F.col("_free_before") > 0))
    d = scan(d, keys, ORDER, [Run("_pon_no", "sum", F.when(pon, 1).otherwise(0)),
                              Run("_hit_no", "sum", F.when(F.col("_hit"), 1).otherwise(0))], ch)
    pons = d.filter(pon).select(*keys, F.col("_pon_no").alias("_no"), F.col("seq").alias("pon_seq"), F.col("ev_idx").alias("pon_idx"))
    kans = d.filter(~pon).select(*keys, "seq", "ev_idx", F.when(F.col("_hit"), F.col("_hit_no")).alias("_no"))
    return kans.join(pons, keys + ["_no"], "left").drop("_no")
