"""Board states per record (G1's record in batch, read by P20, F6, F7, M9, W16 and W18).

Everything that lies on the table has an interval of records: a discard from its own record until a claim takes it, a triple
until an added kan upgrades it, an indicator until its round ends. The state of a record is the list of what has begun in
the round, cut to what has not ended by then. One segmented pass carries lists and scalars together, so a log of any length is spread
over its chunks; a row is as large as the board it describes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.tiles import base_tile
from . import replay as R
from .ordered import Run, scan, seq_chunk

_MELD = ("type", "tiles", "called", "added", "from_seat")


def with_hero(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Adds ``hero``, the seat that the latest ``start_game`` of the log gives the player (column ``id``), -1 before."""
    own = F.when(F.col("type") == "start_game", F.col("id"))
    d = scan(events, ["game"], R.ORDER, [Run("hero", "last", own)], seq_chunk() if chunk is None else chunk)
    return d.withColumn("hero", F.coalesce("hero", F.lit(-1)))


def _sorted_tiles(tiles: Column) -> Column:
    """On-screen order; names that are not in it come last, as they stand."""
    order = F.array(*[F.lit(t) for t in dims.HAND_ORDER])
    ranked = F.transform(tiles, lambda t, i: F.struct(
        F.when(F.array_position(order, t) > 0, F.array_position(order, t)).otherwise(F.lit(999)).alias("r"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(ranked), lambda x: x["t"])


def _marked(rounds: DataFrame, chunk: Column) -> DataFrame:
    """The log with what each event puts on the table: ``laid`` (a discard with the record that claims it) and
    ``meld`` (a set with the record that upgrades it)."""
    at = ["game", *R.ORDER]
    taken = R.claim_levels(rounds, chunk).filter("type = 'dahai'").select(*at, "called_seq")
    riichi = R.riichi_discards(rounds, chunk).select(*at, "riichi")
    kans = R.added_kans(rounds, chunk).select(*at, "pon_seq", "pon_idx")
    pons = rounds.filter("type = 'pon'").select("game", F.col("seq").alias("pon_seq"), F.col("ev_idx").alias("pon_idx"), F.col("pai").alias("_pai"),
                                                F.col("consumed").alias("_consumed"), F.col("target").alias("_target"))
    kans = kans.join(pons, ["game", "pon_seq", "pon_idx"], "left")
    upgraded = kans.filter("pon_seq IS NOT NULL").select("game", F.col("pon_seq").alias("seq"), F.col("pon_idx").alias("ev_idx"), F.col("seq").alias("kan_seq"))
    drawn = F.col("tsumogiri") if "tsumogiri" in rounds.columns else F.lit(False)
    d = rounds.join(taken, at, "left").join(riichi, at, "left").join(kans, at, "left").join(upgraded, at, "left")
    t, none = F.col("type"), F.lit("")
    place = F.struct(*R.ORDER)
    laid = F.struct(place.alias("at"), F.col("actor").alias("seat"), F.col("pai").alias("pai"), F.coalesce(drawn, F.lit(False)).alias("tsumogiri"),
                    F.coalesce("riichi", F.lit(False)).alias("riichi"), F.col("called_seq").alias("till"))
    # An added kan stands where its triple stood; without one it is a set of its own.
    on = F.col("pon_seq").isNotNull()
    kan_place = F.when(on, F.struct(F.col("pon_seq").alias("seq"), F.col("pon_idx").alias("ev_idx"))).otherwise(place)
    consumed = F.coalesce("consumed", F.array().cast("array<string>"))
    tiles = (F.when(t.isin(dims.CLAIM_EVENTS), _sorted_tiles(F.concat(F.array("pai"), consumed)))
             .when(t == "ankan", _sorted_tiles(consumed))
             .when(on, _sorted_tiles(F.concat(F.array("_pai"), "_consumed", F.array("pai"))))
             .otherwise(F.coalesce("consumed", F.array("pai"))))
    meld = F.struct(F.when(t == "kakan", kan_place).otherwise(place).alias("at"), F.col("actor").alias("seat"), t.alias("type"), tiles.alias("tiles"),
                    F.when(t.isin(dims.CLAIM_EVENTS), F.col("pai")).when((t == "kakan") & on, F.col("_pai")).otherwise(none).alias("called"),
                    F.when(t == "kakan", F.col("pai")).otherwise(none).alias("added"),
                    F.when(t.isin(dims.CLAIM_EVENTS), F.col("target")).when((t == "kakan") & on, F.col("_target")).otherwise(F.col("actor")).alias("from_seat"),
                    F.col("kan_seq").alias("till"))
    return d.withColumns({"laid": F.when(t == "dahai", laid), "meld": F.when(t.isin(dims.OWED_EVENTS), meld)}).drop(
        "called_seq", "riichi", "pon_seq", "pon_idx", "_pai", "_consumed", "_target", "kan_seq")


def _open(items: Column, seat: int) -> Column:
    """What has not ended by the record, of one seat, in order of its place."""
    return F.array_sort(F.filter(items, lambda x: (x["seat"] == seat) & (x["till"].isNull() | (x["till"] > F.col("seq")))))


def _river(seat: int) -> Column:
    """A seat's visible river; the first tile left at or after its riichi discard lies sideways."""
    mine = F.filter("_laid", lambda x: x["seat"] == seat)
    since = F.array_min(F.transform(F.filter(mine, lambda x: x["riichi"]), lambda x: x["at"]))
    lies = _open(F.col("_laid"), seat)
    side = F.array_min(F.transform(F.filter(lies, lambda x: x["at"] >= since), lambda x: x["at"]))
    return F.transform(lies, lambda x: F.struct(x["pai"].alias("pai"), x["tsumogiri"].alias("tsumogiri"), x["riichi"].alias("riichi"),
                                                F.coalesce(x["at"] == side, F.lit(False)).alias("sideways")))


def _melds(seat: int) -> Column:
    return F.transform(_open(F.col("_melds"), seat), lambda x: F.struct(*[x[c].alias(c) for c in _MELD]))


def board_states(events: DataFrame, hero: Column, rounds: DataFrame | None = None, chunk: Column | None = None) -> DataFrame:
    """One row per record (game, seq): the board after its events.

    ``kyoku_ord, open, r_bakaze, r_kyoku, r_honba, r_oya, hero, hand`` (on-screen order), ``drawn, dora``, per-seat arrays ``rivers``
    (pai, tsumogiri, riichi, sideways), ``melds`` (type, tiles, called, added, from_seat), ``reach, scores, side, concealed``, and
    ``sticks, owed, last_actor, left_tiles, n_discards``. Claimed discards are not in their river; an added kan takes its triple's
    place. Illegal or cut logs give what an event loop gives. ``rounds`` (the log as of `with_round`, written once) spares a pass.
    """
    from ..session import stage

    ch = seq_chunk() if chunk is None else chunk
    if rounds is None:
        rounds = stage(R.with_round(events, ch), "rounds")
    hands = R.hero_hand(stage(R.hero_events(rounds, hero), "hand-changes"), ch).select("game", *R.ORDER, F.col("hand").alias("_hand"))
    d = _marked(rounds, ch).drop("kyoku_ord", *[f"r_{c}" for c in ("bakaze", "kyoku", "honba", "oya")]).join(hands, ["game", *R.ORDER], "left")
    # The count is written before a record's events, so a record that opens a round loses it.
    count = F.when((F.col("ev_idx") == 0) & (F.col("type") != "start_kyoku"), F.col("left_count")) if "left_count" in d.columns else F.lit(None).cast("int")
    more = (Run("_laid", "list", F.col("laid")), Run("_melds", "list", F.col("meld")), Run("hand", "last", F.col("_hand")), Run("left_tiles", "last", count))
    d = R.replayed(d, hero=hero, chunk=ch, more=more)
    last = F.lead("seq").over(Window.partitionBy("game", "_at").orderBy(*R.ORDER))
    d = d.withColumn("_at", ch).withColumn("_next", last).filter(F.col("_next").isNull() | (F.col("_next") != F.col("seq")))
    seats = range(4)

    def per_seat(name: str) -> Column:
        return F.array(*[F.col(f"{name}_{s}") for s in seats])

    return d.select("game", "seq", "kyoku_ord", "open", "r_bakaze", "r_kyoku", "r_honba", "r_oya", hero.alias("hero"),
                    F.coalesce("hand", F.array().cast("array<string>")).alias("hand"), "drawn", "dora",
                    F.array(*[_river(s) for s in seats]).alias("rivers"), F.array(*[_melds(s) for s in seats]).alias("melds"),
                    per_seat("reach").alias("reach"), per_seat("score").alias("scores"), per_seat("side").alias("side"), per_seat("concealed").alias("concealed"),
                    "sticks", "owed", "last_actor", "left_tiles", "n_discards")


def visible_tiles(states: DataFrame) -> Column:
    """Every tile that lies open: hero's hand, visible rivers, sets and indicators."""
    rivers = F.transform(F.flatten("rivers"), lambda x: x["pai"])
    sets = F.flatten(F.transform(F.flatten("melds"), lambda m: m["tiles"]))
    return F.concat("hand", rivers, sets, "dora")


def violations(states: DataFrame) -> DataFrame:
    """F6 on board states: one row (game, seq, message) per rule that a record's board breaks, without a shuffle."""
    bases = F.transform(F.filter(visible_tiles(states), lambda t: ~t.isin("", "?")), base_tile)
    d = states.withColumn("_b", bases)
    over = F.filter(F.transform(F.array_distinct("_b"), lambda b: F.struct(b.alias("b"), F.size(F.filter("_b", lambda x: x == b)).alias("n"))), lambda x: x["n"] > 4)
    tiles = F.transform(over, lambda x: F.concat(F.lit("tile "), x["b"], F.lit(" seen "), x["n"].cast("string"), F.lit(">4 times across visible zones")))
    n_hand, n_sets = F.size("hand"), F.size(F.get("melds", F.greatest("hero", F.lit(0))))
    total = n_hand + 3 * n_sets
    size = F.when((F.col("hero") >= 0) & (n_hand > 0) & ~total.isin(13, 14), F.concat(
        F.lit("hero hand "), n_hand.cast("string"), F.lit(" + 3*"), n_sets.cast("string"), F.lit(" melds = "), total.cast("string"), F.lit(" not in 13/14")))
    below = [F.when(F.get("concealed", F.lit(s)) < 0, F.concat(F.lit(f"seat {s} concealed count "), F.get("concealed", F.lit(s)).cast("string"), F.lit(" < 0"))) for s in range(4)]
    return d.select("game", "seq", F.explode(F.concat(tiles, F.array_compact(F.array(size, *below)))).alias("message"))
