"""Column functions over tile names and class ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lit_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def class_name(cls: Column) -> Column:
    """Class id -> name; null for ids outside the taxonomy."""
    ok = (cls >= 0) & (cls < len(dims.CLASSES))
    return F.when(ok, F.get(lit_array(dims.CLASSES), cls.cast("int")))


def tile_name(cls: Column) -> Column:
    """Class id -> tile name; null for HUD ids and unknown ids."""
    return F.when(cls < len(dims.TILES), class_name(cls))


def class_id(name: Column) -> Column:
    """Name -> class id; null if unknown."""
    p = F.array_position(lit_array(dims.CLASSES), name)
    return F.when(p > 0, (p - 1).cast("int"))


def to_log_name(name: Column) -> Column:
    """Class name -> event-log notation; ``back`` has none."""
    return F.when(name != "back", F.coalesce(lit_map(dims.LOG_NOTATION)[name], name))


def from_log_name(name: Column) -> Column:
    return F.coalesce(lit_map({v: k for k, v in dims.LOG_NOTATION.items()})[name], name)


def is_red_five(name: Column) -> Column:
    return name.isin(dims.RED_FIVES)


def base_tile(name: Column) -> Column:
    """A red five counts as its plain five."""
    return F.when(is_red_five(name), F.substring(name, 1, 2)).otherwise(name)


def _cycle(values: list[str], name: Column) -> Column:
    return lit_map({v: values[(i + 1) % len(values)] for i, v in enumerate(values)})[name]


def next_tile(indicator: Column) -> Column:
    """The tile an indicator points at: the cyclic successor in its suit, winds or dragons."""
    n = base_tile(from_log_name(indicator))
    rank = F.try_to_number(F.substring(n, 1, 1), F.lit("9")).cast("int")
    suited = F.concat((F.pmod(rank, F.lit(9)) + 1).cast("string"), F.substring(n, 2, 1))
    return F.coalesce(_cycle(dims.WINDS, n), _cycle(dims.DRAGONS, n), suited)


def hand_rank(name: Column) -> Column:
    """Position in the on-screen hand order, 999 for unknown names."""
    p = F.array_position(lit_array(dims.HAND_ORDER), name)
    return F.when(p > 0, p - 1).otherwise(999)


def sort_hand(tiles: Column) -> Column:
    """Tiles in on-screen order."""
    keyed = F.transform(tiles, lambda t: F.struct(hand_rank(t).alias("r"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda s: s["t"])
