"""Small helpers that spell Python constants as SQL text."""

from __future__ import annotations


def sql_list(values) -> str:
    """A list literal."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


def sql_in(values) -> str:
    """A parenthesised list for IN."""
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def dbl(x: float) -> str:
    """A literal that is read as a double, not as a decimal."""
    return f"CAST('{x!r}' AS DOUBLE)"
