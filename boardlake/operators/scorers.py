"""User scorers as tables, and seeded faults to test comparisons."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import seeded_share


def score_with(rows: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Run a user's scorer over batches of rows.

    ``make`` builds the scorer once per task (load a model there); the scorer maps one pandas
    batch to rows of ``schema``: ``probs``, ``detections`` or ``reads``.  Only the columns the
    scorer needs should be selected before.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for b in batches:
            yield scorer(b)

    return rows.mapInPandas(run, schema)


def inject_faults(reads: DataFrame, keys: list[str], value: str, drop_rate: float, error_rate: float, seed: int) -> DataFrame:
    """Drop and corrupt reads at given rates, fixed by the seed.

    A sound comparison must then report rates near one minus the faults.
    """
    cols = [F.col(k) for k in keys]
    d = reads.filter(seeded_share(seed, *cols) >= drop_rate)
    wrong = seeded_share(seed + 1, *cols) < error_rate
    return d.withColumns({value: F.when(wrong, F.concat(F.col(value), F.lit("?"))).otherwise(F.col(value)), "corrupted": wrong})
