"""Helpers the operators share: tables, row keys, balanced running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardlake.session import fresh_path, stage

__all__ = ["fresh_path", "lower_az", "read", "row_key", "running_total", "stage", "word_count"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_key(*cols: Column) -> Column:
    """128-bit key of a row by values, so that repeated rows share it and nulls have one."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *reversed(cols)).alias("b"))


def running_total(df: DataFrame, group: list[str], part: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all rows before this one, by (``part``, ``order``) inside ``group``.

    Windows only ever hold one (group, part); one total per part is scanned across parts. ``part``
    must ascend with the order wanted.
    """
    inner = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = (df.groupBy(*group, part).agg(F.sum(value).alias("_sum"))
             .withColumn("_before", F.coalesce(F.sum("_sum").over(outer), F.lit(0))).drop("_sum"))
    names = [*group, part]
    parts = parts.toDF(*[f"_r_{c}" for c in names], "_before")
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    joined = df.join(parts, on).drop(*[f"_r_{c}" for c in names])
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_before")
