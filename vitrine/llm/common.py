"""What several operators of the subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space as Unicode has it, for Java regular expressions.
WS = r"[\p{Z}\s\x1c-\x1f\x85]+"


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each ``key`` with the greatest ``order``; null keys drop out.

    The window's limit of one row is applied before the shuffle as well, so a key sent
    a billion times moves one row per task."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    return df.where(F.col(key).isNotNull()).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def cell_of(n: int, *cols) -> Column:
    """A number below ``n`` by hash: the part of a hot key's rows one task gets."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
