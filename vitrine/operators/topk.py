"""Stored neighbour lists cut to their first entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.config import NEIGHBOURS


def top_stored(rows: DataFrame, n: int = NEIGHBOURS) -> DataFrame:
    """``(id, neighbor_id, score, rank)`` of stored lists: the latest usable score of each pair, the ``n`` best.

    Null and non-finite scores and a product as its own neighbour don't count."""
    fine = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < F.lit(float("inf"))) & (F.col("id") != F.col("neighbor_id"))
    latest = Window.partitionBy("id", "neighbor_id").orderBy(F.col("computed_at").desc_nulls_last(), F.col("score").desc())
    now = rows.where(fine).withColumn("rn", F.row_number().over(latest)).where("rn = 1").select("id", "neighbor_id", "score")
    best = Window.partitionBy("id").orderBy(F.col("score").desc(), "neighbor_id")
    return now.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
