"""Problem 2: the N best items of every group, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.llm.common import is_finite
from vitrine.runtime import MAX_BROADCAST_ROWS, cut

#: Rows up to which a group is ranked by one task.
LARGE_GROUP = 20_000


def top_n_per_group(
    rows: DataFrame,
    n: int,
    group: str = "id",
    item: str = "neighbor_id",
    score: str = "score",
    version: str | None = "computed_at",
    keep_self: bool = False,
    cells: int | None = None,
    large: int = LARGE_GROUP,
) -> DataFrame:
    """``(group, item, score, pos)``: the ``n`` items of each group by score descending, then item ascending.

    Method: partition lower bounds.  A group of more than ``large`` rows is spread over
    parts of about so many rows (or ``cells`` parts) by a hash of the item.  The N-th best
    score within any one part is a lower bound of the group's N-th best, so the greatest
    of these bounds is joined back, rows below it go and only the survivors (about N of
    a group, with ties) are ranked together.  Other groups are one part, whose local
    ranks are final, so their rows move once.  In huge collections ``large`` is raised so
    that at most ``MAX_BROADCAST_ROWS`` groups can exceed it: their list goes to all tasks.

    Defined results: rows with a null group or item, with a null, NaN or infinite score,
    or with item equal to group (unless ``keep_self``) don't count.  Of several rows of
    one (group, item) the one with the greatest ``version`` counts (null is the oldest;
    of equal versions the greater score), without ``version`` the greatest score.
    Groups with fewer than ``n`` items come out whole; an empty input gives no rows.
    Other columns of the input are ignored, so their names can't clash.
    """
    if n < 1:
        raise ValueError("n must be positive")
    when = F.col(version).cast("timestamp") if version else F.lit(None).cast("timestamp")
    base = rows.select(
        F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"), when.alias("v")
    ).where(F.col("g").isNotNull() & F.col("i").isNotNull() & is_finite(F.col("s")))
    if not keep_self:
        base = base.where(F.col("g") != F.col("i"))
    large = max(large, -(-rows.count() // MAX_BROADCAST_ROWS))  # of parquet, a look at the footers
    sizes = base.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > large)
    hot = [(r["g"], max(2, cells or -(-r["size"] // large))) for r in sizes.collect()]  # at most MAX_BROADCAST_ROWS, as said above
    schema = f"g {dict(base.dtypes)['g']}, parts int"
    parts = base.sparkSession.createDataFrame(hot, schema)
    if hot:
        spread = base.join(F.broadcast(parts), "g").withColumn("c", F.pmod(F.xxhash64("i"), F.col("parts").cast("long")).cast("int"))
        best = cut(_ranked(spread, ["g", "c"], n))
        bounds = best.where(F.col("r") == n).groupBy("g").agg(F.max("s").alias("bound"))
        survivors = best.join(F.broadcast(bounds), "g", "left").where(F.col("bound").isNull() | (F.col("s") >= F.col("bound")))
        final = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i"))
        merged = survivors.withColumn("r", F.row_number().over(final)).where(F.col("r") <= n).select("g", "i", "s", "r")
        base = base.join(F.broadcast(parts), "g", "left_anti")
    out = _ranked(base, ["g"], n).select("g", "i", "s", "r")
    if hot:
        out = out.unionByName(merged)
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("r").cast("int").alias("pos"))


def _ranked(rows: DataFrame, part: list[str], n: int) -> DataFrame:
    """The ``n`` best current rows of each part, with their rank ``r``; one shuffle serves both windows."""
    latest = Window.partitionBy(*part, "i").orderBy(F.col("v").desc_nulls_last(), F.col("s").desc())
    local = Window.partitionBy(*part).orderBy(F.col("s").desc(), F.col("i"))
    current = rows.repartition(*part).withColumn("k", F.row_number().over(latest)).where("k = 1").drop("k", "v")
    return current.withColumn("r", F.row_number().over(local)).where(F.col("r") <= n)
