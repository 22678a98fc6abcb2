"""Item-to-item neighbours by cosine of the engagement two products share across session lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.config import NEIGHBOURS
from vitrine.operators.profiles import event_weight, valid


def line_engagement(events: DataFrame, line: str = "line_no") -> DataFrame:
    """``(line, product_id, w)``: what the products of one session line are worth."""
    return valid(events).groupBy(F.col(line).alias("line"), "product_id").agg(F.sum(event_weight(F.col("event_type"))).alias("w"))


def norms(eng: DataFrame) -> DataFrame:
    return eng.groupBy("product_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm <> 0")


#: Products of a line up to which one task makes all its pairs.
LINE_PART = 500


def dots(eng: DataFrame, part: int = LINE_PART, of: DataFrame | None = None) -> DataFrame:
    """Sums of products for pairs with ``a < b``; both directions follow from one.  With
    ``of(product_id)`` only pairs with one of these products.

    A line of more than ``part`` products is cut into parts of about so many by a hash;
    two parts meet by a join on (line, part, part), so a very long line is many tasks."""
    cut = eng.groupBy("line").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")).where("parts > 1")
    # Of most logs no line is that long; where there are some, their list joins by the line as the rows do.
    rows = eng.join(cut, "line", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("product_id"), F.col("parts").cast("long")).cast("int"))
    if of is not None:
        rows = rows.join(of.select("product_id").distinct().withColumn("of", F.lit(True)), "product_id", "left")
    rows = rows.withColumn("of", F.lit(True) if of is None else F.coalesce("of", F.lit(False)))
    a = rows.select("line", F.col("p").alias("p1"), F.explode(F.sequence("p", F.col("parts") - 1)).alias("p2"), F.col("product_id").alias("x"), F.col("w").alias("wx"), F.col("of").alias("ox"))
    b = rows.select("line", F.explode(F.sequence(F.lit(0), F.col("p"))).alias("p1"), F.col("p").alias("p2"), F.col("product_id").alias("y"), F.col("w").alias("wy"), F.col("of").alias("oy"))
    met = a.join(b, ["line", "p1", "p2"]).where(F.when(F.col("p1") == F.col("p2"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y"))).where("ox OR oy")
    # The join's rows are summed within each task before they move.
    return met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum(F.col("wx") * F.col("wy")).alias("dot"))


def cosines(eng: DataFrame, digits: int = 6, of: DataFrame | None = None) -> DataFrame:
    """``(id, neighbor_id, score)`` in both directions, rounded so that every engine ranks alike; with ``of(product_id)`` from these products only."""
    n = norms(eng)
    half = (
        dots(eng, of=of)
        .join(n.select(F.col("product_id").alias("a"), F.col("norm").alias("na")), "a")
        .join(n.select(F.col("product_id").alias("b"), F.col("norm").alias("nb")), "b")
        .select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), digits).alias("score"))
    )
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("neighbor_id")), F.struct(F.col("b").alias("id"), F.col("a").alias("neighbor_id"))))
    edges = half.select(ends.alias("e"), "score").select("e.id", "e.neighbor_id", "score")
    return edges if of is None else edges.join(of.select(F.col("product_id").alias("id")), "id", "left_semi")


def neighbours(edges: DataFrame, n: int = NEIGHBOURS) -> DataFrame:
    """The ``n`` best neighbours of every product, ties by id, with their ``rank``."""
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "neighbor_id")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cooccurrence(events: DataFrame, n: int = NEIGHBOURS, of: DataFrame | None = None) -> DataFrame:
    return neighbours(cosines(line_engagement(events), of=of), n)


def changed_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges that are new or scored otherwise; removed ones don't count."""
    b = before.select("id", "neighbor_id", F.col("score").alias("old"))
    return after.join(b, ["id", "neighbor_id"], "left").where(~F.col("score").eqNullSafe(F.col("old")))


def as_matrix(neighbors: DataFrame) -> DataFrame:
    """One row per product with the ids and scores of its neighbours in order, as they are exported."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "neighbor_id", "score")))
    rows = neighbors.groupBy("id").agg(ordered.alias("x"))
    return rows.select("id", F.col("x.neighbor_id").alias("neighbor_ids"), F.col("x.score").alias("scores"))
