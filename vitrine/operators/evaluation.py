"""Ranking quality, and the retrain and audit of a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.functions import scalars as S
from vitrine.operators import profiles as P
from vitrine.operators import together as G


def judged(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """``(q, doc, pos, rel)``: 1 for what the judgments ``relevant(q, doc)`` name, else 0."""
    return ranked.select("q", "doc", "pos").join(relevant.select("q", "doc").distinct().withColumn("rel", F.lit(1)), ["q", "doc"], "left").fillna(0, ["rel"])


def query_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``(q, ndcg, precision, recall, mrr, ap)`` at ``k`` for every query that has a relevant document.

    Precision divides by k, recall and average precision by the number relevant (average
    precision by at most k); a query without results scores 0."""
    n = relevant.select("q", "doc").distinct().groupBy("q").agg(F.count(F.lit(1)).alias("n_rel"))
    top = judged(ranked.where(F.col("pos") <= k), relevant)
    w = Window.partitionBy("q").orderBy("pos")
    hits = top.withColumn("seen", F.sum("rel").over(w)).groupBy("q").agg(
        F.sum(F.col("rel") / F.log2(F.col("pos") + 1)).alias("dcg"), F.sum("rel").alias("hits"),
        F.max(F.when(F.col("rel") == 1, 1.0 / F.col("pos"))).alias("rr"), F.sum(F.col("rel") * F.col("seen") / F.col("pos")).alias("ps"),
    )
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel")).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return n.join(hits, "q", "left").select(
        "q",
        zero(F.col("dcg") / best).alias("ndcg"),
        zero(F.col("hits") / F.lit(float(k))).alias("precision"),
        zero(F.col("hits") / F.col("n_rel")).alias("recall"),
        zero(F.col("rr")).alias("mrr"),
        zero(F.col("ps") / F.least(F.col("n_rel"), F.lit(k))).alias("ap"),
    )


def segment_metrics(per_query: DataFrame, segments: DataFrame) -> DataFrame:
    """Means of each segment, never across them; ``segments(q, segment)``."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "precision", "recall", "mrr", "ap")]
    return per_query.join(segments, "q").groupBy("segment").agg(F.count(F.lit(1)).alias("queries"), *means)


def segment_report(per_query: DataFrame, segments: DataFrame, segment: str) -> DataFrame:
    """``segment_metrics`` of one segment.

    Raises ``ValueError`` for ``negative``: those queries have nothing relevant, so what counts is how many
    pages they fill (``page_counts``), and for a segment without queries."""
    if segment == "negative":
        raise ValueError("negative queries have no relevant documents; count their pages instead")
    mine = segments.where(F.col("segment") == segment)
    if not mine.limit(1).count():
        raise ValueError(f"no queries of segment {segment!r}")
    return segment_metrics(per_query, mine)


def page_counts(queries: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Per segment: queries with a full page, rows shown, and queries with none."""
    sizes = ranked.where(F.col("pos") <= k).groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    per = queries.join(sizes, "q", "left").fillna(0, ["n"])
    return per.groupBy("segment").agg(F.count_if(F.col("n") >= k).alias("full_pages"), F.sum("n").alias("shown"), F.count_if(F.col("n") == 0).alias("empty_pages"))


def label_match(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """``(q, doc)``: products one of whose category levels is among the query's ``nodes``."""
    levels = F.array_distinct(F.concat(F.array("category"), "subcategories"))
    mine = catalog.select(F.col("id").alias("doc"), F.explode(levels).alias("node"))
    return queries.select("q", F.explode("nodes").alias("node")).join(mine, "node").select("q", "doc").distinct()


def movers(blended: DataFrame, n: int | None = 10) -> DataFrame:
    """Products whose popularity changed, the greatest change first."""
    delta = F.round(F.col("after") - F.col("before"), 6)
    rows = blended.where("before <> after").select(F.col("id").alias("product_id"), F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), delta.alias("delta"))
    return rows if n is None else rows.orderBy(F.abs("delta").desc(), "product_id").limit(n)


def events_by_type(events: DataFrame) -> DataFrame:
    return P.valid(events).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def audit(events: DataFrame, catalog: DataFrame, before_edges: DataFrame, version: str, alpha: float = 0.5) -> DataFrame:
    """One row of what a retrain would change; nothing is published."""
    good = P.valid(events)
    blended = P.blended_popularity(catalog, P.engagement(events), alpha)
    after = G.cooccurrence(events)
    return good.agg(F.count(F.lit(1)).alias("total_events")).select(
        "total_events",
        events.agg(F.count_distinct("line_no")).scalar().alias("session_count"),
        blended.where("before <> after").agg(F.count(F.lit(1))).scalar().alias("moved_products"),
        G.changed_edges(before_edges, after).agg(F.count(F.lit(1))).scalar().alias("changed_edges"),
        F.lit(version).alias("current_version"),
        F.lit(S.next_version(version)).alias("new_version"),
    )


def retrained(catalog: DataFrame, events: DataFrame, alpha: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The catalogue with blended popularity, and the new neighbours."""
    new = P.blended_popularity(catalog, P.engagement(events), alpha).select("id", F.col("after").alias("popularity_score"))
    return catalog.drop("popularity_score").join(new, "id"), G.cooccurrence(events)
