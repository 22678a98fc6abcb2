"""Session logs, profiles folded from them, and engagement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.config import BUMPS, EVENT_WEIGHTS, RECENT_CAP, Bump


def session_events(sessions: DataFrame) -> DataFrame:
    """``(line_no, session_id, pos, product_id, event_type)``, one row per event of the log."""
    return sessions.select("line_no", "session_id", F.posexplode("events").alias("pos", "e")).select(
        "line_no", "session_id", "pos", F.col("e.product_id").alias("product_id"), F.col("e.event_type").alias("event_type")
    )


def valid(events: DataFrame) -> DataFrame:
    """Events of one of the known types, of some product."""
    return events.where(F.col("event_type").isin(*EVENT_WEIGHTS) & F.col("product_id").isNotNull())


def rejected(events: DataFrame) -> DataFrame:
    """The others, with what is wrong: the quarantine of the log."""
    reason = F.when(F.col("product_id").isNull(), "no product").otherwise("unknown event type")
    return events.where(~F.coalesce(F.col("event_type").isin(*EVENT_WEIGHTS), F.lit(False)) | F.col("product_id").isNull()).withColumn("reason", reason)


def event_weight(c: Column, weights: dict[str, float] | None = None) -> Column:
    out = None
    for k, v in (weights or EVENT_WEIGHTS).items():
        out = (F.when(c == k, F.lit(v))) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(0.0))


def _bump(kind: str, bumps: dict[str, Bump]) -> Column:
    return event_weight(F.col("event_type"), {k: getattr(b, kind) for k, b in bumps.items()})


def affinities(events: DataFrame, catalog: DataFrame, key: str = "session_id", bumps: dict[str, Bump] | None = None) -> DataFrame:
    """``(session, kind, key, value)``.

    Folding events one by one adds a bump each and caps at 1.  Bumps are never negative,
    so the cap can wait: the fold is one sum per key.  Tags a product has twice count
    twice; unknown products count nothing."""
    bumps = bumps or BUMPS
    known = valid(events).where(F.col(key).isNotNull()).join(catalog.select(F.col("id").alias("product_id"), "category", "brand", "tags"), "product_id")
    entries = F.concat(
        F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("key"), _bump("category", bumps).alias("bump"))),
        F.transform("tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("key"), _bump("tag", bumps).alias("bump"))),
        F.when(F.col("brand") != "", F.array(F.struct(F.lit("brand").alias("kind"), F.col("brand").alias("key"), _bump("brand", bumps).alias("bump")))).otherwise(
            F.array().cast("array<struct<kind:string,key:string,bump:double>>")
        ),
    )
    rows = known.select(F.col(key).alias("session"), F.explode(entries).alias("x")).select("session", "x.*")
    return rows.groupBy("session", "kind", "key").agg(F.least(F.lit(1.0), F.sum("bump")).alias("value"))


def recently_viewed(events: DataFrame, catalog: DataFrame, key: str = "session_id", cap: int = RECENT_CAP) -> DataFrame:
    """``(session, product_id, pos)``: distinct known products, the latest first; every event type counts."""
    known = valid(events).where(F.col(key).isNotNull()).join(catalog.select(F.col("id").alias("product_id")), "product_id")
    last = known.groupBy(F.col(key).alias("session"), "product_id").agg(F.max(F.struct("line_no", "pos")).alias("at"))
    w = Window.partitionBy("session").orderBy(F.col("at").desc())
    return last.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap).select("session", "product_id", "pos")


def clicks(events: DataFrame, catalog: DataFrame, key: str = "session_id") -> DataFrame:
    known = valid(events).where(F.col(key).isNotNull()).join(catalog.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    return known.groupBy(F.col(key).alias("session")).agg(F.count_if(F.col("event_type") == "click").alias("click_count"))


def profiles(events: DataFrame, catalog: DataFrame, key: str = "session_id", bumps: dict[str, Bump] | None = None) -> DataFrame:
    """One row per session: maps of affinities, the recent products and the number of clicks.

    A map holds at most the categories, tags or brands of the catalogue."""

    def part(kind: str) -> Column:
        pair = F.when(F.col("kind") == kind, F.struct("key", "value"))
        return F.map_from_entries(F.collect_list(pair)).alias(kind)

    maps = affinities(events, catalog, key, bumps).groupBy("session").agg(part("category"), part("tag"), part("brand"))
    recent = recently_viewed(events, catalog, key).groupBy("session").agg(F.sort_array(F.collect_list(F.struct("pos", "product_id"))).alias("r"))
    recent = recent.select("session", F.transform("r", lambda x: x["product_id"]).alias("recent"))
    return maps.join(recent, "session").join(clicks(events, catalog, key), "session")


def once_per_session(events: DataFrame, limited: tuple[str, ...] = ("favorite", "view")) -> DataFrame:
    """The first favourite and the first view of a product in a session; other types all count."""
    w = Window.partitionBy("session_id", "product_id", "event_type").orderBy("line_no", "pos")
    some = F.col("event_type").isin(*limited)
    first = events.where(some).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return first.unionByName(events.where(~F.coalesce(some, F.lit(False))))


def newest(events: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The rolling log: the newest ``n`` rows by arrival."""
    return events.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def engagement(events: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``(product_id, event_count, weighted_score)``; products outside the catalogue count too."""
    return valid(events).groupBy("product_id").agg(F.count(F.lit(1)).alias("event_count"), F.sum(event_weight(F.col("event_type"), weights)).alias("weighted_score"))


def engagement_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count(F.lit(1)).alias("products"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("total_events"), F.coalesce(F.max("weighted_score"), F.lit(0.0)).alias("max_score")
    )


def blended_popularity(catalog: DataFrame, stats: DataFrame, alpha: float = 0.5) -> DataFrame:
    """``(id, ord, before, after)``: popularity raised by the share of the greatest engagement, at most to 1."""
    top = stats.agg(F.coalesce(F.max("weighted_score"), F.lit(0.0)))
    joined = catalog.select("id", "ord", F.col("popularity_score").alias("before")).join(stats.select(F.col("product_id").alias("id"), "weighted_score"), "id", "left")
    share = F.when(top.scalar() > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("weighted_score") / F.nullif(top.scalar(), F.lit(0.0))))).otherwise(0.0)
    after = F.when(F.col("weighted_score").isNull(), F.col("before")).otherwise(F.least(F.lit(1.0), F.col("before") + F.lit(float(alpha)) * share))
    return joined.select("id", "ord", "before", after.alias("after"))
