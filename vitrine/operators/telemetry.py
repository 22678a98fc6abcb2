"""Small operators over logs and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.functions import scalars as S


def percentiles(rows: DataFrame, value: str, by: list[str], quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles, exactly: the least value with a share of ``q`` at or below it."""
    names = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * q)}") for q in quantiles]
    return rows.groupBy(*by).agg(*names)


def latest_report(rows: DataFrame, source: str, order: list[str]) -> DataFrame:
    """The last report of every source."""
    w = Window.partitionBy(source).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def batches(rows: DataFrame, by: str, order: list[str], size: int = 25, cap: int = 500) -> DataFrame:
    """``batch``: the newest ``cap`` rows of each key, ``size`` to a batch, the oldest first."""
    newest = Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order])
    kept = rows.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= cap).drop("rn")
    w = Window.partitionBy(by).orderBy(*order)
    return kept.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def running_total(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(value).over(w))


def version_verdicts(rows: DataFrame, key: str, version: str, order: list[str] | None = None) -> DataFrame:
    """How each published version stands to the one before: ``first``, ``newer``, ``same`` or ``rollback``.

    One came before another by ``order``; without it by the numbers of the versions, never by their texts."""
    rows = rows.withColumn("parts", S.release_parts(F.col(version)))
    w = Window.partitionBy(key).orderBy(*(order or ["parts", version]))
    before = F.lag("parts").over(w)
    verdict = F.when(before.isNull(), "first").when(F.col("parts") == before, "same").when(F.col("parts") > before, "newer").otherwise("rollback")
    return rows.withColumn("verdict", verdict).drop("parts")


def sequence_verdicts(rows: DataFrame, key: str, order: list[str], sequence: str, identity: str) -> DataFrame:
    """What a reader makes of each pointer as it arrives: ``first``, ``fresh``, ``same`` or ``stale``.

    The active pointer is the first of the greatest sequence so far; a lower one is
    stale, an equal one is the same only if its identity is, and never replaces it.
    Pointers without a sequence of at least 0 prove nothing: ``undecidable``."""
    known = F.coalesce(F.col(sequence) >= 0, F.lit(False))
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("__at", F.row_number().over(w))
    mine = F.when(known, F.struct(F.col(sequence).alias("s"), (-F.col("__at")).alias("first"), F.col(identity).alias("i")))
    active = F.max(mine).over(Window.partitionBy(key).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__active", active)
    verdict = (
        F.when(~known, "undecidable").when(F.col("__active").isNull(), "first").when(F.col(sequence) > F.col("__active.s"), "fresh")
        .when((F.col(sequence) == F.col("__active.s")) & F.col(identity).eqNullSafe(F.col("__active.i")), "same").otherwise("stale")
    )
    return rows.withColumn("verdict", verdict).drop("__at", "__active")


def backend_calls(rows: DataFrame, url: str, start: str, ready_at: float, edge: str, uplink: str | None = None) -> DataFrame:
    """One row ``calls``: requests that started when the page was ready or later and went to the edge or elsewhere; pictures and the uplink don't count."""
    kind = S.classify_resource(F.col(url), edge, uplink)
    return rows.where(F.col(start) >= ready_at).agg(F.count_if(kind.isin("edge", "other")).alias("calls"))


def oversized(rows: DataFrame, batch: str, session: str, most: int = 1_000, characters: int = 200) -> DataFrame:
    """``(batch, reason)`` of batches that a collector refuses: too many events, or too long a session id."""
    sizes = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.max(F.length(session)).alias("c"))
    reason = F.when(F.col("n") > most, "too many events").when(F.col("c") > characters, "session id too long")
    return sizes.select(batch, reason.alias("reason")).where("reason is not null")


def session_expiry(rows: DataFrame, by: str, ts: str, ttl_seconds: int = 3600) -> DataFrame:
    """``visit``: the number of the visit a row lies in; a gap of the limit or more starts a new one."""
    w = Window.partitionBy(by).orderBy(ts)
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w))
    start = F.when(gap.isNull() | (gap >= ttl_seconds * 1_000_000), 1).otherwise(0)
    return rows.withColumn("start", start).withColumn("visit", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("start")


def live_sessions(rows: DataFrame, by: str, ts: str, capacity: int = 10_000) -> DataFrame:
    """The sessions seen last, at most ``capacity``: what a store of that size would hold."""
    last = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.max(ts).alias("last_seen"))
    return last.orderBy(F.col("last_seen").desc(), by).limit(capacity)


def missing(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """What is wanted and not there, each once."""
    return wanted.select(key).distinct().join(stored.select(key), key, "left_anti")


def stale(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return existing.select(key).distinct().join(wanted.select(key), key, "left_anti")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has; no rows if the sets are equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def sync_stats(wanted: DataFrame, stored: DataFrame, key: str = "hash", size: str = "bytes") -> DataFrame:
    """One row: chunks to fetch, chunks there already, bytes to fetch."""
    w = wanted.groupBy(key).agg(F.max(size).alias("size")).join(stored.select(key).distinct().withColumn("have", F.lit(True)), key, "left")
    return w.agg(
        F.count_if(F.col("have").isNull()).alias("fetched"), F.count_if(F.col("have").isNotNull()).alias("reused"),
        F.coalesce(F.sum(F.when(F.col("have").isNull(), F.col("size"))), F.lit(0)).alias("bytes"),
    )
