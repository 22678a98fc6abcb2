"""The event stream: validation, dedup, engagement and session profiles.

Affinities are sums under a cap, so a streaming aggregation in update mode gives the
batch result; the recent products need an order and keep state of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vitrine.config import EVENT_WEIGHTS, RECENT_CAP
from vitrine.operators.profiles import affinities, event_weight

EVENT_SCHEMA = "line_no long, pos int, session_id string, product_id string, event_type string, ts timestamp"
#: Idle time after which a session ends; a gap of exactly that long ends it too.
IDLE = "3599 seconds 999999 microseconds"


def read_events(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """JSON files of events as a stream, at most ``per_batch`` files at a time."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", per_batch).json(path)


def accepted(events: DataFrame) -> DataFrame:
    """Events of a known type with a product and a session id of at most 200 characters."""
    fine = F.col("event_type").isin(*EVENT_WEIGHTS) & F.col("product_id").isNotNull() & (F.length("session_id") <= 200)
    return events.where(fine)


def once_per_session(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Favourites and views once per session and product; clicks and carts all."""
    some = F.col("event_type").isin("favorite", "view")
    first = events.where(some).withWatermark("ts", within).dropDuplicatesWithinWatermark(["session_id", "product_id", "event_type"])
    return first.unionByName(events.where(~some).withWatermark("ts", within))


def engagement(events: DataFrame) -> DataFrame:
    """Running count and weight per product, for update or complete mode."""
    return events.groupBy("product_id").agg(F.count(F.lit(1)).alias("event_count"), F.sum(event_weight(F.col("event_type"))).alias("weighted_score"))


def session_affinities(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Running affinities ``(session, kind, key, value)``; the same fold as in batch."""
    return affinities(events, catalog)


def windowed_engagement(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Counts in sliding windows; events later than ``late`` don't count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "event_type", "n")


def visits(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Visits: runs of a session's events without a gap of an hour or more."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", IDLE), "session_id")
        .agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_seen"))
        .select("session_id", F.col("session_window.start").alias("start"), "last_seen", "events")
    )


def dwell_views(spans: DataFrame, least: float = 0.75, seconds: float = 2.0, late: str = "1 minute") -> DataFrame:
    """A view per session and product shown long enough: ``spans(session_id, product_id, ratio, ts, until)``.

    Spans with at least ``least`` of the card in sight that touch are one showing."""
    seen = spans.where(F.col("ratio") >= least).withWatermark("ts", late)
    gap = F.concat(F.ceil((F.unix_micros("until") - F.unix_micros("ts")) / 1000).cast("string"), F.lit(" milliseconds"))
    shown = seen.groupBy(F.session_window("ts", gap), "session_id", "product_id").agg(F.min("ts").alias("start"), F.max("until").alias("stop"))
    long = (F.unix_micros("stop") - F.unix_micros("start")) >= int(seconds * 1_000_000)
    return shown.where(long).select("session_id", "product_id", "start", F.lit("view").alias("event_type"))


def _recent(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the recent products with when they were last touched, the latest first."""
    if state.hasTimedOut:
        state.remove()
        return
    products, seen = state.get if state.exists else ([], [])
    last = dict(zip(products, seen))
    for pdf in batches:
        for product, line, pos in zip(pdf["product_id"], pdf["line_no"], pdf["pos"]):
            at = int(line) * 1_000_000 + int(pos)
            last[product] = max(at, last.get(product, -1))
    # Order by when an event was said to come, so replays and late batches end in the same list.
    top = sorted(last.items(), key=lambda x: -x[1])[:RECENT_CAP]
    state.update(([p for p, _ in top], [a for _, a in top]))
    yield pd.DataFrame({"session": [key[0]] * len(top), "product_id": [p for p, _ in top], "pos": list(range(1, len(top) + 1))})


def recently_viewed(events: DataFrame) -> DataFrame:
    """Running recent products ``(session, product_id, pos)``; each update is a session's whole list."""
    return events.groupBy("session_id").applyInPandasWithState(
        _recent, "session string, product_id string, pos int", "products array<string>, seen array<long>", "update", GroupStateTimeout.NoTimeout
    )


def republish_on(events: DataFrame, job, checkpoint: str):
    """Run ``job(batch, number)`` on what has arrived, then stop: the retrain step of the loop."""
    return events.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def uplink(events: DataFrame, send, checkpoint: str, size: int = 25):
    """Send what has arrived in lists of ``size`` rows, at least once: ``send(rows)`` that fails ends the run, and the
    next run on the same checkpoint sends the whole batch again.  Each task sends its own rows."""

    def deliver(batch: DataFrame, number: int) -> None:
        def run(rows: Iterator) -> None:
            while part := list(itertools.islice(rows, size)):
                send(part)

        batch.foreachPartition(run)

    return events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(stream: DataFrame, path: str, checkpoint: str, mode: str) -> DataFrame:
    """Run a stream on what has arrived and keep its result as a table: the whole of it in complete mode, else the batches one after another, numbered."""

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)
