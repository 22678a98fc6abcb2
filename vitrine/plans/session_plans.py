"""Session logs, profiles, engagement, neighbours, retrain and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import catalog as C
from vitrine.operators import evaluation as V
from vitrine.operators import profiles as P
from vitrine.operators import telemetry as T
from vitrine.operators import together as G
from vitrine.operators.topk import top_stored
from vitrine.plans.base import catalog, events, query
from vitrine.runtime import table


@query("session_events", "SELECT line_no, session_id, CAST(pos AS INTEGER) AS pos, product_id, event_type FROM raw_ev")
def session_events(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d)


@query("rejected_events", "SELECT line_no, CAST(pos AS INTEGER) AS pos, CASE WHEN product_id IS NULL THEN 'no product' ELSE 'unknown event type' END AS reason FROM raw_ev WHERE product_id IS NULL OR NOT coalesce(event_type IN ('click', 'view', 'favorite', 'cart'), false)")
def rejected_events(spark: SparkSession, d: str) -> DataFrame:
    return P.rejected(events(spark, d)).select("line_no", "pos", "reason")


@query("unknown_products", "SELECT DISTINCT product_id FROM ev WHERE product_id NOT IN (SELECT id FROM cat)")
def unknown_products(spark: SparkSession, d: str) -> DataFrame:
    return P.valid(events(spark, d)).select("product_id").distinct().join(catalog(spark, d).select(F.col("id").alias("product_id")), "product_id", "left_anti")


@query("session_profile", "SELECT session, kind, key, round(value, 6) AS value FROM aff")
def session_profile(spark: SparkSession, d: str) -> DataFrame:
    return P.affinities(events(spark, d), catalog(spark, d)).withColumn("value", F.round("value", 6))


@query("recently_viewed", "SELECT session, product_id, CAST(pos AS INTEGER) AS pos FROM recent")
def recently_viewed(spark: SparkSession, d: str) -> DataFrame:
    return P.recently_viewed(events(spark, d), catalog(spark, d))


@query("session_clicks", "SELECT session_id AS session, count(*) FILTER (event_type = 'click') AS click_count FROM kev GROUP BY 1")
def session_clicks(spark: SparkSession, d: str) -> DataFrame:
    return P.clicks(events(spark, d), catalog(spark, d))


@query("explicit_signals", "SELECT count(*) AS n FROM kev WHERE event_type <> 'view'")
def explicit_signals(spark: SparkSession, d: str) -> DataFrame:
    known = P.valid(events(spark, d)).where("session_id IS NOT NULL").join(catalog(spark, d).select(F.col("id").alias("product_id")), "product_id", "left_semi")
    return known.agg(F.count_if(F.col("event_type") != "view").alias("n"))


@query("engagement", "SELECT product_id, event_count, round(weighted_score, 6) AS weighted_score FROM stat")
def engagement(spark: SparkSession, d: str) -> DataFrame:
    return P.engagement(events(spark, d)).withColumn("weighted_score", F.round("weighted_score", 6))


@query("engagement_totals", "SELECT count(*) AS products, CAST(coalesce(sum(event_count), 0) AS BIGINT) AS total_events, round(coalesce(max(weighted_score), 0), 6) AS max_score FROM stat")
def engagement_totals(spark: SparkSession, d: str) -> DataFrame:
    return P.engagement_totals(P.engagement(events(spark, d))).withColumn("max_score", F.round("max_score", 6))


@query("blend_popularity", "SELECT id, round(before, 6) AS before, round(after, 6) AS after FROM blend")
def blend_popularity(spark: SparkSession, d: str) -> DataFrame:
    b = P.blended_popularity(catalog(spark, d), P.engagement(events(spark, d)))
    return b.select("id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query("retrain_deltas", "SELECT id AS product_id, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta FROM blend WHERE before <> after")
def retrain_deltas(spark: SparkSession, d: str) -> DataFrame:
    return V.movers(P.blended_popularity(catalog(spark, d), P.engagement(events(spark, d))), None)


@query("popularity_movers", "SELECT id AS product_id, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta FROM blend WHERE before <> after ORDER BY abs(round(after - before, 6)) DESC, id LIMIT 10")
def popularity_movers(spark: SparkSession, d: str) -> DataFrame:
    return V.movers(P.blended_popularity(catalog(spark, d), P.engagement(events(spark, d))))


@query("events_by_type", "SELECT event_type, count(*) AS n FROM ev GROUP BY 1")
def events_by_type(spark: SparkSession, d: str) -> DataFrame:
    return V.events_by_type(events(spark, d))


@query("line_engagement", "SELECT line, product_id, round(w, 6) AS w FROM eng")
def line_engagement(spark: SparkSession, d: str) -> DataFrame:
    return G.line_engagement(events(spark, d)).withColumn("w", F.round("w", 6))


@query("cooc_norms", "SELECT product_id, round(norm, 6) AS norm FROM nrm")
def cooc_norms(spark: SparkSession, d: str) -> DataFrame:
    return G.norms(G.line_engagement(events(spark, d))).withColumn("norm", F.round("norm", 6))


@query("cooc_pairs", "SELECT x.product_id AS a, y.product_id AS b, round(sum(x.w * y.w), 6) AS dot FROM eng x JOIN eng y ON x.line = y.line AND x.product_id < y.product_id GROUP BY ALL")
def cooc_pairs(spark: SparkSession, d: str) -> DataFrame:
    return G.dots(G.line_engagement(events(spark, d))).withColumn("dot", F.round("dot", 6))


@query("cooccurrence", "SELECT id, neighbor_id, score, CAST(rank AS INTEGER) AS rank FROM cooc")
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return G.cooccurrence(events(spark, d))


@query("cooc_matrix", "SELECT id, list(neighbor_id ORDER BY rank) AS neighbor_ids, list(score ORDER BY rank) AS scores FROM cooc GROUP BY id")
def cooc_matrix(spark: SparkSession, d: str) -> DataFrame:
    return G.as_matrix(G.cooccurrence(events(spark, d)))


_STORED = """WITH ok AS (SELECT * FROM cooc_neighbors WHERE score IS NOT NULL AND isfinite(score) AND id <> neighbor_id
    QUALIFY row_number() OVER (PARTITION BY id, neighbor_id ORDER BY computed_at DESC NULLS LAST, score DESC) = 1),
    stored AS (SELECT id, neighbor_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbor_id) AS rank FROM ok QUALIFY rank <= 10)"""


@query("cooc_topk", f"{_STORED} SELECT id, neighbor_id, score, CAST(rank AS INTEGER) AS rank FROM stored WHERE rank <= 3")
def cooc_topk(spark: SparkSession, d: str) -> DataFrame:
    """The first three of the stored neighbours of every product."""
    return top_stored(table(spark, d, "cooc_neighbors")).where("rank <= 3")


@query("changed_edges", f"{_STORED} SELECT c.id, c.neighbor_id, c.score, s.score AS old FROM cooc c LEFT JOIN stored s ON s.id = c.id AND s.neighbor_id = c.neighbor_id WHERE c.score IS DISTINCT FROM s.score")
def changed_edges(spark: SparkSession, d: str) -> DataFrame:
    changed = G.changed_edges(top_stored(table(spark, d, "cooc_neighbors")), G.cooccurrence(events(spark, d)))
    return changed.select("id", "neighbor_id", "score", "old")


@query(
    "audit",
    f"""{_STORED} SELECT (SELECT count(*) FROM ev) AS total_events, (SELECT count(DISTINCT line_no) FROM raw_ev) AS session_count,
    (SELECT count(*) FROM blend WHERE before <> after) AS moved_products,
    (SELECT count(*) FROM cooc c LEFT JOIN stored s ON s.id = c.id AND s.neighbor_id = c.neighbor_id WHERE c.score IS DISTINCT FROM s.score) AS changed_edges,
    'v3' AS current_version, 'v4' AS new_version""",
)
def audit(spark: SparkSession, d: str) -> DataFrame:
    version = table(spark, d, "catalog_manifest").agg(F.max("version")).first()[0]
    return V.audit(events(spark, d), catalog(spark, d), top_stored(table(spark, d, "cooc_neighbors")), version)


@query("once_per_session", "SELECT line_no, CAST(pos AS INTEGER) AS pos FROM raw_ev WHERE NOT coalesce(event_type IN ('favorite', 'view'), false) UNION ALL SELECT line_no, CAST(pos AS INTEGER) FROM (SELECT * FROM raw_ev WHERE event_type IN ('favorite', 'view') QUALIFY row_number() OVER (PARTITION BY session_id, product_id, event_type ORDER BY line_no, pos) = 1)")
def once_per_session(spark: SparkSession, d: str) -> DataFrame:
    return P.once_per_session(events(spark, d)).select("line_no", "pos")


@query("rolling_log", "SELECT line_no, CAST(pos AS INTEGER) AS pos, product_id FROM raw_ev ORDER BY line_no DESC, pos DESC LIMIT 500")
def rolling_log(spark: SparkSession, d: str) -> DataFrame:
    """The newest 500 events: what a device keeps of its log."""
    return P.newest(events(spark, d), 500, ["line_no", "pos"]).select("line_no", "pos", "product_id")


@query("ring_buffer", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000")
def ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    """The newest 10,000 events: what the collector keeps."""
    return P.newest(table(spark, d, "events"), 10_000, ["ts", "event_id"]).select("event_id", "event_type")


@query("latest_report", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_report(spark: SparkSession, d: str) -> DataFrame:
    return T.latest_report(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("running_total", "SELECT event_id, user_id, sum(1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::bigint AS running FROM events")
def running_total(spark: SparkSession, d: str) -> DataFrame:
    return T.running_total(table(spark, d, "events").withColumn("one", F.lit(1)), "user_id", ["ts", "event_id"], "one").select("event_id", "user_id", "running")


@query(
    "uplink_batches",
    """SELECT event_id, user_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 25) AS INTEGER) AS batch
    FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 500)""",
)
def uplink_batches(spark: SparkSession, d: str) -> DataFrame:
    return T.batches(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "batch")


@query("percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return T.percentiles(table(spark, d, "events"), "value", ["event_type"])


@query(
    "session_expiry",
    """SELECT event_id, user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::bigint AS visit FROM
    (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 3600000000 THEN 1 ELSE 0 END AS s FROM events)""",
)
def session_expiry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return T.session_expiry(rows, "user_id", "ts").select("event_id", "user_id", "visit")


@query("live_sessions", "SELECT user_id FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 10000")
def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    return T.live_sessions(table(spark, d, "events"), "user_id", "ts").select("user_id")


@query("version_verdicts", "SELECT version, CASE WHEN lag(version) OVER (ORDER BY version) IS NULL THEN 'first' ELSE 'newer' END AS verdict FROM catalog_manifest")
def version_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return T.version_verdicts(table(spark, d, "catalog_manifest"), "catalog_id", "version").select("version", "verdict")


_FILES = "files AS (SELECT version, f.path AS path, f.checksum AS hash, length(f.path) AS bytes FROM (SELECT version, unnest(files) AS f FROM catalog_manifest))"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalog_manifest").select("version", F.explode("files").alias("f")).select("version", "f.path", F.col("f.checksum").alias("hash"), F.length("f.path").alias("bytes"))


@query("missing_chunks", f"WITH {_FILES} SELECT DISTINCT hash FROM files WHERE version = 'v3' AND hash NOT IN (SELECT hash FROM files WHERE version < 'v3')")
def missing_chunks(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return T.missing(f.where("version = 'v3'"), f.where("version < 'v3'"), "hash")


@query("stale_files", f"WITH {_FILES} SELECT DISTINCT path FROM files WHERE version < 'v3' AND path NOT IN (SELECT path FROM files WHERE version = 'v3')")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return T.stale(f.where("version < 'v3'"), f.where("version = 'v3'"), "path")


@query("sync_stats", f"WITH {_FILES} SELECT count(*) FILTER (NOT have) AS fetched, count(*) FILTER (have) AS reused, CAST(coalesce(sum(bytes) FILTER (NOT have), 0) AS BIGINT) AS bytes FROM (SELECT hash, max(bytes) AS bytes, hash IN (SELECT hash FROM files WHERE version < 'v3') AS have FROM files WHERE version = 'v3' GROUP BY hash)")
def sync_stats(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return T.sync_stats(f.where("version = 'v3'"), f.where("version < 'v3'"))


@query(
    "key_difference",
    """SELECT id, 'left' AS side FROM (SELECT id FROM cat EXCEPT SELECT product_id FROM ev) UNION ALL SELECT product_id, 'right' FROM (SELECT product_id FROM ev EXCEPT SELECT id FROM cat)""",
)
def key_difference(spark: SparkSession, d: str) -> DataFrame:
    """Products never touched, and touched ones that aren't in the catalogue."""
    return T.key_difference(catalog(spark, d), P.valid(events(spark, d)).select(F.col("product_id").alias("id")), "id")


_HALF = """h AS (SELECT max(line_no) / 2 AS half FROM demo_sessions), old_eng AS (SELECT line_no AS line, product_id, sum(w) AS w FROM ev, h WHERE line_no <= half GROUP BY ALL),
    old_nrm AS (SELECT product_id, sqrt(sum(w * w)) AS norm FROM old_eng GROUP BY product_id HAVING sqrt(sum(w * w)) <> 0),
    old_all AS (SELECT x.product_id AS id, y.product_id AS neighbor_id, round(sum(x.w * y.w) / (any_value(nx.norm) * any_value(ny.norm)), 6) AS score
        FROM old_eng x JOIN old_eng y ON x.line = y.line AND x.product_id <> y.product_id JOIN old_nrm nx ON nx.product_id = x.product_id JOIN old_nrm ny ON ny.product_id = y.product_id GROUP BY x.product_id, y.product_id),
    old_cooc AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbor_id) AS rank FROM old_all QUALIFY rank <= 10)"""


@query("retrained_edges", f"WITH {_HALF} SELECT c.id, c.neighbor_id, c.score, s.score AS old FROM cooc c LEFT JOIN old_cooc s ON s.id = c.id AND s.neighbor_id = c.neighbor_id WHERE c.score IS DISTINCT FROM s.score")
def retrained_edges(spark: SparkSession, d: str) -> DataFrame:
    """What a retrain on the whole log changes against one on its first half: new, rescored and unchanged edges all occur."""
    log = events(spark, d)
    half = table(spark, d, "demo_sessions").agg(F.max("line_no") / 2).scalar()
    return G.changed_edges(G.cooccurrence(log.where(F.col("line_no") <= half)), G.cooccurrence(log)).select("id", "neighbor_id", "score", "old")


@query("collector_buffer", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 700")
def collector_buffer(spark: SparkSession, d: str) -> DataFrame:
    """A buffer smaller than the log: the newest 700 events."""
    return P.newest(table(spark, d, "events"), 700, ["ts", "event_id"]).select("event_id", "event_type")


@query("session_store", "SELECT user_id FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 40")
def session_store(spark: SparkSession, d: str) -> DataFrame:
    """A store smaller than the number of sessions: the 40 seen last."""
    return T.live_sessions(table(spark, d, "events"), "user_id", "ts", 40).select("user_id")


@query(
    "uplink_queue",
    """SELECT event_id, user_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 2) AS INTEGER) AS batch
    FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5)""",
)
def uplink_queue(spark: SparkSession, d: str) -> DataFrame:
    """A queue of five per user, in batches of two: the oldest are dropped."""
    return T.batches(table(spark, d, "events"), "user_id", ["ts", "event_id"], 2, 5).select("event_id", "user_id", "batch")


@query("oversized_batches", "SELECT line_no, CASE WHEN len(events) > 8 THEN 'too many events' ELSE 'session id too long' END AS reason FROM demo_sessions WHERE len(events) > 8 OR (len(events) > 0 AND length(session_id) > 12)")
def oversized_batches(spark: SparkSession, d: str) -> DataFrame:
    """Lines a collector with limits of 8 events and 12 characters refuses."""
    return T.oversized(events(spark, d), "line_no", "session_id", 8, 12)


@query(
    "release_verdicts",
    """SELECT line_no, CASE WHEN before IS NULL THEN 'first' WHEN mine = before THEN 'same' WHEN mine > before THEN 'newer' ELSE 'rollback' END AS verdict FROM
    (SELECT *, lag(mine) OVER (PARTITION BY line_no % 50 ORDER BY line_no) AS before FROM (SELECT line_no, (line_no // 50) * 7 % 12 // 2 AS mine FROM (SELECT DISTINCT line_no FROM demo_sessions)))""",
)
def release_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Versions v1.0 to v1.11 and back, published one after another in 50 catalogues: texts would order v1.10 before v1.9."""
    number = F.floor((F.floor(F.col("line_no") / 50) * 7) % 12 / 2) * 2
    rows = table(spark, d, "demo_sessions").select("line_no").distinct().withColumns({"catalog": F.col("line_no") % 50, "version": F.concat(F.lit("v1."), number.cast("bigint").cast("string"))})
    return T.version_verdicts(rows, "catalog", "version", ["line_no"]).select("line_no", "verdict")


@query(
    "sequence_verdicts",
    """WITH p AS (SELECT line_no, line_no % 50 AS c, (line_no // 50) * 7 % 12 - 1 AS s, line_no % 3 AS i FROM (SELECT DISTINCT line_no FROM demo_sessions)),
    q AS (SELECT *, (SELECT max(s) FROM p o WHERE o.c = p.c AND o.line_no < p.line_no AND o.s >= 0) AS top FROM p),
    r AS (SELECT *, (SELECT arg_min(i, o.line_no) FROM p o WHERE o.c = q.c AND o.line_no < q.line_no AND o.s = q.top) AS active FROM q)
    SELECT line_no, CASE WHEN s < 0 THEN 'undecidable' WHEN top IS NULL THEN 'first' WHEN s > top THEN 'fresh' WHEN s = top AND i = active THEN 'same' ELSE 'stale' END AS verdict FROM r""",
)
def sequence_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Pointers of 50 catalogues as they arrive, some out of order, sent again or without a sequence."""
    rows = table(spark, d, "demo_sessions").select("line_no").distinct()
    rows = rows.withColumns({"c": F.col("line_no") % 50, "s": F.expr("(line_no div 50) * 7 % 12 - 1"), "i": F.col("line_no") % 3})
    return T.sequence_verdicts(rows, "c", ["line_no"], "s", "i").select("line_no", "verdict")


@query("backend_calls", "SELECT count(*) FILTER (NOT regexp_matches(lower(url), '\\.(png|jpg|jpeg|webp|gif|svg|avif)$')) AS calls FROM (SELECT ord, url FROM cat UNION ALL SELECT ord, image_url FROM cat) WHERE ord >= 100")
def backend_calls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the catalogue as requests, its order as their start: those from 100 on that aren't pictures."""
    cat = catalog(spark, d)
    rows = cat.select("ord", "url").unionByName(cat.select("ord", F.col("image_url").alias("url")))
    return T.backend_calls(rows, "url", "ord", 100, "https://edge.example")


@query("staged_images", "SELECT cat.id, '/images/' || cat.id || '.' || coalesce(ext, 'svg') AS image_url FROM cat LEFT JOIN (SELECT id, min(CASE WHEN version = 'v3' THEN 'webp' ELSE 'jpg' END) AS ext FROM product_vectors WHERE id IS NOT NULL AND version IS NOT NULL GROUP BY id) s ON s.id = cat.id")
def staged_images(spark: SparkSession, d: str) -> DataFrame:
    """Products with a vector as those with a staged photo; the others get their drawn card."""
    ext = F.when(F.col("version") == "v3", "webp").when(F.col("version").isNotNull(), "jpg")
    return C.with_local_images(catalog(spark, d), table(spark, d, "product_vectors").select("id", ext.alias("ext"))).select("id", "image_url")
