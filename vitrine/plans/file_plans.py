"""Files, snapshots and streams: each query writes its input from a test table into the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.config import DEFAULT_WEIGHTS, RankingConfig
from vitrine.functions import scalars as S
from vitrine.operators import imports as I
from vitrine.operators import profiles as P
from vitrine.operators import retrieval as R
from vitrine.operators import together as G
from vitrine.plans.base import catalog, events, query
from vitrine.runtime import shared_folder, table
from vitrine.sources import files, snapshot
from vitrine.streaming import sessions as W


@query("files_products", "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, id, title, description, brand, price, len(tags) AS n_tags FROM cat")
def files_products(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue as JSON lines, and as read from them."""
    path = shared_folder(spark, "products")
    files.write_products(catalog(spark, d), path)
    good, _ = files.checked_products(files.read_products(spark, path))
    return good.select("ord", "id", "title", "description", "brand", "price", F.size("tags").cast("long").alias("n_tags"))


@query("files_csv", "SELECT ord, id, nullif(title, '') AS title, nullif(description, '') AS description, price FROM cat")
def files_csv(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "csv")
    files.write_csv(catalog(spark, d).select("ord", "id", "title", "description", "price"), path)
    return files.read_csv(spark, path, "ord long, id string, title string, description string, price double")




@query(
    "build_catalog",
    """WITH sc AS (SELECT *, (1 + ord % 5) * ln(1 + ord % 7) AS raw FROM cat), b AS (SELECT min(raw) AS lo, max(raw) AS hi FROM sc)
    SELECT id, title, trim(description, ' ') AS description, brand, round(price, 2) AS price, coalesce(list_filter(list_transform(string_split(category, '›'), lambda x: trim(x)), lambda x: x <> '')[1], 'Uncategorized') AS category,
    'pic/' || id || '.jpg' AS image_url, round(CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 0 END, 6) AS popularity_score FROM sc, b""",
)
def build_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A scraped export of the catalogue, all texts, read with the lenient reader and built again."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = catalog(spark, d).select(
        F.col("id").alias("asin"), text("title").alias("title"), F.lit("").alias("about_item"), F.trim(text("description")).alias("product_description"), text("price").alias("price_value"),
        F.lit("").alias("list_price"), F.trim(text("category")).alias("breadcrumbs"), F.when(F.col("ord") % 2 == 0, text("brand")).otherwise("").alias("brand_name"), text("brand").alias("manufacturer"),
        F.concat((1 + F.col("ord") % 5).cast("string"), F.lit(".0 out of 5 stars")).alias("rating_stars"), F.concat((F.col("ord") % 7).cast("string"), F.lit(" ratings")).alias("rating_count"),
        F.lit("300").alias("recent_purchases"), F.concat(F.lit("['pic/"), "id", F.lit(".jpg', 'x']")).alias("all_images"), text("url").alias("product_url"),
    )
    path = shared_folder(spark, "scrape")
    files.write_csv(rows, path)
    spark.dataSource.register(files.LenientCsv)
    schema = ", ".join(f"{c} string" for c in rows.columns) + ", ord long"
    raw = spark.read.format("lenient_csv").schema(schema).load(path)
    done = I.from_scrape(raw)
    return done.select("id", "title", "description", "brand", "price", "category", "image_url", F.round("popularity_score", 6).alias("popularity_score"))


_MARKET = "SELECT id, title, price FROM cat WHERE trim(split_part(category || ' > Sub', '>', 1)) IN ('Footwear', 'Cycling') ORDER BY ord LIMIT 25"


@query("preprocess_csv", _MARKET)
def preprocess_csv(spark: SparkSession, d: str) -> DataFrame:
    """A marketplace export as CSV, read, filtered by top category and cut to its first rows."""
    rows = catalog(spark, d).select(
        "ord", F.col("id").alias("asin"), "title", F.lit(4.0).alias("stars"), F.lit(3.0).alias("reviews"), "price", F.lit(None).cast("double").alias("listPrice"),
        F.concat("category", F.lit(" > Sub")).alias("category_id"), F.lit(False).alias("isBestSeller"), F.lit(1.0).alias("boughtInLastMonth"), F.lit("i").alias("imgUrl"), F.lit("u").alias("productURL"),
    )
    path = shared_folder(spark, "market")
    files.write_csv(rows, path)
    return I.from_marketplace(files.read_csv(spark, path, "ord long, " + I.MARKET_SCHEMA), ["Footwear", "Cycling"], 25).select("id", "title", "price")


_GOOD_LINES = "len(list_filter(events, lambda e: e.product_id IS NULL OR e.event_type IS NULL)) = 0"


@query("files_session_log", f"SELECT row_number() OVER (ORDER BY line_no) AS line_no, session_id, len(events) AS n FROM demo_sessions WHERE events IS NOT NULL AND {_GOOD_LINES}")
def files_session_log(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "demo_sessions").where("events IS NOT NULL AND NOT exists(events, e -> e.product_id IS NULL OR e.event_type IS NULL)")
    path = shared_folder(spark, "sessions")
    good.orderBy("line_no").select(F.to_json(F.struct("session_id", "events")).alias("value")).write.text(path)
    return files.read_session_log(spark, path).select("line_no", "session_id", F.size("events").cast("long").alias("n"))


@query("files_vectors", "SELECT vec_id AS ord, CAST(vec_id AS VARCHAR) AS id, embedding FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, embedding FROM embeddings)")
def files_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = files.numbered(table(spark, d, "embeddings").select("vec_id", "embedding"), "place")
    order = rows.select(F.col("vec_id").alias("v"), "embedding")
    ranked = order.select((F.row_number().over(R.Window.orderBy("v")) - 1).cast("long").alias("ord"), "embedding").withColumn("id", F.col("ord").cast("string"))
    path = shared_folder(spark, "vectors")
    system, inner = files.file_system(path)
    system.create_dir(inner, recursive=True)
    files.write_vectors(ranked, f"{path}/embeddings.f32", f"{path}/state.json")
    return files.read_vectors(spark, f"{path}/embeddings.f32", f"{path}/state.json", 64)


@query("files_cooccurrence", "SELECT id, neighbor_id, score, CAST(rank AS INTEGER) AS rank FROM cooc")
def files_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "cooccurrence")
    files.write_cooccurrence(G.cooccurrence(events(spark, d)), path)
    return files.read_cooccurrence(spark, path, lines=True)


@query("files_engagement", "SELECT product_id, event_count, round(weighted_score, 6) AS weighted_score FROM stat")
def files_engagement(spark: SparkSession, d: str) -> DataFrame:
    """The export of a collector, pulled: one document a part, as a collector pages it."""
    stats = P.engagement(events(spark, d))
    path = shared_folder(spark, "engagement")
    # A page holds the products of one hash, a bounded number of them.
    page = F.floor((F.row_number().over(R.Window.partitionBy("shard").orderBy("product_id")) - 1) / 500)
    paged = stats.withColumn("shard", F.pmod(F.xxhash64("product_id"), F.lit(64))).withColumn("page", page)
    paged.groupBy("shard", "page").agg(F.collect_list(F.struct("product_id", "event_count", "weighted_score")).alias("stats")).select("stats").write.json(path)
    got = spark.read.schema("stats array<struct<product_id:string,event_count:bigint,weighted_score:double>>").json(path)
    documents = shared_folder(spark, "engagement-documents")
    got.write.option("maxRecordsPerFile", 1).json(documents)
    return files.read_engagement(spark, documents).withColumn("weighted_score", F.round("weighted_score", 6))


@query("files_taste_log", "SELECT line_no * 1000 + pos AS ts, event_type AS type, product_id AS productId FROM ev ORDER BY 1 DESC LIMIT 500")
def files_taste_log(spark: SparkSession, d: str) -> DataFrame:
    """A device's log, appended to in two steps; the newest 500 entries that parse."""
    rows = P.valid(events(spark, d)).select((F.col("line_no") * 1000 + F.col("pos")).alias("ts"), F.col("event_type").alias("type"), F.col("product_id").alias("productId"), F.col("session_id").alias("sessionId"))
    path = shared_folder(spark, "taste")
    early = F.col("ts") < 500_000
    files.append_taste(rows.where(early), path)
    files.append_taste(rows.where(~early), path)
    return files.read_taste_log(spark, path).select("ts", "type", "productId")


@query(
    "files_relevance",
    "SELECT q, CAST(count(*) FILTER (hit) AS BIGINT) AS hits, count(*) AS shown FROM (SELECT name AS q, unnest(list_concat([name], aliases)) AS doc, true AS hit FROM ref_values WHERE field = 'category' AND aliases IS NOT NULL) GROUP BY q",
)
def files_relevance(spark: SparkSession, d: str) -> DataFrame:
    """A nested export of judgments and pages: names as queries, their aliases as results."""
    nodes = F.concat(F.array("name"), F.col("aliases"))
    rows = table(spark, d, "ref_values").where("field = 'category' AND aliases IS NOT NULL")
    one = rows.select(F.struct(F.col("name").alias("query"), nodes.alias("relevant_ids"), nodes.alias("ranked_ids"), F.lit("natural").alias("segment")).alias("x"))
    path = shared_folder(spark, "relevance")
    one.agg(F.collect_list("x").alias("queries")).select(F.lit("c").alias("catalog_id"), F.lit("rule").alias("label_method"), F.lit(24).alias("k"), "queries").write.json(path)  # as many as there are categories
    _, ranked, relevant = files.read_relevance_export(spark, path)
    hit = relevant.distinct().withColumn("hit", F.lit(True))
    return ranked.join(hit, ["q", "doc"], "left").groupBy("q").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("shown"))


@query("files_json", "SELECT '{\"ord\":' || ord || ',\"id\":\"' || id || '\"}' AS value FROM cat")
def files_json(spark: SparkSession, d: str) -> DataFrame:
    return files.as_json(catalog(spark, d).select("ord", "id"))


@query("snapshot_sync", "SELECT id, title, pop AS popularity_score FROM cat")
def snapshot_sync(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue published twice under growing sequences, synchronised after each, and opened."""
    root, local = shared_folder(spark, "root"), shared_folder(spark, "local")
    cat = catalog(spark, d)
    snapshot.publish({"products": cat.limit(0)}, root, "v1", 1)
    snapshot.sync(root, local)
    snapshot.publish({"products": cat}, root, "v2", 2)
    snapshot.sync(root, local)
    return snapshot.load(spark, local, "products").select("id", "title", "popularity_score")


_W = {k: v for k, v in vars(DEFAULT_WEIGHTS).items()}


@query("ranking_config", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::double)" for k, v in _W.items()) + ") t(name, weight)")
def ranking_config(spark: SparkSession, d: str) -> DataFrame:
    """The weights of a published snapshot."""
    root, local = shared_folder(spark, "root"), shared_folder(spark, "local")
    snapshot.publish({}, root, "v1", 1, config=RankingConfig())
    snapshot.sync(root, local)
    return spark.createDataFrame([(k, float(v)) for k, v in vars(snapshot.load_config(local).weights).items()], "name string, weight double")


@query("receipt", f"SELECT sha256('{S.canonical_json(_W).decode()}') AS metric_version")
def receipt(spark: SparkSession, d: str) -> DataFrame:
    """The hash that a ranking can be checked by, of the canonical form of its weights."""
    return spark.createDataFrame([(I.receipt(RankingConfig())["metric_version"],)], "metric_version string")


@query("content_hashes", "SELECT id, sha256('{\"id\":\"' || id || '\",\"ord\":' || ord || '}') AS hash FROM cat")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Canonical JSON of every row, its keys in order, and its hash."""
    return catalog(spark, d).select("id", S.content_hash(F.to_json(F.struct("id", "ord"))).alias("hash"))


@query("resized_urls", "SELECT id, CASE WHEN ord % 2 = 0 THEN 'https://img.example/' || id || '._SL640_.jpg' ELSE 'https://img.example/' || id || '.jpg' END AS url FROM cat")
def resized_urls(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("https://img.example/"), "id", F.lit("._AC_SX300_CR0_.jpg"))).otherwise(F.concat(F.lit("https://img.example/"), "id", F.lit(".jpg")))
    return catalog(spark, d).select("id", S.resized_url(given, 640).alias("url"))


@query("first_images", "SELECT id, CASE ord % 3 WHEN 0 THEN 'a/' || id WHEN 1 THEN '' ELSE '' END AS image FROM cat")
def first_images(spark: SparkSession, d: str) -> DataFrame:
    """First entries of lists written as Python literals: whole ones, empty ones and broken ones."""
    rest = F.col("ord") % 3
    raw = F.when(rest == 0, F.concat(F.lit("['a/"), "id", F.lit("', \"b\"]"))).when(rest == 1, F.lit("[]")).otherwise(F.concat(F.lit("['a/"), "id"))
    return catalog(spark, d).select("id", S.first_image(raw).alias("image"))


@query("index", "SELECT id, 64 AS dim, 1.0::double AS norm FROM cat")
def index(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue's texts encoded, written and read as a vector index: whole, and of length one."""
    path = shared_folder(spark, "index")
    R.encoded(catalog(spark, d)).write.parquet(path)
    return spark.read.parquet(path).select("id", F.size("embedding").alias("dim"), F.round(S.norm(F.col("embedding")), 4).alias("norm"))


# ---------------------------------------------------------------- streams
def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The session log as a stream of JSON files."""
    path = shared_folder(spark, "stream")
    events(spark, d).withColumn("ts", F.timestamp_seconds(F.lit(1_900_000_000) + F.col("line_no"))).repartition(3, "session_id").write.json(path)
    return W.read_events(spark, path, 2)


@query("stream_engagement", "SELECT product_id, event_count, round(weighted_score, 6) AS weighted_score FROM (SELECT product_id, count(*) AS event_count, sum(w) AS weighted_score FROM ev WHERE length(session_id) <= 200 GROUP BY product_id)")
def stream_engagement(spark: SparkSession, d: str) -> DataFrame:
    got = W.written(W.engagement(W.accepted(_stream(spark, d))), shared_folder(spark, "out"), shared_folder(spark, "state"), "complete")
    return got.select("product_id", "event_count", F.round("weighted_score", 6).alias("weighted_score"))


@query("stream_profiles", "SELECT session, kind, key, round(value, 6) AS value FROM aff")
def stream_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Affinities folded from the stream; the same as in batch."""
    got = W.written(W.session_affinities(W.accepted(_stream(spark, d)), catalog(spark, d)), shared_folder(spark, "out"), shared_folder(spark, "state"), "complete")
    return got.select("session", "kind", "key", F.round("value", 6).alias("value"))


@query("stream_recent", "SELECT session, product_id, CAST(pos AS INTEGER) AS pos FROM recent")
def stream_recent(spark: SparkSession, d: str) -> DataFrame:
    """Recent products folded from the stream: of every session the list of its last batch."""
    known = W.accepted(_stream(spark, d)).where("session_id IS NOT NULL").join(catalog(spark, d).select(F.col("id").alias("product_id")), "product_id", "left_semi")
    got = W.written(W.recently_viewed(known), shared_folder(spark, "out"), shared_folder(spark, "state"), "update")
    last = R.Window.partitionBy("session")
    return got.withColumn("last", F.max("batch").over(last)).where("batch = last").select("session", "product_id", "pos")


@query(
    "dwell_views",
    """SELECT session_id, product_id FROM (SELECT *, sum(fresh) OVER (PARTITION BY session_id, product_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN ts > max(until) OVER (PARTITION BY session_id, product_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM (
    SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, event_type AS product_id, ts, ts + to_hours(48) AS until FROM events WHERE event_id % 4 <> 0)))
    GROUP BY session_id, product_id, run HAVING max(until) - min(ts) >= to_hours(72)""",
)
def dwell_views(spark: SparkSession, d: str) -> DataFrame:
    """Showings that last: spans of two days that touch, seen for three days or more; a fourth of them is too little in sight."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ratio = F.when(F.col("event_id") % 4 == 0, 0.5).otherwise(0.9)
    spans = rows.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("product_id"), ratio.alias("ratio"), "ts", F.expr("ts + INTERVAL 48 HOURS").alias("until"))
    return W.dwell_views(spans, seconds=72 * 3600).select("session_id", "product_id")


@query("stream_republish", "SELECT id, round(before, 6) AS before, round(after, 6) AS after FROM blend WHERE before <> after")
def stream_republish(spark: SparkSession, d: str) -> DataFrame:
    """The loop: events arrive, popularity is blended anew, the changed products are written."""
    cat, path = catalog(spark, d), shared_folder(spark, "republished")

    def job(batch: DataFrame, number: int) -> None:
        b = P.blended_popularity(cat, P.engagement(batch)).where("before <> after")
        b.select("id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after")).write.mode("overwrite").parquet(path)

    source = shared_folder(spark, "stream")
    events(spark, d).withColumn("ts", F.timestamp_seconds(F.lit(1_900_000_000))).write.json(source)
    W.republish_on(W.read_events(spark, source, 1 << 30), job, shared_folder(spark, "state")).awaitTermination()
    return spark.read.parquet(path)
