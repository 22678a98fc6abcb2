"""Catalogue, import and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.functions import scalars as S
from vitrine.operators import catalog as C
from vitrine.plans.base import catalog, query, vectors
from vitrine.runtime import table


@query("load_catalog", "SELECT ord, id, title, category, brand, tags, subcategories, round(pop, 6) AS popularity_score, round(fresh, 6) AS freshness_score FROM cat")
def load_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select(
        "ord", "id", "title", "category", "brand", "tags", "subcategories", F.round("popularity_score", 6).alias("popularity_score"), F.round("freshness_score", 6).alias("freshness_score")
    )


@query("product_text", "SELECT id, concat_ws(' ', nullif(title, ''), nullif(category, ''), nullif(array_to_string(tags, ' '), ''), nullif(brand, '')) AS text FROM cat")
def product_text(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("id", S.product_text().alias("text"))


@query("product_tokens", "SELECT id, tokens FROM tok")
def product_tokens(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("id", S.product_tokens().alias("tokens"))


@query("browse", "SELECT id, title, ord FROM cat WHERE category = 'Footwear' ORDER BY ord LIMIT 10 OFFSET 5")
def browse(spark: SparkSession, d: str) -> DataFrame:
    return C.browse(catalog(spark, d), "Footwear", 5, 10).select("id", "title", "ord")


@query("browse_total", "SELECT count(*) AS total FROM cat WHERE category = 'Footwear'")
def browse_total(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).where("category = 'Footwear'").agg(F.count(F.lit(1)).alias("total"))


@query("distinct_categories", "SELECT DISTINCT category FROM cat")
def distinct_categories(spark: SparkSession, d: str) -> DataFrame:
    return C.categories(catalog(spark, d))


@query("catalog_info", "SELECT (SELECT count(*) FROM cat) AS product_count, (SELECT count(*) FROM tok WHERE len(tokens) > 0) AS keyword_size, (SELECT count(*) FROM vec) AS vector_size")
def catalog_info(spark: SparkSession, d: str) -> DataFrame:
    return C.info(catalog(spark, d), vectors(spark, d))


@query("popularity_pool", "SELECT id, pop AS popularity_score, CAST(row_number() OVER (ORDER BY pop DESC, ord) AS INTEGER) AS pos FROM cat QUALIFY pos <= 50")
def popularity_pool(spark: SparkSession, d: str) -> DataFrame:
    return C.top_by(catalog(spark, d), "popularity_score", 50).select("id", "popularity_score", "pos")


@query("freshness_pool", "SELECT id, fresh AS freshness_score, CAST(row_number() OVER (ORDER BY fresh DESC, ord) AS INTEGER) AS pos FROM cat QUALIFY pos <= 50")
def freshness_pool(spark: SparkSession, d: str) -> DataFrame:
    return C.top_by(catalog(spark, d), "freshness_score", 50).select("id", "freshness_score", "pos")


_WELL = """fine AS (SELECT * FROM products WHERE price IS NOT NULL AND coalesce(len(tags), 0) > 0 AND trim(title) <> '' AND trim(description) <> ''
    AND trim(brand) <> '' AND trim(category) <> '' AND trim(image_url) <> '')"""


@query("well_formed", f"WITH {_WELL} SELECT ord, id FROM fine")
def well_formed(spark: SparkSession, d: str) -> DataFrame:
    return C.well_formed(table(spark, d, "products")).select("ord", "id")


@query("category_counts", "SELECT category, count(*) AS n FROM cat GROUP BY category")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.category_counts(catalog(spark, d))


@query("top_categories", f"WITH {_WELL} SELECT category, count(*) AS n FROM fine GROUP BY category ORDER BY n DESC, category LIMIT 12")
def top_categories(spark: SparkSession, d: str) -> DataFrame:
    return C.top_categories(C.well_formed(table(spark, d, "products")))


@query("topn_per_category", "SELECT category, id, CAST(row_number() OVER (PARTITION BY category ORDER BY pop DESC, id) AS INTEGER) AS pos FROM cat QUALIFY pos <= 5")
def topn_per_category(spark: SparkSession, d: str) -> DataFrame:
    cat = catalog(spark, d)
    return C.balanced(cat, C.categories(cat), 5).select("category", "id", "pos")


@query(
    "curate",
    f"""WITH {_WELL}, latest AS (SELECT * FROM fine QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1),
    roots AS (SELECT category, count(*) AS n FROM latest GROUP BY category ORDER BY n DESC, category LIMIT 12)
    SELECT category, ord, id, CAST(row_number() OVER (PARTITION BY category ORDER BY popularity_score DESC, id) AS INTEGER) AS pos
    FROM latest WHERE category IN (SELECT category FROM roots) QUALIFY pos <= 60""",
)
def curate(spark: SparkSession, d: str) -> DataFrame:
    fine = C.well_formed(table(spark, d, "products"))
    w = Window.partitionBy("id").orderBy(F.col("ord").desc())
    latest = fine.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return C.balanced(latest, C.top_categories(latest, 12), 60).select("category", "ord", "id", "pos")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Raw scores from stars and reviews of documents, and days since 2000, of every product."""
    docs = table(spark, d, "documents").where("product_id IS NOT NULL").groupBy(F.col("product_id").alias("id")).agg(
        F.coalesce(F.avg("stars"), F.lit(0.0)).alias("stars"), F.count("stars").alias("reviews")
    )
    day = F.date_diff(F.col("ingested_at").cast("date"), F.lit("2000-01-01").cast("date")).cast("double")
    rows = table(spark, d, "products").select("ord", "id", day.alias("fresh_raw")).join(docs, "id", "left")
    return rows.select("ord", "id", F.coalesce(S.popularity_raw(F.col("stars"), F.col("reviews")), F.lit(0.0)).alias("pop_raw"), "fresh_raw")


_RAW = """dr AS (SELECT product_id AS id, coalesce(avg(stars), 0) AS stars, count(stars) AS reviews FROM documents WHERE product_id IS NOT NULL GROUP BY 1),
    raw AS (SELECT ord, p.id, coalesce(stars * ln(1 + reviews), 0) AS pop_raw, date_diff('day', date '2000-01-01', CAST(ingested_at AS date))::double AS fresh_raw FROM products p LEFT JOIN dr USING (id)),
    bnd AS (SELECT coalesce(min(pop_raw), 0) AS a, coalesce(max(pop_raw), 1) AS b, coalesce(min(fresh_raw), 0) AS c, coalesce(max(fresh_raw), 1) AS e FROM raw)"""


@query("score_bounds", f"WITH {_RAW} SELECT round(a, 6) AS pop_min, round(b, 6) AS pop_max, c AS fresh_min, e AS fresh_max FROM bnd")
def score_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = C.score_bounds(_raw(spark, d))
    return b.select(F.round("pop_min", 6).alias("pop_min"), F.round("pop_max", 6).alias("pop_max"), "fresh_min", "fresh_max")


@query(
    "preprocess",
    f"""WITH {_RAW} SELECT ord, id, round(CASE WHEN b <= a THEN 0 ELSE greatest(0, least(1, (pop_raw - a) / (b - a))) END, 6) AS popularity_score,
    round(CASE WHEN e <= c THEN 0 ELSE greatest(0, least(1, (fresh_raw - c) / (e - c))) END, 6) AS freshness_score FROM raw, bnd""",
)
def preprocess(spark: SparkSession, d: str) -> DataFrame:
    rows = C.normalized(_raw(spark, d))
    return rows.select("ord", "id", F.round("popularity_score", 6).alias("popularity_score"), F.round("freshness_score", 6).alias("freshness_score"))


@query(
    "category_hierarchy",
    """SELECT ord, coalesce(l[1], 'Unknown') AS root, l[2:] AS rest FROM (SELECT ord, list_filter(list_transform(string_split(coalesce(category, '') || ' > ' ||
    array_to_string(coalesce(subcategories, []), ' > '), '>'), lambda x: trim(x)), lambda x: x <> '') AS l FROM products)""",
)
def category_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(S.text_or_empty(F.col("category")), F.lit(" > "), F.array_join(F.coalesce("subcategories", F.array().cast("array<string>")), " > "))
    return table(spark, d, "products").select("ord", S.category_levels(path).alias("l")).select("ord", F.col("l.category").alias("root"), F.col("l.subcategories").alias("rest"))


@query(
    "breadcrumbs",
    """SELECT ord, coalesce(l[1], 'Uncategorized') AS root, l[2:] AS rest FROM (SELECT ord, list_filter(list_transform(string_split(coalesce(category, ''), '›'), lambda x: trim(x)), lambda x: x <> '') AS l FROM products)""",
)
def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("ord", S.breadcrumbs(F.col("category")).alias("l")).select("ord", F.col("l.category").alias("root"), F.col("l.subcategories").alias("rest"))


@query("tag_slugs", "SELECT id, list_transform(subcategories, lambda x: replace(lower(x), ' ', '-')) AS slugs FROM cat")
def tag_slugs(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("id", F.transform("subcategories", S.tag_slug).alias("slugs"))


@query("parse_price", r"SELECT ord, round(TRY_CAST(nullif(regexp_extract(replace(title, ',', ''), '\d+(?:\.\d+)?', 0), '') AS double), 2) AS price FROM products")
def parse_price(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("ord", S.parse_price(F.col("title")).alias("price"))


@query("parse_int", r"SELECT ord, coalesce(TRY_CAST(nullif(regexp_extract(replace(coalesce(description, ''), ',', ''), '\d+', 0), '') AS bigint), 0) AS n FROM products")
def parse_int(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("ord", S.parse_int(F.col("description")).alias("n"))


@query(
    "parse_rating",
    r"""SELECT doc_id, coalesce(TRY_CAST(nullif(regexp_extract(replace(coalesce(stars::varchar || ' out of 5', ''), ',', ''), '\d+(?:\.\d+)?', 0), '') AS double), 0) AS stars,
    coalesce(TRY_CAST(nullif(regexp_extract(replace(coalesce(n_chars::varchar || ' ratings', ''), ',', ''), '\d+', 0), '') AS bigint), 0) AS count FROM documents""",
)
def parse_rating(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    r = S.parse_rating(F.concat(F.col("stars").cast("string"), F.lit(" out of 5")), F.concat(F.col("n_chars").cast("string"), F.lit(" ratings")))
    return docs.select("doc_id", r.alias("r")).select("doc_id", "r.stars", "r.count")


@query("first_text", "SELECT ord, coalesce(nullif(trim(description, ' '), ''), nullif(trim(title, ' '), ''), '') AS text FROM products")
def first_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("ord", S.first_text(F.col("description"), F.col("title")).alias("text"))


@query("recency_days", "SELECT ord, date_diff('day', date '2000-01-01', CAST(ingested_at AS date))::integer AS days FROM products")
def recency_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("ord", S.recency_days(F.date_format("ingested_at", "yyyy-MM-dd")).alias("days"))


@query("scalar_as_float", "SELECT ord, key, coalesce(TRY_CAST(value AS double), -1) AS number FROM (SELECT ord, unnest(map_entries(attributes)).key AS key, unnest(map_entries(attributes)).value AS value FROM products)")
def scalar_as_float(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("ord", F.explode("attributes").alias("key", "value")).select("ord", "key", S.number_or(F.col("value"), -1.0).alias("number"))


@query("bump_version", r"SELECT version, CASE WHEN regexp_matches(version, '\d+$') THEN regexp_replace(version, '\d+$', '') || (regexp_extract(version, '(\d+)$', 1)::bigint + 1)::varchar ELSE version || '-r2' END AS next FROM catalog_manifest")
def bump_version(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalog_manifest").select("version", S.bump_version(F.col("version")).alias("next"))


@query(
    "title_case",
    """SELECT ord, array_to_string(list_transform(string_split(array_to_string(list_transform(string_split(category, ' '), lambda w: upper(w[1:1]) || w[2:]), ' '), '-'),
    lambda w: upper(w[1:1]) || w[2:]), '-') AS label FROM products""",
)
def title_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("ord", S.title_case(F.col("category")).alias("label"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.content_hash(F.col("text")).alias("hash"))


@query("local_images", r"SELECT id, '/images/' || id || '.' || coalesce(nullif(regexp_extract(image_url, '\.([a-z]+)$', 1), ''), 'svg') AS image FROM cat")
def local_images(spark: SparkSession, d: str) -> DataFrame:
    staged = F.nullif(F.regexp_extract("image_url", r"\.([a-z]+)$", 1), F.lit(""))
    return catalog(spark, d).select("id", S.local_image(F.col("id"), staged).alias("image"))


@query("safe_ids", r"SELECT ord, id FROM products WHERE regexp_matches(id, '^[A-Za-z0-9._-]+$')")
def safe_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").where(S.safe_id(F.col("id"))).select("ord", "id")


@query(
    "classify_resource",
    """SELECT id, CASE WHEN regexp_matches(image_url, '\\.(png|jpg|jpeg|webp|gif|svg|avif)$') THEN 'image' WHEN starts_with(image_url, '/') THEN 'edge' ELSE 'other' END AS image_bucket,
    CASE WHEN starts_with(url, '/') THEN 'edge' ELSE 'other' END AS url_bucket FROM cat""",
)
def classify_resource(spark: SparkSession, d: str) -> DataFrame:
    edge = "https://shop.example"
    return catalog(spark, d).select("id", S.classify_resource(F.col("image_url"), edge).alias("image_bucket"), S.classify_resource(F.col("url"), edge).alias("url_bucket"))


@query("url_origin", "SELECT id, 'https://shop.example:8443' AS origin FROM cat WHERE url LIKE '/%'")
def url_origin(spark: SparkSession, d: str) -> DataFrame:
    full = F.concat(F.lit("HTTPS://Shop.example:8443"), F.col("url"))
    return catalog(spark, d).where("url LIKE '/%'").select("id", S.url_origin(full).alias("origin"))


@query("tag_overlap", "SELECT id FROM cat WHERE list_has_any(tags, ['winter', 'office', 'gift-idea'])")
def tag_overlap(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).where(F.arrays_overlap("tags", F.array(*map(F.lit, ("winter", "office", "gift-idea"))))).select("id")
