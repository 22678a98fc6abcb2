"""Raw exports of shops turned into a catalogue, and the receipt of a ranking."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.config import RankingConfig
from vitrine.functions import scalars as S
from vitrine.operators.catalog import normalized

MARKET_SCHEMA = "asin string, title string, stars double, reviews double, price double, listPrice double, category_id string, isBestSeller boolean, boughtInLastMonth double, imgUrl string, productURL string"


def _finished(rows: DataFrame) -> DataFrame:
    """Bounds are those of all rows, whatever is kept afterwards."""
    return normalized(rows).drop("pop_raw", "fresh_raw").withColumn("currency", F.lit("USD"))


def _levels(rows: DataFrame, levels) -> DataFrame:
    rows = rows.withColumn("l", levels)
    return rows.withColumns({"category": F.col("l.category"), "subcategories": F.col("l.subcategories"), "tags": F.transform("l.subcategories", S.tag_slug)}).drop("l")


def from_marketplace(rows: DataFrame, categories: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Catalogue rows of a marketplace export with ``ord``; ``categories`` keeps top levels, ``limit`` the first rows of these."""
    base = rows.select(
        "ord", F.col("asin").alias("id"), S.text_or_empty(F.col("title")).alias("title"), F.lit("").alias("description"), F.lit("").alias("brand"), "price",
        F.coalesce(S.popularity_raw(F.col("stars"), F.col("reviews")), F.lit(0.0)).alias("pop_raw"), F.coalesce("boughtInLastMonth", F.lit(0.0)).alias("fresh_raw"),
        S.text_or_empty(F.col("imgUrl")).alias("image_url"), S.text_or_empty(F.col("productURL")).alias("url"), "category_id",
    )
    done = _finished(_levels(base, S.category_levels(F.col("category_id"))))
    if categories is not None:
        done = done.where(F.trim(F.get(F.split("category_id", ">"), F.lit(0))).isin(*categories))
    done = done.drop("category_id")
    return done if limit is None else done.orderBy("ord").limit(limit)


def from_scrape(rows: DataFrame) -> DataFrame:
    """Catalogue rows of a scraped export, all of whose columns are texts, with ``ord``."""
    rating = S.parse_rating(F.col("rating_stars"), F.col("rating_count"))
    base = rows.withColumn("r", rating).select(
        "ord", F.col("asin").alias("id"), S.text_or_empty(F.col("title")).alias("title"), S.first_text(F.col("about_item"), F.col("product_description")).alias("description"),
        F.coalesce(F.nullif("brand_name", F.lit("")), F.nullif("manufacturer", F.lit("")), F.lit("")).alias("brand"), S.parse_price(F.col("price_value")).alias("price"),
        S.popularity_raw(F.col("r.stars"), F.col("r.count")).alias("pop_raw"), S.parse_int(F.col("recent_purchases")).cast("double").alias("fresh_raw"),
        S.first_image(F.col("all_images")).alias("image_url"), S.text_or_empty(F.col("product_url")).alias("url"), "breadcrumbs",
    )
    return _finished(_levels(base, S.breadcrumbs(F.col("breadcrumbs")))).drop("breadcrumbs")


#: Levels of the signals a receipt is worked out for (fixed values).
GOLDEN = {"popularity": 0.8, "category": 0.6, "tag": 0.4, "brand": 0.5, "freshness": 0.7, "similarity": 0.9, "cooccurrence": 0.3}


def receipt(config: RankingConfig) -> dict:
    """Hash of the weights and the weighted mean of the golden signals of positive weight: what a consumer can check a ranking by."""
    w = {k: v for k, v in vars(config.weights).items()}
    used = {k: g for k, g in GOLDEN.items() if w[k] > 0}
    total = sum(w[k] for k in used)
    composite = sum(w[k] * g for k, g in used.items()) / total if total else 0.0
    return {"metric_version": hashlib.sha256(S.canonical_json(w)).hexdigest(), "subscores": {k: {"value": g, "weight": w[k]} for k, g in used.items()}, "composite": composite}
