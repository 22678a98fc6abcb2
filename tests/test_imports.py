"""Imports of shop exports."""

from dataclasses import replace

import pytest

from vitrine.config import RankingConfig
from vitrine.operators.imports import MARKET_SCHEMA, from_marketplace, from_scrape, receipt

SCRAPE = "ord long, asin string, title string, about_item string, product_description string, price_value string, list_price string, breadcrumbs string, brand_name string, manufacturer string, rating_stars string, rating_count string, recent_purchases string, all_images string, product_url string"


def test_marketplace(spark):
    rows = [("a", "A", 4.0, 9.0, 5.0, None, "Home & Kitchen > Bath Towels", True, 10.0, "i", "u"), ("b", None, 5.0, 99.0, None, None, "Toys", None, None, None, None), ("c", "C", None, None, 1.0, None, "", False, 20.0, "i", "u")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, " + MARKET_SCHEMA)
    got = {r["id"]: r for r in from_marketplace(df).collect()}
    assert (got["a"]["category"], got["a"]["subcategories"], got["a"]["tags"]) == ("Home & Kitchen", ["Bath Towels"], ["bath-towels"])
    assert (got["b"]["popularity_score"], got["b"]["title"], got["c"]["category"], got["c"]["popularity_score"], got["a"]["freshness_score"]) == (1.0, "", "Unknown", 0.0, 0.5)
    kept = from_marketplace(df, ["Toys", "Home & Kitchen"], 1).collect()
    assert [r["id"] for r in kept] == ["a"] and kept[0]["popularity_score"] == got["a"]["popularity_score"]
    assert from_marketplace(df.limit(0)).count() == 0


def test_scrape(spark):
    rows = [
        ("a", "A", "about", "other", "29.999", None, "Home › Bath Mats", "Brand", "Maker", "4.6 out of 5 stars", "1,654 ratings", "300", "['x.jpg', 'y']", "u"),
        ("b", "B", " ", " text ", "", None, "", "", "Maker", None, None, None, "[bad", None),
    ]
    got = {r["id"]: r for r in from_scrape(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCRAPE)).collect()}
    a, b = got["a"], got["b"]
    assert (a["price"], a["description"], a["brand"], a["category"], a["tags"], a["image_url"], a["popularity_score"], a["freshness_score"]) == (30.0, "about", "Brand", "Home", ["bath-mats"], "x.jpg", 1.0, 1.0)
    assert (b["price"], b["description"], b["brand"], b["category"], b["tags"], b["image_url"], b["popularity_score"]) == (None, "text", "Maker", "Uncategorized", [], "", 0.0)


def test_receipt():
    c = RankingConfig()
    one, two = receipt(c), receipt(replace(c, weights=replace(c.weights, tag=0.2)))
    assert one["metric_version"] != two["metric_version"] and one["composite"] != two["composite"]
    assert set(one["subscores"]) == {"popularity", "category", "tag", "brand", "freshness"} and one["composite"] == pytest.approx((0.4 * 0.8 + 0.2 * 0.6 + 0.15 * 0.4 + 0.1 * 0.5 + 0.1 * 0.7) / 0.95)
