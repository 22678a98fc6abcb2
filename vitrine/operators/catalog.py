"""The catalogue: current rows, browsing, curation and the score bounds of raw imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.functions import scalars as S


def current(products: DataFrame) -> DataFrame:
    """The catalogue: the row of each id with the greatest ``ord``, absent fields as their defaults."""
    w = Window.partitionBy("id").orderBy(F.col("ord").desc())
    rows = products.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return rows.select(
        "ord", "id", "title",
        S.text_or_empty(F.col("description")).alias("description"),
        S.text_or_empty(F.col("category")).alias("category"),
        F.coalesce("subcategories", F.array().cast("array<string>")).alias("subcategories"),
        F.coalesce(F.filter("tags", lambda t: t.isNotNull()), F.array().cast("array<string>")).alias("tags"),
        S.text_or_empty(F.col("brand")).alias("brand"),
        "price", F.coalesce("currency", F.lit("USD")).alias("currency"),
        F.coalesce("popularity_score", F.lit(0.0)).alias("popularity_score"),
        F.coalesce("freshness_score", F.lit(0.0)).alias("freshness_score"),
        S.text_or_empty(F.col("image_url")).alias("image_url"), S.text_or_empty(F.col("url")).alias("url"), "attributes",
    )


def browse(catalog: DataFrame, category: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page in catalogue order; an empty category is no filter."""
    rows = catalog.where(F.col("category") == category) if category else catalog
    return rows.orderBy("ord").offset(offset).limit(limit)


def categories(catalog: DataFrame) -> DataFrame:
    return catalog.select("category").distinct()


def info(catalog: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: numbers of products, of products with a word to find, and of vectors."""
    words = catalog.agg(F.count(F.lit(1)).alias("product_count"), F.count_if(F.size(S.product_tokens()) > 0).alias("keyword_size"))
    return words.withColumn("vector_size", vectors.agg(F.count_distinct("id")).scalar())


def top_by(catalog: DataFrame, score: str, n: int) -> DataFrame:
    """The first ``n`` by a score, ties in catalogue order, with their ``pos``."""
    top = catalog.orderBy(F.col(score).desc(), "ord").limit(n)
    # Only n rows are numbered, so the single task of this window stays small.
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.col(score).desc(), "ord")))


def well_formed(products: DataFrame) -> DataFrame:
    """Rows fit for a curated catalogue: everything a card shows is there."""
    some = [F.length(F.trim(c)) > 0 for c in ("title", "description", "brand", "category", "image_url")]
    fine = F.col("price").isNotNull() & (F.size("tags") > 0)
    for c in some:
        fine = fine & F.coalesce(c, F.lit(False))
    return products.where(F.coalesce(fine, F.lit(False)))


def category_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def top_categories(rows: DataFrame, n: int = 12) -> DataFrame:
    return category_counts(rows).orderBy(F.col("n").desc(), "category").limit(n)


def balanced(rows: DataFrame, roots: DataFrame, per_category: int) -> DataFrame:
    """The most popular ``per_category`` rows of each of the given categories."""
    w = Window.partitionBy("category").orderBy(F.col("popularity_score").desc(), "id")
    kept = rows.join(roots.select("category"), "category", "left_semi")
    return kept.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= per_category)


def curate(products: DataFrame, roots: int = 12, per_category: int = 60) -> DataFrame:
    fine = well_formed(products)
    return balanced(fine, top_categories(fine, roots), per_category)


def score_bounds(raw: DataFrame) -> DataFrame:
    """One row of the least and greatest raw scores; 0 and 1 where there are none."""
    return raw.agg(
        F.coalesce(F.min("pop_raw"), F.lit(0.0)).alias("pop_min"), F.coalesce(F.max("pop_raw"), F.lit(1.0)).alias("pop_max"),
        F.coalesce(F.min("fresh_raw"), F.lit(0.0)).alias("fresh_min"), F.coalesce(F.max("fresh_raw"), F.lit(1.0)).alias("fresh_max"),
    )


def normalized(raw: DataFrame) -> DataFrame:
    """Raw scores brought between the bounds of all rows."""
    b = F.broadcast(score_bounds(raw))  # one row
    joined = raw.join(b)
    return joined.withColumns(
        {
            "popularity_score": S.normalize_score(F.col("pop_raw"), F.col("pop_min"), F.col("pop_max")),
            "freshness_score": S.normalize_score(F.col("fresh_raw"), F.col("fresh_min"), F.col("fresh_max")),
        }
    ).drop("pop_min", "pop_max", "fresh_min", "fresh_max")


def first_per_key(stages: list[DataFrame], key: str = "id", by: list[str] | None = None) -> DataFrame:
    """Union of stages, each row in stage order and ``pos``, where the first of a key stays."""
    by = by or []
    both = None
    for k, s in enumerate(stages):
        s = s.withColumn("stage", F.lit(k))
        both = s if both is None else both.unionByName(s)
    w = Window.partitionBy(*by, key).orderBy("stage", "pos")
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def with_local_images(catalog: DataFrame, staged: DataFrame) -> DataFrame:
    """The catalogue with ``image_url`` in the bundle: the staged photo ``staged(id, ext)`` of a product, else the card drawn for it.

    A product staged several times has the least extension; what an address was before doesn't matter."""
    photos = staged.where("id IS NOT NULL AND ext IS NOT NULL").groupBy("id").agg(F.min("ext").alias("__ext"))
    return catalog.join(photos, "id", "left").withColumn("image_url", S.local_image(F.col("id"), F.col("__ext"))).drop("__ext")
