"""Queries of the training-data operators, pN_..., and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.abuse import abuse_scores, rates_by_source
from vitrine.llm.canonical import map_to_canonical, not_exact, typed_values
from vitrine.llm.common import latest_per_key
from vitrine.llm.leakage import leaked, without_leaks
from vitrine.llm.listing_match import item_pairs, same_items
from vitrine.llm.mixture import mix
from vitrine.llm.terms import mark_terms, term_frequencies, term_rows, text_terms
from vitrine.llm.together import lift, pair_counts, session_baskets, surprise, surprising_pairs
from vitrine.llm.topn import top_n_per_group
from vitrine.llm.vectors import nearest, usable_vectors
from vitrine.runtime import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


_LISTINGS = "listings AS (SELECT * FROM products QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1)"


def listings(spark: SparkSession, d: str) -> DataFrame:
    return latest_per_key(table(spark, d, "products"), "id", "ord")


# ---------------------------------------------------------------- problem 2
_P2 = """
WITH ok AS (SELECT * FROM cooc_neighbors WHERE score IS NOT NULL AND isfinite(score) AND id <> neighbor_id),
cur AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY id, neighbor_id ORDER BY computed_at DESC NULLS LAST, score DESC) = 1)
SELECT id, neighbor_id, {score} CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbor_id) AS INTEGER) AS pos
FROM cur QUALIFY pos <= {n}
"""


@query("p2_found", _P2.format(score="", n=10))
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(table(spark, d, "cooc_neighbors"), 10).select("id", "neighbor_id", "pos")


@query("p2_top100", _P2.format(score="score,", n=100))
def p2_top100(spark: SparkSession, d: str) -> DataFrame:
    """The same for the hundred best, with scores."""
    return top_n_per_group(table(spark, d, "cooc_neighbors"), 100)


# ---------------------------------------------------------------- problem 3
_P3 = (
    "WITH "
    + _LISTINGS
    + r""", raw AS (
  SELECT 'title' AS field, id, unnest(regexp_split_to_array(coalesce(title, ''), '[\p{Z}\s\x1c-\x1f\x{85}]+')) AS t FROM listings
  UNION ALL SELECT 'tags', id, unnest(tags) FROM listings),
occ AS (SELECT field, id, regexp_replace(lower(t), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS term FROM raw WHERE t IS NOT NULL),
freq AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM occ WHERE term <> '' GROUP BY ALL),
marked AS (SELECT *, CASE WHEN records = 1 THEN 'rare' WHEN records > 0.1::double * (SELECT count(*) FROM listings) THEN 'common' END AS mark FROM freq)
"""
)


def _marked(spark: SparkSession, d: str) -> DataFrame:
    now = listings(spark, d)
    rows = term_rows(now, "id", {"title": text_terms(F.col("title")), "tags": F.col("tags")})
    total = table(spark, d, "products").agg(F.count_distinct("id").alias("n"))
    return mark_terms(term_frequencies(rows), total)


@query("p3_found", _P3 + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


@query("p3_frequencies", _P3 + "SELECT field, term, CAST(occurrences AS BIGINT) AS occurrences, CAST(records AS BIGINT) AS records, mark FROM marked")
def p3_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Every term with both counts."""
    return _marked(spark, d)


# ---------------------------------------------------------------- problem 1
def _canonical(spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "ref_values")
    values = not_exact(typed_values(listings(spark, d), ["brand", "category"]), ref)
    return map_to_canonical(values, ref)


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).select("id", "field", "ref_id")


@query("p1_unmatched")
def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The report of values no entry was found for, with their number of listings."""
    return _canonical(spark, d).where("ref_id = -1").groupBy("field", "value").agg(F.count(F.lit(1)).alias("listings"))


# ---------------------------------------------------------------- problem 8
#: Which sources fall short doesn't depend on the tokenizer, so the SQL sizes texts in characters.
_P8 = """
WITH docs AS (SELECT lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))) AS source, CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE length(text) END AS n FROM documents),
t AS (SELECT lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))) AS source, sum(target_share) AS share, max(max_repeats) AS cap FROM mix_targets WHERE source IS NOT NULL GROUP BY 1)
SELECT source FROM t WHERE cap * coalesce((SELECT sum(n) FROM docs WHERE docs.source = t.source), 0) < share * (SELECT sum(n) FROM docs)
"""


@query("p8_found", _P8)
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report.where("short").select("source")


@query("p8_report")
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source of the mix."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


@query("p8_copies")
def p8_copies(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is taken."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


# ---------------------------------------------------------------- problem 5
_P5 = """
WITH ev AS (SELECT session_id AS s, upper(trim(e.product_id, ' ' || chr(9) || chr(10) || chr(13))) AS m FROM (SELECT session_id, unnest(events) AS e FROM demo_sessions WHERE session_id IS NOT NULL)),
mem AS (SELECT DISTINCT s, m FROM ev WHERE m <> ''),
cnt AS (SELECT m, count(*) AS n FROM mem GROUP BY m),
tot AS (SELECT count(DISTINCT s) AS n FROM mem),
pr AS (SELECT x.m AS a, y.m AS b, count(*) AS n_ab FROM mem x JOIN mem y ON x.s = y.s AND x.m < y.m
  WHERE x.m IN (SELECT m FROM cnt WHERE n >= {k}) AND y.m IN (SELECT m FROM cnt WHERE n >= {k}) GROUP BY ALL)
SELECT {cols} FROM pr JOIN cnt ca ON ca.m = a JOIN cnt cb ON cb.m = b, tot
WHERE n_ab >= {k} {more}
"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    return session_baskets(table(spark, d, "demo_sessions"))


@query("p5_found", _P5.format(k=6, cols="a AS product_a, b AS product_b", more="AND n_ab * tot.n >= 5 * ca.n * cb.n"))
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    scored = surprise(_members(spark, d), min_count=6)
    often = F.col("n_ab") * F.col("n_baskets") >= 5 * F.col("n_a") * F.col("n_b")
    return scored.where(often).select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"))


@query(
    "p5_counts",
    _P5.format(k=2, cols="a AS product_a, b AS product_b, ca.n AS n_a, cb.n AS n_b, n_ab, round(n_ab * tot.n / (ca.n::double * cb.n), 6) AS lift", more=""),
)
def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every pair in two sessions or more with its counts and lift."""
    scored = surprise(_members(spark, d), min_count=2)
    return scored.select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"), "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"))


@query(
    "p5_pairs",
    _P5.format(k=1, cols="a AS product_a, b AS product_b, ca.n AS n_a, cb.n AS n_b, n_ab, round(n_ab * tot.n / (ca.n::double * cb.n), 6) AS lift", more=""),
)
def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of products, also those in one session, with its counts and lift."""
    counts = pair_counts(_members(spark, d))
    return counts.select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"), "n_a", "n_b", "n_ab", F.round(lift(), 6).alias("lift"))


@query("p5_surprising")
def p5_surprising(spark: SparkSession, d: str) -> DataFrame:
    """Pairs more common than chance at a false discovery rate of 5 %, of all pairs in any session."""
    return surprising_pairs(_members(spark, d), min_count=1)


# ---------------------------------------------------------------- problem 7
@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


@query("p7_matches")
def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with coverage and the longest verbatim match."""
    return leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p7_clean")
def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents left when the affected ones are removed."""
    docs = table(spark, d, "documents")
    return without_leaks(docs, leaked(docs, table(spark, d, "eval_items"))).select("doc_id")


# ---------------------------------------------------------------- problem 9
@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse_scores(table(spark, d, "documents")).where("n_hits > 0").select("doc_id")


@query("p9_scores")
def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its scores."""
    return abuse_scores(table(spark, d, "documents"))


@query("p9_rates")
def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per source."""
    return rates_by_source(abuse_scores(table(spark, d, "documents")))


# ---------------------------------------------------------------- problem 4
#: All pairs; the index finds every one of them where the table is small, and nearly all elsewhere.
_P4 = """
WITH m AS (SELECT version, embedding_dim AS dim FROM catalog_manifest ORDER BY version DESC LIMIT 1),
v AS (SELECT id, any_value(embedding::double[]) AS e FROM product_vectors, m WHERE product_vectors.version = m.version AND id IS NOT NULL AND len(embedding) = dim
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = dim AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
s AS (SELECT a.id, b.id AS neighbor_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbor_id) AS INTEGER) AS pos FROM s QUALIFY pos <= {k})
"""
def _nearest(spark: SparkSession, d: str, k: int) -> DataFrame:
    vectors, dim = usable_vectors(table(spark, d, "product_vectors"), table(spark, d, "catalog_manifest"))
    return nearest(vectors, dim, k)


@query("p4_found", _P4.format(k=5) + "SELECT DISTINCT least(id, neighbor_id) AS id_a, greatest(id, neighbor_id) AS id_b FROM r")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = _nearest(spark, d, 5)
    return near.select(F.least("id", "neighbor_id").alias("id_a"), F.greatest("id", "neighbor_id").alias("id_b")).distinct()


@query("p4_neighbors")
def p4_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar vectors of every vector, with similarities."""
    return _nearest(spark, d, 10)


# ---------------------------------------------------------------- problem 6
def _items(spark: SparkSession, d: str) -> DataFrame:
    return same_items(listings(spark, d), table(spark, d, "ref_values").where("field = 'brand'"))


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return item_pairs(_items(spark, d))


@query("p6_groups")
def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every listing with the item it belongs to."""
    return _items(spark, d)
