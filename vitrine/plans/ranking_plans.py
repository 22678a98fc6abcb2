"""Retrieval, search, recommendation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.config import RETRIEVAL_WEIGHT, STOP_WORDS
from vitrine.functions import scalars as S
from vitrine.operators import evaluation as V
from vitrine.operators import ranking as K
from vitrine.operators import retrieval as R
from vitrine.operators import together as G
from vitrine.plans.base import WS, asked, asked_texts, catalog, events, query, score_sql, seeds, session_profiles, sessions, sql, vectors
from vitrine.runtime import cut, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select(F.struct("ord", "id").alias("doc"), S.product_tokens().alias("tokens"))


@query("bm25_postings", "SELECT term, id, tf, dl::integer AS dl FROM post")
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(_docs(spark, d)).select("term", F.col("doc.id").alias("id"), "tf", "dl")


@query("bm25_stats", "SELECT count(*) AS n, round(avg(len(tokens)), 6) AS avgdl FROM tok")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.corpus_stats(_docs(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


@query("bm25_idf", "SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return R.idf(R.document_frequencies(docs), R.corpus_stats(docs)).withColumn("idf", F.round("idf", 6))


def _keyword(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    queries = asked_texts(spark, d).select("q", S.tokens(F.col("text")).alias("tokens"))
    return R.keyword_search(K.keyword_index(catalog(spark, d)), queries, k)


@query("bm25_search", "SELECT q, id AS doc, score, CAST(pos AS INTEGER) AS pos FROM kw")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return _keyword(spark, d)


_DOCS = rf"""WITH dt AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{WS}'), lambda x: x <> '') AS tokens FROM documents),
    dp AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM dt) GROUP BY ALL),
    dr AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM dt) - count(*) + 0.5::double) - ln(count(*) + 0.5::double) AS raw FROM dp GROUP BY term),
    di AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::double * (SELECT avg(raw) FROM dr) ELSE raw END AS idf FROM dr),
    dq AS (SELECT ref_id AS q, unnest(list_filter(regexp_split_to_array(lower(name), '{WS}'), lambda x: x <> '')) AS term FROM ref_values WHERE field = 'category')
    SELECT q, doc_id AS doc, round(sum(idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / (SELECT avg(len(tokens)) FROM dt)))), 6) AS score,
    CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS pos
    FROM dq JOIN dp USING (term) JOIN di USING (term) GROUP BY q, doc_id HAVING score > 0 QUALIFY pos <= 20"""


@query("bm25_documents", _DOCS)
def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    """The names of all categories as queries over all documents."""
    docs = R.documents(table(spark, d, "documents"), "doc_id", S.tokens(F.col("text")))
    queries = table(spark, d, "ref_values").where("field = 'category'").select(F.col("ref_id").alias("q"), S.tokens(F.col("name")).alias("tokens"))
    return R.top_k(R.bm25(docs, queries), 20).select("q", "doc", "score", "pos")


def _vector(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    queries = asked(spark, d).where("embedding IS NOT NULL").select("q", "embedding")
    return R.knn(vectors(spark, d).select(F.col("id").alias("doc"), "ord", "embedding"), queries, k)


@query("vector_search", "SELECT q, id AS doc, score, CAST(pos AS INTEGER) AS pos FROM vk")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    return _vector(spark, d)


_KNN = """WITH s AS (SELECT a.vec_id AS q, b.vec_id AS doc, b.label = a.label AS rel, a.label AS segment, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 {self})"""


def _embeddings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("doc"), F.col("vec_id").alias("ord"), "embedding"), rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding")


@query("knn", _KNN.format(self="") + " SELECT q, doc, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS INTEGER) AS pos FROM s QUALIFY pos <= 10")
def knn(spark: SparkSession, d: str) -> DataFrame:
    return R.knn(*_embeddings(spark, d), 10)


@query("nearest", _KNN.format(self="AND a.vec_id <> b.vec_id") + " SELECT q, doc, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS INTEGER) AS pos FROM s QUALIFY pos <= 10")
def nearest(spark: SparkSession, d: str) -> DataFrame:
    return R.knn(*_embeddings(spark, d), 10, exclude_self=True)


@query("vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) AS norm, round(list_dot_product(embedding::double[], embedding::double[]), 6) AS dot FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(S.norm(e), 6).alias("norm"), F.round(S.dot(e, e), 6).alias("dot"))


@query("rrf", "SELECT q, id, rrf, CAST(pos AS INTEGER) AS pos FROM fused")
def rrf(spark: SparkSession, d: str) -> DataFrame:
    return K.hybrid(asked(spark, d), catalog(spark, d), vectors(spark, d)).select("q", "id", "rrf", "pos")


@query("retrieval_evidence", "SELECT q, id, lexical, semantic FROM fused")
def retrieval_evidence(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(_keyword(spark, d), _vector(spark, d)).select("q", F.col("doc").alias("id"), "lexical", "semantic")


@query("relevance_floor", "SELECT q, id, round(retrieval, 6) AS retrieval FROM adm")
def relevance_floor(spark: SparkSession, d: str) -> DataFrame:
    fused = R.fuse(_keyword(spark, d), _vector(spark, d))
    return R.retrieval_term(R.admitted(fused), RETRIEVAL_WEIGHT).select("q", F.col("doc").alias("id"), F.round("retrieval", 6).alias("retrieval"))


_ZERO = (0.40, 0.20, 0.15, 0.10, 0.10, 0.25, 0.0, 0.0)
_ADM = "SELECT q, id, pos AS pool_pos, retrieval, 0::double AS similarity, 0::double AS cooccurrence FROM adm"


@query("search", score_sql(_ADM, _ZERO, 10, False, out_extra=", count(*) OVER (PARTITION BY q) AS total"))
def search(spark: SparkSession, d: str) -> DataFrame:
    return K.search(asked(spark, d), catalog(spark, d), vectors(spark, d))


@query(
    "search_in_category",
    score_sql(_ADM, _ZERO, 10, False, out_extra=", count(*) OVER (PARTITION BY q) AS total").replace(
        "SELECT * EXCLUDE (pool_pos)", "SELECT sc.* EXCLUDE (pool_pos)"
    ).replace("FROM sc QUALIFY", "FROM sc JOIN cat ON cat.id = sc.id WHERE cat.category = 'Footwear' QUALIFY"),
)
def search_in_category(spark: SparkSession, d: str) -> DataFrame:
    return K.search(asked(spark, d), catalog(spark, d), vectors(spark, d), category="Footwear")


def _pool(by: str) -> str:
    return f"""SELECT q, id, pool_pos, 0::double AS retrieval, 0::double AS similarity, 0::double AS cooccurrence FROM sess,
        (SELECT id, row_number() OVER (ORDER BY {by} DESC, ord) AS pool_pos FROM cat QUALIFY pool_pos <= 50) t"""


@query("recommend_trending", score_sql(_pool("pop"), (0.80, 0.05, 0.04, 0.03, 0.08, 0.25, 0.0, 0.0), 10))
def recommend_trending(spark: SparkSession, d: str) -> DataFrame:
    return K.recommend("trending", sessions(spark, d), catalog(spark, d), profiles=session_profiles(spark, d))


@query("recommend_new_arrivals", score_sql(_pool("fresh"), (0.15, 0.05, 0.04, 0.03, 0.70, 0.25, 0.0, 0.0), 10))
def recommend_new_arrivals(spark: SparkSession, d: str) -> DataFrame:
    return K.recommend("new_arrivals", sessions(spark, d), catalog(spark, d), profiles=session_profiles(spark, d))


_AFF = """SELECT q, id, stage * 1000000000 + pos AS pool_pos, 0::double AS retrieval, 0::double AS similarity, 0::double AS cooccurrence FROM (
    SELECT * FROM (SELECT q, id, 0 AS stage, ord AS pos FROM m UNION ALL SELECT q, t.id, 1, t.pos FROM sess,
        (SELECT id, row_number() OVER (ORDER BY pop DESC, ord) AS pos FROM cat QUALIFY pos <= 50) t WHERE q NOT IN (SELECT q FROM m GROUP BY q HAVING count(*) >= 10))
    QUALIFY row_number() OVER (PARTITION BY q, id ORDER BY stage, pos) = 1)"""
_MATCH = """m AS (SELECT DISTINCT q, id, ord FROM (
    SELECT q, cat.id, ord FROM sess JOIN aff ON session = q AND kind = 'category' JOIN cat ON cat.category = key WHERE value > 0
    UNION ALL SELECT q, c.id, ord FROM sess JOIN aff ON session = q AND kind = 'tag' JOIN (SELECT id, ord, unnest(tags) AS t FROM cat) c ON c.t = key WHERE value > 0
    UNION ALL SELECT q, cat.id, ord FROM sess JOIN aff ON session = q AND kind = 'brand' JOIN cat ON cat.brand = key WHERE value > 0 AND cat.brand <> ''))"""


@query("recommend_for_you", score_sql(_AFF, _ZERO, 10).replace("WITH src AS", f"WITH {_MATCH}, src AS", 1))
def recommend_for_you(spark: SparkSession, d: str) -> DataFrame:
    return K.recommend("for_you", sessions(spark, d), catalog(spark, d), profiles=session_profiles(spark, d))


@query("recommend_cold", score_sql(_pool("pop"), _ZERO, 10, False))
def recommend_cold(spark: SparkSession, d: str) -> DataFrame:
    """Requests of which nothing is known yet."""
    return K.recommend("for_you", sessions(spark, d), catalog(spark, d))


_SIM = """SELECT q, id, pos AS pool_pos, 0::double AS retrieval, score AS similarity, 0::double AS cooccurrence FROM
    (SELECT a.id AS q, b.id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS score, row_number() OVER (PARTITION BY a.id ORDER BY score DESC, b.ord) AS pos
    FROM vec a JOIN vec b ON a.id <> b.id WHERE a.id IN (SELECT seed FROM seed) QUALIFY pos <= 50)"""


@query("recommend_similar_items", score_sql(_SIM, (0.20, 0.05, 0.04, 0.03, 0.05, 0.25, 0.60, 0.0), 10, False))
def recommend_similar_items(spark: SparkSession, d: str) -> DataFrame:
    return K.recommend("similar_items", seeds(spark, d), catalog(spark, d), vectors=vectors(spark, d))


@query("recommend_because_viewed", score_sql(_SIM, (0.10, 0.12, 0.08, 0.06, 0.04, 0.25, 0.55, 0.0), 10, False))
def recommend_because_viewed(spark: SparkSession, d: str) -> DataFrame:
    return K.recommend("because_viewed", seeds(spark, d), catalog(spark, d), vectors=vectors(spark, d))


_COO = "SELECT q, neighbor_id AS id, rank AS pool_pos, 0::double AS retrieval, 0::double AS similarity, score AS cooccurrence FROM seed JOIN cooc ON cooc.id = seed.seed"


@query("recommend_also_bought", score_sql(_COO, (0.15, 0.05, 0.04, 0.03, 0.03, 0.25, 0.0, 0.70), 10, False))
def recommend_also_bought(spark: SparkSession, d: str) -> DataFrame:
    return K.recommend("also_bought", seeds(spark, d), catalog(spark, d), neighbors=G.cooccurrence(events(spark, d)))


@query("recommend_fbt", score_sql(_COO + " WHERE rank <= 3", (0.08, 0.04, 0.03, 0.02, 0.02, 0.25, 0.0, 0.80), 10, False))
def recommend_fbt(spark: SparkSession, d: str) -> DataFrame:
    return K.recommend("frequently_bought_together", seeds(spark, d), catalog(spark, d), neighbors=G.cooccurrence(events(spark, d)))


def _rail(name: str, source: str, w: tuple[float, ...]) -> str:
    return f"SELECT '{name}' AS rail, q, id, pos, score FROM ({sql(score_sql(source, w, 10, False))})"


@query(
    "product_rails",
    " UNION ALL ".join(
        [
            _rail("frequently_bought_together", _COO + " WHERE rank <= 3", (0.08, 0.04, 0.03, 0.02, 0.02, 0.25, 0.0, 0.80)),
            _rail("similar_items", _SIM, (0.20, 0.05, 0.04, 0.03, 0.05, 0.25, 0.60, 0.0)),
            _rail("also_bought", _COO, (0.15, 0.05, 0.04, 0.03, 0.03, 0.25, 0.0, 0.70)),
        ]
    ),
)
def product_rails(spark: SparkSession, d: str) -> DataFrame:
    """The rails of a product page for every seed."""
    s, cat, near = seeds(spark, d), catalog(spark, d), G.cooccurrence(events(spark, d))
    return K.rails(
        {
            "frequently_bought_together": K.recommend("frequently_bought_together", s, cat, neighbors=near),
            "similar_items": K.recommend("similar_items", s, cat, vectors=vectors(spark, d)),
            "also_bought": K.recommend("also_bought", s, cat, neighbors=near),
        }
    )


@query(
    "product_page",
    " UNION ALL ".join(
        [
            _rail("frequently_bought_together", _COO + " WHERE rank <= 3", (0.08, 0.04, 0.03, 0.02, 0.02, 0.25, 0.0, 0.80)),
            _rail("similar_items", _SIM, (0.20, 0.05, 0.04, 0.03, 0.05, 0.25, 0.60, 0.0)),
            _rail("because_viewed", _SIM, (0.10, 0.12, 0.08, 0.06, 0.04, 0.25, 0.55, 0.0)),
            _rail("also_bought", _COO, (0.15, 0.05, 0.04, 0.03, 0.03, 0.25, 0.0, 0.70)),
            "SELECT 'trending_in_category' AS rail, t.q, t.id, t.pos, t.score FROM ("
            + sql(score_sql(_pool("pop").replace("FROM sess", "FROM seed"), (0.80, 0.05, 0.04, 0.03, 0.08, 0.25, 0.0, 0.0), 10, False))
            + ") t JOIN cat c ON c.id = t.id JOIN cat s ON s.id = t.q WHERE c.category = s.category",
        ]
    ),
)
def product_page(spark: SparkSession, d: str) -> DataFrame:
    """All five rails of a product page for every seed; the last shows what trends in the seed's category."""
    s, cat = seeds(spark, d), catalog(spark, d)
    # Two rails each read these; the pairs of a session line and the nearest vectors are found once.
    near = cut(G.cooccurrence(events(spark, d), of=s.select(F.col("seed").alias("product_id"))))
    alike = cut(K.seed_neighbours(s, vectors(spark, d), 10))
    kind = cat.select("id", "category")
    trending = K.recommend("trending", s.select("q"), cat).join(kind, "id").join(kind.select(F.col("id").alias("q"), F.col("category").alias("own")), "q")
    return K.rails(
        {
            "frequently_bought_together": K.recommend("frequently_bought_together", s, cat, neighbors=near),
            "similar_items": K.recommend("similar_items", s, cat, near=alike),
            "because_viewed": K.recommend("because_viewed", s, cat, near=alike),
            "also_bought": K.recommend("also_bought", s, cat, neighbors=near),
            "trending_in_category": trending.where("category = own"),
        }
    )


@query("trending_in_category", "SELECT t.* FROM (" + sql(score_sql(_pool("pop"), (0.80, 0.05, 0.04, 0.03, 0.08, 0.25, 0.0, 0.0), 10, False)) + ") t JOIN cat ON cat.id = t.id WHERE cat.category = 'Footwear'")
def trending_in_category(spark: SparkSession, d: str) -> DataFrame:
    """The trending ten first, then those of the category among them."""
    cat = catalog(spark, d)
    return K.recommend("trending", sessions(spark, d), cat).join(cat.where("category = 'Footwear'").select("id"), "id", "left_semi")


_RANKED = _KNN.format(self="AND a.vec_id <> b.vec_id") + """, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS pos FROM s QUALIFY pos <= 10),
    n AS (SELECT q, any_value(segment) AS segment, count(*) FILTER (rel) AS n_rel FROM s GROUP BY q HAVING n_rel > 0),
    h AS (SELECT q, sum(rel::int / log2(pos + 1)) AS dcg, sum(rel::int) AS hits, max(CASE WHEN rel THEN 1.0::double / pos END) AS rr, sum(rel::int * seen / pos) AS ps
        FROM (SELECT *, (sum(rel::int) OVER (PARTITION BY q ORDER BY pos))::double AS seen FROM r) GROUP BY q),
    pq AS (SELECT q, segment, coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(10, n_rel) + 1) t(i)), 0) AS ndcg, coalesce(hits / 10.0::double, 0) AS precision,
        coalesce(hits::double / n_rel, 0) AS recall, coalesce(rr, 0) AS mrr, coalesce(ps / least(n_rel, 10), 0) AS ap FROM n LEFT JOIN h USING (q))"""


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages of neighbours, vectors of the same label as judgments, labels as segments."""
    rows, queries = _embeddings(spark, d)
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    mine = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("segment"))
    relevant = mine.join(labels.select(F.col("vec_id").alias("doc"), F.col("label").alias("segment")), "segment").where("q <> doc").select("q", "doc")
    return R.knn(rows, queries, 10, exclude_self=True), relevant, mine


@query("query_metrics", _RANKED + " SELECT q, round(ndcg, 6) AS ndcg, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ap, 6) AS ap FROM pq")
def query_metrics(spark: SparkSession, d: str) -> DataFrame:
    ranked, relevant, _ = _judged(spark, d)
    m = V.query_metrics(ranked, relevant)
    return m.select("q", *[F.round(c, 6).alias(c) for c in ("ndcg", "precision", "recall", "mrr", "ap")])


@query("segment_metrics", _RANKED + " SELECT segment, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ap), 6) AS ap FROM pq GROUP BY segment")
def segment_metrics(spark: SparkSession, d: str) -> DataFrame:
    ranked, relevant, segments = _judged(spark, d)
    return V.segment_metrics(V.query_metrics(ranked, relevant), segments)


@query("page_counts", _RANKED + " SELECT segment, count(*) FILTER (k >= 10) AS full_pages, CAST(sum(k) AS BIGINT) AS shown, count(*) FILTER (k = 0) AS empty_pages FROM (SELECT e.vec_id AS q, e.label AS segment, (SELECT count(*) FROM r WHERE r.q = e.vec_id AND r.score >= 0.4) AS k FROM embeddings e WHERE e.vec_id % 50 = 0) GROUP BY segment")
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    ranked, _, segments = _judged(spark, d)
    return V.page_counts(segments, ranked.where("score >= 0.4"), 10)


@query("label_match", "SELECT DISTINCT r.ref_id AS q, c.id AS doc FROM ref_values r JOIN (SELECT id, unnest(list_concat([category], subcategories)) AS node FROM cat) c ON c.node = r.name OR list_contains(r.aliases, c.node) WHERE r.field = 'category'")
def label_match(spark: SparkSession, d: str) -> DataFrame:
    nodes = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return V.label_match(catalog(spark, d), table(spark, d, "ref_values").where("field = 'category'").select(F.col("ref_id").alias("q"), nodes.alias("nodes")))



@query(
    "query_terms",
    rf"""SELECT q, list_filter(list_filter(regexp_split_to_array(lower(text), '{WS}'), lambda x: x <> ''), lambda x: NOT list_contains({list(STOP_WORDS)}, x)) AS terms
    FROM (SELECT doc_id AS q, coalesce(text, '') AS text FROM documents)""",
)
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    """Texts as queries, without words that say nothing about what is sought."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("q"), R.without_stop_words(S.tokens(F.col("text")), STOP_WORDS).alias("terms"))


@query("segment_report", _RANKED + " SELECT segment, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall FROM pq WHERE segment = 3 GROUP BY segment")
def segment_report(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of one segment; one of negatives would be refused."""
    ranked, relevant, segments = _judged(spark, d)
    return V.segment_report(V.query_metrics(ranked, relevant), segments, 3).select("segment", "queries", "ndcg", "recall")


@query("blank_search", "SELECT id AS q FROM cat WHERE false")
def blank_search(spark: SparkSession, d: str) -> DataFrame:
    """Queries of white space alone find nothing, whatever their vectors."""
    blank = asked(spark, d).withColumn("text", F.lit("  "))
    return K.search(blank, catalog(spark, d), vectors(spark, d)).select("q")


@query(
    "home_rails",
    " UNION ALL ".join([_rail("trending", _pool("pop"), (0.80, 0.05, 0.04, 0.03, 0.08, 0.25, 0.0, 0.0)), _rail("new_arrivals", _pool("fresh"), (0.15, 0.05, 0.04, 0.03, 0.70, 0.25, 0.0, 0.0))]),
)
def home_rails(spark: SparkSession, d: str) -> DataFrame:
    """The rails of a home page that don't depend on who asks."""
    s, cat = sessions(spark, d), catalog(spark, d)
    return K.rails({"trending": K.recommend("trending", s, cat), "new_arrivals": K.recommend("new_arrivals", s, cat)})
