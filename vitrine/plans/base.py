"""Registry of queries and the SQL both engines agree on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import catalog as C
from vitrine.operators import profiles as P
from vitrine.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
WS = r"[\p{Z}\s\x1c-\x1f\x{85}]+"

#: Common table expressions of the oracle, by name, in the order of their dependencies.
CTE = {
    "cat": """SELECT ord, id, title, coalesce(description, '') AS description, coalesce(category, '') AS category, coalesce(subcategories, []) AS subcategories,
        coalesce(list_filter(tags, lambda t: t IS NOT NULL), []) AS tags, coalesce(brand, '') AS brand, price, coalesce(currency, 'USD') AS currency,
        coalesce(popularity_score, 0) AS pop, coalesce(freshness_score, 0) AS fresh, coalesce(image_url, '') AS image_url, coalesce(url, '') AS url
        FROM products QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1""",
    "raw_ev": """SELECT line_no, session_id, pos, e.product_id AS product_id, e.event_type AS event_type FROM
        (SELECT line_no, session_id, unnest(events) AS e, generate_subscripts(events, 1) - 1 AS pos FROM demo_sessions)""",
    "ev": """SELECT *, CASE event_type WHEN 'click' THEN 1.0::double WHEN 'view' THEN 0.2::double WHEN 'favorite' THEN 3.0::double ELSE 4.0::double END AS w
        FROM raw_ev WHERE event_type IN ('click', 'view', 'favorite', 'cart') AND product_id IS NOT NULL""",
    "kev": "SELECT ev.*, category, brand, tags FROM ev JOIN cat ON cat.id = ev.product_id WHERE session_id IS NOT NULL",
    "aff": """SELECT session, kind, key, least(1.0::double, sum(bump)) AS value FROM (
        SELECT session_id AS session, 'category' AS kind, category AS key, CASE event_type WHEN 'click' THEN 0.10::double WHEN 'view' THEN 0.02::double WHEN 'favorite' THEN 0.20::double ELSE 0.25::double END AS bump FROM kev
        UNION ALL SELECT session_id, 'tag', unnest(tags), CASE event_type WHEN 'click' THEN 0.05::double WHEN 'view' THEN 0.01::double WHEN 'favorite' THEN 0.10::double ELSE 0.12::double END FROM kev
        UNION ALL SELECT session_id, 'brand', brand, CASE event_type WHEN 'click' THEN 0.08::double WHEN 'view' THEN 0.02::double WHEN 'favorite' THEN 0.15::double ELSE 0.20::double END FROM kev WHERE brand <> '')
        GROUP BY ALL""",
    "recent": """SELECT session, product_id, row_number() OVER (PARTITION BY session ORDER BY last_at DESC) AS pos
        FROM (SELECT session_id AS session, product_id, max(line_no * 1000000 + pos) AS last_at FROM kev GROUP BY 1, 2) QUALIFY pos <= 50""",
    "vec": """SELECT DISTINCT v.id, cat.ord, v.embedding::double[] AS embedding FROM product_vectors v JOIN cat ON cat.id = v.id,
        (SELECT version, embedding_dim FROM catalog_manifest ORDER BY version DESC LIMIT 1) m
        WHERE v.version = m.version AND len(v.embedding) = m.embedding_dim
        AND len(list_filter(v.embedding, lambda x: x IS NOT NULL AND isfinite(x))) = m.embedding_dim AND len(list_filter(v.embedding, lambda x: x <> 0)) > 0""",
    "eng": "SELECT line_no AS line, product_id, sum(w) AS w FROM ev GROUP BY ALL",
    "nrm": "SELECT product_id, sqrt(sum(w * w)) AS norm FROM eng GROUP BY product_id HAVING sqrt(sum(w * w)) <> 0",
    "cooc_all": """SELECT x.product_id AS id, y.product_id AS neighbor_id, round(sum(x.w * y.w) / (any_value(nx.norm) * any_value(ny.norm)), 6) AS score
        FROM eng x JOIN eng y ON x.line = y.line AND x.product_id <> y.product_id JOIN nrm nx ON nx.product_id = x.product_id
        JOIN nrm ny ON ny.product_id = y.product_id GROUP BY x.product_id, y.product_id""",
    "cooc": "SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbor_id) AS rank FROM cooc_all QUALIFY rank <= 10",
    "stat": "SELECT product_id, count(*) AS event_count, sum(w) AS weighted_score FROM ev GROUP BY product_id",
    "blend": """SELECT cat.id, cat.ord, pop AS before, CASE WHEN weighted_score IS NULL THEN pop ELSE least(1.0::double, pop + 0.5::double *
        CASE WHEN (SELECT max(weighted_score) FROM stat) > 0 THEN least(1.0::double, weighted_score / (SELECT max(weighted_score) FROM stat)) ELSE 0 END) END AS after
        FROM cat LEFT JOIN stat ON stat.product_id = cat.id""",
    "tok": rf"""SELECT ord, id, list_filter(regexp_split_to_array(lower(concat_ws(' ', nullif(title, ''), nullif(category, ''), nullif(array_to_string(tags, ' '), ''), nullif(brand, ''))), '{WS}'), lambda x: x <> '') AS tokens FROM cat""",
    "post": "SELECT term, ord, id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT ord, id, len(tokens) AS dl, unnest(tokens) AS term FROM tok) GROUP BY term, ord, id",
    "raw_idf": "SELECT term, count(*) AS df, ln((SELECT count(*) FROM tok) - count(*) + 0.5::double) - ln(count(*) + 0.5::double) AS raw FROM post GROUP BY term",
    "idf": "SELECT term, df, CASE WHEN raw < 0 THEN 0.25::double * (SELECT avg(raw) FROM raw_idf) ELSE raw END AS idf FROM raw_idf",
    "ask": rf"SELECT id AS q, title AS text FROM cat WHERE ord % 50 = 0 AND trim(title) <> ''",
    "askt": rf"SELECT q, unnest(list_filter(regexp_split_to_array(lower(text), '{WS}'), lambda x: x <> '')) AS term FROM ask",
    "bm": """SELECT q, ord, id, round(sum(idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / (SELECT avg(len(tokens)) FROM tok)))), 6) AS score
        FROM askt JOIN post USING (term) JOIN idf USING (term) GROUP BY q, ord, id HAVING score > 0""",
    "kw": "SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, ord) AS pos FROM bm QUALIFY pos <= 30",
    "vs": "SELECT a.id AS q, b.id, b.ord, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS score FROM vec a JOIN vec b ON true WHERE a.id IN (SELECT q FROM ask)",
    "vk": "SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, ord) AS pos FROM vs QUALIFY pos <= 30",
    "fus": """SELECT q, id, round(sum(1.0::double / (60 + pos)), 9) AS rrf, max(score) FILTER (src = 'kw') AS lexical, max(score) FILTER (src = 'vec') AS semantic,
        max(pos) FILTER (src = 'kw') AS kp, max(pos) FILTER (src = 'vec') AS vp FROM (SELECT 'kw' AS src, * FROM kw UNION ALL SELECT 'vec', * FROM vk) GROUP BY q, id""",
    "fused": "SELECT q, id, rrf, lexical, semantic, row_number() OVER (PARTITION BY q ORDER BY rrf DESC, kp NULLS LAST, vp NULLS LAST) AS pos FROM fus",
    "adm": "SELECT *, CASE WHEN max(rrf) OVER (PARTITION BY q) > 0 THEN 0.2::double * greatest(0, rrf) / max(rrf) OVER (PARTITION BY q) ELSE 0 END AS retrieval FROM fused WHERE coalesce(semantic >= 0.4, false) OR coalesce(lexical > 0, false)",
    "seed": "SELECT id AS q, id AS seed FROM cat WHERE ord % 50 = 0",
    "sess": "SELECT DISTINCT session_id AS q FROM demo_sessions WHERE session_id IS NOT NULL AND line_no % 50 = 0",
}
_NEEDS: dict[str, set[str]] = {}


def _needs(sql: str) -> set[str]:
    import re

    words = set(re.findall(r"[a-z_0-9]+", sql))
    out = set()
    for name in CTE:
        if name in words and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\b\s*(?:WHERE|$)", sql):
            out |= {name} | _NEEDS.setdefault(name, _needs(CTE[name]))
    return out


def sql(text: str) -> str:
    """``text`` behind the common table expressions it needs."""
    used = _needs(text)
    parts = [f"{n} AS ({CTE[n]})" for n in CTE if n in used]
    if text.lstrip().upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, text.lstrip()[5:]])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + text


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return f

    return register


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return C.current(table(spark, d, "products"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return P.session_events(table(spark, d, "demo_sessions"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """``(id, ord, embedding)``: the usable vectors of the current version of catalogue products."""
    now = table(spark, d, "catalog_manifest").orderBy(F.col("version").desc()).select("version", "embedding_dim").first()
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = table(spark, d, "product_vectors").where((F.col("version") == now["version"]) & (F.size("embedding") == now["embedding_dim"]) & fine)
    return rows.select("id", "embedding").dropDuplicates(["id"]).join(catalog(spark, d).select("id", "ord"), "id")


def asked_texts(spark: SparkSession, d: str) -> DataFrame:
    """``(q, text)`` of the search requests."""
    return catalog(spark, d).where("ord % 50 = 0 AND trim(title) <> ''").select(F.col("id").alias("q"), F.col("title").alias("text"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Search requests: titles and vectors of the products whose ``ord`` is divisible by 50, against all products."""
    return asked_texts(spark, d).join(vectors(spark, d).select(F.col("id").alias("q"), "embedding"), "q", "left")


def seeds(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).where("ord % 50 = 0").select(F.col("id").alias("q"), F.col("id").alias("seed"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Recommendation requests: sessions with a line whose number is divisible by 50."""
    return table(spark, d, "demo_sessions").where("session_id IS NOT NULL AND line_no % 50 = 0").select(F.col("session_id").alias("q")).distinct()


def session_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Whole profiles of the requesting sessions."""
    mine = sessions(spark, d).withColumnRenamed("q", "session_id")
    return P.profiles(events(spark, d).join(mine, "session_id", "left_semi"), catalog(spark, d)).withColumnRenamed("session", "q")


def score_sql(source: str, w: tuple[float, ...], limit: int, profile: bool = True, extra: str = "", out_extra: str = "") -> str:
    """Oracle of a scored page: ``source`` gives (q, id, pool_pos, retrieval, similarity, cooccurrence)."""
    pop, ca, ta, br, fr, pen, sim, coo = (f"{x}::double" for x in w)
    if profile:
        match = """coalesce((SELECT value FROM aff WHERE aff.session = s.q AND kind = 'category' AND key = cat.category), 0) AS m_cat,
            coalesce((SELECT sum(value) FROM (SELECT unnest(cat.tags) AS t) x JOIN aff ON aff.session = s.q AND kind = 'tag' AND key = x.t), 0) / greatest(1, len(cat.tags)) AS m_tag,
            CASE WHEN cat.brand <> '' THEN coalesce((SELECT value FROM aff WHERE aff.session = s.q AND kind = 'brand' AND key = cat.brand), 0) ELSE 0 END AS m_brand,
            CASE WHEN EXISTS (SELECT 1 FROM recent r WHERE r.session = s.q AND r.product_id = s.id) THEN 1 ELSE 0 END AS m_pen"""
    else:
        match = "0::double AS m_cat, 0::double AS m_tag, 0::double AS m_brand, 0 AS m_pen"
    return f"""WITH src AS ({source}), facts AS (SELECT s.*, cat.pop, cat.fresh, {match} FROM src s JOIN cat ON cat.id = s.id {extra}),
        sc AS (SELECT q, id, pool_pos, round(retrieval + {pop} * pop + {ca} * m_cat + {ta} * m_tag + {br} * m_brand + {fr} * fresh + {sim} * similarity + {coo} * cooccurrence - {pen} * m_pen, 9) AS score,
            round(retrieval, 9) AS retrieval, round({pop} * pop, 9) AS popularity, round({ca} * m_cat, 9) AS category_match, round({ta} * m_tag, 9) AS tag_match, round({br} * m_brand, 9) AS brand_match,
            round({fr} * fresh, 9) AS freshness, round({sim} * similarity, 9) AS similarity, round({coo} * cooccurrence, 9) AS cooccurrence, round({pen} * m_pen, 9) AS repetition_penalty {out_extra} FROM facts)
        SELECT * EXCLUDE (pool_pos), CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, pool_pos) AS INTEGER) AS pos FROM sc QUALIFY pos <= {limit}"""
