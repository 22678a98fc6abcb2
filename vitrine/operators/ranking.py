"""Scoring, candidate pools and the recommendation strategies; one plan answers many requests.

Requests carry a key ``q``.  A profile, where a request has one, is a row of
``operators.profiles.profiles`` with its session named ``q``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.config import RECENT_CAP, RETRIEVAL_WEIGHT, RankingConfig, Strategy, Weights
from vitrine.functions import scalars as S
from vitrine.operators import best
from vitrine.operators import catalog as C
from vitrine.operators import retrieval as R
from vitrine.runtime import cut

#: The parts of a score, in the order in which they are reported.
COMPONENTS = ["retrieval", "popularity", "category_match", "tag_match", "brand_match", "freshness", "similarity", "cooccurrence", "repetition_penalty"]
#: Digits of reported scores; products of weights and stored scores have fewer, so engines never round a tie apart.
DIGITS = 9


def _lookup(m: str, key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col(m), key), F.lit(0.0))


def _affinity_parts() -> dict[str, Column]:
    """What a profile's maps say of a product; the mean over its tags counts misses and repeats."""
    tags = F.aggregate("tags", F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(F.col("m_tag"), t), F.lit(0.0)))
    return {
        "category_match": _lookup("m_category", F.col("category")),
        "tag_match": F.when(F.size("tags") > 0, tags / F.size("tags")).otherwise(0.0),
        "brand_match": F.when(F.col("brand") != "", _lookup("m_brand", F.col("brand"))).otherwise(0.0),
    }


def with_profile(rows: DataFrame, profiles: DataFrame | None) -> DataFrame:
    """Rows with the maps of their request's profile; null where there is none."""
    if profiles is None:
        none = F.lit(None).cast("map<string,double>")
        return rows.withColumns({"m_category": none, "m_tag": none, "m_brand": none, "recent": F.lit(None).cast("array<string>")})
    p = profiles.select("q", F.col("category").alias("m_category"), F.col("tag").alias("m_tag"), F.col("brand").alias("m_brand"), "recent")
    return rows.join(p, "q", "left")


def score(candidates: DataFrame, catalog: DataFrame, weights: Weights, profiles: DataFrame | None = None, raw: bool = False) -> DataFrame:
    """``(q, id, pool_pos, score, components...)`` of candidates ``(q, id, pool_pos[, retrieval, similarity, cooccurrence, matches])``.

    Candidates outside the catalogue drop out.  The penalty is reported as a positive
    amount and taken off the score.  ``raw`` leaves rounding the components to ``rounded``,
    for the few rows of a page."""
    for c in ("retrieval", "similarity", "cooccurrence"):
        if c not in candidates.columns:
            candidates = candidates.withColumn(c, F.lit(0.0))
    facts = catalog.select("id", "category", "tags", "brand", "popularity_score", "freshness_score")
    rows = candidates.join(facts, "id")
    if "tag_match" in candidates.columns:  # the pool brought them along
        match = {c: F.col(c) for c in ("category_match", "tag_match", "brand_match")}
        rows = rows.join(profiles.select("q", "recent"), "q", "left")
    else:
        rows, match = with_profile(rows, profiles), _affinity_parts()
    parts = {
        "retrieval": F.col("retrieval"),
        "popularity": weights.popularity * F.col("popularity_score"),
        "category_match": weights.category * match["category_match"],
        "tag_match": weights.tag * match["tag_match"],
        "brand_match": weights.brand * match["brand_match"],
        "freshness": weights.freshness * F.col("freshness_score"),
        "similarity": weights.similarity * F.col("similarity"),
        "cooccurrence": weights.cooccurrence * F.col("cooccurrence"),
        "repetition_penalty": F.when(F.coalesce(F.array_contains("recent", F.col("id")), F.lit(False)), float(weights.repetition_penalty)).otherwise(0.0),
    }
    named = rows.select("q", "id", "pool_pos", _total(parts).alias("score"), *[parts[c].alias(c) for c in COMPONENTS])
    return named if raw else rounded(named)


def rounded(scored: DataFrame) -> DataFrame:
    return scored.withColumns({c: F.round(c, DIGITS) for c in COMPONENTS})


def _total(parts: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for c in COMPONENTS:
        total = total - parts[c] if c == "repetition_penalty" else total + parts[c]
    return F.round(total, DIGITS)


def page(scored: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of each request by score, ties in the order of the pool."""
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "pool_pos")
    return scored.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit).drop("pool_pos")


def affinity_matches(catalog: DataFrame, profiles: DataFrame, weights: Weights, page: int | None = None) -> DataFrame:
    """``(q, id, ord, category_match, tag_match, brand_match)`` of the products with a positive affinity.

    A product matches through its category, a tag or its brand, so matches come from
    joins on those keys and no request meets the whole catalogue.

    With ``page``, only those come that can reach a page of so many: the best by the score
    without its penalty, one page more than the penalty can push off it."""
    if page is not None:
        near = _best_liked(catalog, profiles, weights, page + RECENT_CAP)
        rows = with_profile(near.join(catalog.select("id", "ord", "category", "tags", "brand"), "id"), profiles)
        return rows.select("q", "id", "ord", *[c.alias(name) for name, c in _affinity_parts().items()])
    catalog = catalog.select("id", "ord", "category", "tags", "brand")
    pairs = lambda kind: F.transform(F.map_entries(kind), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("key"), e["value"].alias("value")))
    exploded = lambda entries: profiles.select("q", F.explode(entries).alias("e")).select("q", "e.kind", "e.key", "e.value").where("value > 0")
    liked = exploded(pairs("category")).select("q", F.col("key").alias("category"), F.col("value").alias("category_match"))
    used = [kind for kind, w in (("tag", weights.tag), ("brand", weights.brand)) if w > 0]
    wanted = exploded(F.concat(*map(pairs, used)) if used else F.array().cast("array<struct<kind:string,key:string,value:double>>"))
    entry = lambda kind, key, share: F.struct(F.lit(kind).alias("kind"), key.alias("key"), share.alias("share"))
    one, each = F.lit(1.0), 1.0 / F.greatest(F.size("tags"), F.lit(1))
    # A tag a product has twice counts twice, as it does in the mean.
    keys = F.concat(F.transform("tags", lambda t: entry("tag", t, each)), F.array(entry("brand", F.col("brand"), one)))
    offered = catalog.select("id", "ord", "category", F.explode(keys).alias("k")).select("id", "ord", "category", "k.kind", "k.key", "k.share").where("kind <> 'brand' OR key <> ''")
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("value") * F.col("share")).otherwise(0.0)).alias(f"{kind}_match")
    by_keys = wanted.join(offered, ["kind", "key"]).groupBy("q", "id", "ord", "category").agg(part("tag"), part("brand"))
    if weights.category <= 0:
        return by_keys.select("q", "id", "ord", F.lit(0.0).alias("category_match"), "tag_match", "brand_match")
    none = {"tag_match": F.lit(0.0), "brand_match": F.lit(0.0)}
    both = by_keys.unionByName(liked.join(catalog.select("id", "ord", "category"), "category").select("q", "id", "ord", "category").withColumns(none))
    summed = both.groupBy("q", "id", "ord", "category").agg(F.sum("tag_match").alias("tag_match"), F.sum("brand_match").alias("brand_match"))
    matched = summed.join(liked, ["q", "category"], "left").withColumn("category_match", F.coalesce("category_match", F.lit(0.0)))
    return matched.select("q", "id", "ord", "category_match", "tag_match", "brand_match")


def _best_liked(catalog: DataFrame, profiles: DataFrame, weights: Weights, k: int, block: int = R.BLOCK) -> DataFrame:
    """``(q, id)``: the ``k`` products of greatest score, without its penalty, among those with a positive affinity.

    A common tag matches a good part of the catalogue for most profiles, so the pairs never
    leave the tasks: profiles go out in blocks, and a task keeps the best ``k`` of each."""
    kinds = {kind: w for kind, w in (("category", weights.category), ("tag", weights.tag), ("brand", weights.brand)) if w > 0}
    if not kinds:
        return profiles.join(catalog.select("id")).select("q", "id").limit(0)
    term = lambda kind, key: F.concat(F.lit(kind + "\0"), key)
    entries = lambda kind, w: F.transform(F.map_entries(kind), lambda e: F.struct(term(kind, e["key"]).alias("term"), (w * e["value"]).alias("value")))
    likes = F.concat(*[entries(kind, w) for kind, w in kinds.items()])
    asked = profiles.select("q", F.filter(likes, lambda e: e["value"] > 0).alias("likes"))
    has = {
        "category": F.array(term("category", F.col("category"))), "tag": F.transform("tags", lambda t: term("tag", t)),
        "brand": F.when(F.col("brand") != "", F.array(term("brand", F.col("brand")))).otherwise(F.array().cast("array<string>")),
    }
    bias = weights.popularity * F.col("popularity_score") + weights.freshness * F.col("freshness_score")
    rows = catalog.select(F.col("id").alias("doc"), F.col("ord").cast("long").alias("ord"), F.concat(*[has[kind] for kind in kinds]).alias("tokens"), F.size("tags").alias("size"), bias.alias("bias"))
    rows = R.wide(rows).sortWithinPartitions(F.col("bias").desc())
    schema = f"q {dict(profiles.dtypes)['q']}, doc {dict(catalog.dtypes)['id']}, ord long, score double"
    q_type, doc_type = R.arrow(profiles, "q"), R.arrow(catalog, "id")

    def search(part: list) -> DataFrame:
        terms = sorted({e["term"] for _, likes in part for e in likes})
        number = {t: i for i, t in enumerate(terms)}
        starts = np.cumsum([0, *(len(likes) for _, likes in part)])
        which = np.asarray([number[e["term"]] for _, likes in part for e in likes], np.int64)
        each = np.asarray([e["value"] for _, likes in part for e in likes], np.float64)
        share = best.shared(np.asarray([t.startswith("tag\0") for t in terms], bool))
        run = best.matching(pa.array([q for q, _ in part], q_type), starts, which, each, terms, share, k, DIGITS, doc_type, 1e-300)
        return R.top_k(rows.mapInArrow(run, schema), k, "ord").select("q", F.col("doc").alias("id"))

    return R.in_blocks(asked, "likes", block, search, R.top_k(catalog.sparkSession.createDataFrame([], schema), k, "ord").select("q", F.col("doc").alias("id")))


def affinity_pool(requests: DataFrame, catalog: DataFrame, profiles: DataFrame, limit: int, weights: Weights) -> DataFrame:
    """``(q, id, pool_pos, matches...)``: all matches that can reach a page of ``limit`` where there are so many
    or more, else these and the most popular products behind them; the latter alone for requests without a profile."""
    matches = cut(affinity_matches(catalog, profiles, weights, limit))  # read three times below
    enough = matches.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
    few = requests.select("q").join(enough, "q", "left_anti")
    top = F.broadcast(C.top_by(catalog, "popularity_score", 5 * limit).select("id", (F.col("pos") + F.lit(1 << 40)).alias("pool_pos")))  # 5 * limit rows
    filled = few.join(top).join(matches.select("q", "id"), ["q", "id"], "left_anti")
    none = {c: F.lit(0.0) for c in ("category_match", "tag_match", "brand_match")}
    return matches.withColumnRenamed("ord", "pool_pos").unionByName(filled.withColumns(none))


def fixed_pool(requests: DataFrame, catalog: DataFrame, by: str, limit: int) -> DataFrame:
    """``(q, id, pool_pos)``: the ``5 * limit`` products best by a stored score, the same for every request."""
    top = F.broadcast(C.top_by(catalog, by, 5 * limit).select("id", F.col("pos").alias("pool_pos")))  # 5 * limit rows
    return requests.select("q").join(top)


def seed_pool(requests: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """``(q, id, pool_pos, similarity)``: the ``5 * limit`` vectors nearest to the seed, itself apart.

    ``requests(q, seed)``; a seed without a vector has no candidates."""
    return near_pool(requests, seed_neighbours(requests, vectors, limit), limit)


def seed_neighbours(requests: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """``(q, doc, score, pos)``: what ``seed_pool`` brings for each distinct seed; strategies on the same seeds can share it."""
    seeds = requests.select("seed").distinct()
    asked = seeds.join(vectors.select(F.col("id").alias("seed"), "embedding"), "seed").select(F.col("seed").alias("q"), "embedding")
    return R.knn(vectors.select(F.col("id").alias("doc"), "ord", "embedding"), asked, 5 * limit, exclude_self=True)


def near_pool(requests: DataFrame, near: DataFrame, limit: int) -> DataFrame:
    near = near.where(F.col("pos") <= 5 * limit)
    return requests.select("q", "seed").join(near.withColumnRenamed("q", "seed"), "seed").select("q", F.col("doc").alias("id"), F.col("pos").alias("pool_pos"), F.col("score").alias("similarity"))


def together_pool(requests: DataFrame, neighbors: DataFrame, top_k: int | None) -> DataFrame:
    """``(q, id, pool_pos, cooccurrence)``: the seed's stored neighbours, the first ``top_k`` of them; none for an unknown seed."""
    rows = neighbors if top_k is None else neighbors.where(F.col("rank") <= top_k)
    near = rows.select(F.col("id").alias("seed"), F.col("neighbor_id").alias("id"), F.col("rank").alias("pool_pos"), F.col("score").alias("cooccurrence"))
    return requests.select("q", "seed").join(near, "seed").select("q", "id", "pool_pos", "cooccurrence")


def recommend(
    strategy: str, requests: DataFrame, catalog: DataFrame, limit: int = 10, profiles: DataFrame | None = None, vectors: DataFrame | None = None,
    neighbors: DataFrame | None = None, config: RankingConfig | None = None, near: DataFrame | None = None,
) -> DataFrame:
    """The page of a named strategy for ``requests(q[, seed])``; ``near`` are kept ``seed_neighbours`` for its limit or more.

    Raises ``KeyError`` for an unknown strategy and ``ValueError`` where one that starts
    from a seed gets none, or a limit is outside 1..100."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    chosen: Strategy = (config or RankingConfig()).strategy(strategy)
    if chosen.needs_seed and "seed" not in requests.columns:
        raise ValueError(f"strategy {strategy!r} needs a seed product")
    kind = chosen.policy.value
    if kind == "popularity":
        pool = fixed_pool(requests, catalog, "popularity_score", limit)
    elif kind == "freshness":
        pool = fixed_pool(requests, catalog, "freshness_score", limit)
    elif kind == "vector_similarity":
        pool = seed_pool(requests, vectors, limit) if near is None else near_pool(requests, near, limit)
    elif kind == "co_occurrence":
        pool = together_pool(requests, neighbors, chosen.top_k)
    elif profiles is None:
        pool = fixed_pool(requests, catalog, "popularity_score", limit)
    else:
        profiles = cut(profiles)
        pool = affinity_pool(requests, catalog, profiles, limit, chosen.weights)
    return rounded(page(score(pool, catalog, chosen.weights, profiles, raw=True), limit))


def keyword_index(catalog: DataFrame, kept: bool = False) -> R.Index:
    """The index of the catalogue's texts; ``kept`` writes it once for several searches."""
    docs = catalog.select(F.col("id").alias("doc"), "ord", S.product_tokens().alias("tokens"))
    return R.index(cut(docs) if kept else docs, kept)


def hybrid(queries: DataFrame, catalog: DataFrame, vectors: DataFrame, limit: int = 10, index: R.Index | None = None) -> DataFrame:
    """Fused hits ``(q, id, rrf, lexical, semantic, pos)`` for ``queries(q, text, embedding)``; blank queries find nothing."""
    width = max(3 * limit, 30)
    asked = cut(queries.where(F.trim("text") != "").select("q", "text", "embedding"))
    kw = R.keyword_search(index or keyword_index(catalog), asked.select("q", S.tokens(F.col("text")).alias("tokens")), width)
    vec = R.knn(vectors.select(F.col("id").alias("doc"), "ord", "embedding"), asked.where("embedding is not null"), width)
    return R.fuse(kw, vec).withColumnRenamed("doc", "id")


def search(
    queries: DataFrame, catalog: DataFrame, vectors: DataFrame, limit: int = 10, category: str | None = None, profiles: DataFrame | None = None, weights: Weights | None = None,
    index: R.Index | None = None,
) -> DataFrame:
    """The page of a search with ``total``, the number of products that had evidence; ``index`` is a kept ``keyword_index``.

    The category is filtered after ranking: it neither widens retrieval nor changes the total."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    weights = weights or RankingConfig().weights
    known = hybrid(queries, catalog, vectors, limit, index).join(catalog.select("id"), "id", "left_semi")
    kept = R.retrieval_term(R.admitted(known), RETRIEVAL_WEIGHT)
    scored = score(kept.select("q", "id", F.col("pos").alias("pool_pos"), "retrieval"), catalog, weights, profiles, raw=True)
    total = scored.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("q")))
    if category:
        total = total.join(catalog.select("id", F.col("category").alias("cat")), "id").where(F.col("cat") == category).drop("cat")
    return rounded(page(total, limit))


def rails(parts: dict[str, DataFrame]) -> DataFrame:
    """Several pages under their names; a rail without rows isn't there."""
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("rail"), "q", "id", "pos", "score")
        out = rows if out is None else out.unionByName(rows)
    return out
