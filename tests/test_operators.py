"""Operators on hand-checked cases."""

import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.config import BUMPS, RankingConfig, Weights
from vitrine.functions import scalars as S
from vitrine.operators import catalog as C
from vitrine.operators import evaluation as V
from vitrine.operators import profiles as P
from vitrine.operators import ranking as K
from vitrine.operators import retrieval as R
from vitrine.operators import telemetry as T
from vitrine.operators import together as G

CATALOG = "ord long, id string, title string, description string, category string, subcategories array<string>, tags array<string>, brand string, price double, currency string, popularity_score double, freshness_score double, image_url string, url string, attributes map<string,string>"


def catalog(spark, rows):
    """Rows of (id, category, tags, brand, popularity, freshness)."""
    full = [(i, r[0], f"title {r[0]}", "d", r[1], [], r[2], r[3], 1.0, None, r[4], r[5], "i", "u", None) for i, r in enumerate(rows)]
    return C.current(spark.createDataFrame(full, CATALOG))


def events(spark, lines):
    rows = [(n, s, p, product, kind) for n, (s, evs) in enumerate(lines) for p, (product, kind) in enumerate(evs)]
    return spark.createDataFrame(rows, "line_no long, session_id string, pos int, product_id string, event_type string")


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


DOCS = {"a": "shirt polo red", "b": "shirt golf blue", "c": "shirt cotton men", "d": "shirt running", "e": "shoes women"}


@pytest.mark.parametrize(
    "query,want",
    [
        ("shirt", {"d": 0.24518385841520043, "a": 0.20549582377964642, "b": 0.20549582377964642, "c": 0.20549582377964642}),
        ("polo", {"a": 1.0274791188982322}),
        ("shirt polo", {"a": 1.2329749426778787, "d": 0.24518385841520043, "b": 0.20549582377964642, "c": 0.20549582377964642}),
        ("nothing", {}),
    ],
)
def test_bm25(spark, query, want):
    docs = R.documents(spark.createDataFrame(list(DOCS.items()), "id string, text string"), "id", S.tokens(F.col("text")))
    q = spark.createDataFrame([("q", query)], "q string, text string").select("q", S.tokens(F.col("text")).alias("tokens"))
    got = R.top_k(R.bm25(docs, q, digits=15), 10).orderBy("pos").collect()
    assert [(r["doc"], pytest.approx(r["score"], rel=1e-9)) for r in got] == list(want.items())


def test_bm25_repeated_term_and_empty_corpus(spark):
    docs = R.documents(spark.createDataFrame(list(DOCS.items()), "id string, text string"), "id", S.tokens(F.col("text")))
    once, twice = (spark.createDataFrame([("q", t)], "q string, tokens array<string>") for t in (["polo"], ["polo", "polo"]))
    assert R.bm25(docs, twice).first()["score"] == pytest.approx(2 * R.bm25(docs, once).first()["score"], abs=2e-6)
    assert R.bm25(docs.limit(0), once).count() == 0


def ranked(spark, lists):
    return spark.createDataFrame([("q", d, 1.0 - 0.1 * i, i + 1) for i, d in enumerate(lists)], "q string, doc string, score double, pos int")


def test_fusion(spark):
    got = [r["doc"] for r in R.fuse(ranked(spark, "abc"), ranked(spark, "bda")).orderBy("pos").collect()]
    assert got[0] == "b" and got[1] == "a" and sorted(got) == list("abcd")
    assert [r["doc"] for r in R.fuse(ranked(spark, "ab"), ranked(spark, "")).orderBy("pos").collect()] == ["a", "b"]
    assert [r["doc"] for r in R.fuse(ranked(spark, "a"), ranked(spark, "b")).orderBy("pos").collect()] == ["a", "b"]


@pytest.mark.parametrize("semantic,lexical,keep", [(0.3999, None, False), (0.4, None, True), (0.05, 0.9, True), (0.05, 0.0, False), (None, None, False)])
def test_floor(spark, semantic, lexical, keep):
    rows = spark.createDataFrame([("q", semantic, lexical)], "q string, semantic double, lexical double")
    assert (R.admitted(rows).count() == 1) is keep


def test_retrieval_is_renormalised_after_the_floor(spark):
    rows = spark.createDataFrame([("q", "x", 100.0, 0.1, None), ("q", "y", 10.0, 0.9, None)], "q string, doc string, rrf double, semantic double, lexical double")
    assert [(r["doc"], r["retrieval"]) for r in R.retrieval_term(R.admitted(rows), 0.2).collect()] == [("y", 0.2)]


def test_knn(spark):
    v = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [2.0, 0.0]), ("c", 2, [0.0, 0.0]), ("d", 3, [-1.0, 0.0])], "doc string, ord long, embedding array<float>")
    q = v.where("doc = 'a'").select(F.col("doc").alias("q"), "embedding")
    assert [(r["doc"], r["score"]) for r in R.knn(v, q, 3).orderBy("pos").collect()] == [("a", 1.0), ("b", 1.0), ("c", 0.0)]
    assert [r["doc"] for r in R.knn(v, q, 3, exclude_self=True).orderBy("pos").collect()] == ["b", "c", "d"]
    assert R.knn(v, q.limit(0), 3).count() == 0
    two = R.knn(v, v.select(F.col("doc").alias("q"), "embedding"), 2, block=1)
    assert two.count() == 8


def test_cooccurrence(spark):
    e = events(spark, [("s1", [("A", "click"), ("B", "click")]), ("s2", [("A", "click"), ("B", "click")]), ("s3", [("A", "click"), ("C", "click")]), ("s4", [("Z", "click")])])
    got = {(r["id"], r["neighbor_id"]): r["score"] for r in G.cooccurrence(e).collect()}
    assert got[("A", "B")] == got[("B", "A")] == pytest.approx(2 / math.sqrt(6), abs=1e-6)
    assert all(a != b for a, b in got) and not any("Z" in k for k in got)
    hub = events(spark, [("s", [("hub", "cart"), (f"p{i:02d}", "click")]) for i in range(15)])
    assert G.cooccurrence(hub).where("id = 'hub'").count() == 10
    again = events(spark, [("s", [("A", "click"), ("A", "click"), ("B", "click")])])
    assert G.cooccurrence(again).first()["score"] == 1.0


def test_changed_edges(spark):
    schema = "id string, neighbor_id string, score double"
    before, after = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.5), ("a", "x", 0.1)], schema), spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.6), ("a", "d", 0.1)], schema)
    assert sorted(r["neighbor_id"] for r in G.changed_edges(before, after).collect()) == ["c", "d"]


def test_engagement_and_blend(spark):
    e = events(spark, [("s", [("P1", "click"), ("P1", "click"), ("P1", "favorite"), ("P2", "view"), (None, "click"), ("P1", "odd")])])
    stats = {r["product_id"]: (r["event_count"], r["weighted_score"]) for r in P.engagement(e).collect()}
    assert stats == {"P1": (3, 5.0), "P2": (1, 0.2)}
    cat = catalog(spark, [("P1", "c", [], "", 0.2, 0.0), ("P2", "c", [], "", 0.0, 0.0), ("P3", "c", [], "", 0.9, 0.0)])
    after = {r["id"]: r["after"] for r in P.blended_popularity(cat, P.engagement(e), 0.5).collect()}
    assert after == {"P1": pytest.approx(0.7), "P2": pytest.approx(0.02), "P3": 0.9}
    assert P.rejected(e).count() == 2
    assert {r["after"] for r in P.blended_popularity(cat, P.engagement(e.limit(0))).collect()} == {0.2, 0.0, 0.9}


def fold(rows, products):
    value = {}
    for product, kind in rows:
        p, b = products[product], BUMPS[kind]
        keys = [("category", p[1], b.category)] + [("tag", t, b.tag) for t in p[2]] + ([("brand", p[3], b.brand)] if p[3] else [])
        for k, key, bump in keys:
            value[k, key] = min(1.0, value.get((k, key), 0.0) + bump)
    return value


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(list(BUMPS))), max_size=25))
def test_profile_equals_the_fold(spark, rows):
    products = {"a": ("a", "x", ["t", "t", "u"], "m"), "b": ("b", "y", [], ""), "c": ("c", "x", ["u"], "n")}
    cat = catalog(spark, [(*p, 0.1, 0.1) for p in products.values()])
    got = {(r["kind"], r["key"]): r["value"] for r in P.affinities(events(spark, [("s", rows)]), cat).collect()}
    want = fold(rows, products)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_recent_products_and_clicks(spark):
    cat = catalog(spark, [(f"p{i}", "c", [], "", 0.1, 0.1) for i in range(60)])
    e = events(spark, [("s", [(f"p{i}", "view") for i in range(60)]), ("s", [("p3", "click"), ("zz", "click")])])
    got = [r["product_id"] for r in P.recently_viewed(e, cat).orderBy("pos").collect()]
    assert len(got) == 50 and got[:2] == ["p3", "p59"]
    assert P.clicks(e, cat).first()["click_count"] == 1
    assert P.once_per_session(events(spark, [("s", [("a", "view"), ("a", "view"), ("a", "click"), ("a", "click"), ("a", None)])])).count() == 4


def pool_catalog(spark):
    return catalog(spark, [(f"e{i:02d}", "Electronics", [], "", i / 100, 0.0) for i in range(50)] + [(f"c{i:02d}", "Clothing", [], "", 0.0, i / 20) for i in range(20)])


def test_pools(spark):
    cat, ask = pool_catalog(spark), spark.createDataFrame([("s",)], "q string")
    assert K.fixed_pool(ask, cat, "popularity_score", 2).count() == 10
    prof = P.profiles(events(spark, [("s", [("c00", "cart")])]), cat).withColumnRenamed("session", "q")
    w = RankingConfig().weights
    warm = K.affinity_pool(ask, cat, prof, 10, w)
    assert {r["id"][0] for r in warm.collect()} == {"c"} and warm.count() == 20
    few = K.affinity_pool(ask, cat, prof, 25, w)
    assert few.count() == 70 and few.select("id").distinct().count() == 70


def test_recommend(spark):
    cat = catalog(spark, [(f"p{i}", "c", ["t"], "b", i / 20, (20 - i) / 20) for i in range(20)])
    ask = spark.createDataFrame([("q", "p0")], "q string, seed string")
    top = lambda name, **k: [r["id"] for r in K.recommend(name, ask, cat, 3, **k).orderBy("pos").collect()]
    assert top("trending") == ["p19", "p18", "p17"] and top("new_arrivals")[0] == "p0" and top("for_you") == ["p19", "p18", "p17"]
    near = spark.createDataFrame([("p0", "p5", 0.9, 1), ("p0", "gone", 0.8, 2), ("p0", "p6", 0.1, 3), ("p0", "p7", 0.1, 4)], "id string, neighbor_id string, score double, rank int")
    assert top("also_bought", neighbors=near) == ["p5", "p7", "p6"] and top("frequently_bought_together", neighbors=near) == ["p5", "p6"]
    with pytest.raises(KeyError):
        top("nothing")
    with pytest.raises(ValueError):
        K.recommend("similar_items", ask.select("q"), cat)
    with pytest.raises(ValueError):
        K.recommend("trending", ask, cat, 0)


def test_score_components(spark):
    cat = catalog(spark, [("p", "c", ["t", "u"], "b", 0.5, 0.2)])
    cands = spark.createDataFrame([("s", "p", 1)], "q string, id string, pool_pos int")
    prof = P.profiles(events(spark, [("s", [("p", "click")])]), cat).withColumnRenamed("session", "q")
    r = K.score(cands, cat, RankingConfig().weights, prof).first()
    assert (r["popularity"], r["category_match"], r["tag_match"], r["brand_match"], r["freshness"], r["repetition_penalty"]) == (0.2, 0.02, 0.0075, 0.008, 0.02, 0.25)
    assert r["score"] == pytest.approx(0.2 + 0.02 + 0.0075 + 0.008 + 0.02 - 0.25)


def test_metrics(spark):
    r = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("abcd")], "q string, doc string, pos int")
    rel = spark.createDataFrame([("q", "b"), ("q", "d"), ("q", "z"), ("w", "a")], "q string, doc string")
    got = {x["q"]: x for x in V.query_metrics(r, rel, 10).collect()}
    best = sum(1 / math.log2(i + 1) for i in (1, 2, 3))
    assert got["q"]["ndcg"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / best)
    assert (got["q"]["precision"], got["q"]["mrr"]) == (0.2, 0.5) and got["q"]["recall"] == pytest.approx(2 / 3) and got["q"]["ap"] == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert got["w"]["ndcg"] == 0.0


def test_audit(spark):
    cat = catalog(spark, [("P1", "c", [], "", 0.2, 0.0), ("P2", "c", [], "", 0.5, 0.0)])
    e = events(spark, [("s1", [("P1", "cart"), ("P2", "click")]), ("s2", [("P1", "click")])])
    none = spark.createDataFrame([], "id string, neighbor_id string, score double, rank int")
    r = V.audit(e, cat, none, "v1.2").first()
    assert (r["total_events"], r["session_count"], r["moved_products"], r["changed_edges"], r["new_version"]) == (3, 2, 2, 2, "v1.3")
    m = V.movers(P.blended_popularity(cat, P.engagement(e))).first()
    assert (m["product_id"], m["before"], m["after"]) == ("P1", 0.2, 0.7)


def test_scalars(spark):
    assert col(spark, "29.999", S.parse_price) == 30.0 and col(spark, "$1,299.50 each", S.parse_price) == 1299.5 and col(spark, "", S.parse_price) is None and col(spark, None, S.parse_price) is None
    assert col(spark, "1,654 ratings", S.parse_int) == 1654 and col(spark, None, S.parse_int) == 0 and col(spark, "9" * 40, S.parse_int) == 0
    assert col(spark, "['a.jpg', 'b']", S.first_image) == "a.jpg" and col(spark, "[broken", S.first_image) == "" and col(spark, None, S.first_image) == ""
    assert tuple(col(spark, " A > B > C ", S.category_levels)) == ("A", ["B", "C"]) and tuple(col(spark, "", S.category_levels)) == ("Unknown", [])
    assert tuple(col(spark, "A › B", S.breadcrumbs)) == ("A", ["B"]) and tuple(col(spark, None, S.breadcrumbs)) == ("Uncategorized", [])
    assert [col(spark, v, S.bump_version) for v in ("v1", "v1.2", "v9", "2024Z")] == ["v2", "v1.3", "v10", "2024Z-r2"] == [S.next_version(v) for v in ("v1", "v1.2", "v9", "2024Z")]
    assert col(spark, "home & kitchen-aid iPod", S.title_case) == "Home & Kitchen-Aid IPod"
    assert col(spark, "2000-01-11", S.recency_days) == 10 and col(spark, "soon", S.recency_days) == 0
    assert col(spark, "Home & Kitchen", S.tag_slug) == "home-&-kitchen"
    assert [col(spark, v, lambda c: S.number_or(c, -1)) for v in ("3", "2.5", None, "text", "True")] == [3.0, 2.5, -1.0, -1.0, -1.0]
    assert col(spark, "v1.20.0", S.release_parts) == [1, 20] and col(spark, "1.x", S.release_parts) is None
    assert col(spark, "https://Host:8443/a?b", S.url_origin) == "https://host:8443" and col(spark, "/a", S.url_origin) is None
    kinds = {u: col(spark, u, lambda c: S.classify_resource(c, "https://e.example", "https://e.example/events")) for u in ("/a.png?x=1", "https://e.example/events", "/b", "https://e.example/c", "https://o.example/d")}
    assert list(kinds.values()) == ["image", "uplink", "edge", "edge", "other"]
    assert col(spark, "https://m.example/I/x._AC_SX679_.jpg", lambda c: S.resized_url(c, 300)) == "https://m.example/I/x._SL300_.jpg"
    assert col(spark, 5.0, lambda c: S.normalize_score(c, F.lit(5.0), F.lit(5.0)), "double") == 0.0
    assert col(spark, [3.0, 4.0], S.unit, "array<float>") == [0.6, 0.8] and col(spark, [0.0], S.unit, "array<float>") == [0.0]
    assert col(spark, " Red\x1clamp\x85x ", S.tokens) == ["red", "lamp", "x"]
    assert S.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'.encode()
    assert S.nearly_equal({"a": [1.0, True]}, {"a": [1.0 + 1e-9, True]}) and not S.nearly_equal(1, True) and not S.nearly_equal([1], [1, 2])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=8))
def test_nearly_equal_is_reflexive(values):
    assert S.nearly_equal(values, list(values))


def test_telemetry(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 11)], "k string, v double")
    r = T.percentiles(rows, "v", ["k"]).first()
    assert (r["p50"], r["p95"]) == (5.0, 10.0)
    b = T.batches(spark.createDataFrame([("u", i) for i in range(60)], "u string, t int"), "u", ["t"], 25, 50).orderBy("t").collect()
    assert [x["t"] for x in b] == list(range(10, 60)) and [x["batch"] for x in b] == [0] * 25 + [1] * 25
    v = T.version_verdicts(spark.createDataFrame([("c", n, v) for n, v in enumerate(["1.0", "1.0.0", "1.10", "1.9"])], "c string, n int, v string").withColumn("v2", F.col("v")), "c", "v")
    assert {x["v"]: x["verdict"] for x in v.collect()}["1.0.0"] == "same"
    t = spark.createDataFrame([("u", 0.0), ("u", 3599.999), ("u", 7199.999)], "u string, s double").select("u", F.col("s").cast("timestamp").alias("ts"))
    assert [x["visit"] for x in T.session_expiry(t, "u", "ts").orderBy("ts").collect()] == [1, 1, 2]
    live = T.live_sessions(spark.createDataFrame([("first", 3), ("second", 2), ("third", 4)], "u string, ts int"), "u", "ts", 2)
    assert [x["u"] for x in live.collect()] == ["third", "first"]
    x, y = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "hash string, bytes int"), spark.createDataFrame([("a", 1)], "hash string, bytes int")
    assert tuple(T.sync_stats(x, y).first()) == (1, 1, 2) and [r["hash"] for r in T.missing(x, y, "hash").collect()] == ["b"]
    assert [tuple(r) for r in T.key_difference(x, y, "hash").collect()] == [("b", "left")]


def test_catalog_rows(spark):
    cat = spark.createDataFrame([(0, "a", None, None, "x", None, [None, "t"], None, None, None, None, None, None, None, None), (1, "a", "new", None, "x", None, None, None, None, None, 0.3, None, None, None, None)], CATALOG)
    r = C.current(cat).collect()
    assert len(r) == 1 and (r[0]["title"], r[0]["brand"], r[0]["tags"], r[0]["currency"]) == ("new", "", [], "USD")
    assert C.browse(C.current(cat), "").count() == 1 and C.browse(C.current(cat), "y").count() == 0
    b = C.score_bounds(spark.createDataFrame([], "pop_raw double, fresh_raw double")).first()
    assert tuple(b) == (0.0, 1.0, 0.0, 1.0)


def test_weights_are_checked():
    for bad in (-1, float("nan"), float("inf"), "x"):
        with pytest.raises(ValueError):
            Weights(bad, 0, 0, 0, 0, 0)
    c = RankingConfig()
    assert RankingConfig.from_json(c.to_json()) == c and RankingConfig.from_json("{}").schema_version == 1
    with pytest.raises(ValueError):
        RankingConfig.from_json('{"weights": 3}')


def test_oracle_names_match():
    from vitrine.plans import registry

    assert set(registry.ORACLE) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES and len(registry.QUERIES) > 90
    assert all(a != b for a, b in itertools.combinations(registry.QUERIES, 2))
