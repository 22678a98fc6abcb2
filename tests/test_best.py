"""The best of each query, found in the tasks, must be what ranking all pairs gives, and no more may leave a task."""

import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vitrine.operators import best
from vitrine.operators import retrieval as R


def _documents(spark, n=700):
    rng = random.Random(5)
    words = ["the"] * 6 + ["red"] * 3 + [f"w{i}" for i in range(40)]
    return spark.createDataFrame([(f"d{i}", i, rng.choices(words, k=rng.randint(0, 9))) for i in range(n)], "doc string, ord long, tokens array<string>").repartition(3)


def test_keyword_search_is_the_ranking_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(best, "DOCS", 100)
    docs = _documents(spark)
    asked = docs.where("ord % 7 = 0").select(F.concat(F.lit("q"), "doc").alias("q"), "tokens").union(spark.createDataFrame([("none", ["gone"]), ("twice", ["w1", "w1", "the"])], "q string, tokens array<string>"))
    whole = R.top_k(R.bm25(R.index(docs.select(F.struct("ord", "doc").alias("doc"), "tokens")), asked), 6)
    want = sorted(map(tuple, whole.select("q", "doc.doc", "score", "pos").collect()))
    for block in (1000, 30):
        got = sorted(map(tuple, R.keyword_search(R.index(docs), asked, 6, block=block).collect()))
        assert [(q, d, p) for q, d, _, p in got] == [(q, d, p) for q, d, _, p in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-6)
    assert len(want) > 400 and R.keyword_search(R.index(docs), asked.limit(0), 6).count() == 0
    assert R.keyword_search(R.index(docs.limit(0)), asked, 6).count() == 0


def test_a_task_keeps_k_documents_however_many_match():
    n, batches = 5000, []
    for at in range(0, n, 1000):
        ids = [f"d{i}" for i in range(at, at + 1000)]
        batches.append(pa.RecordBatch.from_pydict({"doc": ids, "ord": list(range(at, at + 1000)), "tokens": [["the"]] * 1000, "size": [1] * 1000, "bias": [0.0] * 1000}))
    run = best.matching(pa.array(["a", "b"]), np.array([0, 1, 2]), np.array([0, 0]), np.array([1.0, 2.0]), ["the"], best.bm25_part(1.5, 0.75, 1.0), 4, 6, pa.string(), 1e-7)
    out = pa.Table.from_batches(list(run(iter(batches))))
    assert sorted(zip(out["q"].to_pylist(), out["ord"].to_pylist())) == [(q, i) for q in "ab" for i in range(4)]


def test_nearest_in_a_task(monkeypatch):
    monkeypatch.setattr(best, "VECTORS", 50)
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (900, 3)).astype(float)  # many ties, and zero vectors
    q = rng.integers(-3, 4, (40, 3)).astype(float)
    ids = pa.array([f"d{i}" for i in range(40)])
    batches = [pa.RecordBatch.from_pydict({"doc": [f"d{i}" for i in range(at, at + 300)], "ord": [-i for i in range(at, at + 300)], "embedding": x[at : at + 300].tolist()}) for at in range(0, 900, 300)]
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for exclude in (False, True):
        out = pa.Table.from_batches(list(best.nearest(ids, q, 7, 6, exclude, pa.string())(iter(batches)))).to_pylist()
        s = np.round(unit(q) @ unit(x).T, 6)
        for i in range(40):
            order = [j for j in np.lexsort((-np.arange(900), -s[i])) if not (exclude and j == i)][:7]
            assert [f"d{j}" for j in order] == [r["doc"] for r in sorted((r for r in out if r["q"] == f"d{i}"), key=lambda r: (-r["score"], r["ord"]))]


def test_liked_products_in_blocks_of_profiles(spark):
    from test_operators import catalog, events

    from vitrine.config import DEFAULT_WEIGHTS
    from vitrine.operators import profiles as P
    from vitrine.operators import ranking as K

    rng = random.Random(8)
    cat = catalog(spark, [(f"p{i:03d}", rng.choice("xyz"), rng.choices(["t", "u", "v", "w"], k=rng.randint(0, 3)), rng.choice(["", "m", "n"]), round(rng.random(), 2), round(rng.random(), 2)) for i in range(300)])
    log = events(spark, [(f"s{n}", [(f"p{rng.randrange(300):03d}", "cart") for _ in range(1 + n % 4)]) for n in range(9)])
    prof = P.profiles(log, cat).withColumnRenamed("session", "q")
    whole = K.affinity_matches(cat, prof, DEFAULT_WEIGHTS).withColumnRenamed("ord", "pool_pos")
    free = replace(DEFAULT_WEIGHTS, repetition_penalty=0.0)
    want = {tuple(r) for r in K.page(K.score(whole, cat, free, prof), 12).select("q", "id").collect()}
    for block in (100, 2):
        got = [tuple(r) for r in K._best_liked(cat, prof, DEFAULT_WEIGHTS, 12, block).collect()]
        assert set(got) == want and len(got) == len(want) > 90
    pages = lambda pool: sorted(map(tuple, K.page(K.score(pool, cat, DEFAULT_WEIGHTS, prof), 5).collect()))
    some = K.affinity_matches(cat, prof, DEFAULT_WEIGHTS, 5).withColumnRenamed("ord", "pool_pos")
    assert pages(some) == pages(whole) and some.groupBy("q").count().agg(F.max("count")).first()[0] <= 55


def test_neighbours_of_some_products_only(spark):
    from vitrine.operators import together as G

    rng = random.Random(9)
    eng = spark.createDataFrame([(line, f"p{p}", float(rng.randint(1, 9))) for line in range(30) for p in rng.sample(range(40), 8)], "line long, product_id string, w double")
    of = spark.createDataFrame([("p1",), ("p2",), ("gone",)], "product_id string")
    want = sorted(map(tuple, G.cosines(eng).where("id IN ('p1', 'p2')").collect()))
    assert want and want == sorted(map(tuple, G.cosines(eng, of=of).collect()))
    assert 0 < G.dots(eng, of=of).count() < G.dots(eng).count()
