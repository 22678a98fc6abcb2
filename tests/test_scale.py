"""What splits, prunes or resends must give what the plain way gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from test_operators import catalog, events
from vitrine import runtime
from vitrine.config import DEFAULT_WEIGHTS, STOP_WORDS
from vitrine.operators import catalog as C
from vitrine.operators import evaluation as V
from vitrine.operators import profiles as P
from vitrine.operators import ranking as K
from vitrine.operators import retrieval as R
from vitrine.operators import telemetry as T
from vitrine.operators import together as G
from vitrine.sources import files
from vitrine.streaming import sessions as W


def test_rows_of_several_files_are_numbered(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2000), ("c", 5)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"id": f"{name}{i:04d}"}) for i in range(n)) + "\n\n")
    got = files.read_products(spark, str(tmp_path / "*.jsonl")).orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(2008)) and [r["id"] for r in got] == sorted(r["id"] for r in got)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        again = files.read_products(spark, str(tmp_path / "*.jsonl")).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["id"] for r in again] == [r["id"] for r in got]
    (tmp_path / "none.jsonl").write_text("\n")
    assert files.read_products(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_lenient_csv_of_a_folder(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text(f'asin,title\n{k}a,"x\ny"\n{k}b,z\n')
    (tmp_path / "_SUCCESS").write_text("")
    spark.dataSource.register(files.LenientCsv)
    for path in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/part-*.csv"):
        got = spark.read.format("lenient_csv").schema("asin string, title string, ord long").load(path).orderBy("ord").collect()
        assert [r["asin"] for r in got] == ["0a", "0b", "1a", "1b", "2a", "2b"] and got[2]["title"] == "x\ny"
    with pytest.raises(Exception):
        spark.read.format("lenient_csv").load(str(tmp_path / "missing.csv")).count()


def test_texts_survive_csv(spark, tmp_path):
    rows = [(1, ' say "hi", '), (2, "two\nlines"), (3, "back\\slash"), (4, None)]
    files.write_csv(spark.createDataFrame(rows, "n int, t string"), str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), "n int, t string").collect())) == rows


def test_long_lines_in_parts(spark):
    rng = random.Random(1)
    eng = spark.createDataFrame([(line, f"p{p:03d}", float(rng.randint(1, 9))) for line, n in enumerate([1, 2, 40, 200]) for p in rng.sample(range(300), n)], "line long, product_id string, w double")
    want = sorted(map(tuple, G.dots(eng, 1000).collect()))
    assert want == sorted(map(tuple, G.dots(eng, 7).collect())) and len(want) > 19_000


def test_pool_without_what_cannot_be_shown(spark):
    rng = random.Random(2)
    cat = catalog(spark, [(f"p{i:03d}", rng.choice("xyz"), rng.sample(["t", "u", "v", "w"], rng.randint(0, 2)), rng.choice(["", "m", "n"]), round(rng.random(), 2), round(rng.random(), 2)) for i in range(400)])
    log = events(spark, [("s", [(f"p{i:03d}", "cart") for i in range(3)]), ("t", [("p009", "view")]), ("u", [("p100", "click")] * 3)])
    prof = P.profiles(log, cat).withColumnRenamed("session", "q")
    whole = K.affinity_matches(cat, prof, DEFAULT_WEIGHTS).withColumnRenamed("ord", "pool_pos")
    want = sorted(map(tuple, K.page(K.score(whole, cat, DEFAULT_WEIGHTS, prof), 5).collect()))
    some = K.affinity_matches(cat, prof, DEFAULT_WEIGHTS, 5).withColumnRenamed("ord", "pool_pos")
    assert want == sorted(map(tuple, K.page(K.score(some, cat, DEFAULT_WEIGHTS, prof), 5).collect()))
    assert some.count() < whole.count()


def test_queries_in_blocks(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(f"d{i}", i, [rng.random() for _ in range(4)]) for i in range(60)], "doc string, ord long, embedding array<double>")
    asked = rows.select(F.col("doc").alias("q"), "embedding")
    one = sorted(map(tuple, R.knn(rows, asked, 3).collect()))
    assert one == sorted(map(tuple, R.knn(rows, asked, 3, block=7).collect())) and len(one) == 180
    assert R.knn(rows, asked.limit(0), 3).count() == 0


def test_index_and_stop_words(spark):
    docs = spark.createDataFrame([(i, ws.split()) for i, ws in enumerate(["red lamp", "the red cable", "blue lamp lamp"])], "doc int, tokens array<string>")
    asked = spark.createDataFrame([("a", ["red", "the", "gone"]), ("b", ["lamp"])], "q string, tokens array<string>")
    assert sorted(map(tuple, R.bm25(docs, asked).collect())) == sorted(map(tuple, R.bm25(R.index(docs, kept=True), asked).collect()))
    got = asked.select(R.without_stop_words(F.col("tokens"), STOP_WORDS).alias("t")).collect()
    assert [r["t"] for r in got] == [["red", "gone"], ["lamp"]]
    assert R.bm25(docs, asked.limit(0)).count() == 0


def test_verdicts(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (2, 7, "b"), (3, 6, "c"), (4, 7, "b"), (5, 7, "x"), (6, None, "y"), (7, 8, "z")], "at int, seq long, i string").withColumn("k", F.lit(1))
    got = {r["at"]: r["verdict"] for r in T.sequence_verdicts(rows, "k", ["at"], "seq", "i").collect()}
    assert got == {1: "first", 2: "fresh", 3: "stale", 4: "same", 5: "stale", 6: "undecidable", 7: "fresh"}
    v = spark.createDataFrame([(1, "v9"), (2, "v10"), (3, "v10.0"), (4, "v2")], "at int, v string").withColumn("k", F.lit(1))
    assert {r["at"]: r["verdict"] for r in T.version_verdicts(v, "k", "v", ["at"]).collect()} == {1: "first", 2: "newer", 3: "same", 4: "rollback"}
    assert {r["v"]: r["verdict"] for r in T.version_verdicts(v.where("at <> 3"), "k", "v").collect()} == {"v2": "first", "v9": "newer", "v10": "newer"}


def test_segments_and_limits(spark):
    per = spark.createDataFrame([("q", 1.0, 1.0, 1.0, 1.0, 1.0)], "q string, ndcg double, precision double, recall double, mrr double, ap double")
    seg = spark.createDataFrame([("q", "natural"), ("n", "negative")], "q string, segment string")
    assert V.segment_report(per, seg, "natural").first()["queries"] == 1
    for name in ("negative", "gone"):
        with pytest.raises(ValueError):
            V.segment_report(per, seg, name)
    rows = spark.createDataFrame([("a", "s")] * 3 + [("b", "x" * 9), ("c", None)], "b string, s string")
    assert {r["b"]: r["reason"] for r in T.oversized(rows, "b", "s", 2, 8).collect()} == {"a": "too many events", "b": "session id too long"}
    calls = spark.createDataFrame([("/api/x", 5.0), ("/api/y", 4.9), ("https://o.example/z", 9.0), ("/a.png", 9.0), ("https://up.example/e", 9.0)], "url string, start double")
    assert T.backend_calls(calls, "url", "start", 5.0, "https://edge.example", "https://up.example").first()["calls"] == 2


def test_staged_photos(spark):
    cat = catalog(spark, [(i, "x", [], "", 0.1, 0.1) for i in "abc"])
    staged = spark.createDataFrame([("a", "png"), ("a", "jpg"), ("b", None), (None, "png"), ("z", "png")], "id string, ext string")
    assert {r["id"]: r["image_url"] for r in C.with_local_images(cat, staged).collect()} == {"a": "/images/a.jpg", "b": "/images/b.svg", "c": "/images/c.svg"}


def test_uplink_sends_again_after_a_failure(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"line_no": i, "pos": 0, "session_id": "s", "product_id": "p", "event_type": "click", "ts": "2031-03-01T00:00:00Z"} for i in range(60)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, lines)))
    sent, broken = tmp_path / "sent", tmp_path / "broken"
    sent.mkdir()
    broken.write_text("")

    def send(rows):
        import os
        import uuid

        if os.path.exists(str(broken)):
            raise OSError("no line")
        (sent / uuid.uuid4().hex).write_text(",".join(str(r["line_no"]) for r in rows))

    run = lambda: W.uplink(W.read_events(spark, str(tmp_path / "in")), send, str(tmp_path / "state"))
    with pytest.raises(Exception):
        run().awaitTermination(60)
    broken.unlink()
    run().awaitTermination(60)
    batches = [p.read_text().split(",") for p in sent.iterdir()]
    assert sorted(int(x) for b in batches for x in b) == list(range(60)) and max(map(len, batches)) == 25


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    session = type("Session", (), {"sparkContext": Context, "conf": type("Conf", (), {"get": staticmethod(lambda k, d: None)})})
    with pytest.raises(ValueError):
        runtime.ensure_checkpoint_dir(session)
