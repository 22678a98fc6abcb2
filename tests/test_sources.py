"""Files, snapshots and the public interface."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from test_operators import catalog, events
from vitrine.engine import Engine
from vitrine.sources import files, snapshot

LINE = {"id": "a", "title": "A", "category": "c", "tags": ["t"], "price": 1.5, "popularity_score": 0.5}


def test_products_round_trip(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("\n".join([json.dumps(LINE | {"id": i}) for i in "cab"] + ["", json.dumps(LINE | {"id": "a", "title": "B"})]) + "\n")
    rows = files.read_products(spark, str(tmp_path / "p.jsonl"))
    assert [(r["ord"], r["id"]) for r in rows.orderBy("ord").collect()] == [(0, "c"), (1, "a"), (2, "b"), (3, "a")]
    good, bad = files.checked_products(rows)
    assert {r["id"]: r["title"] for r in good.collect()} == {"c": "A", "a": "B", "b": "A"} and bad.count() == 0
    files.write_products(good, str(tmp_path / "out"), single=True)
    again = files.read_products(spark, str(tmp_path / "out"))
    assert sorted(r["id"] for r in again.collect()) == ["a", "b", "c"]
    (tmp_path / "bad.jsonl").write_text('{"id": "a", "price": "much"}\n')
    with pytest.raises(Exception):
        files.read_products(spark, str(tmp_path / "bad.jsonl")).collect()
    _, bad = files.checked_products(spark.createDataFrame([(0, " ", "t", 0.1, 0.1), (1, "x", None, 0.1, 0.1), (2, "y", "t", float("nan"), 0.1)], "ord long, id string, title string, popularity_score double, freshness_score double"))
    assert [r["reason"] for r in bad.orderBy("ord").collect()] == ["no id", "no title", "score is no number"]


def test_lenient_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('asin,title\n1,"Tall 6\' 1"" person"\n2,"Tall 6\' 1" person"\n3,plain\n')
    spark.dataSource.register(files.LenientCsv)
    got = spark.read.format("lenient_csv").load(str(tmp_path / "x.csv")).orderBy("asin").collect()
    assert [r["asin"] for r in got] == ["1", "2", "3"] and got[1]["title"] == "Tall 6' 1 person\""
    files.write_csv(spark.createDataFrame([(1, "a,b")], "x int, y string"), str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "x int, y string").first()["y"] == "a,b"


def test_session_log(spark, tmp_path):
    good = json.dumps({"session_id": "s", "events": [{"product_id": "p", "event_type": "click"}]})
    (tmp_path / "s.jsonl").write_text(f"{good}\n\n{good}\n")
    assert [r["line_no"] for r in files.read_session_log(spark, str(tmp_path / "s.jsonl")).orderBy("line_no").collect()] == [1, 3]
    (tmp_path / "b.jsonl").write_text(f"{good}\n{{broken\n")
    with pytest.raises(ValueError, match="line 2"):
        files.read_session_log(spark, str(tmp_path / "b.jsonl"))
    t = {"v": 1, "ts": 5, "type": "view", "productId": "p", "sessionId": "s"}
    (tmp_path / "t.jsonl").write_text("\n".join([json.dumps(t), "nonsense", json.dumps(t | {"ts": 9}), json.dumps(t | {"v": 2})]))
    assert [r["ts"] for r in files.read_taste_log(spark, str(tmp_path / "t.jsonl")).collect()] == [9, 5]


def test_vectors_round_trip(spark, tmp_path):
    (tmp_path / "e.f32").write_bytes(struct.pack("<4f", 1, 2, 3, 4))
    (tmp_path / "state.json").write_text(json.dumps({"ids": ["a", "b"]}))
    rows = files.read_vectors(spark, str(tmp_path / "e.f32"), str(tmp_path / "state.json"), 2)
    assert {r["id"]: r["embedding"] for r in rows.collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.0]}
    assert files.write_vectors(rows, str(tmp_path / "o.f32"), str(tmp_path / "o.json")) == 2
    assert (tmp_path / "o.f32").read_bytes() == (tmp_path / "e.f32").read_bytes()
    with pytest.raises(ValueError):
        files.read_vectors(spark, str(tmp_path / "e.f32"), str(tmp_path / "state.json"), 3)


def test_nested_exports(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": 1, "neighbors": {"a": [{"id": "b", "score": 0.5}, {"id": "c", "score": 0.1}]}}))
    assert [tuple(r) for r in files.read_cooccurrence(spark, str(tmp_path / "c.json")).orderBy("rank").collect()] == [("a", "b", 0.5, 1), ("a", "c", 0.1, 2)]
    (tmp_path / "n.json").write_text('{"neighbors": {"a": [{"id": "b", "score": null}]}}')
    with pytest.raises(Exception):
        files.read_cooccurrence(spark, str(tmp_path / "n.json")).collect()
    (tmp_path / "r.json").write_text(json.dumps({"k": 2, "queries": [{"query": "x", "relevant_ids": ["a"], "ranked_ids": ["b", "a"], "segment": "natural"}]}))
    segments, ranked, relevant = files.read_relevance_export(spark, str(tmp_path / "r.json"))
    assert segments.first()["segment"] == "natural" and [r["pos"] for r in ranked.orderBy("pos").collect()] == [1, 2] and relevant.count() == 1
    assert "x" in files.as_table(segments) and json.loads(files.as_json(segments).first()["value"])["q"] == "x"


def engine(spark):
    cat = catalog(spark, [(f"p{i}", "red lamp" if i % 2 else "blue cable", ["t"], "b", i / 20, (20 - i) / 20) for i in range(20)])
    return Engine(cat, events=events(spark, [("s", [("p1", "cart"), ("p3", "click")]), ("s2", [("p1", "click"), ("p5", "view")])]))


def test_engine(spark):
    e = engine(spark)
    found = e.search("lamp", 5, session="s").collect()
    assert len(found) == 5 and found[0]["total"] >= 10 and e.search("  ").count() == 0
    assert e.search("lamp", 5, category="blue cable").count() <= 5
    assert e.recommend("for_you", session="s", limit=3).count() == 3 and e.similar("p1", 4).count() == 4
    assert {r["id"] for r in e.recommend("also_bought", "p1").collect()} == {"p3", "p5"}
    with pytest.raises(KeyError):
        e.recommend("also_bought", "gone")
    assert e.browse("red lamp", 1, 2).count() == 2
    new = e.track(events(spark, [("s3", [("p7", "cart")])])).retrain()
    assert new.catalog.where("id = 'p7'").first()["popularity_score"] > 7 / 20
    assert e.audit("v1").first()["new_version"] == "v2"


def test_snapshots(spark, tmp_path):
    root, local = str(tmp_path / "root"), str(tmp_path / "local")
    e = engine(spark)
    e.publish(root, "v1", 1)
    pointer, stats = snapshot.sync(root, local)
    assert (pointer.version, stats["reused"]) == ("v1", 0) and stats["fetched"] > 1
    assert snapshot.sync(root, local)[1]["fetched"] == 0
    opened = Engine.open(spark, local)
    assert opened.catalog.count() == 20 and opened.recommend("trending", limit=2).count() == 2
    with pytest.raises(ValueError):
        e.publish(root, "v1", 1)
    e.publish(root, "v2", 2)
    with pytest.raises(ValueError):
        snapshot.sync(root, local, floor=3)
    with pytest.raises(ValueError):
        snapshot.sync(root, local, verify=lambda raw, signature: False)
    assert snapshot.sync(root, local)[0].sequence == 2
    (tmp_path / "local/files/ranking.json").unlink()
    with pytest.raises(FileNotFoundError):
        snapshot.load_config(local)
    assert snapshot.load_config(local, 1).schema_version == 3
    with pytest.raises(ValueError):
        snapshot.sync(str(tmp_path / "nothing"), local)
