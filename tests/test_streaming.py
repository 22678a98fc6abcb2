"""Streams give what the batch operators give."""

import json

import pytest
from pyspark.sql import functions as F

from test_operators import catalog
from vitrine.operators import profiles as P
from vitrine.streaming import sessions as W

ROWS = [
    ("s", "a", "click", 0), ("s", "b", "view", 10), ("s", "b", "view", 20), ("s", "a", "cart", 30), ("t", "b", "favorite", 40), ("t", "b", "favorite", 50),
    ("t", "zz", "click", 60), ("t", "a", "error", 70), ("t", None, "click", 80), ("s", "b", "click", 3700), ("x" * 201, "a", "click", 5),
]


@pytest.fixture
def folder(tmp_path):
    for part, rows in enumerate((ROWS[:4], ROWS[4:8], ROWS[8:])):
        lines = [{"line_no": part, "pos": i, "session_id": s, "product_id": p, "event_type": e, "ts": f"2031-03-01T00:00:00Z".replace("00:00:00", f"{t // 3600:02d}:{t // 60 % 60:02d}:{t % 60:02d}")} for i, (s, p, e, t) in enumerate(rows)]
        d = tmp_path / "in"
        d.mkdir(exist_ok=True)
        (d / f"{part}.json").write_text("\n".join(map(json.dumps, lines)))
    return tmp_path


def run(stream, mode, name, tmp):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_profiles_match_batch(spark, folder):
    cat = catalog(spark, [("a", "x", ["t"], "m", 0.1, 0.1), ("b", "y", ["t", "u"], "", 0.1, 0.1)])
    live = W.accepted(W.read_events(spark, str(folder / "in"), 1))
    batch = W.accepted(spark.read.schema(W.EVENT_SCHEMA).json(str(folder / "in")))
    run(W.session_affinities(live, cat), "complete", "aff", folder)
    got = {(r["session"], r["kind"], r["key"]): round(r["value"], 9) for r in spark.table("aff").collect()}
    want = {(r["session"], r["kind"], r["key"]): round(r["value"], 9) for r in P.affinities(batch, cat).collect()}
    assert got == want and want
    run(W.engagement(live), "complete", "eng", folder)
    assert {r["product_id"]: r["event_count"] for r in spark.table("eng").collect()} == {r["product_id"]: r["event_count"] for r in P.engagement(batch).collect()}


def test_recent_products(spark, folder):
    run(W.recently_viewed(W.accepted(W.read_events(spark, str(folder / "in"), 1))), "update", "recent", folder)
    rows = [tuple(r) for r in spark.table("recent").where("session = 's'").collect()]
    assert rows[-2:] == [("s", "b", 1), ("s", "a", 2)]


def test_once_and_visits(spark, folder):
    live = W.accepted(W.read_events(spark, str(folder / "in"), 1))
    run(W.once_per_session(live), "append", "once", folder)
    kinds = sorted((r["session_id"], r["product_id"], r["event_type"]) for r in spark.table("once").collect())
    assert kinds.count(("t", "b", "favorite")) == 1 and kinds.count(("s", "b", "view")) == 1 and kinds.count(("s", "a", "click")) == 1
    run(W.visits(live), "complete", "visits", folder)
    assert sorted(r["events"] for r in spark.table("visits").where("session_id = 's'").collect()) == [1, 4]
    run(W.windowed_engagement(live), "complete", "windows", folder)
    assert spark.table("windows").agg(F.max("n")).first()[0] >= 2


def test_dwell(spark):
    rows = spark.createDataFrame([("s", "p", 0.8, 0, 1), ("s", "p", 0.9, 1, 3), ("s", "q", 0.9, 0, 1), ("s", "r", 0.5, 0, 9)], "session_id string, product_id string, ratio double, a int, b int")
    spans = rows.select("session_id", "product_id", "ratio", F.col("a").cast("timestamp").alias("ts"), F.col("b").cast("timestamp").alias("until"))
    assert [r["product_id"] for r in W.dwell_views(spans).collect()] == ["p"]


def test_republish_loop(spark, folder):
    seen = []
    q = W.republish_on(W.read_events(spark, str(folder / "in"), 10), lambda batch, n: seen.append(batch.count()), str(folder / "loop"))
    q.awaitTermination(120)
    assert sum(seen) == len(ROWS)
