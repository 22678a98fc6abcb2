"""Problems 1, 2, 3 and 8 against brute force on small fixtures, with the awkward cases."""

import math
import random
from collections import Counter

import pytest

from vitrine.llm.canonical import Matcher, edit_distance, map_to_canonical, name_tokens, not_exact, typed_values
from vitrine.llm.mixture import balance, copies_of, mix, pieces, token_counts
from vitrine.llm.terms import mark_terms, term_frequencies, term_rows, text_terms
from vitrine.llm.topn import top_n_per_group

REF = [
    (1, "brand", "Acme Works", ["ACW", "Acme"]), (2, "brand", "Acme Worms", []), (3, "brand", "Bolt & Sons", None),
    (4, "category", "Garden & Patio", ["yard"]), (5, "category", "Garden", []), (6, None, "Nobody", []), (7, "brand", None, ["Zed Labs"]), (8, "brand", "Lumen Harbour Trading", None),
]


def ref(spark):
    return spark.createDataFrame(REF, "ref_id int, field string, name string, aliases array<string>")


@pytest.mark.parametrize(
    "field,value,want",
    [
        ("brand", "ACME WORKS", 1), ("brand", "Visit the Acme Works Official Store", 1), ("brand", "Acm3 W0rks", 1), ("brand", "Ac.me-Works®", 1),
        ("brand", "acw", 1), ("brand", "Acme Wroks", 1), ("brand", "Acme Worms™", 2), ("brand", "Bolt and Sons GmbH", 3), ("brand", "Sons & Bolt", 3),
        ("brand", "Lumen Harbour", 8), ("brand", "Harbour Lumen", 8), ("brand", "Lumen", -1), ("brand", "Tradnig Lumen Harbor", 8), ("brand", "Ac meWo rks", 1),
        ("brand", "Zed Lábs", 7), ("brand", "Some Other", -1), ("brand", "???", -1), ("category", "Home > Garden &amp; Patio > Pots", 4),
        ("category", "Patio & Garden", 5), ("category", "Yard", 4), ("category", "yardstick", -1), ("missing", "Acme", -1),
    ],
)
def test_canonical_values(spark, field, value, want):
    rows = spark.createDataFrame([("x", field, value)], "id string, field string, value string")
    assert [r["ref_id"] for r in map_to_canonical(rows, ref(spark)).collect()] == [want]


def test_canonical_edges(spark):
    long = "x" * 200_000 + " Acme Works"
    rows = [("a", "brand", None), ("b", "brand", "  "), ("b", "brand", "\t\u00a0\n"), ("c", None, "Acme"), ("d", "brand", long), ("e", "brand", "Acme"), ("e", "brand", "Acme"), (None, "brand", "Acme")]
    df = spark.createDataFrame(rows, "id string, field string, value string")
    got = Counter((r["id"], r["ref_id"]) for r in map_to_canonical(df, ref(spark)).collect())
    assert got == Counter({("d", 1): 1, ("e", 1): 2, (None, 1): 1})
    assert map_to_canonical(df.limit(0), ref(spark)).count() == 0
    assert {r["ref_id"] for r in map_to_canonical(df, ref(spark).limit(0)).collect()} == {-1}


def test_canonical_blocks_agree(spark):
    values = ["Acme Works", "acme wrks", "Bolt & Sons", "nothing", "acw", "Acme Worms x"]
    df = spark.createDataFrame([(str(i), "brand", v) for i, v in enumerate(values * 2)], "id string, field string, value string")
    whole = sorted((r["id"], r["ref_id"]) for r in map_to_canonical(df, ref(spark)).collect())
    assert whole == sorted((r["id"], r["ref_id"]) for r in map_to_canonical(df, ref(spark), block=2).collect())


def test_typed_values_and_exact(spark):
    products = spark.createDataFrame([("p", "Acme Works", "yard", "extra"), ("q", None, "Garden", "v")], "id string, brand string, category string, value string")
    rows = not_exact(typed_values(products, ["brand", "category"]).where("value is not null"), ref(spark))
    assert [(r["id"], r["field"], r["value"]) for r in rows.collect()] == [("p", "category", "yard")]


def test_edit_distance_and_tokens():
    assert [edit_distance("abcd", x, 2) for x in ("abcd", "abdc", "abd", "xbcde", "zzzz")] == [0, 1, 1, 2, 3]
    assert name_tokens("Ｂｏｌｔ ＆ S0ns®") == ["bolt", "sons"]
    assert Matcher([], 0.8).match("x") == (-1, 0.0, "none")


def brute_top(rows, n):
    last = {}
    for g, i, s, t in rows:
        if g is None or i is None or s is None or not math.isfinite(s) or g == i:
            continue
        key = (t if t is not None else -1, s)
        if (g, i) not in last or key > last[g, i]:
            last[g, i] = key
    out = []
    for g in {g for g, _ in last}:
        best = sorted(((-s, i) for (h, i), (_, s) in last.items() if h == g))[:n]
        out += [(g, i, k + 1) for k, (_, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("cells", [1, 3, 16])
def test_top_n(spark, cells):
    rng = random.Random(cells)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, "a", *(f"i{k}" for k in range(60))]), rng.choice([None, math.nan, math.inf, 0.1, 0.5, 0.5, 0.9, rng.random()]), rng.choice([None, 1, 2, 3])) for _ in range(800)]
    rows += rows[:50]
    df = spark.createDataFrame([(g, i, s, t, "x", 1) for g, i, s, t in rows], "id string, neighbor_id string, score double, computed_at long, bound string, pos int")
    df = df.withColumn("computed_at", df["computed_at"].cast("timestamp"))
    got = sorted((r["id"], r["neighbor_id"], r["pos"]) for r in top_n_per_group(df, 5, cells=cells).collect())
    assert got == brute_top(rows, 5)
    for large in (20, 150):
        assert got == sorted((r["id"], r["neighbor_id"], r["pos"]) for r in top_n_per_group(df, 5, cells=cells, large=large).collect())
    assert top_n_per_group(df.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, 0)


def test_longest_mention_wins_across_blocks(spark):
    names = spark.createDataFrame([(1, "brand", "Foo", None), (2, "brand", "Zorbo", ["Foo Indoor"]), (3, "brand", "Foo Outdoor Gear", None), (4, "brand", "Quuxa", None)], "ref_id int, field string, name string, aliases array<string>")
    texts = ["Foo Outdoor Gear", "the foo shop", "Foo Indoor", "Quuxa Zorbo", "Zorbo Quuxa", "Quuxxa", "nothing"]
    values = spark.createDataFrame([(str(i), "brand", v) for i, v in enumerate(texts)] * 2, "id string, field string, value string")
    got = [sorted(map(tuple, map_to_canonical(values, names, block=b).collect())) for b in (1, 2, 100)]
    assert got[0] == got[1] == got[2]
    assert [r[3] for r in got[0][::2]] == [3, 1, 2, 4, 2, 4, -1]


def test_terms(spark):
    rows = [(1, "Red  red, LAMP!", ["a", " A ", None]), (2, None, None), (3, "lamp – (x)", []), (4, "", ["b"]), (5, "!!!", ["a"]), (None, "red", ["a"])]
    df = spark.createDataFrame(rows, "id int, title string, tags array<string>")
    t = term_rows(df, "id", {"title": text_terms(df["title"]), "tags": df["tags"]})
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in term_frequencies(t).collect()}
    assert got == {("title", "red"): (2, 1), ("title", "lamp"): (2, 2), ("title", "x"): (1, 1), ("tags", "a"): (3, 2), ("tags", "b"): (1, 1)}
    total = spark.createDataFrame([(10,)], "n long")
    marks = {(r["field"], r["term"]): r["mark"] for r in mark_terms(term_frequencies(t), total).collect()}
    assert marks[("title", "red")] == "rare" and marks[("title", "lamp")] == "common" and marks[("tags", "a")] == "common"
    assert term_frequencies(t.limit(0)).count() == 0


def test_terms_of_records_sent_in_parts(spark):
    rng = random.Random(1)
    rows = [("f", rng.choice("abc"), rng.randrange(20)) for _ in range(500)]
    df = spark.createDataFrame(rows, "field string, term string, rec int").repartition(7)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_frequencies(df, cells=3).collect()}
    assert got == {t: (sum(x[1] == t for x in rows), len({x[2] for x in rows if x[1] == t})) for t in "abc"}


def test_mixture(spark):
    rng = random.Random(3)
    words = "lamp cable garden soft red tall quiet".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(5, 60))), s) for i, s in enumerate([" Web ", "web"] * 200 + ["books"] * 100 + ["forum"] * 10 + [None] * 5)]
    docs += [(9_998, None, "web"), (9_999, "  ", "books")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("web", 0.4, 1), ("BOOKS", 0.4, 3), ("forum", 0.1, 2), ("empty", 0.1, 5), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    copies, report = mix(d, t)
    r = {x["source"]: x for x in report.collect()}
    assert {s for s, x in r.items() if x["short"]} == {"forum", "empty"}
    assert r["forum"]["mixed_tokens"] == 2 * r["forum"]["tokens"] and r["empty"]["mixed_tokens"] == 0
    total = sum(x["n_tokens"] for x in copies.collect())
    for s in ("web", "books"):
        assert abs(r[s]["mixed_tokens"] / total - 0.4) < 0.01
    caps = {"web": 1, "books": 3, "forum": 2}
    for x in copies.collect():
        assert 0 <= x["copies"] <= caps.get(x["source"], 0)
    assert mix(d.limit(0), t)[1].count() == 4
    assert mix(d, t.limit(0))[1].count() == 0


def test_sources_in_blocks_and_rounding(spark):
    rng = random.Random(4)
    counts = spark.createDataFrame([(i, f"s{i % 7}", rng.randint(1, 400)) for i in range(4000)], "doc long, source string, n_tokens long")
    t = spark.createDataFrame([(f"S{k}", (k + 1) / 40, 3) for k in range(7)], "source string, target_share double, max_repeats int")
    one, many = balance(counts, t), balance(counts, t, max_sources=2)
    assert [(x.source, x.rate) for x in one] == [(x.source, x.rate) for x in many] and not any(x.short for x in one)
    whole = {r["source"]: r["n"] for r in copies_of(counts, one, "doc_id", 1).groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    mixed = {}
    for r in copies_of(counts, one, "doc_id", 1).collect():
        mixed[r["source"]] = mixed.get(r["source"], 0) + r["n_tokens"] * r["copies"]
    assert all(abs(mixed[x.source] - x.goal) < 800 for x in one) and sum(whole.values()) == sum(r["n_tokens"] for r in counts.collect())


def test_pieces_leave_tokens_whole():
    text = "ab  cd\n\n efg " * 40
    assert "".join(pieces(text, 20)) == text and all(p[0].isspace() and not q[-1].isspace() for q, p in zip(pieces(text, 20), pieces(text, 20)[1:]))
    assert [len(p) for p in pieces("x" * 50, 10)] == [20, 20, 10]


def test_balance_is_the_entropy_solution(spark):
    tokens = [10, 20, 30, 40, 100]
    counts = spark.createDataFrame([(i, "s", n) for i, n in enumerate(tokens)], "doc long, source string, n_tokens long")
    t = spark.createDataFrame([("s", 0.5, 5)], "source string, target_share double, max_repeats int")
    (tilt,) = balance(counts, t)
    rates = [min(5, math.exp(tilt.rate * n / tilt.mean)) for n in tokens]
    assert abs(sum(r * n for r, n in zip(rates, tokens)) - 100) < 1e-3
    assert copies_of(counts, [tilt], "doc_id", 1).count() == 5


def test_token_counts_long_text(spark):
    d = spark.createDataFrame([("lamp " * 50_000,), (None,), ("",)], "text string")
    got = sorted(r["n_tokens"] for r in token_counts(d).collect())
    assert got[:2] == [0, 0] and 50_000 <= got[2] <= 100_010
