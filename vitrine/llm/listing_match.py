"""Problem 6: listings of the same item, by token blocking, metablocking, rules and clustering."""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.canonical import NOISE, reference_blocks
from vitrine.llm.listing_facts import ANSWERS, FACTS, FOUND, answer_all, read_all
from vitrine.llm.together import pairs_of_sets
from vitrine.runtime import MAX_BROADCAST_ROWS, collect_bounded, cut, parallelism

#: Different listings of one token block beyond which the block is cut into cells by the other tokens.
LARGE_BLOCK = 32
#: Amounts nearer than this share of the larger one are the same size in other units.
SAME_AMOUNT = 0.015
#: A word is usual for a type if this share of the type's listings has it, so many times as many as of the others; it names
#: types if its usual ones make up this share of its listings, and means those of at least so large a share.
TYPE_SHARE, TYPE_LIFT, TYPE_MOST, TYPE_MEANT = 0.2, 4.0, 0.85, 0.15
#: A word is of a feature, or of a maker, if it follows an opener, or stands in the brand, in this share of its listings.
FEATURE_SHARE, MAKER_SHARE = 0.6, 0.4
#: A word belongs to the item if other listings of the same code repeat it with this chance, and so much more often than others do.
REPEATED, ABOVE_OTHERS = 0.5, 3.0
#: Listings, or share of them, up to which a word without such evidence belongs to the item.
FEW, FEW_SHARE = 3, 0.01


def facts_of(listings: DataFrame, makers: DataFrame, least: float = 0.8, known: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One row of ``FACTS`` per listing; ``makers(ref_id, name, aliases)`` are the known makers.

    More than ``known`` of these are looked up in blocks, of whose answers the best counts
    as in ``map_to_canonical``; the facts are the same as with one block."""
    path = F.transform("subcategories", lambda x: F.lower(F.btrim(x)))
    leaf = F.when(F.size("subcategories") > 0, F.nullif(F.element_at(path, -1), F.lit("")))
    above = F.when(F.size("subcategories") > 1, F.slice(path, 1, F.size("subcategories") - 1))
    columns = listings.where("id is not null").select(
        F.col("id").cast("string").alias("id"), "title", "description", "brand", leaf.alias("leaf"), above.alias("above"), F.map_entries("attributes").alias("attributes")
    )
    # Reading is the longest step: on as many cores as there are, however small the table.
    columns = columns.repartition(parallelism(listings.sparkSession), "id")
    rows = collect_bounded(makers.where("ref_id is not null").orderBy("ref_id").select("ref_id", "name", "aliases"), known)
    if rows is not None:
        entries = [(r["ref_id"], n) for r in rows for n in [r["name"], *(r["aliases"] or [])] if n and n.strip()]
        return columns.mapInArrow(read_all(entries, least), FACTS)
    columns = cut(columns)
    texts = columns.select("id", "title", "description", "brand")
    blocks = reference_blocks(makers.withColumn("field", F.lit("brand")), known)
    answers = reduce(DataFrame.unionByName, [cut(texts.mapInPandas(answer_all(b.get("brand", []), least), ANSWERS)) for b, _ in blocks])
    rank = F.struct("mention", "length", (-F.col("start")).alias("s"), "likeness", (-F.col("ref_id")).alias("r"), "names")
    best = answers.groupBy("id", "role").agg(F.max(rank).alias("b"))
    one = F.struct("role", (-F.col("b.r")).alias("ref_id"), F.col("b.names").alias("names"))
    found = best.groupBy("id").agg(F.collect_list(one).cast(FOUND).alias("found"))
    return columns.join(found, "id", "left").mapInArrow(read_all([], least, resolved=True), FACTS)


def listed(rows: DataFrame) -> DataFrame:
    """A table written once; sent to all tasks by joins only where it has few enough rows."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows


def types_stated(facts: DataFrame) -> DataFrame:
    """``(leaf, of_type)``: the last levels of the category paths, but for those that are a higher level of other paths."""
    last = facts.where("leaf is not null").groupBy("leaf").agg(F.count(F.lit(1)).alias("of_type"))
    return last.join(facts.select(F.explode("above").alias("leaf")).distinct(), "leaf", "left_anti")


def listing_words(facts: DataFrame, types: DataFrame) -> DataFrame:
    """``(w, role, kinds)``: what the words of two listings or more are, as the listings show.

    ``type``: a usual word of some type and much rarer elsewhere; ``kinds`` are the types
    its listings state, with their shares, so other names of a type are learned.
    ``maker``: usually part of the brand of its listings.  ``feature``: usually follows an
    opener, as in "with strap".  ``line``: other listings of the same code have it too.
    Words of selling are none of these, as listings of the same code rarely share them.
    Every figure is an aggregate over all listings; a code group counts by its sums, so a
    hot one is a row."""
    zipped = F.explode(F.arrays_zip("words", "opened", "branded")).alias("x")
    typed = facts.join(types, "leaf", "left")
    rows = typed.select("code", F.when(F.col("of_type").isNotNull(), F.col("leaf")).alias("leaf"), "of_type", zipped)
    rows = rows.select("code", "leaf", "of_type", F.col("x.words").alias("w"), "x.opened", "x.branded")
    usual = rows.groupBy("w", "leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if("opened").alias("o"), F.count_if("branded").alias("b"), F.first("of_type").alias("of_type"))
    # The types of a word that matter, told by how usual the word is for them.
    stated = F.when(F.col("leaf").isNotNull(), F.col("n"))
    top = F.struct(F.col("n").alias("n"), F.col("of_type").alias("of_type"), F.col("leaf").alias("kind"))
    # A type with few listings may have a word by chance, hence two at least.
    words = usual.groupBy("w").agg(
        F.sum("n").alias("df"), F.sum("o").alias("o"), F.sum("b").alias("b"), F.sum(stated).alias("typed"),
        F.collect_list(F.when((F.col("n") >= TYPE_SHARE * F.col("of_type")) & (F.col("n") > 1), top)).alias("kinds"),
    ).where("df > 1")
    sizes = facts.where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = rows.where("code is not null").groupBy("code", "w").agg(F.count(F.lit(1)).alias("c")).join(sizes, "code")
    again = shared.groupBy("w").agg(F.sum("c").alias("seen"), F.sum(F.col("c") * (F.col("c") - 1) / (F.col("size") - 1)).alias("again"))
    # Two tables of one row.
    totals = facts.agg(F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(types.agg(F.coalesce(F.sum("of_type"), F.lit(0)).alias("all_typed"))))
    joined = words.join(again, "w", "left").crossJoin(F.broadcast(totals))
    n, all_typed = F.col("total"), F.col("all_typed")
    elsewhere = lambda k: (F.col("typed") - k["n"]) / F.greatest(F.lit(1), all_typed - k["of_type"])
    kinds = F.filter("kinds", lambda k: k["n"] >= TYPE_LIFT * k["of_type"] * elsewhere(k))
    is_type = F.aggregate(kinds, F.lit(0).cast("long"), lambda s, k: s + k["n"]) >= TYPE_MOST * F.col("typed")
    chance = F.col("again") / F.col("seen")
    few = (F.coalesce(F.col("seen"), F.lit(0)) < 2) & (F.col("df") <= F.greatest(F.lit(float(FEW)), FEW_SHARE * n))
    line = few | ((F.col("seen") >= 2) & (chance >= REPEATED) & (chance >= ABOVE_OTHERS * F.col("df") / n))
    role = (
        F.when(F.col("b") >= MAKER_SHARE * F.col("df"), "maker").when(F.col("o") >= FEATURE_SHARE * F.col("df"), "feature").when(F.coalesce(is_type, F.lit(False)), "type")
        .when(F.coalesce(line, F.lit(False)), "line")
    )
    meant = F.filter(kinds, lambda k: k["n"] >= TYPE_MEANT * F.col("typed"))
    kinds = F.transform(meant, lambda k: F.struct(k["kind"].alias("kind"), (k["n"] / F.col("typed")).alias("share")))
    rows = joined.select("w", role.alias("role"), F.when(role == "type", kinds).alias("kinds"))
    return rows.where("role in ('type', 'line', 'maker')")


def described(facts: DataFrame, types: DataFrame, words: DataFrame) -> DataFrame:
    """``facts`` with ``kind`` and ``lines``.

    The type is the one stated, else the one its words share most, if no other one as
    much; where no maker was read, the maker's words are the maker."""
    said = facts.select("id", F.posexplode("words").alias("at", "w")).join(words, "w")
    votes = said.groupBy("id").agg(
        F.array_sort(F.collect_set(F.when(F.col("role") == "line", F.col("w")))).alias("lines"), F.flatten(F.collect_list("kinds")).alias("votes"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "maker", F.struct("at", "w")))).alias("makers"),
    )
    rows = facts.drop("words", "opened", "branded", "above").join(types, "leaf", "left").join(votes, "id", "left")
    total = lambda kind: F.aggregate(F.filter("votes", lambda v: v["kind"] == kind), F.lit(0.0), lambda s, v: s + v["share"])
    named = F.array_distinct(F.transform("votes", lambda v: v["kind"]))
    rows = rows.withColumn("ranked", F.sort_array(F.transform(named, lambda k: F.struct(F.round(total(k), 6).alias("sum"), k.alias("kind"))), asc=False))
    clear = F.coalesce(F.get("ranked", F.lit(0))["sum"] > F.get("ranked", F.lit(1))["sum"], F.lit(True))
    kind = F.coalesce(F.when(F.col("of_type").isNotNull(), F.col("leaf")), F.when(clear, F.get("ranked", F.lit(0))["kind"]))
    lines = F.coalesce("lines", F.array().cast("array<string>"))
    own = F.filter(F.transform("makers", lambda m: m["w"]), lambda w: ~w.isin(*sorted(NOISE)))
    maker = F.coalesce("maker", F.when(F.size(own) > 0, F.concat(F.lit("t"), F.array_join(own, ""))))
    return rows.select("id", maker.alias("maker"), lines.alias("lines"), kind.alias("kind"), "size", "amount", "colour", "pack", "gen", "code")


def _snapped(amount):
    """An amount as two digits where that is nearly the same, so that units agree."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(amount)) - 1)
    near = F.round(amount / scale) * scale
    return F.when(amount > 0, F.when(F.abs(near - amount) <= 0.01 * amount, near).otherwise(F.round(amount, 3)))


def _tokens(nodes: DataFrame) -> DataFrame:
    """``(node, token, blocking, cells)``: every token of a listing; its code and the words of its line make blocks, with their cells."""
    one = lambda name, c: F.when(c.isNotNull(), F.concat_ws("|", F.lit(name), c))
    col = F.col
    size = F.when(col("size").isNotNull(), F.concat_ws("|", "size", F.coalesce(col("amount").cast("string"), F.lit(""))))
    line = F.transform("lines", lambda x: F.concat(F.lit("line|"), x))
    others = F.array(one("maker", col("maker")), one("type", col("kind")), one("size", size), one("colour", col("colour")), one("pack", col("pack")), one("gen", col("gen")))
    by_code, by_facts = _cells()
    none = F.array().cast("array<string>")
    entry = lambda xs, b, cells: F.transform(F.filter(xs, lambda x: x.isNotNull()), lambda x: F.struct(x.alias("token"), F.lit(b).alias("blocking"), cells.alias("cells")))
    entries = F.concat(entry(F.array(one("code", col("code"))), True, by_code), entry(line, True, by_facts), entry(others, False, none))
    return nodes.select("node", F.explode(entries).alias("t")).select("node", "t.*")


def _cells():
    """The cells of a listing in a large block, of a code or of a word: tokens that the rules ask for, so no pair is lost.

    Two listings that ``verified`` joins share a cell.  Without a common code they agree in
    type, size, colour, pack and generation, and amounts ``SAME_AMOUNT`` apart lie in the
    same or in neighbouring steps; the makers are the same known one or both unknown.  With
    a common code they agree in pack and generation.  Listings of a line that don't state
    one of these facts join by their code only and have no cell."""
    # A little wider than the tolerance, so that rounding can't part two amounts.
    step = F.floor(F.log("amount") / F.lit(-log(1 - SAME_AMOUNT) * (1 + 1e-6)))
    steps = F.when(F.col("amount") > 0, F.array(step.cast("string"), (step + 1).cast("string"))).otherwise(F.array(F.lit("")))
    maker = F.when(F.col("maker").startswith("t"), F.lit("t")).otherwise(F.col("maker"))
    stated = F.col("size").isNotNull() & F.col("colour").isNotNull() & F.col("kind").isNotNull() & F.col("maker").isNotNull()
    by_facts = F.when(stated, F.transform(steps, lambda x: F.concat_ws("|", "size", x, "colour", "pack", "gen", "kind", maker))).otherwise(F.array().cast("array<string>"))
    return F.array(F.concat_ws("|", "pack", "gen")), by_facts


def candidate_edges(nodes: DataFrame, large: int = LARGE_BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(a, b)`` of listings that share a block, and ``(node, tokens)`` with the rarity of each token.

    A block of more than ``large`` listings is cut into cells, overlapping and no finer
    than ``verified``, so no pair that it joins is lost; however big a cell is,
    ``pairs_of_sets`` spreads it."""
    tokens = _tokens(nodes)
    n = nodes.agg(F.count(F.lit(1))).scalar()
    # Tokens of one listing weigh nothing in any edge.
    sizes = listed(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    marked = tokens.join(sizes, "token")
    weights = marked.groupBy("node").agg(F.collect_list(F.struct("token", F.log1p(F.lit(1.0) * n / F.col("n")).alias("rarity"))).alias("tokens"))
    cells = F.when(F.col("n") <= large, F.array(F.lit(""))).otherwise(F.col("cells"))
    blocks = marked.where("blocking").select(F.col("token"), F.col("node").alias("m"), F.explode(cells).alias("cell"))
    sets = cut(blocks.select(F.concat_ws("|", "token", F.lit("cell"), "cell").alias("s"), "m"))
    return _pairs(sets).select("a", "b").distinct(), weights


def weighted(edges: DataFrame, weights: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b, weight, holds)``: how rare the tokens are that both listings have, and whether the rules join them."""
    side = lambda end: nodes.join(weights, "node", "left").select(F.col("node").alias(end), F.struct("*").alias(f"f{end}"))
    e = edges.join(side("a"), "a").join(side("b"), "b")
    common = F.array_intersect("fa.tokens", "fb.tokens")
    weight = F.coalesce(F.aggregate(common, F.lit(0.0), lambda s, x: s + x["rarity"]), F.lit(0.0))
    return e.select("a", "b", weight.alias("weight"), verified().alias("holds"))


def pruned(edges: DataFrame, share: float = 0.25) -> DataFrame:
    """Edges that hold and weigh at least ``share`` of the mean edge of one of their two listings."""
    ends = edges.select(F.col("a").alias("node"), "weight").unionByName(edges.select(F.col("b").alias("node"), "weight"))
    least = ends.groupBy("node").agg((F.avg("weight") * share).alias("least"))
    return (
        edges.where("holds").join(least.withColumnsRenamed({"node": "a", "least": "la"}), "a")
        .join(least.withColumnsRenamed({"node": "b", "least": "lb"}), "b")
        .where(F.col("weight") >= F.least("la", "lb"))
        .select("a", "b")
    )


def verified():
    """Whether two listings ``fa`` and ``fb`` agree in every fact.

    Type, pack count and generation must be equal (one piece and the first generation if
    none is said); type, size and colour equal, or one not stated and the codes equal; a
    word of the line common, or the codes equal; the makers equal, or both unknown ones
    spelled nearly alike, or one unknown and the codes equal."""
    x, y = (lambda c: F.col(f"fa.{c}")), (lambda c: F.col(f"fb.{c}"))
    code = F.coalesce(x("code") == y("code"), F.lit(False))
    open_or = lambda c, same: F.when(x(c).isNull() | y(c).isNull(), code).otherwise(same)
    amount = F.coalesce(F.abs(x("amount") - y("amount")) <= SAME_AMOUNT * F.greatest(x("amount"), y("amount")), x("amount").isNull() & y("amount").isNull())
    typed = x("maker").startswith("t") | y("maker").startswith("t")
    both = x("maker").startswith("t") & y("maker").startswith("t")
    alike = both & (F.length(x("maker")) >= 8) & (F.levenshtein(x("maker"), y("maker")) <= 2)
    maker = open_or("maker", (x("maker") == y("maker")) | alike | (typed & code))
    line = F.arrays_overlap(x("lines"), y("lines")) | code
    rule = (
        (x("pack") == y("pack")) & (x("gen") == y("gen")) & open_or("kind", x("kind") == y("kind"))
        & open_or("size", (x("size") == y("size")) & amount) & open_or("colour", x("colour") == y("colour")) & maker & line
    )
    return F.coalesce(rule, F.lit(False))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``(node, cluster)``: connected components by the smallest label, with a jump to the
    label's own label in each round, so chains shorten by halves."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("cluster")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("cluster").alias("m"))
        step = labels.join(near, "node", "left").select("node", "cluster", F.least("cluster", "m").alias("best"))
        jump = labels.withColumnsRenamed({"node": "best", "cluster": "next"})
        new = cut(step.join(jump, "best", "left").select("node", F.col("cluster").alias("old"), F.least("best", "next").alias("cluster")))
        changed = new.where("old <> cluster").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels
    raise RuntimeError(f"components not settled after {rounds} rounds")


def same_items(listings: DataFrame, makers: DataFrame, large: int = LARGE_BLOCK) -> DataFrame:
    """``(id, item)``: every listing and its group; ``item`` is the smallest id of the group.

    ``listings(id, title, description, brand, subcategories, attributes)``, one row per id.
    Facts are read from title, attributes and description alike; types, lines and makers
    among the other words are learned from all listings (``listing_words``).  Listings with
    the same facts are one node of the graph, so a group of copies, however large, makes
    no pairs.  Words of a line and codes are token blocks, two nodes of a block an edge
    weighted by the rarity of all tokens they share; light edges go, attribute rules
    verify the others and connected nodes are one item.

    Null ids don't count; null or empty texts, arrays and maps state nothing; a listing
    of which neither line nor code is known is an item of its own.  Without any category
    paths no types are known, so only codes join; without makers the typed brands count."""
    raw = cut(facts_of(listings, makers))
    types = listed(types_stated(raw))
    facts = described(raw, types, listed(listing_words(raw, types))).withColumn("amount", _snapped(F.col("amount")))
    columns = ["maker", "lines", "kind", "size", "amount", "colour", "pack", "gen", "code"]
    # What can't be matched by its facts stays alone.
    bare = F.size("lines") == 0
    key = F.when(bare & F.col("code").isNull(), F.concat(F.lit("id "), "id")).otherwise(F.to_json(F.struct(*columns)))
    keyed = cut(facts.withColumn("key", key))
    nodes = cut(keyed.groupBy("key", *columns).agg(F.min("id").alias("node")))
    edges, weights = candidate_edges(nodes, large)
    clusters = components(pruned(cut(weighted(edges, weights, nodes.drop("key")))))
    named = nodes.select("key", "node").join(clusters, "node", "left").select("key", F.coalesce("cluster", "node").alias("item"))
    return keyed.select("id", "key").join(named, "key").select("id", "item")


def item_pairs(groups: DataFrame) -> DataFrame:
    """``(id_a, id_b)`` of all listings of one item."""
    sets = cut(groups.select(F.col("item").alias("s"), F.col("id").alias("m")))
    return _pairs(sets).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def _pairs(sets: DataFrame, chunk: int = 256) -> DataFrame:
    """``pairs_of_sets`` of a table already written, split only where a set is large."""
    largest = sets.groupBy("s").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return pairs_of_sets(sets, chunk, largest > chunk)
