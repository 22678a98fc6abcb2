"""Problem 4: the most similar vectors of every vector, by balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.runtime import Scratch, cut

#: Vectors that the centroids of a collection, or of a region of it, are fitted on (a sample; every vector is indexed and searched).
SAMPLE = 50_000
#: Vectors a posting list is meant to hold.
LIST_SIZE = 200
#: Sampled vectors for each list that is fitted.
FIT = 12
#: Lists up to which one graph of centroids serves all (fewer where vectors are longer than 64); larger collections are cut into regions with a graph each.
GRAPH_LISTS = 131_072
#: Centroids in a cell at most, and about those that a query looks through, in its nearest cells.
CELL_CENTROIDS, LOOK = 64, 1_024
#: Lists of neighbouring centroids that are searched by one task, so that a vector is sent there once for all of them.
GROUP_LISTS = 16
#: Members, and queries, that one task takes of a group at once (fewer where vectors are longer than 256); larger groups are split both ways.
CELL = 48_000
#: Numbers of vectors that a task holds at once.
BLOCK_FLOATS = 12_288_000
#: Vectors that a pass over the groups sends at least, and the share of all of them that it sends at most.
PASS_ROWS, PASS_SHARE = 1_000_000, 0.75


@dataclass(frozen=True)
class Search:
    """How lists are chosen: members go to centroids within ``member_ratio`` of the
    nearest one's distance (at most ``replicas``), queries look in those within
    ``query_ratio`` (at most ``probes``) and always in the ``least`` nearest, as a vector
    may be its own centroid.  Regions are chosen likewise, by ratios of
    their own."""

    member_ratio: float = 1.1
    replicas: int = 3
    query_ratio: float = 1.6
    probes: int = 16
    least: int = 4
    beam: int = 32
    region_member_ratio: float = 1.02
    region_query_ratio: float = 1.2
    region_probes: int = 4


def usable_vectors(vectors: DataFrame, manifest: DataFrame) -> tuple[DataFrame, int]:
    """``(id, embedding)`` of the greatest version of the manifest, and their length.

    Left out: other versions, null ids, vectors of another length, with null or
    non-finite entries, or all zero.  An id counts once."""
    now = manifest.where("version is not null").orderBy(F.col("version").desc()).select("version", "embedding_dim").first()
    version, dim = (now["version"], now["embedding_dim"]) if now else (None, 0)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.where((F.col("version") == F.lit(version)) & F.col("id").isNotNull() & (F.size("embedding") == dim) & fine & some)
    return rows.select("id", "embedding").dropDuplicates(["id"]), dim


def _pack(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
            x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column("id"), _binary(x)], names=["id", "vec"])

    return run


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of ``x`` as bytes."""
    width = x.shape[1] * 4
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x, "<f4"))]).cast(pa.binary())


def unpack(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f4").reshape(-1, dim)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, 1)
        for j in range(k):
            mine = x[near == j]
            if len(mine):
                m = mine.mean(0)
                n = np.linalg.norm(m)
                c[j] = m / n if n > 0 else mine[0]
    return np.argmax(x @ c.T, 1)


def balanced_centroids(x: np.ndarray, leaf: float, seed: int = 7, fan: int = 8) -> np.ndarray:
    """Unit centroids of parts of ``x``, split again and again until a part holds ``leaf`` vectors or fewer."""
    rng, out, todo = np.random.default_rng(seed), [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        part = x[rows]
        parts = [rows] if len(rows) <= leaf else []
        if not parts:
            k = int(min(fan, max(2, np.ceil(len(rows) / leaf)), len(rows)))
            near = _kmeans(part.copy(), k, rng)
            parts = [rows[near == j] for j in range(k) if (near == j).any()]
        if len(parts) == 1:  # small enough, or not to be split as all are alike
            m = part.astype(np.float64).mean(0)
            n = np.linalg.norm(m)
            out.append(m / n if n > 1e-12 else part[0])
        else:
            todo += parts[::-1]
    return np.asarray(out, np.float32)


class CentroidGraph:
    """Centroids in cells of neighbouring ones; few centroids are one cell.

    A query looks through the cells whose centers are nearest to it, and the queries that
    look into a cell are compared with its centroids at once."""

    def __init__(self, centroids: np.ndarray, cell: int = CELL_CENTROIDS, look: int = LOOK):
        n = len(centroids)
        self.c, self.order, self.at, self.cells = centroids, np.arange(n, dtype=np.int32), np.array([0, n]), 1
        if n <= look:
            return
        centers = balanced_centroids(centroids, cell)
        home = np.concatenate([np.argmax(centroids[at : at + 1024] @ centers.T, 1) for at in range(0, n, 1024)])
        kept, home, counts = np.unique(home, return_inverse=True, return_counts=True)
        self.centers, self.order, self.at = centers[kept], np.argsort(home, kind="stable").astype(np.int32), np.append(0, np.cumsum(counts))
        self.c, self.cells = centroids[self.order], min(len(kept), -(-look * len(kept) // n))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of about the ``beam`` nearest centroids, best first."""
        beam, width = min(beam, len(self.c)), int(np.diff(self.at).max())
        ids, sims = np.zeros((len(q), beam), np.int32), np.zeros((len(q), beam), np.float32)
        rows = max(1, 8_388_608 // (self.cells * width))
        for at in range(0, len(q), rows):
            ids[at : at + rows], sims[at : at + rows] = self._search(q[at : at + rows], beam, width)
        return ids, sims

    def _search(self, q: np.ndarray, beam: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(q)
        if len(self.at) == 2:
            s, cells = q @ self.c.T, np.zeros((m, 1), np.int64)
        else:
            near = q @ self.centers.T
            cells = np.argpartition(near, near.shape[1] - self.cells, 1)[:, -self.cells :]
            s = np.full((m, self.cells, width), -9, np.float32)
            flat = cells.ravel()
            order = np.argsort(flat, kind="stable")
            ends = np.searchsorted(flat[order], np.arange(len(self.at)))
            for k in range(len(self.at) - 1):
                if ends[k] < ends[k + 1]:
                    row, slot = np.divmod(order[ends[k] : ends[k + 1]], self.cells)
                    first, last = self.at[k], self.at[k + 1]
                    s[row, slot, : last - first] = q[row] @ self.c[first:last].T
            s = s.reshape(m, -1)
        top = np.argpartition(s, s.shape[1] - beam, 1)[:, -beam:]
        near = np.take_along_axis(s, top, 1)
        sort = np.argsort(-near, 1, kind="stable")
        top, near = np.take_along_axis(top, sort, 1), np.take_along_axis(near, sort, 1)
        slot, place = np.divmod(top, width)
        place = np.minimum(self.at[np.take_along_axis(cells, slot, 1)] + place, len(self.order) - 1)  # what lies beyond has the similarity -9
        return self.order[place], near


def _chosen(graph: CentroidGraph, q: np.ndarray, how: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, member) of the lists that every vector is looked for in, the row's lists in order of their numbers."""
    rows, lists, member = [], [], []
    for at in range(0, len(q), 65_536):
        ids, sims = graph.search(q[at : at + 65_536], how.beam)
        dist = np.sqrt(np.maximum(0.0, 2 - 2 * sims.astype(np.float64)))
        ok = sims > -9
        mine = ok & (dist <= how.member_ratio * dist[:, :1] + 1e-6)
        probe = ok & (dist <= how.query_ratio * dist[:, :1] + 1e-6)
        probe[:, : how.least] = ok[:, : how.least]
        mine[:, how.replicas :], probe[:, how.probes :] = False, False
        r, c = np.nonzero(probe)
        sort = np.lexsort((ids[r, c], r))
        rows.append(r[sort] + at)
        lists.append(ids[r, c][sort])
        member.append(mine[r, c][sort])
    return (np.concatenate(rows), np.concatenate(lists), np.concatenate(member)) if rows else (np.zeros(0, np.int64),) * 3


#: ``codes``: twice the number of a list, and one more where the vector is a member of it; ``grps``: the groups of these lists, likewise.
ASSIGNED = "region int, id string, vec binary, codes array<int>, grps array<int>"


def _placed(ids: pa.Array, vecs: pa.Array, region: int, home: np.ndarray, graph: CentroidGraph, dim: int, how: Search) -> pa.RecordBatch:
    """One row per vector, as ``ASSIGNED``; in regions that aren't a vector's ``home`` it is no member."""
    row, lists, member = _chosen(graph, unpack(vecs.to_pylist(), dim), how)
    member = member & home[row]
    grp = lists // GROUP_LISTS
    heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (grp[1:] != grp[:-1])])) if len(row) else np.zeros(0, np.int64)
    owned = np.logical_or.reduceat(member, heads) if len(heads) else np.zeros(0, bool)
    every = np.arange(len(ids) + 1)
    columns = [
        pa.array(np.full(len(ids), region), pa.int32()), ids, vecs,
        pa.ListArray.from_arrays(pa.array(np.searchsorted(row, every), pa.int32()), pa.array(lists * 2 + member, pa.int32())),
        pa.ListArray.from_arrays(pa.array(np.searchsorted(row[heads], every), pa.int32()), pa.array(grp[heads] * 2 + owned, pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ASSIGNED.split(", ")])


def _gathered(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches."""
    most, held, rows = min(65_536, max(1, BLOCK_FLOATS // dim)), [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _assign(graph: CentroidGraph, dim: int, how: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, dim):
            yield _placed(batch.column("id"), batch.column("vec"), 0, np.ones(batch.num_rows, bool), graph, dim, how)

    return run


def _regions(graph: CentroidGraph, dim: int, how: Search):
    """``(region, home, id, vec)``: the regions a vector is looked for in, and whether it belongs there."""
    near = Search(how.region_member_ratio, 2, how.region_query_ratio, how.region_probes, 1, how.beam)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, region, home = _chosen(graph, unpack(batch.column("vec").to_pylist(), dim), near)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(region, pa.int32()), pa.array(home), batch.column("id").take(take), batch.column("vec").take(take)], names=["region", "home", "id", "vec"]
                )

    return run


def _fit_region(dim: int, list_size: int, how_many: str = "n"):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unpack(pdf["vec"], dim)
        c = balanced_centroids(x, max(1.0, len(x) * list_size / float(pdf[how_many].iloc[0])))
        return pd.DataFrame({"region": np.full(len(c), pdf["region"].iloc[0], np.int32), "at": np.arange(len(c), dtype=np.int32), "vec": [v.tobytes() for v in c.astype("<f4")]})

    return run


def _fit_part(dim: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = balanced_centroids(unpack(pdf["vec"], dim), max(1.0, float(pdf["leaf"].iloc[0])))
        return pd.DataFrame({"region": np.full(len(c), pdf["region"].iloc[0], np.int32), "at": np.arange(len(c), dtype=np.int32), "vec": [v.tobytes() for v in c.astype("<f4")]})

    return run


def _assign_in_region(dim: int, how: Search):
    def run(vectors: pa.Table, centroids: pa.Table) -> pa.Table:
        ints = pa.list_(pa.int32())
        schema = pa.schema([("region", pa.int32()), ("id", pa.string()), ("vec", pa.binary()), ("codes", ints), ("grps", ints)])
        if not vectors.num_rows or not centroids.num_rows:
            return schema.empty_table()
        c = centroids.sort_by("at")
        graph = CentroidGraph(unpack(c.column("vec").to_pylist(), dim))
        v = vectors.combine_chunks()
        ids, vecs = v.column("id").combine_chunks(), v.column("vec").combine_chunks()
        home = v.column("home").to_numpy(zero_copy_only=False).astype(bool)
        return pa.Table.from_batches([_placed(ids, vecs, int(v.column("region")[0].as_py()), home, graph, dim, how)]).cast(schema)

    return run


def _sampled(vectors: DataFrame, n: int, sample: int) -> DataFrame:
    keep = 1 << 20
    share = min(keep, int(keep * sample / n) + 1)
    return vectors.where(F.pmod(F.xxhash64("id"), F.lit(keep)) < share) if share < keep else vectors


def _coarse(graph: CentroidGraph, dim: int):
    """``(region, vec)``: the nearest of few centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = graph.search(unpack(batch.column("vec").to_pylist(), dim), 1)[0][:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column("vec")], names=["region", "vec"])

    return run


def build_graph(vectors: DataFrame, dim: int, n: int, lists: int, sample: int) -> CentroidGraph:
    """Where ``sample`` vectors are too few for so many lists, they are fitted in the tasks, part by part, each on about so many."""
    parts = -(-lists * FIT // sample)
    if parts == 1 or lists == 1:
        x = unpack(_sampled(vectors, n, sample).select("vec").toPandas()["vec"], dim)
        return CentroidGraph(balanced_centroids(x, max(1.0, len(x) / max(1, lists))))
    coarse = build_graph(vectors, dim, n, parts, max(sample, parts * FIT))
    leaf = F.lit(min(float(FIT), n / lists))
    some = _sampled(vectors, n, lists * FIT).select("vec").mapInArrow(_coarse(coarse, dim), "region int, vec binary").withColumn("leaf", leaf)
    fitted = some.groupBy("region").applyInPandas(_fit_part(dim), "region int, at int, vec binary").toPandas().sort_values(["region", "at"])
    return CentroidGraph(unpack(fitted["vec"], dim))


def assigned(groups: DataFrame, dim: int, n: int, how: Search, list_size: int, sample: int, graph_lists: int) -> DataFrame:
    """Every vector with the lists it is looked for in and their groups (``ASSIGNED``).

    Up to ``graph_lists`` lists, one graph over all centroids is sent to the tasks, and a
    vector is one row.  Beyond
    that, coarse centroids cut the collection into regions of so many lists each, whose
    centroids are fitted region by region in the tasks, each on a sample of its own; so
    lists stay the same size however large the collection is."""
    vectors = groups.select("id", "vec")
    lists, graph_lists = max(1, n // list_size), max(1, min(graph_lists, GRAPH_LISTS * 64 // dim))
    if lists <= graph_lists:
        return vectors.mapInArrow(_assign(build_graph(groups, dim, n, lists, sample), dim, how), ASSIGNED)
    coarse = build_graph(groups, dim, n, -(-lists // graph_lists), sample)
    placed = cut(vectors.mapInArrow(_regions(coarse, dim, how), "region int, home boolean, id string, vec binary"))
    sizes = cut(placed.groupBy("region").agg(F.count_if("home").alias("n"), F.ceil(F.count(F.lit(1)) / sample).cast("int").alias("parts")))
    keep = 1 << 20
    share = F.least(F.lit(keep), F.floor(F.lit(float(keep)) * sample / F.col("n")).cast("long") + 1)
    fitted = placed.where("home").join(F.broadcast(sizes), "region").where(F.pmod(F.xxhash64("id"), F.lit(keep)) < share)
    centroids = cut(fitted.select("region", "n", "vec").groupBy("region").applyInPandas(_fit_region(dim, list_size), "region int, at int, vec binary"))
    # As many rows as there are regions, each of ``graph_lists`` lists.
    split = placed.join(F.broadcast(sizes.select("region", "parts")), "region").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
    spread = centroids.join(F.broadcast(sizes.select("region", "parts")), "region").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = split.select("region", "part", "home", "id", "vec").groupBy("region", "part").cogroup(spread.select("region", "part", "at", "vec").groupBy("region", "part"))
    return both.applyInArrow(_assign_in_region(dim, how), ASSIGNED)


FOUND = "id string, near array<struct<d double, i string>>"


def _best(dim: int, k: int):
    """The ``k`` nearest members of the lists of one group, for each of its queries."""
    kind = pa.list_(pa.struct([("d", pa.float64()), ("i", pa.string())]))

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids = t.column("id").to_numpy(zero_copy_only=False).astype(object)
        vec = unpack(t.column("vec").to_pylist(), dim)
        as_query = t.column("query").to_numpy(zero_copy_only=False).astype(bool)
        as_member = t.column("as_member").to_numpy(zero_copy_only=False).astype(bool)
        codes = t.column("codes").combine_chunks()
        row = np.repeat(np.arange(len(ids)), np.diff(codes.offsets.to_numpy()))
        at = codes.flatten().to_numpy()
        at, is_member = at >> 1, (at & 1).astype(bool) & as_member[row]
        rank = np.unique(ids.astype(str), return_inverse=True)[1]  # one id may be here as member and as query
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for number in np.unique(at):
            here = at == number
            m_rows, q_rows = row[here & is_member], row[here & as_query[row]]
            if not len(m_rows) or not len(q_rows):
                continue
            m, take = vec[m_rows], min(k + 1, len(m_rows))  # the query itself may be among them
            for begin in range(0, len(q_rows), 1024):
                rows = q_rows[begin : begin + 1024]
                s = vec[rows] @ m.T
                top = np.argpartition(-s, take - 1, 1)[:, :take]
                found.append((np.repeat(rows, take), m_rows[top].ravel(), s[np.arange(len(rows))[:, None], top].ravel()))
        if not found:
            return pa.table({"id": pa.array([], pa.string()), "near": pa.array([], kind)})
        q, m, s = (np.concatenate(x) for x in zip(*found))
        other = rank[q] != rank[m]
        q, m, s = q[other], m[other], s[other]
        # A member of several lists counts once; then the k + 1 best of each query, so that rounding can't lose one.
        _, once = np.unique(q * len(ids) + m, return_index=True)
        q, m, s = q[once], m[once], s[once]
        sort = np.lexsort((-s, q))
        q, m = q[sort], m[sort]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        q, m = q[place <= k], m[place <= k]
        # Similarities once more in double precision: equal for a pair wherever it is met.
        exact = np.empty(len(q))
        for begin in range(0, len(q), 65_536):
            part = slice(begin, begin + 65_536)
            exact[part] = (vec[q[part]].astype(np.float64) * vec[m[part]].astype(np.float64)).sum(1)
        sort = np.lexsort((rank[m], -exact, q))
        q, m, exact = q[sort], m[sort], exact[sort]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        q, m, exact = q[place < k], m[place < k], exact[place < k]
        heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        near = pa.StructArray.from_arrays([pa.array(-exact), pa.array(ids[m], pa.string())], fields=list(kind.value_type))
        return pa.table({"id": pa.array(ids[q[heads]], pa.string()), "near": pa.ListArray.from_arrays(pa.array(np.append(heads, len(q)), pa.int32()), near)})

    return run


def nearest(
    vectors: DataFrame, dim: int, k: int = 5, how: Search = Search(), list_size: int = LIST_SIZE, sample: int = SAMPLE, graph_lists: int = GRAPH_LISTS
) -> DataFrame:
    """``(id, neighbor_id, similarity, pos)``: about the ``k`` most similar others of every vector, by cosine.

    ``vectors(id, embedding)``, ids distinct.  Centroids are fitted by repeated splitting
    on samples of some ``sample`` vectors, so the posting lists are balanced; their number
    grows with the data (``assigned``).  A graph over the centroids finds those near a
    vector.  Vectors between clusters are members of several lists; a query looks into all
    lists whose centroid is within a ratio of the nearest one's distance.  Neighbouring
    lists form a group that one task searches, list by list; groups too large for one task
    are split both ways.  Vectors lie in files once, with their lists; passes over the
    groups send a share of them at a time, and what a pass sent is gone before the next.

    Vectors that are equal after scaling are searched for once; each copy then gets
    its own copies (smallest ids first) and the copies of what was found.  Equal
    similarities are ordered by id.  One vector alone, and an empty input, give no rows."""
    empty = vectors.select("id", F.col("id").alias("neighbor_id"), F.lit(0.0).alias("similarity"), F.lit(1).alias("pos")).limit(0)
    if not dim:
        return empty
    spark = vectors.sparkSession
    with Scratch(spark, "vectors") as scratch:
        packed = scratch.keep("packed", vectors.select("id", "embedding").mapInArrow(_pack(dim), "id string, vec binary"))
        groups = scratch.keep("groups", packed.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
        n, copied = groups.agg(F.count(F.lit(1)), F.count_if(F.col("copies") > 1)).first()
        if not n:
            return empty
        members = _copies(packed, groups) if copied else None
        scratch.drop("packed")
        rows = scratch.keep("rows", assigned(groups, dim, n, how, list_size, sample, graph_lists))
        scratch.drop("groups")
        key = _key("region", F.shiftright("g", 1))
        sizes = rows.select("region", F.explode("grps").alias("g")).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("q"), F.sum(F.col("g").bitwiseAND(1)).alias("m"))
        # One row per group, so one for some thousand vectors.
        sizes = sizes.orderBy("key").toPandas()
        sent = sizes["q"].cumsum() - sizes["q"]
        passes = (sent // max(PASS_ROWS, PASS_SHARE * n)).to_numpy().astype(np.int64)
        parts = []
        for number, some in sizes.groupby(passes):
            parts.append(scratch.keep(f"found{number}", _merged(_found(rows, some, dim, k), k)))
        scratch.drop("rows")
        merged = cut(_merged(reduce(DataFrame.unionByName, parts), k) if len(parts) > 1 else parts[0])
    base = merged.select("id", F.posexplode("near").alias("at", "x")).select("id", F.col("x.i").alias("neighbor_id"), (-F.col("x.d")).alias("similarity"), (F.col("at") + 1).alias("pos"))
    if members is None:
        return base
    w = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbor_id")
    return _with_copies(members, base.drop("pos"), k).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def _key(region: str, grp: Column) -> Column:
    return F.shiftleft(F.col(region).cast("long"), 32) + grp


def _merged(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("id").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))


def _found(rows: DataFrame, sizes: pd.DataFrame, dim: int, k: int) -> DataFrame:
    """What the queries of some neighbouring groups find there (``FOUND``)."""
    cell = max(1, min(CELL, BLOCK_FLOATS // dim))
    shift = int(2 * GROUP_LISTS).bit_length() - 1
    low, high = int(sizes["key"].iloc[0]), int(sizes["key"].iloc[-1])
    first = F.shiftleft(F.col("region").cast("long"), 32)
    here = F.filter("grps", lambda g: (first + F.shiftright(g, 1) >= low) & (first + F.shiftright(g, 1) <= high))
    sent = rows.withColumn("here", here).where(F.size("here") > 0).withColumn("g", F.explode("here"))
    sent = sent.select("region", F.shiftright("g", 1).alias("grp"), (F.col("g").bitwiseAND(1) == 1).alias("owned"), "id", "vec", "codes")
    sent = sent.withColumn("codes", F.filter("codes", lambda c: F.shiftright(c, shift) == F.col("grp")))
    out = ["region", "grp", "mc", "qc", "id", "vec", "codes", "as_member", "query"]
    one = sent.withColumns({"mc": F.lit(0), "qc": F.lit(0), "as_member": F.col("owned"), "query": F.lit(True)})
    large = sizes[(sizes["m"] > cell) | (sizes["q"] > cell)]
    if len(large):
        # A member meets every block of queries, a query every block of members; where the group is one block, as one row.
        blocks = [(int(x >> 32), int(x & 0xFFFFFFFF), max(1, -(-int(m) // cell)), -(-int(q) // cell)) for x, m, q in zip(large["key"], large["m"], large["q"])]
        large = F.broadcast(rows.sparkSession.createDataFrame(blocks, "region int, grp int, ms int, qs int"))
        split = sent.join(large, ["region", "grp"])
        h = F.xxhash64("id")
        m_cell, q_cell = F.pmod(h, F.col("ms").cast("long")).cast("int"), F.pmod(h, F.col("qs").cast("long")).cast("int")
        all_q, all_m = F.explode(F.sequence(F.lit(0), F.col("qs") - 1)), F.explode(F.sequence(F.lit(0), F.col("ms") - 1))
        as_member = split.where("owned").withColumns({"mc": m_cell, "as_member": F.lit(True), "query": F.lit(False)}).withColumn("qc", all_q).select(out)
        as_query = split.withColumns({"qc": q_cell, "as_member": F.lit(False), "query": F.lit(True)}).withColumn("mc", all_m).select(out)
        one = one.join(large, ["region", "grp"], "left_anti").select(out).unionByName(as_member).unionByName(as_query)
    # The group first, as rows are sorted by a prefix of the first key.
    return one.select(out).groupBy("grp", "region", "mc", "qc").applyInArrow(_best(dim, k), FOUND)


def _copies(packed: DataFrame, groups: DataFrame) -> DataFrame:
    """``(rep, id)`` of the vectors that have copies; they meet by a digest, so that no vector moves."""
    several = groups.where("copies > 1").select(F.sha2("vec", 256).alias("digest"), F.col("id").alias("rep"))
    return cut(packed.select("id", F.sha2("vec", 256).alias("digest")).join(several, "digest").select("rep", "id"))


def _with_copies(members: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """Neighbours of all vectors from those of the first of each group of equal ones."""
    w = Window.partitionBy("rep").orderBy("id")
    # k + 1 of a group suffice as neighbours; the limit works before the shuffle too.
    firsts = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")
    others = base.join(firsts.withColumnsRenamed({"rep": "neighbor_id", "id": "copy"}), "neighbor_id", "left").select(
        "id", F.coalesce("copy", "neighbor_id").alias("neighbor_id"), "similarity"
    )
    own = members.join(firsts.withColumnRenamed("id", "neighbor_id"), "rep").where("id <> neighbor_id").select("id", "neighbor_id", F.lit(1.0).alias("similarity"))
    best = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbor_id")
    top = others.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    spread = top.withColumnRenamed("id", "rep").join(members, "rep", "left").select(F.coalesce("id", "rep").alias("id"), "neighbor_id", "similarity")
    return spread.unionByName(own)
