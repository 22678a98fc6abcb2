"""Keyword and vector retrieval, fusion and the relevance floor; one plan answers many queries."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from vitrine.config import COSINE_FLOOR, RRF_K
from vitrine.functions import scalars as S
from vitrine.operators import best
from vitrine.runtime import collect_bounded, cut

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries that are sent to the tasks at once.
BLOCK = 20_000


def documents(rows: DataFrame, key: str, tokens) -> DataFrame:
    """``(doc, tokens)`` of a collection; ``key`` is unique and orders ties."""
    return rows.select(F.col(key).alias("doc"), tokens.alias("tokens"))


def postings(docs: DataFrame) -> DataFrame:
    """``(term, doc, tf, dl)``: how often a term stands in a document, and the document's length."""
    return docs.select("doc", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: number of documents and their average length."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avgdl"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(term, df)``, summed up in each task before it moves, so no (term, document) row does."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """``(term, df, idf)``; a negative weight becomes a quarter of the mean raw weight of all terms."""
    n = F.broadcast(stats.select("n"))  # one row
    raw = frequencies.join(n).withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = F.broadcast(raw.agg(F.avg("raw").alias("mean")))  # one row
    return raw.join(mean).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


@dataclass(frozen=True)
class Index:
    """What searches of one collection share: ``docs(doc, tokens)``, ``(term, idf)`` and the one row of ``corpus_stats``."""

    docs: DataFrame
    terms: DataFrame
    stats: DataFrame


def index(docs: DataFrame, kept: bool = False) -> Index:
    """An index of ``docs``; ``kept`` writes the weights of the terms once, for several searches."""
    stats = corpus_stats(docs)
    terms = idf(document_frequencies(docs), stats).select("term", "idf")
    return Index(docs, cut(terms), cut(stats)) if kept else Index(docs, terms, stats)


def bm25(docs: DataFrame | Index, queries: DataFrame, digits: int = 6) -> DataFrame:
    """``(q, doc, score)`` above 0 for ``queries(q, tokens)``; a term asked twice counts twice.

    Only the terms asked for are counted per document: they meet the words of the
    documents before anything moves, sent to all tasks where they are few enough."""
    at = docs if isinstance(docs, Index) else index(docs)
    asked = queries.select("q", F.explode("tokens").alias("term"))
    terms = collect_bounded(asked.select("term").distinct())
    words = at.docs.select("doc", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    if terms is None:
        words = words.join(asked.select("term").distinct(), "term", "left_semi")
    else:
        few = asked.sparkSession.createDataFrame(terms, "term string")
        words = words.join(F.broadcast(few), "term", "left_semi")
    posts = words.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    hits = asked.join(posts, "term").join(at.terms, "term").join(F.broadcast(at.stats.select("avgdl")))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.nullif(F.col("avgdl"), F.lit(0.0))))
    return hits.groupBy("q", "doc").agg(F.round(F.sum(part), digits).alias("score")).where("score > 0")


def without_stop_words(tokens, stop_words: Iterable[str]):
    """The tokens of a query without words that say nothing about what is sought."""
    return F.filter(tokens, lambda t: ~t.isin(*sorted(stop_words))) if (stop_words := set(stop_words)) else tokens


def top_k(scored: DataFrame, k: int, order: str = "doc") -> DataFrame:
    """The ``k`` best of each query, ties by ``order``, with ``pos`` from 1."""
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), order)
    return scored.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def wide(rows: DataFrame) -> DataFrame:
    """As few parts as there are cores: each gives k rows per query, so fewer move."""
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def in_blocks(queries: DataFrame, column: str, block: int, search, empty: DataFrame) -> DataFrame:
    """The union of ``search([(q, column)])`` over blocks of the queries, of which the driver holds one at a time."""
    columns = queries.select("q", column)
    few = collect_bounded(columns, block)  # one job; more queries than a block come partition by partition
    if few is not None:
        return search([(r["q"], r[column]) for r in few]) if few else empty
    out, part = None, []
    for r in itertools.chain(columns.toLocalIterator(prefetchPartitions=True), [None]):
        if r is not None:
            part.append((r["q"], r[column]))
        if part and (r is None or len(part) >= block):
            # Found before the next block is fetched, so the driver holds one block.
            got = cut(search(part))
            out, part = (got if out is None else out.unionByName(got)), []
    return out


def arrow(df: DataFrame, name: str) -> pa.DataType:
    return to_arrow_type(df.schema[name].dataType)


def knn(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """Exact cosine neighbours ``(q, doc, score, pos)`` of ``queries(q, embedding)`` among
    ``vectors(doc, ord, embedding)``.

    The queries go to the tasks in blocks of at most ``block``; each task multiplies its
    rows with a block and keeps its best ``k``, so what moves is k rows per query and task."""
    kinds = dict(vectors.dtypes)
    schema = f"q {dict(queries.dtypes)['q']}, doc {kinds['doc']}, ord long, score double"
    rows = wide(vectors.select("doc", F.col("ord").cast("long").alias("ord"), "embedding"))
    q_type, doc_type = arrow(queries, "q"), arrow(vectors, "doc")

    def search(part: list) -> DataFrame:
        run = best.nearest(pa.array([q for q, _ in part], q_type), np.asarray([v for _, v in part], np.float64), k, digits, exclude_self, doc_type)
        return top_k(rows.mapInArrow(run, schema), k, "ord").select("q", "doc", "score", "pos")

    return in_blocks(queries, "embedding", block, search, top_k(rows.sparkSession.createDataFrame([], schema), k, "ord").select("q", "doc", "score", "pos"))


def keyword_search(at: Index, queries: DataFrame, k: int, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """The ``k`` best of ``bm25`` for each query, ``(q, doc, score, pos)``, ties by the document's ``ord``.

    ``at.docs(doc, ord, tokens)``.  Common words match a good part of all documents for
    every query, so the pairs never leave the tasks: queries go out in blocks with the
    weights of their terms, and a task keeps the best ``k`` of each query."""
    schema = f"q {dict(queries.dtypes)['q']}, doc {dict(at.docs.dtypes)['doc']}, ord long, score double"
    rows = wide(at.docs.select("doc", F.col("ord").cast("long").alias("ord"), "tokens", F.size("tokens").alias("size"), F.lit(0.0).alias("bias")))
    q_type, doc_type = arrow(queries, "q"), arrow(at.docs, "doc")
    spark = rows.sparkSession

    def search(part: list) -> DataFrame:
        words = sorted({t for _, ts in part for t in ts or []})
        # As many terms as one block of queries asks for.
        weights = dict(map(tuple, at.terms.join(F.broadcast(spark.createDataFrame([(t,) for t in words], "term string")), "term").select("term", "idf").collect()))
        terms = sorted(weights)
        number = {t: i for i, t in enumerate(terms)}
        counts = [Counter(t for t in ts or [] if t in number) for _, ts in part]
        starts = np.cumsum([0, *map(len, counts)])
        asked = np.asarray([number[t] for c in counts for t in c], np.int64)
        each = np.asarray([n * weights[t] for c in counts for t, n in c.items()], np.float64)
        share = best.bm25_part(K1, B, at.stats.first()["avgdl"])
        # Half of the last digit, or a little less: what rounds to 0 after all is left out below.
        run = best.matching(pa.array([q for q, _ in part], q_type), starts, asked, each, terms, share, k, digits, doc_type, 0.499999 * 10.0**-digits)
        return top_k(rows.mapInArrow(run, schema).where("score > 0"), k, "ord").select("q", "doc", "score", "pos")

    return in_blocks(queries, "tokens", block, search, top_k(spark.createDataFrame([], schema), k, "ord").select("q", "doc", "score", "pos"))


def fuse(keyword: DataFrame, vector: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion with the evidence kept: ``(q, doc, rrf, lexical, semantic, pos)``.

    One union and one aggregation stand for the full outer join.  Ties keep the order of
    the lists: keyword hits first, then what only the vectors found."""
    side = lambda df, name: df.select("q", "doc", F.lit(name).alias("src"), "score", "pos")
    both = side(keyword, "kw").unionByName(side(vector, "vec"))
    pick = lambda src, c: F.max(F.when(F.col("src") == src, F.col(c)))
    fused = both.groupBy("q", "doc").agg(
        F.round(F.sum(1.0 / (k + F.col("pos"))), 9).alias("rrf"), pick("kw", "score").alias("lexical"), pick("vec", "score").alias("semantic"),
        pick("kw", "pos").alias("kw_pos"), pick("vec", "pos").alias("vec_pos"),
    )
    w = Window.partitionBy("q").orderBy(F.col("rrf").desc(), F.col("kw_pos").asc_nulls_last(), F.col("vec_pos").asc_nulls_last())
    return fused.withColumn("pos", F.row_number().over(w))


def admitted(fused: DataFrame, floor: float = COSINE_FLOOR) -> DataFrame:
    """What has evidence: a cosine of the floor or more, or any keyword score.  No evidence isn't evidence of 0."""
    return fused.where(F.coalesce(F.col("semantic") >= floor, F.lit(False)) | F.coalesce(F.col("lexical") > 0, F.lit(False)))


def retrieval_term(rows: DataFrame, weight: float) -> DataFrame:
    """``retrieval``: the fused score over the greatest admitted one of the query, weighted."""
    top = F.max("rrf").over(Window.partitionBy("q"))
    return rows.withColumn("retrieval", F.when(top > 0, weight * F.greatest(F.lit(0.0), F.col("rrf")) / top).otherwise(0.0))


def hashed_encoder(dim: int = 64):
    """A deterministic stand-in for a neural text encoder: words hashed to signed places, scaled to length one."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        import hashlib

        def one(t):
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if (h >> 32) & 1 else -1.0
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32).tolist()

        return texts.map(one)

    return encode


def encoded(catalog: DataFrame, encoder=None) -> DataFrame:
    """``(id, ord, embedding)`` of the catalogue's texts, as an index stores them."""
    return catalog.select("id", "ord", (encoder or hashed_encoder())(S.product_text()).alias("embedding"))
