"""The best k documents of every query, found in the tasks that hold the documents.

Queries go out in blocks; a task takes its documents as they stream by and keeps k of them
per query, so what moves is k rows per query and task however many pairs match."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Documents that are scored at once.
DOCS, VECTORS = 32_768, 8_192
#: Queries whose similarities to a chunk of vectors are held at once.
QUERIES = 512


class Best:
    """The ``k`` best documents of each of ``n`` queries: by rounded score, ties by their order; no number comes last."""

    def __init__(self, n: int, k: int, digits: int):
        self.k, self.digits, self.tolerance = k, digits, 10.0**-digits
        self.score, self.order = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
        self.doc, self.empty = np.full((n, k), None, object), np.ones((n, k), bool)
        #: What a document must reach before rounding to have a chance.
        self.floor = np.full(n, -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, order: np.ndarray, doc: np.ndarray) -> None:
        if not len(q):
            return
        k, at = self.k, np.unique(q)
        qs = np.concatenate([np.repeat(at, k), q])
        scores = np.concatenate([self.score[at].ravel(), np.round(score, self.digits)])
        orders = np.concatenate([self.order[at].ravel(), order])
        docs = np.concatenate([self.doc[at].ravel(), doc])
        empty = np.concatenate([self.empty[at].ravel(), np.zeros(len(q), bool)])
        sort = np.lexsort((orders, -scores, empty, qs))
        qs = qs[sort]
        place = np.arange(len(qs)) - np.searchsorted(qs, qs, "left")
        kept = place < k
        qs, place, sort = qs[kept], place[kept], sort[kept]
        self.score[qs, place], self.order[qs, place] = scores[sort], orders[sort]
        self.doc[qs, place], self.empty[qs, place] = docs[sort], empty[sort]
        last = self.score[at, k - 1] - self.tolerance
        self.floor[at] = np.where(self.empty[at, k - 1] | np.isnan(last), self.floor[at], np.maximum(last, self.floor[at]))

    def batches(self, ids: pa.Array, doc_type: pa.DataType, size: int = 100_000) -> Iterator[pa.RecordBatch]:
        q, place = np.nonzero(~self.empty)
        for at in range(0, len(q), size):
            i = (q[at : at + size], place[at : at + size])
            columns = [ids.take(pa.array(i[0])), pa.array(self.doc[i], doc_type), pa.array(self.order[i]), pa.array(self.score[i])]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "doc", "ord", "score"])


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to ``size`` rows or some more."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _values(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_pylist() + [None], object)[:-1]


def nearest(ids: pa.Array, vectors: np.ndarray, k: int, digits: int, exclude: bool, doc_type: pa.DataType) -> Callable:
    """Of rows ``(doc, ord, embedding)`` the ``k`` of greatest cosine with each of ``vectors``; ``exclude`` leaves out the document named as the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        best, n, dim = Best(len(m), k, digits), len(m), m.shape[1]
        names = ids.unique()
        own = pc.index_in(ids, value_set=names).to_numpy(zero_copy_only=False)
        seen = 0
        for batch in batches:
            rows = batch.num_rows
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != rows * dim:
                raise ValueError("vectors of different lengths")
            x = flat.reshape(rows, dim)
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(length > 0, length, 1)
            docs, orders = _values(batch.column("doc")), batch.column("ord").to_numpy()
            same = pc.fill_null(pc.index_in(batch.column("doc").cast(names.type), value_set=names), -1).to_numpy(zero_copy_only=False) if exclude else None
            begin = 0
            while begin < rows:
                # Few at first, as nothing is known yet of what a document must reach.
                end = min(rows, begin + min(VECTORS, max(256, 2 * seen)))
                for at in range(0, n, QUERIES):
                    s = m[at : at + QUERIES] @ x[begin:end].T
                    q, d = np.nonzero(~(s < best.floor[at : at + QUERIES, None]))
                    score, q, d = s[q, d], q + at, d + begin
                    if exclude:
                        other = own[q] != same[d]
                        score, q, d = score[other], q[other], d[other]
                    best.add(q, score, orders[d], docs[d])
                seen += end - begin
                begin = end
        yield from best.batches(ids, doc_type)

    return run


def bm25_part(k1: float, b: float, avgdl: float) -> Callable:
    """What a term counts in a document of ``size`` words that has it ``tf`` times."""
    return lambda tf, size, term: tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / avgdl)) if avgdl else np.zeros(len(tf))


def shared(means: np.ndarray) -> Callable:
    """A term of ``means`` counts by its share of a document's ``size`` entries, any other wholly."""
    return lambda tf, size, term: np.where(means[term], tf / np.maximum(size, 1), 1.0)


def matching(ids: pa.Array, starts: np.ndarray, asked: np.ndarray, weights: np.ndarray, terms: list[str], part: Callable, k: int, digits: int, doc_type: pa.DataType, least: float) -> Callable:
    """Of rows ``(doc, ord, tokens, size, bias)`` that match a query by ``least`` or more, the ``k`` of greatest score.

    Query ``i`` asks for the terms ``asked[starts[i]:starts[i + 1]]``, each of its weight; a
    document matches by the sum of weight times ``part(tf, size, term)`` and scores its ``bias`` more.
    Where rows come by falling bias, chunks that can't reach a query's best any more are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, best = pa.array(terms, pa.string()), Best(len(ids), k, digits)
        for batch in _chunks(batches, DOCS):
            rows, tokens = batch.num_rows, batch.column("tokens")
            docs, orders = _values(batch.column("doc")), batch.column("ord").to_numpy()
            bias, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bias", "size"))
            length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            term = pc.fill_null(pc.index_in(tokens.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            cell, tf = np.unique((term * rows + np.repeat(np.arange(rows), length))[term >= 0], return_counts=True)
            term, at = cell // rows, cell % rows
            share = part(tf, size[at], term)
            bounds = np.searchsorted(term, np.arange(len(terms) + 1))
            most = np.zeros(len(terms))
            np.maximum.at(most, term, share)
            total, some = np.zeros(rows), np.empty(rows)
            full: dict[int, np.ndarray] = {}
            for t in np.flatnonzero(np.diff(bounds) > rows / 16):  # at most 16 times as many as a document has terms
                full[t] = np.zeros(rows)
                full[t][at[bounds[t] : bounds[t + 1]]] = share[bounds[t] : bounds[t + 1]]
            highest = bias.max()
            for i in range(len(ids)):
                mine = slice(starts[i], starts[i + 1])
                if highest + np.maximum(weights[mine] * most[asked[mine]], 0).sum() < best.floor[i]:
                    continue
                total.fill(0)
                for t, w in zip(asked[mine], weights[mine]):
                    if t in full:
                        np.multiply(full[t], w, out=some)
                        np.add(total, some, out=total)
                    else:
                        here = slice(bounds[t], bounds[t + 1])
                        total[at[here]] += w * share[here]
                np.add(total, bias, out=some)
                good = np.flatnonzero((some >= best.floor[i]) & (total >= least))
                score = some[good]
                if len(good) > 4 * k:
                    reach = score >= np.partition(score, len(good) - k)[len(good) - k] - best.tolerance
                    good, score = good[reach], score[reach]
                best.add(np.full(len(good), i), score, orders[good], docs[good])
        yield from best.batches(ids, doc_type)

    return run
