"""Problem 7: evaluation texts leaking into training text, by suffix arrays of corpus shards."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.runtime import cut, spread

_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W_]+")
#: Words of test items handled at once; more items are worked through in blocks.
BLOCK_WORDS = 1_000_000
#: Places of matches held at once; a shard's matches are worked through by items where there are more.
MOST_PLACES = 4_000_000
#: Words of corpus text per suffix array.
SHARD_WORDS = 1_000_000
SCHEMA = "doc long, item long, coverage double, matched int, longest int, doc_word int, item_word int"


def words_of(text: str) -> list[str]:
    """Words without case, punctuation, spacing, markup and invisible characters."""
    text = unicodedata.normalize("NFKC", _TAG.sub(" ", html.unescape(text)))
    if not text.isascii():
        text = "".join(ch for ch in text if unicodedata.category(ch) != "Cf")
    return _WORD.findall(text.lower())


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``tokens`` in the order of their suffixes, by doubling; order beyond
    ``depth`` words doesn't matter to texts that short."""
    n = len(tokens)
    rank, k = tokens.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while n > 1:
        after = np.zeros(n, np.int64)
        if k < n:
            after[:-k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank, k = new, 2 * k
        if k >= depth or rank[order[-1]] == n - 1:
            break
    return order


class ItemSet:
    """The words of the items of one block, and all their suffixes."""

    def __init__(self, items: list[tuple[int, list[str]]], seed: int):
        self.vocabulary: dict[str, int] = {}
        flat, owner, at = [], [], []
        self.items = [i for i, _ in items]
        self.lengths = np.array([len(w) for _, w in items])
        for k, (_, words) in enumerate(items):
            for j, w in enumerate(words):
                flat.append(self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
                owner.append(k)
                at.append(j)
            flat.append(0)
            owner.append(k)
            at.append(len(words))
        self.tokens = np.array(flat, np.int64)
        self.owner, self.at = np.array(owner), np.array(at)
        # Shorter items are looked for whole.
        self.least = np.minimum(seed, self.lengths)[self.owner] if len(items) else self.owner
        self.starts = np.flatnonzero(self.at + self.least <= self.lengths[self.owner]) if len(items) else np.zeros(0, np.int64)
        self.starts = self.starts[self.tokens[self.starts] > 0]
        self.depth = int(self.lengths.max()) if len(items) else 0


def narrowed(order: np.ndarray, tokens: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, wanted: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search, for all intervals at once: where among the suffixes ``order[lo:hi]``, which agree in
    ``depth`` words, those begin whose next word isn't below (``upper``: is above) ``wanted``."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        word = tokens[order[np.where(open_, mid, 0)] + depth]
        right = open_ & ((word <= wanted) if upper else (word < wanted))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)


def suffix_intervals(order: np.ndarray, tokens: np.ndarray, test: ItemSet):
    """Every test suffix looked up in the suffix array: ``(q, lo, hi, length)``, disjoint intervals of
    ``order`` whose suffixes agree with the test suffix ``q`` in exactly ``length`` words.

    The interval of a suffix is narrowed word by word until no suffix of the shard is
    left; what drops out at a word has that much in common with it."""
    q = test.starts
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(order))
    out, depth = [], 0
    while len(q):
        wanted = test.tokens[q + depth]
        a = narrowed(order, tokens, lo, hi, depth, wanted, False)
        b = narrowed(order, tokens, a, hi, depth, wanted, True)
        b = np.where(wanted == 0, a, b)  # the item ends here
        long = depth >= test.least[q]
        for x, y in ((lo, a), (b, hi)):
            some = long & (x < y)
            out.append((q[some], x[some], y[some], np.full(some.sum(), depth)))
        go = a < b
        q, lo, hi, depth = q[go], a[go], b[go], depth + 1
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... n[0] of them, then those of lo[1], and so on."""
    first = np.repeat(np.cumsum(n) - n, n)
    return np.repeat(lo, n) + np.arange(n.sum()) - first


def shard_matches(tokens: np.ndarray, place: np.ndarray, doc: np.ndarray, test: ItemSet, gap: int, passage: int, most: int = MOST_PLACES) -> Iterator[list[np.ndarray]]:
    """Passages of test items in one shard, by groups of items.

    ``tokens`` are the shard's words (0: no word of the tests, at least one between
    documents), ``place`` their places in the document and ``doc`` its number.  Every
    test suffix is looked up in the suffix array by binary search, which gives all
    places with the length of their verbatim match; those that can't be extended to the
    left are kept; matches on one diagonal with at most ``gap`` other words between them
    are one passage.  Items with many places are worked through ``most`` at a time.

    Gives per passage: doc, item, first and last word in the item, first word in the
    document, words of its longest verbatim match."""
    order = suffix_array(tokens, test.depth)
    order = order[tokens[order] > 0]
    padded = np.concatenate([tokens, np.zeros(test.depth + 1, tokens.dtype)])
    q, lo, hi, length = suffix_intervals(order, padded, test)
    by_item = np.argsort(test.owner[q], kind="stable")
    q, lo, hi, length = (x[by_item] for x in (q, lo, hi, length))
    heads = np.flatnonzero(np.concatenate([[True], test.owner[q][1:] != test.owner[q][:-1]])) if len(q) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(hi - lo)])
    begin = 0
    for k, head in enumerate(heads):
        end = heads[k + 1] if k + 1 < len(heads) else len(q)
        # Up to the item after which there would be too many.
        if end < len(q) and total[heads[k + 2] if k + 2 < len(heads) else len(q)] - total[begin] <= most:
            continue
        part = slice(begin, end)
        yield _passages(q[part], lo[part], hi[part], length[part], order, tokens, place, doc, test, gap, passage)
        begin = end


def _passages(q, lo, hi, length, order, tokens, place, doc, test: ItemSet, gap: int, passage: int) -> list[np.ndarray]:
    n = hi - lo
    p = order[_ranges(lo, n)]
    q, length = np.repeat(q, n), np.repeat(length, n)
    before_p = np.where(p > 0, tokens[p - 1], 0)
    before_q = np.where(test.at[q] > 0, test.tokens[q - 1], 0)
    first = (before_p == 0) | (before_p != before_q)
    p, q, length = p[first], q[first], length[first]
    if not len(p):
        return [np.zeros(0, np.int64)] * 6
    item, start, where, d = test.owner[q], test.at[q], place[p], doc[p]
    diagonal = where - start
    sort = np.lexsort((start, diagonal, item, d))
    item, start, where, d, diagonal, length = (x[sort] for x in (item, start, where, d, diagonal, length))
    end = start + length
    joins = np.concatenate([[False], (d[1:] == d[:-1]) & (item[1:] == item[:-1]) & (diagonal[1:] == diagonal[:-1]) & (start[1:] - end[:-1] <= gap)])
    heads = np.flatnonzero(~joins)
    last = np.concatenate([heads[1:], [len(start)]]) - 1
    longest = np.maximum.reduceat(length, heads)
    keep = end[last] - start[heads] >= np.minimum(passage, test.lengths[item[heads]])
    h, e = heads[keep], last[keep]
    return [d[h], item[h], start[h], end[e], where[h], longest[keep]]


def _covered(found, test: ItemSet, least: float) -> list[tuple]:
    """Per document and item the share of the item's words that its passages cover."""
    d, item, start, end, where, longest = found
    if not len(d):
        return []
    sort = np.lexsort((start, item, d))
    d, item, start, end, where, longest = (x[sort] for x in (d, item, start, end, where, longest))
    out = []
    heads = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (item[1:] != item[:-1])]))
    for a, b in zip(heads, [*heads[1:], len(d)]):
        top, total = -1, 0
        for s, e in zip(start[a:b], end[a:b]):
            total += max(0, e - max(s, top))
            top = max(top, e)
        size = int(test.lengths[item[a]])
        if total >= least * size:
            best = a + int(np.argmax(longest[a:b]))
            out.append((int(d[a]), test.items[item[a]], total / size, int(total), int(longest[best]), int(where[best]), int(start[best])))
    return out


def _search(items: list[tuple[int, list[str]]], seed: int, gap: int, passage: int, least: float, shard_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        test = ItemSet(items, seed)
        vocabulary = test.vocabulary

        def finish(ids, tokens, places, docs):
            found = shard_matches(np.concatenate(tokens), np.concatenate(places), np.concatenate(docs), test, gap, passage)
            rows = [(ids[r[0]], *r[1:]) for part in found for r in _covered(part, test, least)]
            return pd.DataFrame(rows, columns=["doc", "item", "coverage", "matched", "longest", "doc_word", "item_word"])

        ids, tokens, places, docs, size = [], [], [], [], 0
        for pdf in batches:
            for key, text in zip(pdf["doc"], pdf["text"]):
                words = words_of(text)
                t = np.fromiter((vocabulary.get(w, 0) for w in words), np.int64, len(words))
                # Of runs of words no test has, one place is enough; a 0 ends every document.
                keep = (t > 0) | (np.concatenate([[1], t[:-1]]) > 0)
                t, at = np.append(t[keep], 0), np.append(np.flatnonzero(keep), len(words))
                if len(t) < 2:
                    continue
                tokens.append(t)
                places.append(at)
                docs.append(np.full(len(t), len(ids)))
                ids.append(key)
                size += len(t)
                if size >= shard_words:
                    yield finish(ids, tokens, places, docs)
                    ids, tokens, places, docs, size = [], [], [], [], 0
        if ids:
            yield finish(ids, tokens, places, docs)

    return run


def leaked(
    documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", seed: int = 4, gap: int = 2,
    passage: int = 8, least: float = 0.4, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(doc_id, item_id, coverage, matched, longest, doc_word, item_word)`` of leaked test items.

    Every task builds suffix arrays of its documents (``shard_words`` words each, words
    no test holds left out) and looks every suffix of every test item up in them, which
    gives the longest verbatim matches with their places.  Matches of ``seed`` words or
    more, apart by at most ``gap`` changed words, make a passage; passages of at least
    ``passage`` words count, and a document whose passages cover ``least`` of an item's
    words holds it.  An item of fewer words than these counts where it stands whole.
    ``longest``, ``doc_word`` and ``item_word`` are length and places of the longest
    verbatim match.

    The corpus isn't shuffled.  Items go to the tasks in blocks of ``block_words`` words,
    one pass over the corpus each; the driver holds one block at a time.  Null or blank
    texts and null keys match nothing; a repeated item key counts once, with the longest
    text.  Documents are read whole; the same document sent twice gives its rows twice."""
    rows = documents.select(F.col(doc_key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    rows = spread(rows)
    out = None
    for block, last in item_blocks(items, item_key, text, block_words):
        part = rows.mapInPandas(_search(block, seed, gap, passage, least, shard_words), SCHEMA)
        if out is not None or not last:
            part = cut(part)  # found before the next block is fetched
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], SCHEMA)
    return out.withColumnsRenamed({"doc": doc_key, "item": item_key})


def item_blocks(items: DataFrame, key: str, text: str, block_words: int) -> Iterator[tuple[list[tuple[int, list[str]]], bool]]:
    """(items with their words, whether it is the last block), about ``block_words`` words at a time."""
    size = F.length(text)
    longest = items.select(F.col(key).cast("long").alias("i"), F.struct(size.alias("n"), F.col(text).alias("t")).alias("x")).where("i is not null and x.t is not null")
    block: list[tuple[int, list[str]]] = []
    n = 0
    for r in longest.groupBy("i").agg(F.max("x").alias("x")).orderBy("i").select("i", "x.t").toLocalIterator():
        words = words_of(r["t"])
        if not words:
            continue
        if n and n + len(words) > block_words:
            yield block, False
            block, n = [], 0
        block.append((r["i"], words))
        n += len(words)
    if block:
        yield block, True


def without_leaks(documents: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that hold no test item."""
    return documents.join(found.select(key).distinct(), key, "left_anti")
