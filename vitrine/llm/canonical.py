"""Problem 1: values typed freely, mapped to the entries of a reference list."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.runtime import MAX_BROADCAST_ROWS, cut, parallelism

#: Words that sellers put around a name and that are no part of one (fixed values).
NOISE = frozenset("a an and by brand co company corp gmbh inc llc ltd limited n of official sa store the visit und y".split())
#: Digits and signs typed for letters (fixed values); only used inside words that hold letters.
LOOKALIKES = str.maketrans("01345789@$", "oleastbgas")
_SIGNS = re.compile("[™®©]")
_WORD = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*")


def name_tokens(value: str) -> list[str]:
    """Lower-case words of a name without accents, signs, entities and look-alike digits."""
    text = _SIGNS.sub(" ", html.unescape(value) if "&" in value else value)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text))
        text = "".join(ch for ch in text if not unicodedata.combining(ch) and unicodedata.category(ch) != "Cf")
    return [w if w.isalpha() or not any(ch.isalpha() for ch in w) else w.translate(LOOKALIKES) for w in _WORD.findall(text.casefold())]


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours) from a to b, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new, least = [i], i
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
            least = min(least, v)
        if least > most:
            return most + 1
        before, row = row, new
    return row[-1]


def _grams(s: str) -> set[str]:
    padded = f"^{s}$"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


#: Likeness from which two words count as spellings of one, and letters from which a word may be misspelt.
SAME_WORD, SPELT = 0.75, 4


class Matcher:
    """Names and aliases of one field: an automaton for mentions, sets of words that may be misspelt for likeness."""

    def __init__(self, entries: list[tuple[int, str]], least: float):
        import ahocorasick

        self.least = least
        #: sets of words of the entries, the entries of each word, and the words of each pair of letters
        self.sets: list[tuple[frozenset[str], int]] = []
        self.having: dict[str, list[int]] = defaultdict(list)
        self.by_gram: dict[str, list[str]] = defaultdict(list)
        self._spelt: dict[str, list[tuple[str, float]]] = {}
        self.forms: list[tuple[str, int]] = []
        best: dict[str, int] = {}
        for ref, name in entries:
            tokens = [t for t in name_tokens(name) if t not in NOISE] or name_tokens(name)
            if tokens:
                for t in set(tokens):
                    if t not in self.having and len(t) >= SPELT:
                        for g in _grams(t):
                            self.by_gram[g].append(t)
                    self.having[t].append(len(self.sets))
                self.sets.append((frozenset(tokens), ref))
            for form in {"".join(tokens), "".join(sorted(tokens))} - {""}:
                best[form] = min(ref, best.get(form, ref))
        self.exact = best
        self.automaton = ahocorasick.Automaton()
        self.index: dict[str, list[int]] = defaultdict(list)
        for k, (form, ref) in enumerate(sorted(best.items())):
            self.forms.append((form, ref))
            self.automaton.add_word(form, (len(form), ref))
            for g in _grams(form):
                self.index[g].append(k)
        if best:
            self.automaton.make_automaton()

    def match(self, value: str) -> tuple[int, float, str]:
        """(ref_id or -1, likeness, method)."""
        return self.ranked(value)[:3]

    def ranked(self, value: str) -> tuple[int, float, str, int, int]:
        """``match`` with the length and start of the mention, by which answers of several lists are compared."""
        if not self.forms:
            return -1, 0.0, "none", 0, 0
        tokens = name_tokens(value)
        kept = [t for t in tokens if t not in NOISE] or tokens
        mention = self.mention(kept)
        if mention is not None:
            length, start, ref = mention
            return ref, 1.0, "mention", length, start
        found = self._word_set(kept)
        return *(found if found[0] >= 0 else self._joined(kept)), 0, 0

    def mention(self, tokens: list[str]) -> tuple[int, int, int] | None:
        """(length, start, ref_id) of the longest name found from word start to word end, of several the first."""
        if not self.forms:
            return None
        text, starts, ends = "".join(tokens), set(), set()
        at = 0
        for t in tokens:
            starts.add(at)
            at += len(t)
            ends.add(at)
        found = [(-length, end + 1 - length, ref) for end, (length, ref) in self.automaton.iter(text) if end + 1 - length in starts and end + 1 in ends]
        if not found:
            return None
        length, start, ref = min(found)
        return -length, start, ref

    def _spellings(self, word: str) -> list[tuple[str, float]]:
        """Words of the entries that are ``word`` or a spelling of it, with their likeness."""
        got = self._spelt.get(word)
        if got is None:
            if len(self._spelt) > 100_000:  # only a cache
                self._spelt.clear()
            got = [(word, 1.0)] if word in self.having else []
            shared: dict[str, int] = defaultdict(int)
            grams = _grams(word) if len(word) >= SPELT else ()
            for g in grams:
                for w in self.by_gram.get(g, ()):
                    shared[w] += 1
            for w, n in shared.items():
                longest = max(len(word), len(w))
                most = int((1 - SAME_WORD) * longest + 1e-9)
                # One edit changes at most three bigrams; repeated bigrams only make the count smaller.
                if w != word and n >= min(len(grams), len(w)) - 3 * most:
                    d = edit_distance(word, w, most)
                    if d <= most:
                        got.append((w, 1 - d / longest))
            self._spelt[word] = got
        return got

    def _word_set(self, tokens: list[str]) -> tuple[int, float, str]:
        """Token-set similarity: twice the likeness of the words two sets share, over the sizes of both.

        Each word of the value goes to one of the entry at most, the most alike pairs first."""
        words = sorted(set(tokens))
        pairs: dict[int, list[tuple[float, str, str]]] = defaultdict(list)
        for word in words:
            for w, like in self._spellings(word):
                for k in self.having[w]:
                    pairs[k].append((-like, word, w))
        top: tuple[float, int] | None = None
        for k, found in pairs.items():
            entry, ref = self.sets[k]
            if 2 * len(found) < self.least * (len(words) + len(entry)) - 1e-9:
                continue
            mine, theirs, total = set(), set(), 0.0
            for minus, word, w in sorted(found):
                if word not in mine and w not in theirs:
                    mine.add(word)
                    theirs.add(w)
                    total -= minus
            score = 2 * total / (len(words) + len(entry))
            if score >= self.least - 1e-9 and (top is None or (-score, ref) < top):
                top = (-score, ref)
        return (top[1], -top[0], "alike") if top else (-1, 0.0, "none")

    def _joined(self, tokens: list[str]) -> tuple[int, float, str]:
        """For values whose blanks are set wrongly: the joined words, in the given and in sorted order, by edits over length."""
        top: tuple[float, int] | None = None
        for form in {"".join(tokens), "".join(sorted(tokens))} - {""}:
            shared: dict[int, int] = defaultdict(int)
            grams = _grams(form)
            for g in grams:
                for k in self.index.get(g, ()):
                    shared[k] += 1
            for k, n in shared.items():
                other, ref = self.forms[k]
                longest = max(len(form), len(other))
                most = int((1 - self.least) * longest + 1e-9)
                if most < 1 or abs(len(form) - len(other)) > most or n < min(len(grams), len(_grams(other))) - 3 * most:
                    continue
                d = edit_distance(form, other, most)
                if d <= most and (top is None or (d / longest - 1, ref) < top):
                    top = (d / longest - 1, ref)
        return (top[1], -top[0], "joined") if top else (-1, 0.0, "none")


MATCHED = "field string, value string, ref_id int, likeness double, method string, length int, start int"
#: Methods in the order in which answers of several lists are compared.
METHODS = ("none", "joined", "alike", "mention")


def _mapper(entries: dict[str, list[tuple[int, str]]], least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = {f: Matcher(e, least) for f, e in entries.items()}
        columns = [c.split()[0] for c in MATCHED.split(", ")]
        for pdf in batches:
            rows = []
            for field, value in zip(pdf["field"], pdf["value"]):
                m = matchers.get(field)
                rows.append((field, value, *(m.ranked(value) if m else (-1, 0.0, "none", 0, 0))))
            yield pd.DataFrame(rows, columns=columns)

    return run


def reference_blocks(reference: DataFrame, block: int) -> Iterator[tuple[dict[str, list[tuple[int, str]]], bool]]:
    """(names and aliases by field, whether it is the last block), about ``block`` rows at a time; those of one ``ref_id`` stay together.

    There is always a block, if an empty one."""
    ref = reference.select("ref_id", "field", "name", "aliases").where("ref_id is not null and field is not null").orderBy("ref_id")
    names: dict[str, list[tuple[int, str]]] = defaultdict(list)
    n, last = 0, None
    for r in ref.toLocalIterator():
        if n >= block and r["ref_id"] != last:
            yield dict(names), False
            names, n = defaultdict(list), 0
        n, last = n + 1, r["ref_id"]
        for name in [r["name"], *(r["aliases"] or [])]:
            if name and name.strip():
                names[r["field"]].append((r["ref_id"], name))
    yield dict(names), True


def map_to_canonical(values: DataFrame, reference: DataFrame, least: float = 0.8, block: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``values(id, field, value)`` plus ``ref_id, likeness, method``.

    ``reference(ref_id, field, name, aliases)``.  A multi-pattern automaton over all names
    and aliases finds those mentioned in a value (whole words, blanks and punctuation
    apart); of the mentions the longest non-overlapping ones win, and of several the
    longest, then the first.  Values without a mention go to token-set similarity, where
    words spelt nearly alike count by their likeness, ``least`` at least; what that leaves
    is compared joined, as blanks may be set wrongly.  Equal likeness goes to the smaller
    ``ref_id``.  Method is ``mention``, ``alike``, ``joined`` or ``none`` (``ref_id`` -1, the
    report of unmatched values).

    Every distinct value is matched once, spread over all tasks, and its answer joined
    back (sent to all tasks only where there are at most ``MAX_BROADCAST_ROWS``).  The list
    goes to the tasks in blocks of ``block`` entries, of which the driver holds one at a
    time; of several blocks' answers the best by the same rules counts.

    Null or blank values and null fields give no row.  Entries without a name count by
    their aliases; a field without entries is unmatched.  Texts of any length are
    searched whole; repeated rows come out as often as they went in."""
    rows = values.select(F.col("id").cast("string").alias("id"), F.col("field").cast("string").alias("field"), F.col("value").cast("string").alias("value")).where(
        F.col("field").isNotNull() & F.col("value").rlike(r"[^\p{Z}\s]")
    )
    parts = parallelism(values.sparkSession)
    distinct = rows.select("field", "value").distinct().repartition(parts, "value", "field")
    answers: list[DataFrame] = []
    for entries, last in reference_blocks(reference, block):
        if not last and not answers:
            distinct = cut(distinct)  # so that it is told once, not once a block
        part = distinct.mapInPandas(_mapper(entries, least), MATCHED)
        answers.append(part if last and not answers else cut(part))  # matched before the next block is fetched
    best = answers[0]
    if len(answers) > 1:
        order = F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))
        rank = F.struct(order.alias("m"), F.col("length").alias("n"), (-F.col("start")).alias("s"), F.col("likeness").alias("l"), (-F.col("ref_id")).alias("r"))
        best = reduce(DataFrame.unionByName, answers).groupBy("field", "value").agg(F.max(F.struct(rank, "method")).alias("b"))
        best = best.select("field", "value", (-F.col("b.col1.r")).alias("ref_id"), F.col("b.col1.l").alias("likeness"), F.col("b.method").alias("method"))
    best = cut(best.select("field", "value", "ref_id", "likeness", "method"))
    if best.count() <= MAX_BROADCAST_ROWS:
        best = F.broadcast(best)
    return rows.join(best, ["field", "value"]).select("id", "field", "value", "ref_id", "likeness", "method")


def typed_values(records: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """``(id, field, value)``: the given columns of each record as rows."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return records.select(F.col(key).alias("id"), F.explode(pairs).alias("p")).select("id", "p.field", "p.value")


def not_exact(values: DataFrame, reference: DataFrame) -> DataFrame:
    """Values that aren't, character for character, a canonical name of their field."""
    names = reference.select("field", F.col("name").alias("value")).where("name is not null").distinct()
    return values.join(names, ["field", "value"], "left_anti")
