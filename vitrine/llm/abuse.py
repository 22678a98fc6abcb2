"""Problem 9: abusive, hateful or sexual language, scored per document and per source."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.folding import ANY, doubled, fold_word, sentences, unleeted
from vitrine.llm.lexicon import EXCEPTIONS, LEXICON, Entry, phrases_of
from vitrine.runtime import spread

_RUN = re.compile(rf"{re.escape(ANY)}+")
KINDS = ("abuse", "hate", "sexual")


class Scorer:
    """The lexicon as one automaton over folded words."""

    def __init__(self, lexicon: Sequence[Entry], exceptions: str, memory: int = 500_000):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        #: phrase -> what it counts as, once for each kind
        meaning: dict[str, list[tuple[str, float, bool, bool, int]]] = defaultdict(list)
        alone: dict[str, float] = {}
        for n, e in enumerate(lexicon):
            for p in phrases_of(e.phrases):
                meaning[p].append((e.kind, e.weight, e.context, e.adds, n))
                if not e.context:
                    alone[p] = max(e.weight, alone.get(p, 0.0))
        for p in phrases_of(exceptions):
            meaning[p] = []
        for p, what in meaning.items():
            self.auto.add_word(f" {p} ", (p, tuple(what)))
        if meaning:
            self.auto.make_automaton()
        self.words = {w for p in meaning for w in p.split()}
        #: words of phrases that can make a sentence score; without one it isn't searched
        self.triggers = {w for p in alone for w in p.split()}
        # Words with one or two letters hidden, told by what is left of them; the most telling words first.
        self.hidden: dict[str, str] = {}
        telling = {w for p, what in meaning.items() if p in alone or any(e[0] == "abuse" for e in what) for w in p.split() if len(w) > 3 or w == p}
        for w in sorted(telling, key=lambda w: (-alone.get(w, 0.0), -len(w), w)):
            for n in (1, 2):
                if len(w) >= 3 * n:
                    for at in combinations(range(len(w)), n):
                        self.hidden.setdefault("".join(ANY if i in at else ch for i, ch in enumerate(w)), w)
        # For longer runs: words by length, the mildest first.
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted(telling, key=lambda w: (w not in alone, alone.get(w, 0.0), w)):
            self.by_length[len(w)].append(w)
        self.memory, self.known = memory, {}

    def unmasked(self, word: str) -> str:
        """A word with hidden letters filled in: one sign for each letter, else a run of signs for one.

        Two letters at least must be seen in a word that the table doesn't hold."""
        if word in self.hidden:
            return self.hidden[word]
        if len(word) - word.count(ANY) >= 2:
            for w in self.by_length.get(len(word), ()):
                if all(x in (ANY, y) for x, y in zip(word, w)):
                    return w
        return self.hidden.get(_RUN.sub(ANY, word), word)

    def folded(self, word: str) -> str:
        """A word with digits read as letters, hidden letters filled in, or a one-letter word that stuck to it taken off."""
        given, word = word, fold_word(word)
        if word not in self.words:
            # Of a number with letters, and of a run of one letter, the reading that the lexicon knows.
            for other in (unleeted(given), fold_word(unleeted(given)), doubled(given)):
                if other in self.words and not given.isdigit():
                    return other
        if ANY in word:
            return self.unmasked(word)
        if word in self.words or len(word) < 5:
            return word
        if len(word) > 8:
            for start in (0, 1):
                for k in range(start + 4, len(word) - 3):
                    a, b = word[start:k], word[k:]
                    if a in self.words and b in self.words and (a in self.triggers or b in self.triggers):
                        return " ".join(filter(None, (word[:start], a, b)))
        # Short words of context are too often part of others.
        at_end, at_start = word[1:], word[:-1]
        if word[0] in "aeiouy" and at_end in self.words and (at_end in self.triggers or len(at_end) > 4):
            return f"{word[0]} {at_end}"
        if word[-1] in "aeiouy" and at_start in self.triggers:
            return f"{at_start} {word[-1]}"
        return word

    def look(self, word: str) -> tuple[str, bool]:
        """(folded word, whether it is of a telling phrase), remembered."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.memory:  # only a cache
                self.known.clear()
            plain = self.folded(word)
            got = self.known[word] = plain, not self.triggers.isdisjoint(plain.split(" "))
        return got

    def sentence(self, words: list[str]) -> dict[str, float]:
        """Weights by kind; of overlapping phrases the longest counts, inside exceptions none.

        A phrase said again adds nothing, and of most classes one phrase counts: two nouns that
        may be insults are no more of one than the first, but an address beside them tells."""
        looked = [self.look(w) for w in words]
        if not any(t for _, t in looked):
            return {}
        text = " " + " ".join(p for p, _ in looked) + " "
        found = sorted((-len(p), end - len(p), what, p) for end, (p, what) in self.auto.iter(text))
        classes: dict[tuple[str, int], float] = {}
        beside: dict[tuple[str, int], float] = {}
        taken: list[tuple[int, int]] = []
        once: set[str] = set()
        for minus, start, what, phrase in found:
            end = start - minus
            if any(start < b and a < end for a, b in taken):
                continue
            taken.append((start, end))
            if phrase in once:
                continue
            once.add(phrase)
            for kind, weight, context, adds, n in what:
                if context:
                    beside[kind, n] = weight
                else:
                    classes[kind, n] = weight + (classes.get((kind, n), 0.0) if adds else 0.0)
        told: dict[str, float] = {}
        for (kind, _), weight in classes.items():
            told[kind] = told.get(kind, 0.0) + weight
        for (kind, _), weight in beside.items():
            if kind in told:
                told[kind] += weight
        return told


def _scoring(lexicon: Sequence[Entry], exceptions: str, threshold: float):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(lexicon, exceptions)
        for texts in batches:
            rows = []
            for t in texts:
                kinds, hits, n_words, worst = dict.fromkeys(KINDS, 0.0), 0, 0, 0.0
                for words in sentences(t) if t else ():
                    n_words += len(words)
                    got = scorer.sentence(words)
                    if not got:
                        continue
                    top = max(got.values())
                    worst = max(worst, top)
                    hits += top >= threshold - 1e-9
                    for k, v in got.items():
                        kinds[k] += v
                total = sum(kinds.values())
                rows.append((hits, n_words, worst, 100.0 * total / n_words if n_words else 0.0, *(100.0 * v / n_words if n_words else 0.0 for v in kinds.values())))
            yield pd.DataFrame(rows, columns=["n_hits", "n_words", "worst", "score", *KINDS], index=texts.index)

    return run


def abuse_scores(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 1.0, lexicon: Sequence[Entry] | None = None, exceptions: str | None = None) -> DataFrame:
    """``(doc_id, source, n_hits, n_words, worst, score, abuse, hate, sexual)``, one row per document.

    A weighted lexicon is matched by one Aho-Corasick automaton over the words of each
    sentence, after folding look-alike letters, digits and signs typed for letters, hidden
    letters and letters set apart.  Phrases inside an exception don't count.  Milder words
    add up within a kind, and some only count beside others (see ``lexicon``).

    ``score`` and the three kinds are all weights found per hundred words, so that long
    texts don't score high for their length; ``worst`` is the heaviest kind of a sentence
    and ``n_hits`` the number of sentences where it reaches ``threshold``.

    Null and blank texts score 0; a document sent twice has two rows.  Whole texts are
    read; rows only move where they lie in fewer parts than there are cores."""
    run = F.pandas_udf(
        _scoring(lexicon or LEXICON, EXCEPTIONS if exceptions is None else exceptions, threshold),
        "n_hits int, n_words int, worst double, score double, abuse double, hate double, sexual double",
    )
    texts = spread(documents.select(F.col(key).alias("k"), F.col("source").alias("src"), F.col(text).alias("t")))
    rows = texts.select("k", "src", run(F.col("t")).alias("s"))
    return rows.select(F.col("k").alias(key), F.col("src").alias("source"), "s.*")


def rates_by_source(scores: DataFrame) -> DataFrame:
    """``(source, documents, flagged, rate, mean_score)``, sources trimmed and lower-cased, null as ``unknown``."""
    source = F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("unknown"))
    flagged = F.col("n_hits") > 0
    return scores.groupBy(source.alias("source")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(flagged).alias("flagged"), F.avg(flagged.cast("double")).alias("rate"), F.avg("score").alias("mean_score")
    )
