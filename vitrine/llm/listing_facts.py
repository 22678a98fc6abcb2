"""Facts of a product listing, read from wherever it states them, and its other words.

Only general knowledge of shop copy is fixed here: units, ways to say a pack or a
generation, colour names.  What is a type of product, a product line, a maker or mere
selling is learned from the listings themselves by ``listing_words``."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa

from vitrine.llm.canonical import NOISE, Matcher, name_tokens

#: Colour names (fixed values); names of the same colour stand together.
COLOURS = """black; white; grey gray; silver; gold; red; orange; yellow; green; blue; navy; teal; turquoise; cyan; purple; violet; pink; magenta;
brown; beige; khaki; olive; sand; copper; bronze; maroon; burgundy; ivory"""
#: Words for no maker (fixed values).
NO_MAKER = frozenset("unbranded generic na none null unknown nobrand tbd other misc various".split())
#: Words that open a phrase of features or purposes (fixed values).
OPENERS = frozenset("with for mit für fuer con para avec pour".split())
#: Words of such a phrase that count as opened by it.
OPENED = 2
#: Attributes that hold a code, a size, a pack count, a generation or a colour (fixed values).
CODE_KEYS = ("mpn", "model", "sku", "part number", "article")
SIZE_KEYS = ("size", "dimension", "dimensions", "capacity", "weight", "length")
PACK_KEYS = ("pack", "quantity", "count")
GEN_KEYS = ("generation", "version")
COLOUR_KEYS = ("color", "colour")

_UNITS = {
    "mm": ("len", 1.0), "cm": ("len", 10.0), "m": ("len", 1000.0), "in": ("len", 25.4), "inch": ("len", 25.4), "inches": ("len", 25.4), "ft": ("len", 304.8),
    "ml": ("vol", 1.0), "cl": ("vol", 10.0), "l": ("vol", 1000.0), "fl oz": ("vol", 29.5735),
    "mg": ("mass", 0.001), "g": ("mass", 1.0), "kg": ("mass", 1000.0), "oz": ("mass", 28.3495), "lb": ("mass", 453.592), "lbs": ("mass", 453.592),
    "w": ("power", 1.0), "watt": ("power", 1.0), "watts": ("power", 1.0), "kw": ("power", 1000.0),
    "pc": ("count", 1.0), "pcs": ("count", 1.0), "piece": ("count", 1.0), "pieces": ("count", 1.0),
}
_MEASURE = re.compile(r"(?<![\w.])(\d+(?:[.,]\d+)?)[\s-]*(fl\.?\s?oz|mm|cm|ml|cl|kg|kw|mg|inches|inch|in|ft|lbs|lb|oz|watts|watt|pieces|piece|pcs|pc|m|l|g|w)(?![\w])", re.I)
_FL_OZ = re.compile(r"fl\.?\s?oz")
_WEAR = {"s": "s", "small": "s", "m": "m", "medium": "m", "l": "l", "large": "l", "xl": "xl", "x-large": "xl", "xxl": "xxl", "2xl": "xxl", "xx-large": "xxl"}
_WEAR_MARKED = re.compile(
    r"(?:\bsize:?\s*|\()\s*(xx-large|x-large|xxl|2xl|xl|small|medium|large|[sml])\b\)?|(?<!\bfor )(?<!\bwith )\b(xx-large|x-large|xxl|2xl|xl|small|medium|large)\b", re.I
)
_WEAR_BARE = re.compile(r"(?:^|[\s,|])([SML])(?=$|[\s,|.])")
_PACK = re.compile(r"\b(?:pack of|set of|box of)\s*(\d+)\b|\b(\d+)\s*-\s*pack\b|(?<![\w])x\s?(\d+)\b|\b(twin)[\s-]pack\b|\b(half)[\s-]dozen\b", re.I)
_GENERATION = re.compile(r"\b(?:gen|generation|mark|mk)\.?\s*(iii|ii|iv|i|\d+)\b|\b(\d+)(?:st|nd|rd|th)\s+gen(?:eration)?\b", re.I)
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4}
#: A code in an attribute, where a blank may part it, and in a text, where "can 2000 ml" is none.
_CODE = re.compile(r"(?<![A-Za-z0-9])([A-Za-z]{2,6})[-/. ]?(\d{3,8})(?![A-Za-z0-9])")
_CODE_SAID = re.compile(r"(?<![A-Za-z0-9])([A-Za-z]{2,6})[-/.]?(\d{3,8})(?![A-Za-z0-9])")
_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W\d_]+|[^\s]")
_DIGIT = re.compile(r"\d")
_LETTERS = re.compile(r"[^\W\d_]+")


def short_spellings(name: str) -> set[str]:
    """Spellings of a colour without some of its vowels, doubled letters or the c of ck, of three letters
    or more; names under five letters lose all vowels or none."""
    if len(name) < 5:
        return {s for s in (name, name[0] + re.sub("[aeiou]", "", name[1:])) if len(s) >= 3}
    out = {name[:1]}
    for i, ch in enumerate(name[1:], 1):
        free = ch in "aeiouwy" or ch == name[i - 1] or name[i : i + 2] == "ck"
        out = {s + ch for s in out} | (out if free else set())
    return {s for s in out if len(s) >= 3}


def _colour_names() -> dict[str, str]:
    groups = [g.split() for g in COLOURS.split(";")]
    whole = {n: g[0] for g in groups for n in g}
    short: dict[str, set[str]] = {}
    for n, c in whole.items():
        for s in short_spellings(n):
            short.setdefault(s, set()).add(c)
    return {s: min(cs) for s, cs in short.items() if len(cs) == 1} | whole


def measures(text: str) -> list[tuple[str, float]]:
    """All sizes in a text as (kind, amount in the base unit)."""
    out = []
    for m in _MEASURE.finditer(text):
        kind, factor = _UNITS[_FL_OZ.sub("fl oz", m[2].lower())]
        out.append((kind, float(m[1].replace(",", ".")) * factor))
    return out


def plain(text: str | None) -> str:
    """A text without markup, wide letters and accents."""
    text = _TAG.sub(" ; ", text) if text and "<" in text else text or ""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text))
    return "".join(ch for ch in text if not unicodedata.combining(ch) and unicodedata.category(ch) != "Cf")


def texts_of(title, description, brand) -> tuple[str, str, str]:
    return plain(title), plain(description), brand or ""


class Reader:
    """Facts and words of listings; ``entries`` are the known makers."""

    def __init__(self, entries: list[tuple[int, str]], least: float = 0.8, memory: int = 200_000):
        self.makers = Matcher(entries, least)
        # Shorter names are found in a brand, but not within a text.
        self.known = Matcher([e for e in entries if len("".join(name_tokens(e[1]))) >= 6], least)
        self.colours = _colour_names()
        self.memory, self._typed = memory, {}
        self._names: dict[str | None, set[str]] = {}
        for ref, name in entries:
            self._names.setdefault(f"r{ref}", set()).update(name_tokens(name))

    def look(self, role: str, text: str) -> int:
        """ref_id of the known maker a text gives, or -1: brands by likeness too, titles and descriptions by mentions."""
        return self.answer(role, text)[0]

    def answer(self, role: str, text: str) -> tuple[int, float, str, int, int]:
        """``look`` with what answers of several lists are compared by."""
        if role == "brand":
            return self.makers.ranked(text)
        found = self.known.mention(name_tokens(text))
        return (found[2], 1.0, "mention", found[0], found[1]) if found else (-1, 0.0, "none", 0, 0)

    def typed(self, brand: str) -> tuple[str | None, str, set[str]]:
        """(known maker, joined words, words) of a typed brand."""
        tokens = name_tokens(brand)
        own = [t for t in tokens if t not in NOISE]
        if not own or "".join(tokens) in NO_MAKER or "".join(own) in NO_MAKER:
            return None, "", set()
        ref = self.look("brand", brand)
        return (f"r{ref}" if ref >= 0 else None), "".join(own), set(tokens)

    def maker(self, brand: str, title: str, description: str) -> tuple[str | None, set[str]]:
        """(maker, its words): the known one that the brand gives, else the one that a text mentions, else the brand as typed."""
        got = self._typed.get(brand)
        if got is None:
            if len(self._typed) >= self.memory:  # only a cache
                self._typed.clear()
            got = self._typed[brand] = self.typed(brand)
        maker, own, tokens = got
        if maker is None:
            for role, text in (("title", title), ("description", description)):
                ref = self.look(role, text) if text else -1
                if ref >= 0:
                    maker = f"r{ref}"
                    break
        if maker is not None:
            return maker, tokens | self._names.get(maker, set())
        return ("t" + own if own else None), tokens

    def read(self, title, description, brand, attributes) -> dict:
        title, description, brand = texts_of(title, description, brand)
        attributes = {str(k).strip().lower(): str(v) for k, v in attributes if v is not None}

        def first(pattern, texts, value):
            for text in texts:
                m = pattern.search(text)
                if m:
                    return value(m)
            return None

        def said(names):
            return [attributes[k] for k in names if k in attributes]

        # Facts are taken out of the texts one after another, so that none is read as part of another;
        # a text without what every form of a fact needs isn't searched for it.
        texts, lows = [title, description], [title.lower(), description.lower()]
        digits = [_DIGIT.search(t) is not None for t in texts]
        gens = ["gen" in t or "mk" in t or "mark" in t for t in lows]
        packs = [d and ("pack" in t or " of" in t or "x" in t) or "twin" in t or "half" in t for t, d in zip(lows, digits)]

        def take(pattern, where, stated, value, stated_pattern=None):
            got = first(stated_pattern or pattern, stated, value)
            for n, t in enumerate(texts):
                if where[n]:
                    got = got or first(pattern, [t], value)
                    texts[n] = pattern.sub(" ; ", t)
            return got

        code = take(_CODE_SAID, digits, said(CODE_KEYS), lambda m: (m[1] + m[2]).lower(), _CODE)
        gen = take(_GENERATION, gens, said(GEN_KEYS), lambda m: int(m[2]) if m[2] else _ROMAN.get(m[1].lower()) or int(m[1]))
        pack = take(_PACK, packs, said(PACK_KEYS), lambda m: 2 if m[4] else 6 if m[5] else int(next(g for g in m.groups() if g)))
        size = wear = None
        for text, digit in [*((t, True) for t in said(SIZE_KEYS)), *zip(texts, digits)]:
            got = measures(text) if digit else []
            m = None if got else _WEAR_MARKED.search(text) or _WEAR_BARE.search(text)
            if got:
                size = got[0]
            elif m:
                wear = _WEAR[next(g for g in m.groups() if g).lower()]
            if got or m:
                break
        texts = [_MEASURE.sub(" ; ", t) if d else t for t, d in zip(texts, digits)]
        maker, maker_words = self.maker(brand, title, description)
        colour = None
        for text in said(COLOUR_KEYS):
            colour = colour or next((self.colours[w] for w in _LETTERS.findall(text.lower()) if w in self.colours), None)
        words, opened = {}, set()
        for text in texts:
            since = OPENED
            for w in _WORD.findall(text.lower()):
                if w in OPENERS:
                    since = 0
                elif not w[0].isalpha():
                    since = OPENED
                else:
                    if since < OPENED:
                        opened.add(w)
                    since += 1
                    if w in self.colours:
                        colour = colour or self.colours[w]
                    elif len(w) > 1 and w not in _WEAR:
                        words[w] = None
        return {
            "maker": maker,
            "size": f"{size[0]}" if size else (f"wear-{wear}" if wear else None),
            "amount": size[1] if size else None,
            "colour": colour,
            "pack": min(pack or 1, 2**31 - 1),
            "gen": min(gen or 1, 2**31 - 1),
            "code": code,
            "words": list(words),
            "opened": [w in opened for w in words],
            "branded": [w in maker_words for w in words],
        }


FACTS = "id string, leaf string, above array<string>, maker string, size string, amount double, colour string, pack int, gen int, code string, words array<string>, opened array<boolean>, branded array<boolean>"


ANSWERS = "id string, role string, mention boolean, length int, start int, likeness double, ref_id int, names array<string>"
FOUND = "array<struct<role:string,ref_id:int,names:array<string>>>"


class ResolvedReader(Reader):
    """Reads listings whose makers were looked up in the blocks of a long list."""

    def __init__(self, least: float = 0.8):
        super().__init__([], least, memory=1)
        self.found: dict[str, int] = {}

    def resolve(self, found) -> None:
        self.found = {x["role"]: x["ref_id"] for x in found}
        self._names = {f"r{x['ref_id']}": set(x["names"]) for x in found}
        self._typed.clear()

    def look(self, role: str, text: str) -> int:
        return self.found.get(role, -1)


def answer_all(entries: list[tuple[int, str]], least: float):
    """What one block of makers answers to the texts of each listing, as ``ANSWERS``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(entries, least)
        columns = [c.split()[0] for c in ANSWERS.split(", ")]
        for pdf in batches:
            rows = []
            for i, *texts in zip(pdf["id"], pdf["title"], pdf["description"], pdf["brand"]):
                title, description, brand = texts_of(*texts)
                for role, text in (("brand", brand), ("title", title), ("description", description)):
                    ref, likeness, method, length, start = reader.answer(role, text) if text else (-1, 0.0, "none", 0, 0)
                    if ref >= 0:
                        rows.append((i, role, method == "mention", length, start, likeness, ref, sorted(reader._names[f"r{ref}"])))
            yield pd.DataFrame(rows, columns=columns)

    return run


_FACTS_SCHEMA = pa.schema(
    [
        ("id", pa.string()), ("leaf", pa.string()), ("above", pa.list_(pa.string())), ("maker", pa.string()), ("size", pa.string()), ("amount", pa.float64()), ("colour", pa.string()),
        ("pack", pa.int32()), ("gen", pa.int32()), ("code", pa.string()), ("words", pa.list_(pa.string())), ("opened", pa.list_(pa.bool_())), ("branded", pa.list_(pa.bool_())),
    ]
)


def read_all(entries: list[tuple[int, str]], least: float, resolved: bool = False):
    """Facts of Arrow batches of listings, as ``FACTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ResolvedReader(least) if resolved else Reader(entries, least)
        names = [f.name for f in _FACTS_SCHEMA][3:]
        for batch in batches:
            given = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            out: dict[str, list] = {n: [] for n in names}
            found = given.get("found") or [None] * batch.num_rows
            for t, d, b, a, f in zip(given["title"], given["description"], given["brand"], given["attributes"], found):
                if resolved:
                    reader.resolve(f or [])
                facts = reader.read(t, d, b, [(x["key"], x["value"]) for x in a or ()])
                for n in names:
                    out[n].append(facts[n])
            yield pa.RecordBatch.from_pydict({"id": given["id"], "leaf": given["leaf"], "above": given["above"], **out}, schema=_FACTS_SCHEMA)

    return run
