"""Folding of disguised spellings: look-alike letters, digits for letters, separators inside words."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like Latin ones (fixed values).
HOMOGLYPHS = {
    ord(a): b
    for a, b in zip(
        "авсԁеғɡһіјκӏмоорԛгѕтυѵѡхуᴢαβγδεηικνορτυχωɑıℓʟ",
        "abcdefghijklmnopqrstuvwxyzabydenikvoptuxwaill",
    )
}
HOMOGLYPHS |= {ord(a): b for a, b in zip("кпзщвнмтиьъєыл", "knzwbhmtnbbeyl") if ord(a) not in HOMOGLYPHS}
#: Digits and signs typed for letters (fixed values).
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
#: Signs that hide one letter, whichever it is.
MASKS = "#$@*%&"
ANY = "*"

_TAG = re.compile(r"<[^<>]*>")
_ANY_MASK = re.compile(f"[{re.escape(MASKS)}]")
_MASK = re.compile(rf"(?<=\w)[{re.escape(MASKS)}]+(?=\w)|(?<=\w)\*+|(?<![\w])[@$](?=\w)")
_JOINED = re.compile(r"(?<![^\W_])[^\W_](?:[-._·~]+[^\W_])+(?:(?![^\W_])|(?<=[^\W_][-._·~][^\W_])[^\W_](?![^\W_]))|(?<![^\W_])[^\W_](?:[-._·~ ]{1,3}[^\W_](?![^\W_])){2,}")
#: Without such a pair of single letters in a row nothing is joined.
_PAIR = re.compile(r"(?<![^\W_])[^\W_][-._·~ ]{1,3}[^\W_](?![^\W_])|(?<![^\W_])[^\W_][-._·~]+[^\W_]")
_SEPARATORS = re.compile(r"[^\w*]|_")
_REPEATED = re.compile(r"([^*])\1{2,}")
_WORD = re.compile(r"[^\W_*]*(?:\*+[^\W_*]+|[^\W_*]+\**)+[^\W_]*|[^\W_]+")
_PLAIN_WORD = re.compile(r"[^\W_]+")
_UNIT = re.compile(r"\d+[a-z]{1,4}|[a-z]{2,4}\d{3,}")
#: Ends of sentences; after doubled marks, which also stand within one for stress, only before a capital.
_END = re.compile(r"(?:(?<=[.?…])(?<!\?\?)|(?<=[^!]!))[\s\"'”»)]+|(?<=!!|\?\?)[\s\"'”»)]+(?=[^a-z])|\n+")


class _Plain(dict):
    """Characters in compatible form without accents and invisible ones, worked out when first met."""

    def __missing__(self, code: int) -> str:
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", chr(code)))
        out = self[code] = "".join(ch for ch in text if not unicodedata.combining(ch) and unicodedata.category(ch) != "Cf")
        return out


_PLAIN = _Plain()


def clean(text: str) -> str:
    """Entities, tags, invisible and combining characters removed."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return text if text.isascii() else text.translate(_PLAIN)


def doubled(word: str) -> str:
    """Runs of one letter cut to two."""
    return _REPEATED.sub(r"\1\1", word)


def unleeted(word: str) -> str:
    """Digits of a word read as letters."""
    return "".join(LEET.get(ch, ch) for ch in word)


def fold_word(word: str) -> str:
    """Digits read as letters in words that hold letters, runs of one letter cut to one."""
    if not word.isalpha():
        digits = sum(ch.isdigit() for ch in word)
        letters = sum(ch.isalpha() for ch in word)
        if digits and letters and (digits <= 2 * letters or digits + letters >= 5) and not _UNIT.fullmatch(word):
            word = unleeted(word)
    return _REPEATED.sub(r"\1", word)


def sentences(text: str) -> list[list[str]]:
    """The words of every sentence in lower case, letters set apart joined, look-alikes as Latin letters and
    each sign that hides a letter as ``*``; ``fold_word`` is left to the caller, who may know the word."""
    text = clean(text)
    ascii_only, masked, apart = text.isascii(), _ANY_MASK.search(text), _PAIR.search(text)
    out = []
    for part in _END.split(text):
        part = part.casefold()
        if not ascii_only:
            part = part.translate(HOMOGLYPHS)
        if apart:
            part = _JOINED.sub(lambda m: _SEPARATORS.sub("", m.group()), part)
        if masked:
            part = _MASK.sub(lambda m: ANY * len(m.group()), part)
        words = (_WORD if masked else _PLAIN_WORD).findall(part)
        if words:
            out.append(words)
    return out
