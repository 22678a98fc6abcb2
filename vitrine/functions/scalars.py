"""Scalar functions as column expressions; all of them stay inside the JVM unless said."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for Java regular expressions.
WHITE = r"[\p{Z}\s\x1c-\x1f\x85]+"
_NUMBER = r"\d+(?:\.\d+)?"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-cased words of a text, split at white space."""
    return F.filter(F.split(F.lower(text_or_empty(c)), WHITE), lambda x: x != "")


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def product_text(title="title", category="category", tags="tags", brand="brand") -> Column:
    """Title, category, tags and brand in one text; empty parts leave no gap."""
    return _joined(F.col(title), F.col(category), F.array_join(F.col(tags), " "), F.col(brand))


def product_tokens(title="title", category="category", tags="tags", brand="brand") -> Column:
    return tokens(product_text(title, category, tags, brand))


def normalize_score(value: Column, low: Column, high: Column) -> Column:
    """Position between the bounds, kept within 0 and 1; 0 where the bounds leave no room."""
    return F.when(high <= low, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.nullif(high - low, F.lit(0.0)))))


def popularity_raw(stars: Column, reviews: Column) -> Column:
    return stars * F.log1p(reviews)


def _levels(c: Column, sep: str) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(c), sep), lambda x: F.trim(x)), lambda x: x != "")


def category_levels(c: Column, sep: str = ">", none: str = "Unknown") -> Column:
    """Struct of the first level of a path (``none`` if there is none) and the others."""
    levels = _levels(c, sep)
    return F.struct(F.coalesce(F.get(levels, 0), F.lit(none)).alias("category"), F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1))).alias("subcategories"))


def breadcrumbs(c: Column) -> Column:
    return category_levels(c, "›", "Uncategorized")


def tag_slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("-"))


def first_number(c: Column) -> Column:
    plain = F.replace(text_or_empty(c), F.lit(","), F.lit(""))
    return F.nullif(F.regexp_extract(plain, _NUMBER, 0), F.lit("")).try_cast("double")


def parse_price(c: Column) -> Column:
    """First number of a text, thousands commas apart, to two digits; null if there is none."""
    return F.round(first_number(c), 2)


def parse_int(c: Column) -> Column:
    """First run of digits of a text, thousands commas apart; 0 if there is none."""
    digits = F.nullif(F.regexp_extract(F.replace(text_or_empty(c), F.lit(","), F.lit("")), r"\d+", 0), F.lit(""))
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def parse_rating(stars: Column, count: Column) -> Column:
    return F.struct(F.coalesce(first_number(stars), F.lit(0.0)).alias("stars"), parse_int(count).alias("count"))


def _first_entries(values: pd.Series) -> pd.Series:
    import ast

    def one(v):
        try:
            got = ast.literal_eval(v)
            return str(got[0]) if isinstance(got, (list, tuple)) and got else ""
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return ""

    return values.map(one)


def first_image(c: Column) -> Column:
    """First entry of a list written as a Python literal; an empty text if it isn't one."""
    return F.pandas_udf(_first_entries, "string")(c)


def first_text(*columns: Column) -> Column:
    """First of the texts that isn't blank, trimmed; else an empty text."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def recency_days(c: Column, since: str = "2000-01-01") -> Column:
    """Days from ``since`` to an ISO date; 0 for what isn't one."""
    return F.coalesce(F.date_diff(F.try_to_date(c, "yyyy-MM-dd"), F.lit(since).cast("date")), F.lit(0))


def number_or(c: Column, default: float) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float(default)))


def bump_version(c: Column) -> Column:
    """The trailing whole number plus one, else ``-r2`` at the end."""
    digits = F.regexp_extract(c, r"(\d+)$", 1)
    return F.when(digits != "", F.concat(F.regexp_replace(c, r"\d+$", ""), (digits.try_cast("bigint") + 1).cast("string"))).otherwise(F.concat(c, F.lit("-r2")))


def next_version(current: str) -> str:
    m = re.search(r"(\d+)$", current)
    return f"{current[: m.start()]}{int(m[1]) + 1}" if m else f"{current}-r2"


def release_parts(c: Column) -> Column:
    """Numbers of a release such as v1.20.3, trailing zeros apart, for comparing; null if it isn't one."""
    plain = F.regexp_replace(c, r"^[vV]", "")
    parts = F.transform(F.split(F.regexp_replace(plain, r"(\.0+)+$", ""), r"\."), lambda x: x.try_cast("bigint"))
    return F.when(plain.rlike(r"^\d+(\.\d+)*$"), parts)


def title_case(c: Column) -> Column:
    """Capital after the start, blanks and hyphens; other letters as they are."""

    def by(sep: str):
        return lambda words: F.array_join(F.transform(F.split(words, sep), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), sep)

    return by("-")(by(" ")(c))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector scaled to length one; one of length zero as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def url_origin(c: Column) -> Column:
    host = F.try_parse_url(c, F.lit("HOST"))
    return F.when(host.isNotNull(), F.concat(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.try_parse_url(c, F.lit("AUTHORITY")))))


def classify_resource(c: Column, edge: str, uplink: str | None = None) -> Column:
    """``image``, ``uplink``, ``edge`` or ``other``, the first that fits; images by their suffix."""
    image = F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1)).isin("png", "jpg", "jpeg", "webp", "gif", "svg", "avif")
    chain = F.when(image, "image")
    if uplink:
        chain = chain.when(F.startswith(c, F.lit(uplink)), "uplink")
    same = F.startswith(c, F.lit("/")) | F.coalesce(url_origin(c) == F.lit(edge.lower()), F.lit(False))
    return chain.when(same, "edge").otherwise("other")


def safe_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9._-]+$")


def local_image(key: Column, extension: Column) -> Column:
    """Where a product's picture lies in a bundle: the staged photo, else the drawn one."""
    return F.concat(F.lit("/images/"), key, F.lit("."), F.coalesce(extension, F.lit("svg")))


def resized_url(c: Column, pixels: int) -> Column:
    """The size token of a CDN address replaced; other addresses as they are."""
    return F.regexp_replace(c, r"\._[A-Z0-9_,]*S[XLY]\d+[A-Z0-9_,]*_\.", f"._SL{pixels}_.")


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def canonical_json(value) -> bytes:
    """Sorted keys, no blanks, plain UTF-8: equal values have equal bytes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def nearly_equal(a, b, rel: float = 1e-6, absolute: float = 1e-12) -> bool:
    """Numbers within the tolerance, all else exactly; a truth value is no number."""
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or abs(a - b) <= max(rel * max(abs(a), abs(b)), absolute)
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(nearly_equal(a[k], b[k], rel, absolute) for k in a)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(nearly_equal(x, y, rel, absolute) for x, y in zip(a, b))
    return a == b


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
