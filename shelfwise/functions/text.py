"""Text normalisation, tokens, slugs and label helpers."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a normalised text may hold besides single spaces.
ALLOWED = "abcdefghijklmnopqrstuvwxyz0123456789%,./+-"

DISALLOWED_RUN = r"[^a-z0-9%,./+-]+"

# White space as ECMAScript defines it (\s and String.trim); Java's \s is ASCII only.
_WIDE_SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
JS_SPACE = r"\s\x0B" + "".join(chr(c) for c in _WIDE_SPACES)
JS_SPACES = "\t\n\x0b\f\r " + "".join(chr(c) for c in _WIDE_SPACES)


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """(from, to) arguments for ``translate``.

    Code points whose canonical decomposition, less combining marks U+0300-036F,
    is one allowed character map to it; the marks come last and have no
    counterpart, so ``translate`` deletes them.
    """
    src: list[str] = []
    dst: list[str] = []
    for cp in range(0x80, min(sys.maxunicode, 0x2FFFF) + 1):
        if 0xD800 <= cp <= 0xDFFF or 0x300 <= cp <= 0x36F:
            continue
        ch = chr(cp)
        base = "".join(
            c for c in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(c) <= 0x36F
        )
        if base != ch and len(base) == 1 and base.lower() in ALLOWED:
            src.append(ch)
            dst.append(base)
    marks = [chr(cp) for cp in range(0x300, 0x370)]
    return "".join(src + marks), "".join(dst)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it.

    A long expression that repeats a costly input would otherwise compute it
    again in every branch, and outgrow what Spark can compile.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_text(c: Column, also: str = "") -> Column:
    """Accent-free lower case; every run outside the allowed set (and ``also``) becomes one space.

    The regex is left out for texts that are already words and single spaces, which it would not change.
    """
    src, dst = fold_table()
    disallowed = DISALLOWED_RUN.replace("[^", f"[^{re.escape(also)}")

    def spaced(t: Column) -> Column:
        plain = (F.translate(t, f"{ALLOWED}{also} ", "") == "") & ~F.contains(t, F.lit("  "))
        return F.when(plain, t).otherwise(F.regexp_replace(t, disallowed, " "))

    return F.trim(bind(F.lower(F.translate(c, src, dst)), spaced))


def tokens_of(normalized: Column) -> Column:
    """Non-empty words of a normalised text."""
    return F.array_remove(F.split(normalized, " "), "")


def has_words(normalized_name: Column, tokens: Column) -> Column:
    """True when every token is a whole word of the name."""
    return F.size(F.array_except(tokens, F.split(normalized_name, " "))) == 0


def has_word_prefixes(normalized_name: Column, tokens: Column) -> Column:
    """True when every token begins some word of the name (``%`` taken literally)."""
    words = F.split(normalized_name, " ")
    return F.forall(tokens, lambda t: F.exists(words, lambda w: F.startswith(w, t)))


#: position used when no query word occurs in the name
NO_POSITION = 9999


def first_position(normalized_name: Column, tokens: Column, prefix: Column) -> Column:
    """Earliest 1-based position of any query word in the padded name.

    A word that does not occur counts as 0, and an overall 0 becomes
    ``NO_POSITION``, so category-only matches sort last.
    """
    padded = F.concat(F.lit(" "), normalized_name, F.lit(" "))
    tail = F.when(prefix, F.lit("")).otherwise(F.lit(" "))
    pos = F.array_min(
        F.transform(tokens, lambda t: F.position(F.concat(F.lit(" "), t, tail), padded))
    )
    return F.when(pos == 0, F.lit(NO_POSITION)).otherwise(pos)


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(JS_SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def build_normalized_name(name: Column, brand: Column) -> Column:
    """Search name: the brand goes first unless the name already contains it."""

    def joined(both: Column) -> Column:
        n, b = both["n"], both["b"]
        return F.when((b != "") & ~F.contains(n, b), F.concat_ws(" ", b, n)).otherwise(n)

    return bind(
        F.struct(normalize_text(name).alias("n"), normalize_text(brand).alias("b")), joined
    )


def display_label(name: Column, brand: Column) -> Column:
    """Label shown for a product, also used as its basket query."""
    missing = ~F.contains(F.lower(name), F.lower(brand))
    return F.when((brand != "") & missing, F.concat_ws(" ", brand, name)).otherwise(name)


def dashed(c: Column) -> Column:
    """Lower case with every white-space run as one dash."""
    return F.regexp_replace(F.lower(c), f"[{JS_SPACE}]+", "-")


def place_slug(place: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), dashed(place))


def fallback_product_id(name: Column) -> Column:
    return dashed(name)


def admin_product_id(name: Column) -> Column:
    return F.concat(F.lit("admin-"), F.regexp_replace(normalize_text(name), " ", "-"))


def supermarket_slug(name: Column) -> Column:
    return F.regexp_replace(normalize_text(name), " ", "-")


def _upper_first(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def capitalize_slug(slug: Column) -> Column:
    """``mega-image`` -> ``Mega Image``."""
    return F.array_join(F.transform(F.split(slug, "-"), _upper_first), " ")


def title_case(c: Column) -> Column:
    """Title-case a text that is all upper case; leave any other text alone."""
    pieces = F.split(F.lower(c), f"(?<=[{JS_SPACE}-])")
    return F.when(c == F.upper(c), F.array_join(F.transform(pieces, _upper_first), "")).otherwise(c)


def alternative_stem(query: Column) -> Column:
    """Longest word (the first of equals, three characters at least), cut to a stem."""
    words = F.filter(tokens_of(normalize_text(query)), lambda t: F.length(t) >= 3)
    longest = F.aggregate(
        words,
        F.lit(""),
        lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best),
    )
    stem = F.substring(longest, F.lit(1), F.greatest(F.lit(4), F.length(longest) - 2))
    return blank_to_null(stem)


def strip_html(c: Column) -> Column:
    c = F.regexp_replace(c, "<[^>]+>", " ")
    c = F.replace(c, F.lit("&amp;"), F.lit("&"))
    return js_trim(F.regexp_replace(c, f"[{JS_SPACE}]+", " "))


def origin_of(url: Column) -> Column:
    """scheme://host[:port] of a URL; NULL when it has none."""
    return blank_to_null(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))


def absolute_url(url: Column, origin: Column) -> Column:
    """Root-relative links get the page origin; others stay as they are."""
    return F.when(
        F.startswith(url, F.lit("/")) & (origin != ""), F.concat(origin, url)
    ).otherwise(url)
