"""Pack sizes and unit prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.numbers import round_half_up
from shelfwise.functions.text import bind, blank_to_null, normalize_text

# Unit word -> (base unit, factor).
UNIT_WORDS = {
    "kg": ("kg", 1.0),
    "g": ("kg", 0.001),
    "gr": ("kg", 0.001),
    "mg": ("kg", 0.000001),
    "l": ("l", 1.0),
    "litri": ("l", 1.0),
    "litru": ("l", 1.0),
    "ml": ("l", 0.001),
    "cl": ("l", 0.01),
    "buc": ("buc", 1.0),
    "bucati": ("buc", 1.0),
    "bucata": ("buc", 1.0),
    "set": ("buc", 1.0),
    "role": ("buc", 1.0),
    "oua": ("buc", 1.0),
}

# Patterns, on normalised text.
NUMBER = r"(\d+(?:[.,]\d+)?)"
UNIT_WORD = r"(kg|gr?|mg|ml|cl|l|litri|litru|buc(?:ata|ati)?|set|role|oua)"
MULTIPACK = rf"(\d+)\s*x\s*{NUMBER}\s*{UNIT_WORD}\b"
SINGLE = rf"{NUMBER}\s*{UNIT_WORD}\b"
PIECE = r"\bbuc(ata)?\b"
BASE_PRICE = rf"=\s*{NUMBER}\s*{UNIT_WORD}\s+{NUMBER}"

# Fixed value: pack size inside a raw product name; the end stands for an ASCII word boundary.
UNIT_IN_NAME = (
    r"(?i)(\d+(?:[.,]\d+)?)\s*(?:x\s*(\d+(?:[.,]\d+)?)\s*)?"
    r"(kg|g|gr|l|ml|cl|buc|bucati|bucăți)(?![A-Za-z0-9_])"
)


def _number(c: Column) -> Column:
    return F.translate(c, ",", ".").try_cast("double")


def _by_word(word: Column, what: int) -> Column:
    out = None
    groups: dict[object, list[str]] = {}
    for w, info in UNIT_WORDS.items():
        groups.setdefault(info[what], []).append(w)
    for value, words in groups.items():
        cond = word.isin(words)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out


def base_unit(word: Column) -> Column:
    return _by_word(word, 0)


def unit_factor(word: Column) -> Column:
    return _by_word(word, 1)


def pack_text(normalized: Column) -> Column:
    """The part of a normalised text that states a pack size: ``6x1,5l``, ``500g`` or ``buc``."""

    def first(t: Column) -> Column:
        multi, single, piece = [
            F.get(F.regexp_extract_all(t, F.lit(p), F.lit(0)), F.lit(0)) for p in (MULTIPACK, SINGLE, PIECE)
        ]
        # a pattern is tried only on texts that hold a letter any match of it has
        return F.coalesce(
            F.when(F.contains(t, F.lit("x")), multi), single, F.when(F.contains(t, F.lit("buc")), piece)
        )

    return bind(normalized, first)


def size_of_pack(pack: Column) -> Column:
    """struct(quantity in the base unit, unit) of a :func:`pack_text`."""
    return bind(pack, _size)


def _size(pack: Column) -> Column:
    # the patterns leave digits, marks, spaces and an x before the unit word, which has no x
    word = F.translate(pack, "0123456789., x", "")
    times = F.when(F.contains(pack, F.lit("x")), F.substring_index(pack, "x", 1)).try_cast("double")
    number = _number(F.translate(F.substring_index(pack, "x", -1), "abcdefghijklmnopqrstuvwyz ", ""))
    # "buc" alone is one piece
    quantity = F.coalesce(
        F.when(times.isNotNull(), times * number).otherwise(number), F.lit(1.0)
    ) * unit_factor(word)
    return F.when(
        pack.isNotNull(),
        F.struct(round_half_up(quantity, 3).alias("quantity"), base_unit(word).alias("unit")),
    )


def parse_unit_size(text: Column) -> Column:
    """Pack text -> struct(quantity in the base unit, unit); NULL when not recognised."""
    return size_of_pack(pack_text(normalize_text(text)))


def price_per_unit(price: Column, parsed: Column) -> Column:
    """Unit price as struct(value, unit); NULL without a positive quantity."""

    def priced(size: Column) -> Column:
        quantity = size["quantity"]
        return F.when(
            quantity > 0,
            F.struct(round_half_up(price / quantity, 2).alias("value"), size["unit"].alias("unit")),
        )

    return bind(parsed, priced)


def parse_base_price(text: Column, reference_compat: bool = False) -> Column:
    """``(=1 kg 37.98)`` -> struct(value per base unit, unit).

    Normalising first would drop the ``=`` and never match; ``reference_compat``
    gives that result (always NULL), and callers then fall back on the computed
    unit price.
    """
    if reference_compat:
        return F.lit(None).cast("struct<value:double,unit:string>")
    stated = F.regexp_extract(normalize_text(text, "="), BASE_PRICE, 0)

    def per_base_unit(m: Column) -> Column:
        word = F.regexp_extract(m, BASE_PRICE, 2)
        quantity = _number(F.regexp_extract(m, BASE_PRICE, 1)) * unit_factor(word)
        price = _number(F.regexp_extract(m, BASE_PRICE, 3))
        return F.when(
            quantity > 0,
            F.struct(
                round_half_up(price / quantity, 2).alias("value"), base_unit(word).alias("unit")
            ),
        )

    return bind(stated, per_base_unit)


def unit_from_name(name: Column) -> Column:
    """Pack size written inside a product name, e.g. ``1 l``."""
    return blank_to_null(F.regexp_extract(name, UNIT_IN_NAME, 0))
