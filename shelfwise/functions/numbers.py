"""Number parsing and rounding with the feed format's conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The price range taken as sane.
MIN_SANE_PRICE = 0.05
MAX_SANE_PRICE = 30000.0

_LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def round_half_up(x: Column, digits: int) -> Column:
    """Half-up on the scaled double (1.005 -> 1.0), unlike ``F.round`` on decimals."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def parse_float_prefix(c: Column) -> Column:
    """Leading number of a text, NULL when there is none."""
    return F.regexp_extract(c, _LEADING_NUMBER, 1).try_cast("double")


def parse_price(c: Column) -> Column:
    """As :func:`parse_float_prefix`, the first comma read as the decimal point."""
    return parse_float_prefix(F.regexp_replace(c, r"^([^,]*),", "$1."))


def is_sane_price(p: Column) -> Column:
    return p.between(MIN_SANE_PRICE, MAX_SANE_PRICE) & ~F.isnan(p)


def positive(p: Column) -> Column:
    """A price above 0; Spark orders NaN above every number, so it is ruled out."""
    return (p > 0) & ~F.isnan(p)


def discount_shown(price: Column, old_price: Column) -> Column:
    """The old price, only where it is above the current one."""
    return F.when(old_price > price, old_price)
