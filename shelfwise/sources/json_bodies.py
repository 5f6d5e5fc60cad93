"""Product lists inside arbitrary captured JSON.

A small per-body walk finds arrays that look like product lists and emits
their objects; price scale, sanity and mapping are DataFrame work.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import batched
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numbers import is_sane_price, round_half_up
from shelfwise.functions.text import absolute_url, blank_to_null, js_trim, origin_of
from shelfwise.functions.units import unit_from_name
from shelfwise.schemas import HARVESTED_COLUMNS
from shelfwise.session import bound_batches, materialize

#: items a worker turns into one frame at a time
SLICE_ROWS = 4096

# Member names tried in order, and the patterns of price members.
NAME_KEYS = ["name", "productName", "title", "displayName", "fullTitle", "label", "denumire"]
ID_KEYS = ["sku", "id", "productId", "code", "ean", "itemId", "articleNumber", "klNr"]
IMAGE_KEYS = ["image", "imageUrl", "imageURL", "img", "thumbnail", "listImage", "picture"]
URL_KEYS = ["url", "link", "href", "canonicalUrl", "productUrl"]
BRAND_KEYS = ["brand", "brandName", "manufacturer", "marca"]
CATEGORY_KEYS = ["category", "categoryName", "categorie"]
PRICE_KEY = re.compile(r"price|pret|amount|value|suma", re.IGNORECASE)
PREFERRED_PRICE_KEY = re.compile(
    r"(^|[._])(price|pret|sellingprice|currentprice|finalprice)", re.IGNORECASE
)
PRICE_TEXT = re.compile(r"^\d+([.,]\d+)?$", re.ASCII)
# What makes a list of products.
MIN_OBJECTS = 3
GOOD_SHARE = 0.6


class Limits(NamedTuple):
    """Optional cuts of the walk; None is no cut. A longer text is no text, or cut if it is rendered."""

    depth: int | None = None  # levels walked
    entered: int | None = None  # elements entered per array that is no product list
    sample: int | None = None  # objects a list is judged on
    price_depth: int | None = None  # levels of price members
    name: int | None = None  # characters, as all that follow
    external_id: int | None = None
    brand: int | None = None
    category: int | None = None
    address: int | None = None


#: the walk of the reference
REFERENCE_LIMITS = Limits(8, 50, 10, 3, 300, 100, 100, 150, 2000)

ITEM_SCHEMA = (
    "body_id bigint, url string, array_idx int, item_idx int, name string, raw_price double, "
    "external_id string, brand string, category string, image string, link string"
)


def text_of(value: object, longest: int | None = None) -> str | None:
    """Usable text of a member: a string, a named or rendered object, or a first element."""
    if isinstance(value, str):
        fits = longest is None or len(value) <= longest
        return value.strip() if len(value.strip()) >= 2 and fits else None
    if isinstance(value, dict):
        named, rendered = value.get("name"), value.get("rendered")
        if isinstance(named, str) and named.strip():
            return named.strip()
        if isinstance(rendered, str) and rendered.strip():
            plain = re.sub(r"<[^>]+>", " ", rendered).replace("&amp;", "&")
            return " ".join(plain.split())[:longest]
    if isinstance(value, list) and value:
        head = value[0]
        if isinstance(head, str) and head.strip():
            return head.strip()
        if isinstance(head, dict) and isinstance(head.get("url"), str):
            return head["url"]
    return None


def first_text(obj: dict, keys: list[str], longest: int | None = None) -> str | None:
    found = (text_of(obj.get(k), longest) for k in keys)
    return next((t for t in found if t is not None), None)


def price_members(obj: dict, max_depth: int | None = None) -> Iterator[tuple[str, float]]:
    stack = [("", iter(obj.items()))]
    while stack:
        path, members = stack[-1]
        for key, value in members:
            where = f"{path}.{key}" if path else key
            if not PRICE_KEY.search(where):
                continue
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                yield where, float(value)
            elif isinstance(value, str) and PRICE_TEXT.match(value.strip()):
                yield where, float(value.strip().replace(",", "."))
            elif isinstance(value, dict) and (max_depth is None or len(stack) <= max_depth):
                stack.append((where, iter(value.items())))
                break
        else:
            stack.pop()


def price_of(obj: dict, max_depth: int | None = None) -> float | None:
    """Positive price of the member that says so most plainly, the shortest path first."""
    found = [m for m in price_members(obj, max_depth) if m[1] > 0]
    best = min(
        found, key=lambda m: (PREFERRED_PRICE_KEY.search(m[0]) is None, len(m[0])), default=None
    )
    return None if best is None else best[1]


def product_lists(value: object, limits: Limits = Limits()) -> Iterator[list[dict]]:
    """Product lists in document order; nothing is looked for inside one."""
    stack = [(value, 0)]
    while stack:
        value, depth = stack.pop()
        if limits.depth is not None and depth > limits.depth:
            continue
        if isinstance(value, list):
            objects = [x for x in value if isinstance(x, dict)]
            if len(objects) >= MIN_OBJECTS:
                sample = objects[: limits.sample]
                good = sum(
                    1
                    for o in sample
                    if first_text(o, NAME_KEYS, limits.name) and price_of(o, limits.price_depth) is not None
                )
                if good / len(sample) >= GOOD_SHARE:
                    yield objects
                    continue
            inner = value[: limits.entered]
        elif isinstance(value, dict):
            inner = list(value.values())
        else:
            continue
        stack.extend((x, depth + 1) for x in reversed(inner) if isinstance(x, (dict, list)))


_SPACE = re.compile(r"[ \t\n\r]*")


def _loads_deep(body: str) -> object:
    """``json.loads`` with a stack of its own, for bodies nested deeper than the interpreter allows."""
    scalar = json.JSONDecoder().raw_decode
    root: list = []
    stack: list[tuple] = [(root, None)]  # open containers, and the key each has in its parent

    def put(value: object, key: object) -> None:
        held = stack[-1][0]
        held.append(value) if isinstance(held, list) else held.__setitem__(key, value)

    at, fresh, value_due, key = 0, False, True, None  # fresh: just opened, may close at once
    while True:
        at = _SPACE.match(body, at).end()
        c, held = body[at : at + 1], stack[-1][0]
        if len(stack) == 1 and not value_due:
            if c:
                raise ValueError(f"extra data at {at}")
            return root[0]
        closing = "]" if isinstance(held, list) else "}"
        if len(stack) > 1 and c == closing and (fresh or not value_due):
            stack.pop()
            at, fresh, value_due = at + 1, False, False
            continue
        if not value_due:
            if c != ",":
                raise ValueError(f"comma expected at {at}")
            at, value_due, fresh = at + 1, True, False
            continue
        if isinstance(held, dict):
            if c != '"':
                raise ValueError(f"key expected at {at}")
            key, at = scalar(body, at)
            at = _SPACE.match(body, at).end()
            if body[at : at + 1] != ":":
                raise ValueError(f"colon expected at {at}")
            at = _SPACE.match(body, at + 1).end()
            c = body[at : at + 1]
        if c and c in "[{":
            opened: list | dict = [] if c == "[" else {}
            put(opened, key)
            stack.append((opened, key))
            at, fresh, value_due = at + 1, True, True
        else:
            value, at = scalar(body, at)
            put(value, key)
            fresh, value_due = False, False


def _loads(body: str) -> object:
    try:
        return json.loads(body)
    except RecursionError:
        return _loads_deep(body)


def _rows_of(body_id: int, url: str | None, body: str, limits: Limits = Limits()) -> Iterator[tuple]:
    try:
        data = _loads(body)
    except (TypeError, ValueError):
        return
    for array_idx, objects in enumerate(product_lists(data, limits)):
        for item_idx, o in enumerate(objects):
            yield (
                body_id, url, array_idx, item_idx, first_text(o, NAME_KEYS, limits.name),
                price_of(o, limits.price_depth), first_text(o, ID_KEYS, limits.external_id),
                first_text(o, BRAND_KEYS, limits.brand), first_text(o, CATEGORY_KEYS, limits.category),
                first_text(o, IMAGE_KEYS, limits.address), first_text(o, URL_KEYS, limits.address),
            )


_COLUMNS = [c.split()[0] for c in ITEM_SCHEMA.split(", ")]


def listed_items(bodies: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Objects of the product lists in ``bodies`` (body_id, url, body)."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = (
                r
                for b in batch.itertuples(index=False)
                for r in _rows_of(b.body_id, b.url, b.body, limits)
            )
            for some in batched(rows, SLICE_ROWS):
                out = pd.DataFrame(some, columns=_COLUMNS)
                yield out.astype({"raw_price": "float64"})

    bound_batches(bodies.sparkSession)
    return bodies.select("body_id", "url", "body").mapInPandas(walk, ITEM_SCHEMA)


def price_scales(items: DataFrame) -> DataFrame:
    """Per list, 100 when its prices look like hundredths: at least three, all whole, upper median >= 150.

    The median is an exact percentile over value counts, taken from above.
    """
    positive = items.filter(F.col("raw_price") > 0)
    whole = F.bool_and(F.col("raw_price") == F.floor("raw_price"))
    upper_median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY raw_price DESC)")
    return positive.groupBy("body_id", "array_idx").agg(
        F.when((F.count("*") >= 3) & whole & (upper_median >= 150), 100.0)
        .otherwise(1.0)
        .alias("scale")
    )


def products_from_json(bodies: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Harvested products of captured JSON bodies, with (body_id, item_seq)."""
    items = materialize(listed_items(bodies, limits), "items")  # read twice, walked once
    origin = origin_of(F.col("url"))
    priced = items.join(price_scales(items), ["body_id", "array_idx"]).filter(
        F.col("name").isNotNull() & F.col("raw_price").isNotNull()
    )
    rows = priced.select(
        "body_id",
        F.struct("array_idx", "item_idx").alias("item_seq"),
        blank_to_null(js_trim(F.col("external_id"))).alias("external_id"),
        "name",
        "brand",
        round_half_up(F.col("raw_price") / F.col("scale"), 2).alias("price"),
        F.lit(None).cast("double").alias("old_price"),
        unit_from_name(F.col("name")).alias("unit_size"),
        "category",
        absolute_url(F.col("image"), origin).alias("image_url"),
        absolute_url(F.col("link"), origin).alias("url"),
    )
    return rows.filter(is_sane_price(F.col("price"))).select(
        "body_id", "item_seq", *HARVESTED_COLUMNS
    )
