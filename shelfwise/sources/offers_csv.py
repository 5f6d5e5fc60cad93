"""Loose offer files: the roles of columns are guessed from the header."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.numbers import is_sane_price, parse_price
from shelfwise.functions.text import blank_to_null, js_trim
from shelfwise.functions.units import unit_from_name
from shelfwise.schemas import HARVESTED_COLUMNS
from shelfwise.sources.catalogue_csv import read_in_arrival_order

# Header patterns per role; the first matching column takes the role.
ROLES = {
    "name": [r"product.*name|^name$|denumire|titlu|nume"],
    "price": [r"new_price|current_price|^price$|pret(?!.*vechi)(?!.*old)", r"price|pret"],
    "old_price": [r"old_price|pret.*vechi|list_price"],
    "image_url": [r"image|img|poza"],
    "url": [r"^url$|link"],
    "external_id": [r"^id$|sku|cod"],
    "brand": [r"brand|marca"],
    "category": [r"categ"],
}


def column_roles(columns: list[str]) -> dict[str, str]:
    roles = {}
    for role, patterns in ROLES.items():
        for pattern in patterns:
            hit = next((c for c in columns if re.search(pattern, c.strip(), re.IGNORECASE)), None)
            if hit is not None:
                roles[role] = hit
                break
    return roles


def products_from_offers(raw: DataFrame) -> DataFrame:
    """Harvested products of an offers table; none without a name and a price column."""
    roles = column_roles([c for c in raw.columns if c != "seq"])
    seq = F.col("seq") if "seq" in raw.columns else F.monotonically_increasing_id()

    def field(role: str):
        if role not in roles:
            return F.lit(None).cast("string")
        return js_trim(F.coalesce(F.col(f"`{roles[role]}`"), F.lit("")))

    name = field("name")
    price = parse_price(field("price"))
    old_price = parse_price(field("old_price"))
    rows = raw.select(
        seq.alias("item_seq"),
        blank_to_null(field("external_id")).alias("external_id"),
        name.alias("name"),
        blank_to_null(field("brand")).alias("brand"),
        price.alias("price"),
        F.when(is_sane_price(old_price) & (old_price > price), old_price).alias("old_price"),
        unit_from_name(name).alias("unit_size"),
        blank_to_null(field("category")).alias("category"),
        blank_to_null(field("image_url")).alias("image_url"),
        blank_to_null(field("url")).alias("url"),
    )
    usable = F.lit("name" in roles and "price" in roles)
    rows = rows.filter(usable & (F.col("name") != "") & is_sane_price(F.col("price")))
    return rows.select("item_seq", *HARVESTED_COLUMNS)


def read_offers_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return products_from_offers(read_in_arrival_order(spark, path))
