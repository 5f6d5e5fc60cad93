"""Bulk catalogue edits: created, patched and deleted products, category recompute."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numbers import positive
from shelfwise.functions.categories import map_category
from shelfwise.functions.text import (
    admin_product_id,
    blank_to_null,
    build_normalized_name,
    js_trim,
    supermarket_slug,
)
from shelfwise.functions.units import parse_unit_size, price_per_unit
from shelfwise.operators.keyed import assign_ids, last_known, max_id
from shelfwise.operators.upsert import ordered
from shelfwise.schemas import DEFAULT_CURRENCY, NATIONAL
from shelfwise.session import broadcast_if_small, materialize
from shelfwise.sources.snapshot import Catalog


def create_supermarkets(cat: Catalog, edits: DataFrame) -> Catalog:
    """``edits``: seq, name (two characters at least)."""
    from shelfwise.operators.upsert import upsert_supermarkets

    batch = edits.withColumn("name", js_trim(F.col("name"))).filter(F.length("name") >= 2)
    batch = batch.withColumn("supermarket_slug", supermarket_slug(F.col("name")))
    return cat.with_tables(supermarkets=upsert_supermarkets(cat.supermarkets, batch))


def _apply(existing: DataFrame, edits: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``existing`` with the columns of its edit, edits of no existing row); one edit a key.

    A few edits are sent to the stored rows, which then do not move.
    """
    edits = materialize(edits, "edits")
    few = broadcast_if_small(edits)
    known = materialize(existing.join(broadcast_if_small(edits.select(*keys)), keys, "left_semi").select(*keys), "known")
    return existing.join(few, keys, "left"), edits.join(broadcast_if_small(known), keys, "left_anti")


def _set_national_prices(cat: Catalog, new: DataFrame, as_of: Column) -> DataFrame:
    """``new``: product_id, price, unit_price. Offer columns of a stored price stay."""
    edits = new.select(
        "product_id",
        F.lit(NATIONAL).cast("bigint").alias("store_id"),
        F.col("price").alias("new_price"),
        F.col("unit_price.value").alias("new_value"),
        F.col("unit_price.unit").alias("new_unit"),
    )
    known, fresh = _apply(cat.prices, edits, ["product_id", "store_id"])
    touched = F.col("new_price").isNotNull()
    return ordered(
        known.unionByName(fresh, allowMissingColumns=True).withColumns(
            {
                "price": F.coalesce("new_price", "price"),
                "price_per_unit": F.when(touched, F.col("new_value")).otherwise(F.col("price_per_unit")),
                "per_unit": F.when(touched, F.col("new_unit")).otherwise(F.col("per_unit")),
                "currency": F.coalesce("currency", F.lit(DEFAULT_CURRENCY)),
                "updated_at": F.when(touched, as_of).otherwise(F.col("updated_at")),
            }
        ),
        "prices",
    )


def create_products(cat: Catalog, edits: DataFrame, as_of: datetime) -> Catalog:
    """``edits``: seq, supermarket_slug, name, brand, category, unit_size, price.

    A product of the same derived id is overwritten. The national price is set
    and nothing is added to the price history.
    """
    now = F.lit(as_of).cast("timestamp")
    chain = cat.supermarkets.select(
        F.col("slug").alias("supermarket_slug"), F.col("id").alias("supermarket_id")
    )
    size = parse_unit_size(F.col("unit_size"))
    rows = (
        edits.filter((F.col("name") != "") & positive(F.col("price")))
        .join(chain, "supermarket_slug")
        .withColumns(
            {
                "external_id": admin_product_id(F.col("name")),
                "normalized_name": build_normalized_name(F.col("name"), F.col("brand")),
                "category": F.coalesce(
                    blank_to_null(F.col("category")), map_category(None, F.col("name"))
                ),
                "quantity": size.getField("quantity"),
                "unit": size.getField("unit"),
                "unit_price": price_per_unit(F.col("price"), size),
            }
        )
    )
    keys = ["supermarket_id", "external_id"]
    overwritten = ["name", "normalized_name", "brand", "category", "unit_size", "quantity", "unit"]
    fold = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*overwritten, "price", "unit_price"), "seq").alias("new"),
        F.min("seq").alias("first_seq"),
    )
    known, fresh = _apply(cat.products, fold, keys)
    fresh = assign_ids(fresh, max_id(cat.products), ["first_seq", *keys])
    touched = F.col("first_seq").isNotNull()
    numbered = known.unionByName(fresh, allowMissingColumns=True).withColumns(
        {c: F.when(touched, F.col(f"new.{c}")).otherwise(F.col(c)) for c in overwritten}
        | {"created_at": F.coalesce("created_at", now)}
    )
    priced = numbered.filter(touched).select(
        F.col("id").alias("product_id"), "new.price", "new.unit_price"
    )
    return cat.with_tables(
        products=ordered(numbered, "products"), prices=_set_national_prices(cat, priced, now)
    )


def patch_products(cat: Catalog, edits: DataFrame, as_of: datetime) -> Catalog:
    """``edits``: seq, product_id, name, brand, category, unit_size, price (NULL = not given).

    Given fields overwrite, an empty text too; the search name is rebuilt from
    the edit's own name and brand. Every price edit sets the national price and
    is logged. Edits of unknown products are dropped.
    """
    now = F.lit(as_of).cast("timestamp")
    size = parse_unit_size(F.col("unit_size"))
    known = cat.products.select(F.col("id").alias("product_id"))
    rows = edits.join(known, "product_id", "left_semi").withColumns(
        {"quantity": size.getField("quantity"), "unit": size.getField("unit")}
    )
    applies = (
        (F.col("name") != "")
        | F.col("brand").isNotNull()
        | (F.col("category") != "")
        | F.col("unit_size").isNotNull()
    )
    rebuilt = F.when(F.col("name") != "", build_normalized_name(F.col("name"), F.col("brand")))
    kept = ["brand", "category", "unit_size", "quantity", "unit"]
    fold = (
        rows.filter(F.coalesce(applies, F.lit(False)))
        .groupBy("product_id")
        .agg(
            F.max_by(
                F.struct("name", rebuilt.alias("normalized_name")),
                F.when(F.col("name").isNotNull(), F.col("seq")),
            ).alias("named"),
            *[last_known(c).alias(f"new_{c}") for c in kept],
        )
    )
    products = cat.products.join(fold, F.col("id") == F.col("product_id"), "left")
    products = products.withColumns(
        {
            "name": F.coalesce("named.name", "name"),
            "normalized_name": F.when(
                F.col("named").isNotNull(), F.col("named.normalized_name")
            ).otherwise(F.col("normalized_name")),
        }
        | {c: F.coalesce(f"new_{c}", c) for c in kept}
    )

    price_edits = rows.filter(positive(F.col("price")))
    last = price_edits.groupBy("product_id").agg(
        F.max(F.struct("seq", "price")).alias("last")
    )
    # the pack size known at the last price edit: given by then, else the stored one
    given = (
        rows.join(last, "product_id")
        .filter(F.col("seq") <= F.col("last.seq"))
        .groupBy("product_id", "last.price")
        .agg(last_known("unit_size").alias("given_size"))
    )
    stored = cat.products.select(F.col("id").alias("product_id"), "unit_size")
    priced = given.join(stored, "product_id").select(
        "product_id",
        "price",
        price_per_unit(
            F.col("price"), parse_unit_size(F.coalesce("given_size", "unit_size"))
        ).alias("unit_price"),
    )
    logged = price_edits.select(
        "product_id", F.lit(NATIONAL).alias("store_id"), "price", now.alias("recorded_at")
    )
    return cat.with_tables(
        products=ordered(products, "products"),
        prices=_set_national_prices(cat, priced, now),
        price_history=cat.price_history.unionByName(ordered(logged, "price_history")),
    )


def delete_products(cat: Catalog, ids: DataFrame) -> Catalog:
    """Drop products (``product_id``) with their prices and price history."""
    gone = ids.select("product_id").distinct()

    def without(df: DataFrame, key: str) -> DataFrame:
        return df.join(gone, df[key] == gone["product_id"], "left_anti")

    return cat.with_tables(
        products=without(cat.products, "id"),
        prices=cat.prices.join(gone, "product_id", "left_anti"),
        price_history=cat.price_history.join(gone, "product_id", "left_anti"),
    )


def recompute_categories(cat: Catalog) -> tuple[Catalog, DataFrame]:
    """Categories by the current rules, and how many products changed."""
    new = map_category(F.col("raw_category"), F.col("name"))
    report = cat.products.agg(
        F.count_if(~new.eqNullSafe(F.col("category"))).alias("changed"),
        F.count("*").alias("products"),
    )
    return cat.with_tables(products=cat.products.withColumn("category", new)), report
