"""Catalogue reports: metadata, product pages, chain report, run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.categories import CATEGORIES
from shelfwise.functions.text import normalize_text
from shelfwise.session import materialize
from shelfwise.sources.snapshot import Catalog

PAGE = 50
LAST_RUNS = 10


def product_counts(cat: Catalog) -> DataFrame:
    """Products per chain, zero included."""
    per_chain = cat.products.groupBy("supermarket_id").agg(F.count("*").alias("n"))
    return (
        cat.supermarkets.join(per_chain, F.col("id") == F.col("supermarket_id"), "left")
        .select("slug", "name", F.coalesce("n", F.lit(0)).alias("product_count"))
        .orderBy("name", "slug")
    )


def meta(cat: Catalog) -> dict[str, DataFrame]:
    """Vocabularies of the search form."""
    return {
        "supermarkets": product_counts(cat),
        "cities": cat.stores.select("city").distinct().orderBy("city"),
        "counties": cat.stores.filter(F.col("county").isNotNull())
        .select("county")
        .distinct()
        .orderBy("county"),
        "categories": cat.spark.createDataFrame(
            list(CATEGORIES.items()), "slug string, label string"
        ),
        "last_update": cat.prices.agg(F.max("updated_at").alias("last_update")),
    }


def product_page(cat: Catalog, q: str | None = None, offset: int = 0) -> DataFrame:
    """Fifty products, newest first; ``q`` filters by substring of the search name.

    The page is cut before prices are looked up, so only its own products are priced.
    """
    products = cat.products
    if q:
        wanted = cat.spark.range(1).select(normalize_text(F.lit(q)).alias("q")).first()["q"]  # once, not for every product
        products = products.filter(F.contains(F.col("normalized_name"), F.lit(wanted)))
    chains = cat.supermarkets.select(
        F.col("id").alias("supermarket_id"), F.col("name").alias("supermarket")
    )
    page = (
        products.join(chains, "supermarket_id")
        .select("id", "name", "brand", "category", "unit_size", "supermarket")
        .orderBy(F.desc("id"))
        .offset(offset)
        .limit(PAGE)
    )
    page = materialize(page, "page")  # fifty rows, read twice
    priced = (
        cat.prices.join(F.broadcast(page.select("id")), F.col("product_id") == F.col("id"))
        .groupBy("product_id")
        .agg(F.min("price").alias("price"), F.max("updated_at").alias("updated_at"))
    )
    return (
        page.join(priced, F.col("id") == F.col("product_id"), "left")
        .drop("product_id")
        .orderBy(F.desc("id"))
    )


def supermarket_report(cat: Catalog) -> DataFrame:
    """Products, stores and cities per chain; each side is counted before the join."""
    products = cat.products.groupBy("supermarket_id").agg(F.count("*").alias("products"))
    stores = cat.stores.groupBy("supermarket_id").agg(
        F.count("*").alias("stores"), F.countDistinct("city").alias("cities")
    )
    chains = cat.supermarkets.select(F.col("id").alias("supermarket_id"), "slug", "name")
    return (
        chains.join(products, "supermarket_id", "left")
        .join(stores, "supermarket_id", "left")
        .select(
            F.col("supermarket_id").alias("id"),
            "slug",
            "name",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("products", "stores", "cities")],
        )
        .orderBy("name", "id")
    )


def last_runs(cat: Catalog, n: int = LAST_RUNS) -> DataFrame:
    return (
        cat.scrape_runs.orderBy(F.desc("id"))
        .limit(n)
        .select("id", "supermarket", "status", "products_found", "message", "finished_at")
    )
