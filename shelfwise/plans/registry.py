"""Registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.functions.categories import CATEGORIES, category_of_normalized
from shelfwise.functions.geo import county_from_postal_code, resolve_county
from shelfwise.functions.numbers import discount_shown
from shelfwise.functions.text import (
    display_label,
    normalize_text,
    origin_of,
    strip_html,
    tokens_of,
)
from shelfwise.functions.units import parse_unit_size, price_per_unit
from shelfwise.operators import basket, gates, reports, upsert
from shelfwise.operators import edits as edits_ops
from shelfwise.operators.search import search, search_hits
from shelfwise.operators.upsert import save
from shelfwise.plans import oracles, testbed
from shelfwise.plans.testbed import CITIES, GROCERY_TERMS, pick, postal_code, table
from shelfwise.session import materialize, new_shared_path, shuffles_dropped, spread
from shelfwise.sources import cards, feeds, json_bodies, jsonld, links
from shelfwise.sources import catalogue_csv as csv
from shelfwise.sources import merge_sources as merge
from shelfwise.sources import stores as stores_src
from shelfwise.sources.offers_csv import read_offers_csv
from shelfwise.sources.snapshot import Catalog, empty_catalog, read_snapshot
from shelfwise.streaming.ingest import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# ---------------------------------------------------------------- text functions


@register("normalize_documents", oracles.normalize_documents())
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", normalize_text(F.col("text")).alias("normalized")
    )
    return docs.withColumn(
        "n_tokens", F.size(tokens_of(F.col("normalized"))).cast("bigint")
    )


@register("categorize_documents", oracles.categorize_documents())
def categorize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    normalized = docs.select("doc_id", normalize_text(F.col("text")).alias("normalized"))
    return normalized.select(
        "doc_id", category_of_normalized(None, F.col("normalized")).alias("category")
    )


@register("category_counts", oracles.category_counts())
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        categorize_documents(spark, sf_dir)
        .groupBy("category")
        .agg(F.count("*").alias("n_documents"))
    )


@register("parse_units", oracles.parse_units())
def parse_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pick([t.replace("{n}", "#") for t in oracles.UNIT_TEXTS], F.col("p_partkey"))
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        "p_retailprice",
        F.replace(text, F.lit("#"), F.col("p_size").cast("string")).alias("unit_text"),
    )
    parsed = parts.withColumn("size", parse_unit_size(F.col("unit_text")))
    return parsed.select(
        "p_partkey",
        "unit_text",
        F.col("size.quantity").alias("quantity"),
        F.col("size.unit").alias("unit"),
        price_per_unit(F.col("p_retailprice"), F.col("size")).getField("value").alias("price_per_unit"),
    )


@register("county_resolution", oracles.county_resolution())
def county_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    code = postal_code(key)
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey",
        pick([*CITIES, "Atlantida"], key).alias("city"),
        F.when(key % 3 == 0, F.lit(""))
        .when(key % 3 == 1, F.concat(F.lit("RO "), code))
        .otherwise(F.concat(code, F.lit("9")))
        .alias("postal_code"),
        F.when(key % 10 == 0, F.lit("Cluj")).otherwise(F.lit("")).alias("given"),
    )
    return customers.select(
        "c_custkey",
        "city",
        "postal_code",
        resolve_county(F.col("given"), F.col("postal_code"), F.col("city")).alias("county"),
    )


@register("page_texts", oracles.page_texts())
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages without their markup."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", strip_html(F.col("html")).alias("text"))


# ---------------------------------------------------------------- search


def term_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(GROCERY_TERMS)), "query_id bigint, q string")


def _search(spark: SparkSession, sf_dir: str, queries: DataFrame, **options) -> DataFrame:
    hits = search(testbed.catalog(spark, sf_dir), queries, limit=oracles.TOP_HITS, **options)
    rows = hits.join(F.broadcast(queries.select("query_id", "q")), "query_id").select(
        "query_id", "q", "hit_no", "product_id", "store_id",
        F.col("supermarket_slug").alias("slug"), "name", "price", "match_rank",
    )
    return longs(rows, "hit_no", "match_rank")


@register("search_token", oracles.search_sql(oracles.TERM_ROWS))
def search_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, term_queries(spark))


@register("search_category", oracles.search_sql(oracles.TERM_ROWS, category="'bauturi'"))
def search_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(
        spark, sf_dir, term_queries(spark).withColumn("category", F.lit("bauturi"))
    )


@register("search_prefix", oracles.search_sql(oracles.TERM_ROWS, prefix=True))
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the whole term begins a word of the name."""
    return _search(spark, sf_dir, term_queries(spark).withColumn("prefix", F.lit(True)))


_STEMS = oracles.TERM_ROWS.replace("AS q FROM", "[1:4] AS q FROM")


@register("search_stem", oracles.search_sql(_STEMS, prefix=True))
def search_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix search as one types: the first four characters so far."""
    stems = term_queries(spark).select(
        "query_id", F.substring("q", 1, 4).alias("q"), F.lit(True).alias("prefix")
    )
    return _search(spark, sf_dir, stems)


_LOCAL = oracles.TERM_ROWS
_LOCAL_ARGS = {"county": "'Cluj'", "supermarket": "'nation-' || (query_id % 25)", "strict": True}


@register("search_local", oracles.search_sql(_LOCAL, **_LOCAL_ARGS))
def search_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = term_queries(spark).withColumns(
        {
            "county": F.lit("Cluj"),
            "supermarket": F.concat(F.lit("nation-"), F.col("query_id") % 25),
            "strict": F.lit(True),
        }
    )
    return _search(spark, sf_dir, queries)


_IN_CITY = {"city": oracles.pick(CITIES, "query_id")}


@register("search_city", oracles.search_sql(oracles.TERM_ROWS, **_IN_CITY))
def search_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term in one of the cities: national prices and those of stores there."""
    return _search(spark, sf_dir, term_queries(spark).withColumn("city", pick(CITIES, F.col("query_id"))))


# ---------------------------------------------------------------- baskets


def basket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket.assemble_baskets(testbed.basket_events(spark, sf_dir))


@register("basket_assembly", oracles.basket_assembly())
def basket_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket_lines(spark, sf_dir).groupBy("basket_id").agg(
        F.count("*").alias("n_lines"), F.sum("qty").alias("item_total")
    )


@register("basket_compare", oracles.basket_compare())
def basket_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = basket.compare_baskets(
        testbed.catalog(spark, sf_dir), basket_lines(spark, sf_dir)
    )
    return longs(compared, "chain_rank").select(
        "basket_id", "slug", "total", "found_count", "missing_count", "chain_rank"
    )


@register("basket_top3", oracles.basket_top3())
def basket_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket.top_chains(basket_compare(spark, sf_dir)).drop("missing_count")


@register("basket_missing", oracles.basket_missing())
def basket_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket.missing_counts(testbed.catalog(spark, sf_dir), basket_lines(spark, sf_dir))


@register("alternatives", oracles.alternatives())
def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = testbed.catalog(spark, sf_dir)
    found = basket.missed_alternatives(cat, basket_lines(spark, sf_dir)).drop("city")
    return longs(found, "alt_rank")


# ---------------------------------------------------------------- merge


def feed_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The price feed as scraped supermarkets, stores and products (with l_shipdate)."""
    chains = testbed.supermarkets(spark, sf_dir)
    slugs = chains.select(F.col("id").alias("chain_id"), F.col("slug").alias("supermarket_slug"))
    supermarkets_in = chains.select(
        F.col("slug").alias("supermarket_slug"), F.lit(0).cast("bigint").alias("seq"), "name"
    )
    stores_in = (
        testbed.stores(spark, sf_dir)
        .withColumn("seq", F.col("id"))
        .join(slugs, F.col("supermarket_id") == F.col("chain_id"))
        .drop("id", "supermarket_id", "chain_id")
    )
    lines = testbed.feed(spark, sf_dir, "l_linenumber", "l_linestatus", "l_shipdate")
    parts = table(spark, sf_dir, "part")
    promo = F.when(F.col("l_linestatus") == "O", F.lit(" promo")).otherwise(F.lit(""))
    products_in = (
        lines.join(parts, F.col("part") == F.col("p_partkey"))
        .join(slugs, "chain_id")
        .select(
            "supermarket_slug",
            "seq",
            F.col("part").cast("string").alias("external_id"),
            F.concat(testbed.part_name(F.col("p_name"), F.col("p_partkey")), promo).alias("name"),
            F.when(F.col("l_linenumber") % 3 != 0, F.col("p_brand")).alias("brand"),
            F.col("p_type").alias("raw_category"),
            F.when(
                F.col("l_linenumber") % 2 != 0, testbed.unit_text(F.col("p_size"))
            ).alias("unit_size_text"),
            "price",
            F.lit(None).cast("double").alias("old_price"),
            F.lit(None).cast("string").alias("currency"),
            F.lit(None).cast("struct<value:double,unit:string>").alias("price_per_unit"),
            F.lit(None).cast("string").alias("image_url"),
            F.lit(None).cast("string").alias("url"),
            F.lit(None).cast("string").alias("valid_from"),
            F.lit(None).cast("string").alias("valid_to"),
            F.when(
                F.col("store_id") != 0, F.array((F.col("store_id") - 1).cast("string"))
            ).alias("store_external_ids"),
            "l_shipdate",
        )
    )
    return supermarkets_in, stores_in, products_in


_BATCH_TIMES = [datetime(2000, 1, 1), datetime(2000, 1, 2)]


def saved_feed(spark: SparkSession, sf_dir: str) -> Catalog:
    """The feed saved in two batches, into an empty catalogue."""
    chains, stores, lines = feed_batches(spark, sf_dir)
    early = F.col("l_shipdate") < F.lit(oracles.SECOND_BATCH).cast("timestamp")
    cat = empty_catalog(spark)
    for part, as_of in zip([lines.filter(early), lines.filter(~early)], _BATCH_TIMES):
        cat = save(cat, chains, stores, part.drop("l_shipdate"), as_of).catalog
    return cat


def _chain_slugs(cat: Catalog) -> DataFrame:
    return cat.supermarkets.select(F.col("id").alias("supermarket_id"), "slug")


@register("save_products", oracles.save_products())
def save_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = saved_feed(spark, sf_dir)
    return cat.products.join(_chain_slugs(cat), "supermarket_id").select(
        "id", "slug", "external_id", "name", "normalized_name", "category", "brand", "unit_size",
        "quantity",
    )


def _by_store(cat: Catalog, rows: DataFrame) -> DataFrame:
    """Product and store ids replaced by the keys they had in the feed."""
    products = cat.products.select(
        F.col("id").alias("product_id"), "external_id", "supermarket_id"
    ).join(_chain_slugs(cat), "supermarket_id")
    stores = cat.stores.select(F.col("id").alias("store_id"), F.col("external_id").alias("ref"))
    return (
        rows.join(products, "product_id")
        .join(stores, "store_id", "left")
        .withColumn("store_ref", F.coalesce("ref", F.lit("national")))
    )


def _batch_no(when: str):
    return F.when(F.col(when) == F.lit(_BATCH_TIMES[0]), 1).otherwise(2).alias("batch")


@register("save_prices", oracles.save_prices())
def save_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = saved_feed(spark, sf_dir)
    return _by_store(cat, cat.prices).select(
        "slug", "external_id", "store_ref", _batch_no("updated_at"), "price", "price_per_unit"
    )


@register("price_history", oracles.price_history())
def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = saved_feed(spark, sf_dir)
    return _by_store(cat, cat.price_history).select(
        "slug", "external_id", "store_ref", _batch_no("recorded_at"), "price"
    )


@register("import_summary", oracles.import_summary())
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains, stores, lines = feed_batches(spark, sf_dir)
    result = save(empty_catalog(spark), chains, stores, lines.drop("l_shipdate"), _BATCH_TIMES[0])
    return upsert.import_summary(result.counts)


# ---------------------------------------------------------------- edits and reports


@register("patch_products", oracles.patch_products())
def patch_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = testbed.catalog(spark, sf_dir)
    pid = F.col("id")
    renamed, priced = pid % 10 == 3, pid % 7 == 2
    edits = cat.products.filter(renamed | priced).select(
        pid.alias("seq"),
        pid.alias("product_id"),
        F.when(renamed, F.concat(F.lit("Ediție "), "name")).alias("name"),
        F.when(renamed, F.lit("Acme")).alias("brand"),
        F.lit(None).cast("string").alias("category"),
        F.when(priced, F.concat((pid % 4 + 1).cast("string"), F.lit(" kg"))).alias("unit_size"),
        F.when(priced, F.lit(5.5)).alias("price"),
    )
    new = edits_ops.patch_products(cat, edits, _BATCH_TIMES[1])
    national = new.prices.filter(F.col("store_id") == 0).select(
        F.col("product_id").alias("id"),
        F.col("price").alias("national_price"),
        F.col("price_per_unit").alias("national_unit_price"),
    )
    logged = new.price_history.groupBy(F.col("product_id").alias("id")).agg(
        F.count("*").alias("logged")
    )
    return (
        new.products.select("id", "name", "normalized_name", "brand", "unit_size", "quantity")
        .join(national, "id", "left")
        .join(logged, "id", "left")
        .fillna({"logged": 0})
    )


@register("create_products", oracles.create_products())
def create_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = testbed.catalog(spark, sf_dir)
    made = (
        table(spark, sf_dir, "part")
        .groupBy("p_name")
        .agg(F.min("p_retailprice").alias("price"), F.min("p_partkey").alias("seq"))
        .select(
            "seq",
            F.lit("nation-0").alias("supermarket_slug"),
            F.concat("p_name", F.lit(" nou")).alias("name"),
            F.lit(None).cast("string").alias("brand"),
            F.lit("").alias("category"),
            F.lit("1 l").alias("unit_size"),
            "price",
        )
    )
    new = edits_ops.create_products(cat, made, _BATCH_TIMES[1])
    prices = new.prices.filter(F.col("store_id") == 0).select(
        F.col("product_id").alias("id"), "price", "price_per_unit"
    )
    added = new.products.filter(F.startswith("external_id", F.lit("admin-")))
    return added.join(prices, "id").select(
        "external_id", "name", "normalized_name", "category", "quantity", "unit", "price",
        "price_per_unit",
    )


@register("delete_products", oracles.delete_products())
def delete_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = testbed.catalog(spark, sf_dir)
    gone = cat.products.filter(F.col("id") % 3 == 0).select(F.col("id").alias("product_id"))
    left = edits_ops.delete_products(cat, gone)
    products = left.products.agg(F.count("*").alias("products"))
    prices = left.prices.agg(
        F.count("*").alias("prices"), F.round(F.sum(F.col("price") * 100)).alias("price_sum")
    )
    return products.crossJoin(prices)  # one row each


@register("recompute_categories", oracles.recompute_categories())
def recompute_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = testbed.catalog(spark, sf_dir)
    stale = F.when(F.col("external_id").cast("bigint") % 4 == 0, F.col("category"))
    old = cat.with_tables(
        products=cat.products.withColumn("category", F.coalesce(stale, F.lit("altele")))
    )
    return edits_ops.recompute_categories(old)[1]


@register("meta_counts", oracles.meta_counts())
def meta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = reports.meta(testbed.catalog(spark, sf_dir))

    def part(name: str, kind: str, value, n=None) -> DataFrame:
        count = F.lit(1).cast("bigint") if n is None else F.col(n)
        return meta[name].select(F.lit(kind).alias("kind"), value.alias("value"), count.alias("n"))

    return testbed.union_all(
        [
            part("supermarkets", "supermarket", F.col("slug"), "product_count"),
            part("cities", "city", F.col("city")),
            part("counties", "county", F.col("county")),
            part("last_update", "last_update", F.date_format("last_update", "yyyy-MM-dd")),
        ]
    )


@register("admin_page", oracles.admin_page())
def admin_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = reports.product_page(testbed.catalog(spark, sf_dir), "Ring LAP", 10)
    return page.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@register("supermarket_report", oracles.supermarket_report())
def supermarket_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.supermarket_report(testbed.catalog(spark, sf_dir))


@register("last_runs", oracles.last_runs())
def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    log = table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("id"),
        kind.alias("supermarket"),
        F.when(kind == "error", F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.floor("value").alias("products_found"),
        F.col("props").alias("message"),
        F.col("ts").cast("timestamp").alias("finished_at"),
    )
    cat = empty_catalog(spark).with_tables(scrape_runs=log)
    return reports.last_runs(cat).drop("finished_at")


def _gate_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(lines, runs): the feed's rows and what the gates say of each chain."""
    chains, _, lines = feed_batches(spark, sf_dir)
    total = table(spark, sf_dir, "lineitem").count()
    key = F.substring_index("supermarket_slug", "-", -1).cast("bigint")
    requested = chains.select(
        "supermarket_slug", (F.lit(total // 25 - 60) + key * 5).alias("min_products")
    )
    warnings = chains.select(
        "supermarket_slug",
        F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < key % 7),
            lambda i: F.concat(F.lit("w"), i.cast("string")),
        ).alias("warnings"),
    )
    lines = materialize(lines.select("supermarket_slug"), "lines")
    return lines, materialize(gates.check_runs(requested, lines, warnings), "runs")


@register("gate_overall", oracles.gate_overall())
def gate_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.overall(_gate_runs(spark, sf_dir)[1])


@register("quality_gate", oracles.quality_gate())
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, runs = _gate_runs(spark, sf_dir)
    passed = gates.passing(lines, runs).groupBy("supermarket_slug").agg(F.count("*").alias("passed"))
    return (
        runs.join(passed, "supermarket_slug", "left")
        .fillna({"passed": 0})
        .drop("min_products")
    )


# ---------------------------------------------------------------- feeds


@register("representative_store", oracles.representative_store())
def representative_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    listed = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("RO"), F.lpad(key.cast("string"), 12, "0")).alias("n"),
        F.col("c_name").alias("cn"),
        pick(CITIES, key).alias("t"),
        postal_code(key).alias("pc"),
    )
    chosen, _ = stores_src.select_stores(listed)
    return chosen.select("n", "cn", county_from_postal_code(F.col("pc")).alias("county"))


@register("offer_availability", oracles.offer_availability())
def offer_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("kl_nr"),
        F.lit(None).cast("array<string>").alias("store_external_ids"),
    )

    def store_no(c: str):
        return F.concat(F.lit("S"), F.lpad(F.col(c).cast("string"), 12, "0"))

    selected = table(spark, sf_dir, "supplier").select(store_no("s_suppkey").alias("n"))
    lists = table(spark, sf_dir, "lineitem").select(
        store_no("l_suppkey").alias("store_n"), F.col("l_partkey").cast("string").alias("kl_nr")
    )
    found = stores_src.attach_availability(offers, selected, lists)
    return found.select("kl_nr", F.array_join("store_external_ids", ",").alias("stores"))


@register("csv_roundtrip", oracles.csv_roundtrip())
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spread(table(spark, sf_dir, "part")).select(
        F.col("p_partkey").cast("string").alias("external_id"),
        F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\nx')).alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice") + 1).alias("old_price"),
        testbed.unit_text(F.col("p_size")).alias("unit_size"),
        F.col("p_type").alias("category"),
        F.lit(None).cast("string").alias("image_url"),
        F.lit(None).cast("string").alias("url"),
    )
    path = new_shared_path(spark, "csv")
    csv.write_catalogue_csv(csv.catalogue_csv_rows(parts, "metro", city="Cluj Napoca"), path)
    back = csv.rows_to_batch(csv.read_catalogue_csv(spark, path)).products
    return back.select(
        "external_id", "name", "brand", "raw_category", "unit_size_text", "price", "old_price",
        F.get("store_external_ids", F.lit(0)).alias("store"),
    )


@register("csv_order", oracles.csv_order())
def csv_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries, each smaller than the one before, that contradict each other: the last row wins."""
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(
        key.cast("string").alias("external_id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("brand"),
        "p_retailprice", F.lit(None).cast("double").alias("old_price"),
        *[F.lit(None).cast("string").alias(c) for c in ("unit_size", "category", "image_url", "url")],
    )
    root = new_shared_path(spark, "deliveries")
    paths = []
    for i, step in enumerate((1, 2, 4)):
        some = parts.filter(F.col("external_id").cast("bigint") % step == 0)
        rows = some.withColumn("price", F.col("p_retailprice") + (2 - i)).drop("p_retailprice")
        paths.append(f"{root}/{'zya'[i]}")  # the oldest path is not the first by name
        csv.write_catalogue_csv(csv.catalogue_csv_rows(rows, "metro", city="Cluj Napoca"), paths[-1])
    landed = csv.rows_to_batch(csv.read_catalogue_csv(spark, paths)).products
    return landed.groupBy("external_id").agg(F.max_by("price", "seq").alias("price"), F.count("*").alias("deliveries"))


def _payloads(items: DataFrame, size: int = 50) -> DataFrame:
    """Items (key, pos, item) gathered into payloads of ``size`` parts, some items twice."""
    again = items.filter(F.col("key") % 5 == 0).withColumn("pos", F.lit(1))
    entry = F.struct("key", "pos", "item")
    return (
        items.withColumn("pos", F.lit(0))
        .unionByName(again, allowMissingColumns=True)
        .groupBy(F.floor(F.col("key") / size).alias("payload_seq"))
        .agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["item"]).alias("items"))
    )


def _part_items(spark: SparkSession, sf_dir: str, item) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), item.alias("item"))


def _cols() -> dict:
    key = F.col("p_partkey")
    return {"key": key, "text": key.cast("string"), "size": F.col("p_size").cast("string")}


@register("feed_lidl", oracles.feed_lidl())
def feed_lidl(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cols()
    key, text = c["key"], c["text"]
    price = F.when(key % 7 == 1, F.lit(0.0)).when(key % 7 > 1, F.col("p_retailprice"))
    data = F.struct(
        F.when(key % 3 == 0, key).alias("itemId"),
        F.when(key % 3 == 1, F.concat(F.lit("E"), text)).alias("erpNumber"),
        F.col("p_name").alias("fullTitle"),
        F.struct(F.when(key % 4 != 0, F.col("p_brand")).otherwise(F.lit("")).alias("name")).alias("brand"),
        F.concat(F.lit("/p/"), text).alias("canonicalUrl"),
        F.struct(F.col("p_type").alias("wonCategoryPrimary")).alias("keyfacts"),
        F.struct(
            price.alias("price"),
            F.when(key % 2 == 0, F.col("p_retailprice") + 1).otherwise(F.lit(0.0)).alias("oldPrice"),
            F.struct(F.concat(c["size"], F.lit(" g")).alias("text")).alias("packaging"),
        ).alias("price"),
        F.struct(
            F.array(F.struct((F.lit(1700000000) + key * 3600).alias("validFrom"))).alias("badgeInfoV2")
        ).alias("stockAvailability"),
    )
    item = F.struct(
        F.concat(F.lit("C"), text).alias("code"), F.struct(data.alias("data")).alias("gridbox")
    )
    raw = _payloads(_part_items(spark, sf_dir, item)).select(
        "payload_seq", F.to_json(F.struct(F.size("items").alias("numFound"), "items")).alias("payload")
    )
    return feeds.parse_feed("lidl", raw).select(
        "external_id", "name", "brand", "raw_category", "unit_size_text", "price", "old_price",
        "currency", "url", "valid_from",
    )


@register("feed_auchan", oracles.feed_auchan())
def feed_auchan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cols()
    key, text = c["key"], c["text"]
    offer = F.struct(
        F.when(key % 7 > 0, F.col("p_retailprice")).otherwise(F.lit(0.0)).alias("Price"),
        F.when(key % 2 == 0, F.col("p_retailprice") + 5).otherwise(F.col("p_retailprice")).alias("ListPrice"),
    )
    item = F.struct(
        F.concat(F.lit("A"), text).alias("productId"),
        F.col("p_name").alias("productName"),
        F.col("p_brand").alias("brand"),
        F.concat(F.lit("l"), text).alias("linkText"),
        F.array(F.concat(F.lit("/Alimente/"), "p_type", F.lit("/"))).alias("categories"),
        F.array(
            F.struct(
                F.when(key % 3 == 0, F.lit("un")).otherwise(F.lit("kg")).alias("measurementUnit"),
                (F.col("p_size") / 10).alias("unitMultiplier"),
                F.array(F.struct(offer.alias("commertialOffer"))).alias("sellers"),
            )
        ).alias("items"),
    )
    raw = _payloads(_part_items(spark, sf_dir, item)).select(
        "payload_seq", F.to_json("items").alias("payload")
    )
    return feeds.parse_feed("auchan", raw).select(
        "external_id", "name", "brand", "raw_category", "unit_size_text", "price", "old_price", "url"
    )


@register("feed_penny", oracles.feed_penny())
def feed_penny(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cols()
    key, text, size = c["key"], c["text"], F.col("p_size")
    item = F.struct(
        F.when(key % 2 == 0, F.concat(F.lit("S"), text)).otherwise(F.lit("")).alias("sku"),
        F.concat(F.lit("P"), text).alias("productId"),
        F.upper("p_name").alias("name"),
        F.struct(
            F.lit("LT").alias("baseUnitShort"),
            F.struct(
                (size * 100 + 99).cast("double").alias("value"),
                F.when(key % 3 == 0, (size * 10).cast("double")).alias("perStandardizedQuantity"),
            ).alias("regular"),
        ).alias("price"),
        F.when(key % 2 == 0, size.cast("double")).alias("weight"),
        (key % 5 == 0).alias("weightArticle"),
        c["size"].alias("amount"),
        F.lit("buc").alias("packageLabelKey"),
        (key % 11 != 0).alias("published"),
    )
    raw = _payloads(_part_items(spark, sf_dir, item)).select(
        "payload_seq",
        F.to_json(F.struct(F.size("items").alias("total"), F.col("items").alias("results"))).alias("payload"),
    )
    return feeds.parse_feed("penny", raw).select(
        "external_id", "name", "unit_size_text", "price",
        F.col("price_per_unit.value").alias("unit_price"),
        F.col("price_per_unit.unit").alias("per_unit"),
    )


@register("feed_profi", oracles.feed_profi())
def feed_profi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offer pages of forty parts, by turns JSON-LD and cards; some show the challenge instead."""
    c = _cols()
    key, text = c["key"], c["text"]
    page = F.floor(key / 40)
    name = F.concat_ws(" ", "p_name", text)
    described = F.to_json(
        F.struct(
            F.lit("Product").alias("@type"),
            F.when(key % 9 != 0, F.concat(F.lit("PF"), text)).alias("sku"),
            name.alias("name"),
            F.when(key % 3 != 0, F.struct(F.col("p_brand").alias("name"))).alias("brand"),
            F.array(
                F.struct(F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")).alias("price"))
            ).alias("offers"),
        )
    )
    title = F.when(key % 10 == 3, F.lit("<b>oferta</b>")).otherwise(F.concat(F.lit("<h3>"), name, F.lit("</h3>")))
    card = F.concat(
        F.lit('<div class="product-card">'), title, F.lit("<p>"), c["size"], F.lit(",99 lei</p></div>")
    )
    items = F.array_sort(F.collect_list(F.struct(key.alias("k"), described.alias("d"), card.alias("c"))))
    pages = table(spark, sf_dir, "part").groupBy(page.alias("payload_seq")).agg(items.alias("items"))
    body = F.when(
        F.col("payload_seq") % 2 == 0,
        F.concat(
            F.lit('<script type="application/ld+json">{"@type":"ItemList","itemListElement":['),
            F.array_join("items.d", ","),
            F.lit("]}</script>"),
        ),
    ).otherwise(F.concat(F.lit('<div class="offer-grid">'), F.array_join("items.c", "\n"), F.lit("</div>")))
    head = F.when(F.col("payload_seq") % 7 == 3, F.lit("Just a moment...")).otherwise(F.lit("Oferte"))
    html = F.concat(F.lit("<html><head><title>"), head, F.lit("</title></head><body>"), body, F.lit("</body></html>"))
    return feeds.parse_feed("profi", pages.select("payload_seq", html.alias("payload"))).select(
        "external_id", "name", "brand", "price"
    )


@register("feed_kaufland", oracles.feed_kaufland())
def feed_kaufland(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cols()
    key, text = c["key"], c["text"]
    plain = key % 3 == 0
    offer = F.struct(
        F.concat(F.lit("O"), text).alias("offerId"),
        F.when(key % 2 == 0, F.concat(F.lit("K"), text)).alias("klNr"),
        F.when(~plain, F.col("p_brand")).alias("title"),
        F.when(~plain, F.concat("p_name", F.lit("\n"), c["size"], F.lit(" G"))).alias("subtitle"),
        F.when(~plain, F.lit("bax")).alias("unit"),
        F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")).alias("price"),
        F.concat(
            F.lit("(="), c["size"], F.lit(" g "), F.col("p_retailprice").cast("string"), F.lit(")")
        ).alias("basePrice"),
        F.col("p_name").alias("detailTitle"),
    )
    category = F.struct(F.col("p_type").alias("displayName"), F.array(offer).alias("offers"))
    cycles = F.transform("items", lambda x: F.struct(F.array(x).alias("categories")))
    blob = F.to_json(
        F.struct(
            F.lit("OfferTemplate").alias("component"),
            F.struct(F.struct(cycles.alias("cycles")).alias("offerData")).alias("props"),
        )
    )
    raw = _payloads(_part_items(spark, sf_dir, category)).select(
        "payload_seq",
        F.concat(
            F.lit("<html><script>window.SSR['x'] = "), blob, F.lit(";</script></html>")
        ).alias("payload"),
    )
    return feeds.parse_feed("kaufland", raw).select(
        "external_id", "kl_nr", "name", "raw_category", "unit_size_text", "price",
        F.col("price_per_unit.value").alias("unit_price"),
        F.col("price_per_unit.unit").alias("per_unit"),
    )


# ---------------------------------------------------------------- harvested pages


@register("jsonld_products", oracles.jsonld_products())
def jsonld_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored page, and every part as an ld+json block in one: alone, in an array, a list or a graph."""
    c = _cols()
    key, text = c["key"], c["text"]
    quoted_price = F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))
    product = F.to_json(
        F.struct(
            F.lit("Product").alias("@type"),
            F.concat(F.lit("L"), text).alias("sku"),
            F.concat("p_name", F.lit(" "), c["size"], F.lit(" g")).alias("name"),
            F.struct(F.col("p_brand").alias("name")).alias("brand"),
            F.array(F.concat(F.lit("https://cdn.example.com/"), text, F.lit(".png"))).alias("image"),
            F.array(F.struct(quoted_price.alias("price"))).alias("offers"),
        )
    )
    block = (
        F.when(key % 4 == 0, product)
        .when(key % 4 == 1, F.concat(F.lit("["), product, F.lit("]")))
        .when(
            key % 4 == 2,
            F.concat(F.lit('{"@type":"ItemList","itemListElement":[{"item":'), product, F.lit("}]}")),
        )
        .otherwise(F.concat(F.lit('{"@graph":[{"@type":"Thing"},'), product, F.lit("]}")))
    )
    stored = table(spark, sf_dir, "pages").select("page_id", "html")
    pages = (
        table(spark, sf_dir, "part")
        .select(key.alias("page_id"), block.alias("block"))
        .join(stored, "page_id", "full")
        .select(
            "page_id",
            F.lit("https://shop.example.com/x").alias("url"),
            F.concat_ws(
                "",
                "html",
                F.concat(F.lit('<script type="application/ld+json">'), "block", F.lit("</script>")),
            ).alias("html"),
        )
    )
    return jsonld.products_from_jsonld(pages).select(
        "page_id", "external_id", "name", "brand", "price", "unit_size", "image_url"
    )


@register("json_arrays", oracles.json_arrays())
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured bodies of fifty parts; even bodies hold prices in hundredths."""
    c = _cols()
    bani = F.round(F.col("p_retailprice") * 100).cast("bigint")
    item = F.struct(
        F.col("p_name").alias("title"),
        F.concat(F.lit("J"), c["text"]).alias("sku"),
        F.struct(F.col("p_brand").alias("name")).alias("brand"),
        F.when(F.floor(c["key"] / 50) % 2 == 0, bani.cast("string"))
        .otherwise(F.col("p_retailprice").cast("string"))
        .alias("price"),
        F.concat(F.lit("/p/"), c["text"]).alias("link"),
    )
    parts = _part_items(spark, sf_dir, item)
    bodies = (
        parts.groupBy(F.floor(F.col("key") / 50).alias("body_id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "item"))), lambda e: e["item"]).alias("products"))
        .select(
            "body_id",
            F.lit("https://shop.example.com/api").alias("url"),
            F.to_json(F.struct(F.struct("products").alias("data"))).alias("body"),
        )
    )
    return json_bodies.products_from_json(bodies).select(
        "body_id", "external_id", "name", "brand", "price", "url"
    )


@register("dom_cards", oracles.dom_cards())
def dom_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of forty cards: split price elements, priced text, untitled cards."""
    c = _cols()
    key = c["key"]
    name = F.concat("p_name", F.lit(" "), "p_brand")
    card = (
        F.when(
            key % 3 == 0,
            F.concat(
                F.lit('<div class="product-card"><h3>'), name,
                F.lit('</h3><p class="price"><span>'), c["size"],
                F.lit("</span><sup>99</sup> lei</p></div>"),
            ),
        )
        .when(
            key % 3 == 1,
            F.concat(
                F.lit('<li><b class="title">'), name, F.lit("</b> acum "), c["size"],
                F.lit(",99 lei</li>"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("<article><p>"), name, F.lit("</p><p>oferta</p><div>"), c["size"],
                F.lit(".99 RON</div></article>"),
            )
        )
    )
    pages = (
        table(spark, sf_dir, "part")
        .groupBy(F.floor(key / 40).alias("page_id"))
        .agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), card.alias("card")))).alias("cards"))
        .select(
            "page_id",
            F.lit("https://shop.example.com/oferte/").alias("url"),
            F.concat(
                F.lit("<html><body>"), F.array_join("cards.card", "\n"), F.lit("</body></html>")
            ).alias("html"),
        )
    )
    return cards.products_from_cards(pages).select("page_id", "name", "price")


@register("merge_sources", oracles.merge_sources())
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even parts come from a trusted source too, and again on later pages at another price."""
    key = F.col("p_partkey")
    nothing = F.lit(None).cast("string")

    def source(parts: DataFrame, extra: float, later: int) -> DataFrame:
        return parts.select(
            F.lit("shop").alias("site"),
            (key % 10 + later).alias("page_seq"),
            key.alias("item_seq"),
            key.cast("string").alias("external_id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("brand"),
            (F.col("p_retailprice") + extra).alias("price"),
            F.lit(None).cast("double").alias("old_price"),
            *[nothing.alias(n) for n in ("unit_size", "category", "image_url", "url")],
        )

    parts = table(spark, sf_dir, "part")
    even = parts.filter(key % 2 == 0)
    trusted = source(even, 0.0, 0).unionByName(source(even, 7.0, 10))
    merged = merge.merge_sources(trusted, source(parts, 1.0, 0))
    return merged.select("product_key", "source_rank", "price")


@register("page_links", oracles.page_links())
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of each site."""
    pages = table(spark, sf_dir, "pages").select(
        F.lower(origin_of(F.col("url"))).alias("site"), F.col("page_id").alias("page_seq"), "url", "html"
    )
    return longs(links.page_links(pages, "(?i)/[a-s]", None), "link_no")


QUERIES["page_links_all"], ORACLES["page_links_all"] = page_links, oracles.page_links_all()  # its former name


# ---------------------------------------------------------------- streaming


@register("stream_ingest", oracles.stream_ingest())
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current prices landed as catalogue CSV files and merged by the stream."""
    cat = testbed.catalog(spark, sf_dir)
    products = cat.products.select(
        F.col("id").alias("product_id"), "external_id", "name", "brand", "unit_size",
        "supermarket_id", F.col("raw_category").alias("category"),
    ).join(_chain_slugs(cat).withColumnRenamed("slug", "supermarket"), "supermarket_id")
    stores = cat.stores.select(
        F.col("id").alias("store_id"), F.col("external_id").alias("store_external_id"), "city",
        "county", F.col("name").alias("store_name"),
    )
    rows = (
        cat.prices.drop("old_price")
        .join(products, "product_id")
        .join(stores, "store_id", "left")
        .withColumn("price", F.format_string("%.2f", "price"))
    )
    columns = [
        F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c)
        for c in csv.READ_COLUMNS
    ]
    landing, root = new_shared_path(spark, "landing"), new_shared_path(spark, "live")
    with shuffles_dropped(spark):
        csv.write_catalogue_csv(rows.select(*columns), landing, compression="gzip")
    query = ingest_stream(spark, landing, root, new_shared_path(spark, "stream"), _BATCH_TIMES[0])
    query.awaitTermination()
    live = read_snapshot(spark, root)
    return _by_store(live, live.prices).select("slug", "external_id", "store_ref", "price")


# ---------------------------------------------------------------- further operators


@register("category_browse", oracles.category_browse())
def category_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = spark.createDataFrame(
        [(slug, None, slug, "Cluj") for slug in CATEGORIES],
        "query_id string, q string, category string, county string",
    )
    hits = search_hits(testbed.catalog(spark, sf_dir), queries, limit=oracles.TOP_HITS)
    return longs(hits, "hit_no").select(
        F.col("query_id").alias("category"), "product_id", "store_id", "price", "hit_no"
    )


@register("product_labels", oracles.product_labels())
def product_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = testbed.catalog(spark, sf_dir)
    rows = cat.products.join(cat.prices, F.col("id") == F.col("product_id"))
    old_price = F.col("price") + (F.col("id") % 3 - 1)
    return rows.select(
        "id",
        "store_id",
        display_label(F.col("name"), F.col("brand")).alias("label"),
        discount_shown(F.col("price"), old_price).alias("shown_old_price"),
    )


@register("offers_csv", oracles.offers_csv())
def offers_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ID"),
        F.concat_ws(" ", "p_name", testbed.unit_text(F.col("p_size"))).alias("Product_Name"),
        F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")).alias("New_Price"),
        (F.col("p_retailprice") + F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1)).alias("Old_Price"),
        F.col("p_type").alias("Categorie"),
    )
    path = new_shared_path(spark, "offers")
    parts.write.csv(path, header=True)
    return read_offers_csv(spark, path).select(
        "external_id", "name", "unit_size", "price", "old_price", "category"
    )


@register("save_stores", oracles.save_stores())
def save_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores saved twice, the second time renamed, moved and without a postal code."""
    chains, first, _ = feed_batches(spark, sf_dir)
    key = F.col("external_id").cast("bigint")
    second = first.withColumns(
        {
            "name": F.concat("name", F.lit(" nou")),
            "city": pick(CITIES, key + 1),
            "county": F.lit(None).cast("string"),
            "postal_code": F.lit(None).cast("string"),
        }
    )
    nothing = spark.createDataFrame([], schemas.PRODUCTS_IN)
    cat = empty_catalog(spark)
    for batch, as_of in zip([first, second], _BATCH_TIMES):
        cat = save(cat, chains, batch, nothing, as_of).catalog
    return cat.stores.join(_chain_slugs(cat), "supermarket_id").select(
        "slug", "external_id", "name", "city", "county", "postal_code"
    )


@register("run_log", oracles.run_log())
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains, _, lines = feed_batches(spark, sf_dir)
    key = F.substring_index("supermarket_slug", "-", -1).cast("bigint")
    lines = materialize(lines.select("supermarket_slug", "external_id"), "lines")
    asked = chains.select("supermarket_slug", (key * 200).alias("min_products"))
    runs = materialize(gates.check_runs(asked, lines), "runs")
    saved = (
        gates.passing(lines, runs)
        .groupBy("supermarket_slug")
        .agg(F.count_distinct("external_id").alias("products"))
    )
    log = gates.append_runs(empty_catalog(spark).scrape_runs, runs, saved, *_BATCH_TIMES)
    return log.select("id", "supermarket", "status", "products_found")


@register("store_gate", oracles.store_gate())
def store_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as selected stores; the orders say whose list was read."""
    selected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("store_n"))
    lists = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("store_n"))
    return gates.store_failures_ok(selected, lists)


@register("runners_up", oracles.runners_up())
def runners_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = basket.runners_up(basket_compare(spark, sf_dir))
    return rest.groupBy("slug", "chain_rank").agg(F.count("*").alias("baskets"))
