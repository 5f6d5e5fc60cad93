"""Schemas of the catalogue tables and of the in-flight records."""

from __future__ import annotations

SUPERMARKETS = "id bigint, slug string, name string, logo_url string"
STORES = (
    "id bigint, supermarket_id bigint, external_id string, name string, city string, "
    "county string, postal_code string, address string, lat double, lng double"
)
PRODUCTS = (
    "id bigint, supermarket_id bigint, external_id string, name string, normalized_name string, "
    "brand string, category string, raw_category string, unit_size string, quantity double, "
    "unit string, image_url string, url string, created_at timestamp"
)
PRICES = (
    "product_id bigint, store_id bigint, price double, old_price double, price_per_unit double, "
    "per_unit string, currency string, valid_from string, valid_to string, updated_at timestamp"
)
PRICE_HISTORY = "product_id bigint, store_id bigint, price double, recorded_at timestamp"
SCRAPE_RUNS = (
    "id bigint, supermarket string, status string, products_found bigint, message string, "
    "started_at timestamp, finished_at timestamp"
)

TABLES = {
    "supermarkets": SUPERMARKETS,
    "stores": STORES,
    "products": PRODUCTS,
    "prices": PRICES,
    "price_history": PRICE_HISTORY,
    "scrape_runs": SCRAPE_RUNS,
}

# A scraped batch: ``seq`` is the arrival order of a row within the batch.
STORES_IN = (
    "supermarket_slug string, seq bigint, external_id string, name string, city string, "
    "county string, postal_code string, address string, lat double, lng double"
)
PRODUCTS_IN = (
    "supermarket_slug string, seq bigint, external_id string, name string, brand string, "
    "raw_category string, unit_size_text string, price double, old_price double, "
    "currency string, price_per_unit struct<value:double,unit:string>, image_url string, "
    "url string, valid_from string, valid_to string, store_external_ids array<string>"
)
SUPERMARKETS_IN = "supermarket_slug string, seq bigint, name string"

QUERIES = (
    "query_id bigint, q string, category string, city string, county string, "
    "supermarket string, strict boolean, prefix boolean"
)
BASKET_LINES = "basket_id bigint, seq bigint, query string, qty double, city string, county string"

# A harvested page or file item, before merging sources.
HARVESTED = (
    "external_id string, name string, brand string, price double, old_price double, "
    "unit_size string, category string, image_url string, url string"
)
HARVESTED_COLUMNS = [part.split()[0] for part in HARVESTED.split(", ")]

#: store id of a price valid in every store of the chain
NATIONAL = 0
DEFAULT_CURRENCY = "RON"
