"""schema.org products in the ``ld+json`` blocks of stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numbers import is_sane_price, parse_price
from shelfwise.functions.text import absolute_url, blank_to_null, js_trim, origin_of
from shelfwise.functions.units import unit_from_name
from shelfwise.schemas import HARVESTED_COLUMNS

# Fixed value: an embedded block.
LD_JSON = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'


def _get(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$['{key}']", kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _elements(v: Column) -> Column:
    """Array elements; a lone value counts as an array of one."""
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))


def _listed(v: Column, key: str) -> Column:
    """Elements of a member that should be an array, else none."""
    member = _get(v, key)
    empty = F.array().cast("array<variant>")
    return F.when(
        _is(member, "ARRAY"), F.coalesce(F.try_variant_get(member, "$", "array<variant>"), empty)
    ).otherwise(empty)


def _text(v: Column, key: str) -> Column:
    """Member as text; NULL when it is absent, empty or not a scalar."""
    return blank_to_null(_get(v, key, "string"))


def _string_only(v: Column) -> Column:
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def ld_items(pages: DataFrame, graph: bool = True) -> DataFrame:
    """(page_id, url, item_seq, item): objects of every block, in page order."""
    blocks = pages.select(
        "page_id",
        "url",
        F.posexplode(F.regexp_extract_all("html", F.lit(LD_JSON), F.lit(1))).alias("block", "json"),
    )
    parsed = blocks.select("page_id", "url", "block", F.try_parse_json("json").alias("v"))
    docs = parsed.filter(F.col("v").isNotNull()).select(
        "page_id", "url", "block", F.posexplode(_elements(F.col("v"))).alias("doc", "d")
    )
    d = F.col("d")
    listed = F.transform(
        _listed(d, "itemListElement"), lambda x: F.coalesce(_get(x, "item"), x)
    )
    own = F.concat(F.array(d), _listed(d, "@graph")) if graph else F.array(d)
    items = F.when(_get(d, "@type", "string") == "ItemList", listed).otherwise(own)
    return docs.select(
        "page_id", "url", "block", "doc", F.posexplode(items).alias("pos", "item")
    ).select("page_id", "url", F.struct("block", "doc", "pos").alias("item_seq"), "item")


def _first_offer(it: Column) -> Column:
    offers = _get(it, "offers")
    return F.when(
        _is(offers, "ARRAY"), F.get(F.try_variant_get(offers, "$", "array<variant>"), F.lit(0))
    ).otherwise(offers)


def _image(it: Column, of_object: bool) -> Column:
    image = _get(it, "image")
    in_object = _get(image, "url", "string") if of_object else F.lit(None).cast("string")
    return (
        F.when(_is(image, "STRING"), F.try_variant_get(image, "$", "string"))
        .when(_is(image, "ARRAY"), F.try_variant_get(image, "$[0]", "string"))
        .otherwise(in_object)
    )


def products_from_jsonld(pages: DataFrame) -> DataFrame:
    """Harvested products of ``pages`` (page_id, url, html)."""
    items = ld_items(pages).filter(_get(F.col("item"), "@type", "string") == "Product")
    it = F.col("item")
    origin = origin_of(F.col("url"))
    offer = _first_offer(it)
    price = parse_price(F.coalesce(_get(offer, "price", "string"), _get(offer, "lowPrice", "string")))
    brand = _get(it, "brand")
    name = js_trim(F.coalesce(_text(it, "name"), F.lit("")))
    rows = items.select(
        "page_id",
        "item_seq",
        blank_to_null(
            js_trim(F.coalesce(_text(it, "sku"), _text(it, "productID"), _text(it, "mpn")))
        ).alias("external_id"),
        name.alias("name"),
        F.coalesce(_string_only(brand), _get(brand, "name", "string")).alias("brand"),
        price.alias("price"),
        F.lit(None).cast("double").alias("old_price"),
        unit_from_name(name).alias("unit_size"),
        F.lit(None).cast("string").alias("category"),
        _image(it, of_object=True).alias("image_url"),
        absolute_url(_string_only(_get(it, "url")), origin).alias("url"),
    )
    rows = rows.filter((F.col("name") != "") & is_sane_price(F.col("price")))
    return rows.select("page_id", "item_seq", *HARVESTED_COLUMNS)


def offers_from_jsonld(pages: DataFrame) -> DataFrame:
    """The stricter reading used for a chain's own pages.

    No ``@graph`` and no ``lowPrice``; any positive price; the name stands in
    for a missing id; brands only as objects.
    """
    items = ld_items(pages, graph=False).filter(
        (_get(F.col("item"), "@type", "string") == "Product")
        & _get(F.col("item"), "offers").isNotNull()
    )
    it = F.col("item")
    price = parse_price(_get(_first_offer(it), "price", "string"))
    name = F.coalesce(_text(it, "name"), F.lit(""))
    rows = items.select(
        "page_id",
        "item_seq",
        F.coalesce(_text(it, "sku"), _text(it, "productID"), name).alias("external_id"),
        name.alias("name"),
        blank_to_null(_get(_get(it, "brand"), "name", "string")).alias("brand"),
        price.alias("price"),
        F.lit(None).cast("double").alias("old_price"),
        F.lit(None).cast("string").alias("unit_size"),
        F.lit(None).cast("string").alias("category"),
        _image(it, of_object=False).alias("image_url"),
        _get(it, "url", "string").alias("url"),
    )
    return rows.filter(F.col("price") > 0).select("page_id", "item_seq", *HARVESTED_COLUMNS)
