"""Parsers of landed feed payloads: raw rows -> scraped products.

Input: ``payload_seq bigint, payload string`` (one row per landed response, in
arrival order). Output: PRODUCTS_IN columns; within a chain the first row per
product id wins, in arrival order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.numbers import parse_price, positive
from shelfwise.functions.text import blank_to_null, js_trim, title_case
from shelfwise.functions.units import parse_base_price
from shelfwise.operators.keyed import first_per_key
from shelfwise.sources.cards import offers_from_cards
from shelfwise.sources.jsonld import offers_from_jsonld

#: bits of ``seq`` for the position of an item inside its payload
ITEM_BITS = 24

LIDL = (
    "struct<numFound:int, items:array<struct<code:string, gridbox:struct<data:struct<"
    "itemId:bigint, erpNumber:string, fullTitle:string, brand:struct<name:string>, "
    "canonicalUrl:string, image:string, keyfacts:struct<wonCategoryPrimary:string>, "
    "price:struct<price:double, oldPrice:double, packaging:struct<text:string>, "
    "currencyCode:string>, stockAvailability:struct<badgeInfoV2:array<struct<validFrom:bigint, "
    "validUntil:bigint>>>>>>>>"
)
AUCHAN = (
    "array<struct<productId:string, productName:string, brand:string, linkText:string, "
    "categories:array<string>, items:array<struct<ean:string, measurementUnit:string, "
    "unitMultiplier:double, images:array<struct<imageUrl:string>>, sellers:array<struct<"
    "commertialOffer:struct<Price:double, ListPrice:double, IsAvailable:boolean>>>>>>>"
)
PENNY = (
    "struct<total:int, count:int, offset:int, results:array<struct<sku:string, productId:string, "
    "name:string, slug:string, category:string, brandMarketing:string, images:array<string>, "
    "price:struct<baseUnitShort:string, regular:struct<value:double, "
    "perStandardizedQuantity:double>, validityStart:string, validityEnd:string>, weight:double, "
    "weightArticle:boolean, volumeLabelShort:string, amount:string, packageLabelKey:string, "
    "published:boolean>>>"
)
KAUFLAND = (
    "struct<props:struct<offerData:struct<cycles:array<struct<categories:array<struct<"
    "displayName:string, name:string, offers:array<struct<offerId:string, klNr:string, "
    "title:string, subtitle:string, unit:string, price:string, basePrice:string, "
    "formattedBasePrice:string, dateFrom:string, dateTo:string, listImage:string, "
    "detailTitle:string>>>>>>>>>"
)

# Site addresses used for product links.
LIDL_SITE = "https://www.lidl.ro"
AUCHAN_SITE = "https://www.auchan.ro"
PENNY_SITE = "https://www.penny.ro/products/"
KAUFLAND_OFFERS = "https://www.kaufland.ro/oferte/oferte-saptamanale/saptamana-curenta.html"
# Fixed value: the offers blob in the page.
KAUFLAND_BLOB = (
    r"(?s)window\.SSR\['[^']+'\]\s*=\s*(\{\"component\":\"OfferTemplate\".*?\});?\s*</script>"
)
# The offers page, and the title of a page that asks to prove one is no robot.
PROFI_OFFERS = "https://www.profi.ro/oferte/"
PAGE_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
PROFI_CHALLENGE = r"(?i)moment|attention|just a"
# Unit names of reported unit prices.
PENNY_UNITS = {"kg": "kg", "l": "l", "buc": "buc", "lt": "l"}

_NULLS = {
    "old_price": "double",
    "currency": "string",
    "price_per_unit": "struct<value:double,unit:string>",
    "image_url": "string",
    "url": "string",
    "valid_from": "string",
    "valid_to": "string",
    "store_external_ids": "array<string>",
}


def _items(raw: DataFrame, array: Column) -> DataFrame:
    exploded = raw.select("payload_seq", F.posexplode(array).alias("pos", "item"))
    return exploded.withColumn("seq", F.shiftleft("payload_seq", ITEM_BITS) + F.col("pos"))


def _products(items: DataFrame, slug: str, **columns: Column) -> DataFrame:
    fields = ["external_id", "name", "brand", "raw_category", "unit_size_text", "price", *_NULLS]
    values = [
        columns[f].alias(f) if f in columns else F.lit(None).cast(_NULLS[f]).alias(f)
        for f in fields
    ]
    extra = [v.alias(k) for k, v in columns.items() if k not in fields]
    return items.select(F.lit(slug).alias("supermarket_slug"), "seq", *values, *extra)


def _first_wins(products: DataFrame) -> DataFrame:
    return first_per_key(products, ["supermarket_slug", "external_id"], ["seq"])


def _or(*options: Column) -> Column:
    return F.coalesce(*[blank_to_null(o) for o in options])


def _join_words(*parts: Column) -> Column:
    return F.concat_ws(" ", *[blank_to_null(p) for p in parts])


def number_text(x: Column) -> Column:
    """Shortest decimal text of a number: 1.0 -> ``1``, 0.50 -> ``0.5``."""
    decimals = F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"0+$", "")
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(decimals)


def _epoch_date(seconds: Column) -> Column:
    days = F.floor(seconds / 86400).cast("int")
    return F.when(seconds != 0, F.date_add(F.lit("1970-01-01"), days).cast("string"))


def lidl(raw: DataFrame) -> DataFrame:
    items = _items(raw, F.from_json("payload", LIDL)["items"])
    d = F.col("item.gridbox.data")
    price = d["price"]["price"]
    validity = F.get(d["stockAvailability"]["badgeInfoV2"], F.lit(0))
    link = d["canonicalUrl"]
    products = _products(
        items,
        "lidl",
        external_id=F.coalesce(d["itemId"].cast("string"), d["erpNumber"], F.col("item.code")),
        name=F.coalesce(d["fullTitle"], F.lit("")),
        brand=blank_to_null(d["brand"]["name"]),
        raw_category=d["keyfacts"]["wonCategoryPrimary"],
        unit_size_text=d["price"]["packaging"]["text"],
        price=price,
        old_price=F.when(d["price"]["oldPrice"] > 0, d["price"]["oldPrice"]),
        currency=_or(d["price"]["currencyCode"], F.lit("RON")),
        image_url=d["image"],
        url=F.when(link != "", F.concat(F.lit(LIDL_SITE), link)),
        valid_from=_epoch_date(validity["validFrom"]),
        valid_to=_epoch_date(validity["validUntil"]),
    )
    return _first_wins(products.filter((F.col("external_id") != "") & positive(F.col("price"))))


def auchan(raw: DataFrame) -> DataFrame:
    items = _items(raw, F.from_json("payload", AUCHAN))
    p = F.col("item")
    first = F.get(p["items"], F.lit(0))
    offer = F.get(first["sellers"], F.lit(0))["commertialOffer"]
    price, list_price = offer["Price"], offer["ListPrice"]
    unit, times = first["measurementUnit"], first["unitMultiplier"]
    path = F.split(F.get(p["categories"], F.lit(0)), "/")
    link = p["linkText"]
    products = _products(
        items,
        "auchan",
        external_id=p["productId"],
        name=p["productName"],
        brand=blank_to_null(p["brand"]),
        raw_category=F.try_element_at(F.array_remove(path, ""), F.lit(-1)),
        unit_size_text=F.when(
            (unit != "") & (unit != "un") & (times != 0), F.concat_ws(" ", number_text(times), unit)
        ).otherwise(p["productName"]),
        price=price,
        old_price=F.when(list_price > price, list_price),
        currency=F.lit("RON"),
        image_url=F.get(first["images"], F.lit(0))["imageUrl"],
        url=F.when(link != "", F.concat(F.lit(AUCHAN_SITE + "/"), link, F.lit("/p"))),
    )
    valid = (F.col("external_id") != "") & (F.col("name") != "") & positive(F.col("price"))
    return _first_wins(products.filter(valid))


def penny(raw: DataFrame) -> DataFrame:
    items = _items(raw, F.from_json("payload", PENNY)["results"])
    p = F.col("item")
    bani = p["price"]["regular"]["value"]
    reported = p["price"]["regular"]["perStandardizedQuantity"]
    unit_map = F.create_map(*[F.lit(x) for pair in PENNY_UNITS.items() for x in pair])
    unit = F.try_element_at(unit_map, F.lower(p["price"]["baseUnitShort"]))
    weighed = F.concat_ws(
        " ",
        number_text(F.coalesce(p["weight"], F.lit(1.0))),
        F.coalesce(p["volumeLabelShort"], F.lit("kg")),
    )
    packaged = blank_to_null(_join_words(p["amount"], p["packageLabelKey"]))
    slug = p["slug"]
    products = _products(
        items.filter(F.coalesce(F.col("item.published"), F.lit(True))),
        "penny",
        external_id=_or(p["sku"], p["productId"]),
        name=title_case(p["name"]),
        brand=blank_to_null(p["brandMarketing"]),
        raw_category=p["category"],
        unit_size_text=F.when(p["weightArticle"], weighed).otherwise(packaged),
        price=bani / 100,
        price_per_unit=F.when(
            (reported != 0) & unit.isNotNull(),
            F.struct((reported / 100).alias("value"), unit.alias("unit")),
        ),
        currency=F.lit("RON"),
        image_url=F.get(p["images"], F.lit(0)),
        url=F.when(slug != "", F.concat(F.lit(PENNY_SITE), slug)),
        valid_from=p["price"]["validityStart"],
        valid_to=p["price"]["validityEnd"],
    )
    valid = F.col("external_id").isNotNull() & (F.col("name") != "") & positive(F.col("price"))
    return _first_wins(products.filter(valid))


def kaufland(raw: DataFrame, reference_compat: bool = False) -> DataFrame:
    """Offers embedded in the weekly page (``payload`` is HTML). Adds ``kl_nr``.

    The first offer of an id claims it even when it turns out to have no name.
    """
    empty = F.array()
    blob = F.from_json(F.regexp_extract("payload", KAUFLAND_BLOB, 1), KAUFLAND)
    cycles = F.coalesce(blob["props"]["offerData"]["cycles"], empty)

    def offers_of(category: Column) -> Column:
        label = _or(category["displayName"], category["name"])
        return F.transform(
            F.coalesce(category["offers"], empty),
            lambda o: F.struct(label.alias("category"), o.alias("o")),
        )

    flat = F.flatten(
        F.transform(
            F.flatten(F.transform(cycles, lambda c: F.coalesce(c["categories"], empty))), offers_of
        )
    )
    items = _items(raw, flat)
    o = F.col("item.o")
    subtitle = js_trim(F.replace(F.coalesce(o["subtitle"], F.lit("")), F.lit("\n"), F.lit(" ")))
    name = _or(
        _join_words(js_trim(o["title"]), subtitle),
        js_trim(F.coalesce(o["detailTitle"], F.lit(""))),
    )
    products = _products(
        items,
        "kaufland",
        external_id=_or(o["klNr"], o["offerId"]),
        name=name,
        brand=F.lit(None).cast("string"),
        raw_category=F.col("item.category"),
        unit_size_text=blank_to_null(_join_words(subtitle, o["unit"])),
        price=parse_price(o["price"]),
        price_per_unit=parse_base_price(
            _or(o["basePrice"], o["formattedBasePrice"]), reference_compat
        ),
        currency=F.lit("RON"),
        image_url=o["listImage"],
        url=F.lit(KAUFLAND_OFFERS),
        valid_from=o["dateFrom"],
        valid_to=o["dateTo"],
        kl_nr=F.coalesce(o["klNr"], F.lit("")),
    )
    priced = products.filter(F.col("external_id").isNotNull() & positive(F.col("price")))
    return _first_wins(priced).filter(F.col("name").isNotNull())


def profi(raw: DataFrame) -> DataFrame:
    """Offer pages as a browser saw them (``payload`` is HTML).

    A page's JSON-LD products count; a page without any is read by its product cards. Pages that show
    the site's challenge instead of offers are left out.
    """
    title = F.coalesce(F.regexp_extract("payload", PAGE_TITLE, 1), F.lit(""))
    pages = raw.filter(~F.rlike(title, F.lit(PROFI_CHALLENGE))).select(
        F.col("payload_seq").alias("page_id"), F.lit(PROFI_OFFERS).alias("url"), F.col("payload").alias("html")
    )
    described = offers_from_jsonld(pages)
    # JSON-LD decides page by page, by its presence alone, so pages are told apart before cards are walked
    plain = pages.join(described.select("page_id").distinct(), "page_id", "left_anti")
    shown = offers_from_cards(plain, own=True)

    def numbered(offers: DataFrame) -> DataFrame:
        in_page = F.row_number().over(Window.partitionBy("page_id").orderBy("item_seq"))
        return offers.withColumn("seq", F.shiftleft("page_id", ITEM_BITS) + in_page).drop("item_seq")

    offers = numbered(described).unionByName(numbered(shown))
    products = _products(
        offers,
        "profi",
        external_id=F.col("external_id"),
        name=F.col("name"),
        brand=F.col("brand"),
        raw_category=F.lit(None).cast("string"),
        unit_size_text=F.lit(None).cast("string"),
        price=F.col("price"),
        image_url=F.col("image_url"),
        url=F.col("url"),
    )
    return _first_wins(products)


#: feed name -> parser; add an entry to support another chain
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "lidl": lidl,
    "auchan": auchan,
    "penny": penny,
    "kaufland": kaufland,
    "profi": profi,
}


def parse_feed(name: str, raw: DataFrame) -> DataFrame:
    if name not in PARSERS:
        raise ValueError(f"unknown feed {name!r}; available: {', '.join(PARSERS)}")
    return PARSERS[name](raw)
