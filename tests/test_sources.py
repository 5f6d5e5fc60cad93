"""Feed parsers and harvested pages."""

import json

from pyspark.sql import functions as F

from shelfwise.schemas import HARVESTED
from shelfwise.sources import cards, feeds, json_bodies, jsonld, links, merge_sources, stores

SHOP = "https://shop.example.com/oferte/x.html"


def payloads(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "payload_seq bigint, payload string")


def test_lidl_first_wins_and_drops(spark):
    def item(price, **data):
        return {"code": data.pop("code", None), "gridbox": {"data": {"price": {"price": price}, **data}}}

    first = {"items": [item(5.5, itemId=1, fullTitle="Lapte", brand={"name": ""}), item(None, itemId=2), item(0, itemId=3), {"code": "x"}]}
    second = {"items": [item(9.9, itemId=1, fullTitle="Alt"), item(2, code="c9", fullTitle="Apă", stockAvailability={"badgeInfoV2": [{"validFrom": 1700000000}]})]}
    got = {r.external_id: r for r in feeds.parse_feed("lidl", payloads(spark, json.dumps(first), json.dumps(second), "{broken")).collect()}
    assert set(got) == {"1", "c9"}
    assert got["1"].price == 5.5 and got["1"].brand is None and got["1"].currency == "RON"
    assert got["c9"].valid_from == "2023-11-14" and got["c9"].valid_to is None


def test_penny_and_auchan_details(spark):
    results = [
        {"sku": "", "productId": "p1", "name": "ROSII CHERRY-MIX", "price": {"regular": {"value": 899, "perStandardizedQuantity": 1798}, "baseUnitShort": "KG"}, "weightArticle": True, "weight": 0.5},
        {"sku": "s2", "name": "Lapte", "price": {"regular": {"value": 500}}, "amount": "6", "packageLabelKey": "buc", "published": False},
    ]
    (p,) = feeds.parse_feed("penny", payloads(spark, json.dumps({"results": results}))).collect()
    assert (p.external_id, p.name, p.price, p.unit_size_text) == ("p1", "Rosii Cherry-Mix", 8.99, "0.5 kg")
    assert tuple(p.price_per_unit) == (17.98, "kg")
    product = {
        "productId": "7", "productName": "Cașcaval, 500 g", "categories": ["/Lactate, Carne/Cascaval/"], "linkText": "casc",
        "items": [{"measurementUnit": "kg", "unitMultiplier": 1.0, "sellers": [{"commertialOffer": {"Price": 10.0, "ListPrice": 10.0}}]}],
    }
    (a,) = feeds.parse_feed("auchan", payloads(spark, json.dumps([product]))).collect()
    assert (a.raw_category, a.unit_size_text, a.old_price, a.url) == ("Cascaval", "1 kg", None, "https://www.auchan.ro/casc/p")


def test_kaufland_flatten_and_claims(spark):
    offers = [
        {"klNr": "1", "price": "0", "title": "fără preț"},
        {"klNr": "2", "price": 5.5},  # claims the id, has no name
        {"klNr": "2", "price": 6, "title": "Prea târziu"},
        {"offerId": "o3", "price": "12,49", "title": " Gordi ", "subtitle": "Cașcaval\n100 G", "unit": "buc", "formattedBasePrice": "(=1 kg 124.90)"},
    ]
    blob = {"component": "OfferTemplate", "props": {"offerData": {"cycles": [{"categories": None}, {"categories": [{"name": "Lactate", "offers": offers}]}]}}}
    page = f"<script>window.SSR['a-b'] = {json.dumps(blob, separators=(',', ':'))};</script><p>x</p>"
    (o,) = feeds.kaufland(payloads(spark, page, "<html></html>")).collect()
    assert (o.external_id, o.kl_nr, o.name, o.price) == ("o3", "", "Gordi Cașcaval 100 G", 12.49)
    assert (o.unit_size_text, tuple(o.price_per_unit), o.raw_category) == ("Cașcaval 100 G buc", (124.9, "kg"), "Lactate")


def test_store_selection_and_availability(spark):
    raw = payloads(spark, json.dumps([
        {"n": "RO2", "cn": "B", "t": "Cluj-Napoca", "pc": "400002", "lat": "46.7"}, {"n": "RO1", "cn": "A", "t": "Cluj-Napoca", "pc": "400001"},
        {"n": "RO3", "cn": "C", "t": "Iași", "pc": "700001"}, {"n": "RO4", "cn": "D", "t": "Nicăieri", "pc": "9"},
    ]))
    listed = stores.parse_store_list(raw)
    chosen, warned = stores.select_stores(listed)
    assert {r.n for r in chosen.collect()} == {"RO1", "RO3"} and "1 magazine" in warned.first().warning
    chosen, warned = stores.select_stores(listed, cities=["cluj-napoca", " Brașov"])
    assert {r.n for r in chosen.collect()} == {"RO1"} and [r.warning for r in warned.collect()][0].count("brașov") == 1
    everything, _ = stores.select_stores(listed, everything=True)
    assert everything.count() == 4
    offers = spark.createDataFrame([("k1", None), ("k2", None)], "kl_nr string, store_external_ids array<string>")
    lists = spark.createDataFrame([("RO3", "k1"), ("RO1", "k1"), ("RO1", "k1"), ("RO9", "k2"), ("RO1", "")], "store_n string, kl_nr string")
    got = {r.kl_nr: r.store_external_ids for r in stores.attach_availability(offers, everything, lists).collect()}
    assert got == {"k1": ["RO1", "RO3"], "k2": None}


def pages(spark, *htmls):
    return spark.createDataFrame([(i, SHOP, h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")


def test_jsonld_variants(spark):
    def block(x):
        return f'<script data-x="1" type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'

    lone = {"@type": "Product", "sku": 12, "name": " Lapte 1 l ", "brand": "Zuzu", "offers": {"lowPrice": "5,49"}, "image": {"url": "i.png"}, "url": "/p/1"}
    graph = {"@graph": [{"@type": "Thing"}, {"@type": "Product", "name": "Unt", "offers": [{"price": 7.5}, {"price": 1}], "image": ["a.png", "b.png"]}]}
    listing = {"@type": "ItemList", "itemListElement": [{"item": {"@type": "Product", "name": "Suc", "offers": {"price": 3}, "brand": {"name": "Fanta"}}}, {"@type": "Product", "name": "Apă", "offers": {"price": 99999}}]}
    html = block(lone) + block("{broken") + block([graph, listing]) + block({"@type": "Product", "name": "", "offers": {"price": 4}})
    got = jsonld.products_from_jsonld(pages(spark, html, None)).orderBy("item_seq").collect()
    assert [(r.external_id, r.name, r.brand, r.price, r.unit_size, r.image_url, r.url) for r in got] == [
        ("12", "Lapte 1 l", "Zuzu", 5.49, "1 l", "i.png", "https://shop.example.com/p/1"),
        (None, "Unt", None, 7.5, None, "a.png", None),
        (None, "Suc", "Fanta", 3.0, None, None, None),
    ]
    own = jsonld.offers_from_jsonld(pages(spark, html)).orderBy("item_seq").collect()
    assert [(r.external_id, r.price) for r in own] == [("Suc", 3.0), ("Apă", 99999.0), ("", 4.0)]


def test_json_lists_and_scale(spark):
    def items(prices, **extra):
        return [{"title": f"Produs {i}", "price": {"regular": {"value": p}}, **extra} for i, p in enumerate(prices)]

    deep = {"a": {"b": [{"c": items([199, 899, 1299])}]}, "noise": [1, 2, 3], "few": items([1, 2])}
    odd = {"list": items([5.5, 200, 300], sku=["id-1"]), "nested": {"name": "x", "price": 1}}
    low = items([1, 2, 149])
    unnamed = [{"price": "1000"}] + items([200, 300])
    bodies = spark.createDataFrame(
        [(i, SHOP, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate([deep, odd, low, unnamed, "not json"])],
        "body_id bigint, url string, body string",
    )
    got = {}
    for r in json_bodies.products_from_json(bodies).orderBy("body_id", "item_seq").collect():
        got.setdefault(r.body_id, []).append(r.price)
    assert got == {0: [1.99, 8.99, 12.99], 1: [5.5, 200.0, 300.0], 2: [1.0, 2.0, 149.0], 3: [2.0, 3.0]}
    assert json_bodies.price_of({"value": 3, "oldprice": 9, "current.price": "7,5", "prices": {"price": {"x": {"value": 1}}}}) == 7.5


def test_json_walk_has_no_cuts(spark):
    def items(n, **extra):
        return [{"title": f"Produs {i}", "price": 1.5 + i, **extra} for i in range(n)]

    late = {"a": [*[[k] for k in range(60)], {"x": items(3)}]}  # behind element 50
    deep = items(4)
    for _ in range(12):
        deep = {"in": [deep]}
    bottomless = '{"in":[' * 30000 + json.dumps(items(3)) + "]}" * 30000
    judged = [{"title": "fără preț"}] * 10 + items(20)  # ten bad objects, then twenty good ones
    long = items(3, sku="s" * 150, brand="b" * 150, category="c" * 200)
    for x in long:
        x["title"] += " y" * 200
    nested = [{"title": f"Produs {i}", "price": {"price": {"price": {"price": {"price": 3.5}}}}} for i in range(3)]
    bodies = spark.createDataFrame(
        [(i, SHOP, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate([late, deep, bottomless, judged, long, nested])],
        "body_id bigint, url string, body string",
    )
    got = {}
    for r in json_bodies.products_from_json(bodies).collect():
        got.setdefault(r.body_id, []).append(r)
    assert {i: len(rows) for i, rows in got.items()} == {0: 3, 1: 4, 2: 3, 3: 20, 4: 3, 5: 3}
    assert all((len(r.external_id), len(r.brand), len(r.category)) == (150, 150, 200) and len(r.name) > 400 for r in got[4])
    assert json_bodies.products_from_json(bodies, json_bodies.REFERENCE_LIMITS).count() == 0


def test_deep_json_reads_like_json():
    good = ['{"a": [1, -2.5e3, {"b": null}, [], {}], "c": "x\\n\\u00e9", "a2": true}', "[]", " [1 , 2] ", "3", '"x"', "{}", '{"a":1,"a":2}']
    for text in good:
        assert json_bodies._loads_deep(text) == json.loads(text)
    for text in ["", "[1,]", "{,}", '{"a"}', '{"a":}', "[1 2]", "[", "]", "[1]]", '{"a":1,}', "[1}", "{1:2}", "[,1]"]:
        for read in (json.loads, json_bodies._loads_deep):
            try:
                read(text)
            except ValueError:
                continue
            raise AssertionError(text)


def test_cards(spark):
    html = """<div class="product-grid"><div class="card-a"><h3>Lapte Zuzu</h3>
      <div class="price"><span>12</span><sup>99</sup> lei</div><img src="/i.png"><a href="/p/1">x</a></div>
      <li>Brânză de vaci proaspătă<br>acum 7,50 lei</li><li>12 lei</li><li>fără preț</li>
      <li class="item"><p class="title">Unt gras</p><p class="pret">9.5</p> 8 RON</li>
      <article><h2>Lapte  Zuzu</h2> 12,99 lei</article></div>"""
    rows = cards.products_from_cards(pages(spark, html, None)).orderBy("item_seq").collect()
    assert [(r.name, r.price) for r in rows] == [("Lapte Zuzu", 12.99), ("Brânză de vaci proaspătă", 7.5), ("Unt gras", 9.0)]
    assert (rows[0].image_url, rows[0].url) == ("https://shop.example.com/i.png", "https://shop.example.com/p/1")
    own = cards.offers_from_cards(pages(spark, html)).collect()
    assert ("unt-gras", 8.0) in [(r.external_id, r.price) for r in own]


def test_cards_have_no_cuts(spark):
    name = "Lapte " + "foarte " * 40 + "bun"
    html = (
        f'<li><b class="title">{name}</b> 12345,99 lei</li><li><b class="title">Unt gras</b>{" text" * 200} 20500 lei</li>'
        '<div class="product-card"><h3>Frigider</h3><p class="price"><span>12345</span><sup>99</sup> lei</p></div>'
        '<div class="product-card"><h3>Cuptor</h3><p class="price">23456.50</p></div>'
        '<div class="product-card"><h3>Plita</h3><p class="price">23456</p></div>'
    )
    rows = cards.products_from_cards(pages(spark, html)).orderBy("item_seq").collect()
    assert [(r.name, r.price) for r in rows] == [(name, 12345.99), ("Unt gras", 20500.0), ("Frigider", 12345.99), ("Cuptor", 23456.5), ("Plita", 23456.0)]
    cut = cards.products_from_cards(pages(spark, html), longest_card=600, longest_name=200).orderBy("item_seq").collect()
    assert [r.name for r in cut] == [name[:200], "Frigider", "Cuptor", "Plita"]


def test_links(spark):
    html = (
        '<a href="/oferte/lapte?x=1#top">a</a><a href="/oferte/lapte?x=1">again</a><a href="https://SHOP.example.com/Oferte/ouă">b</a>'
        '<a href="https://other.example.com/oferte/">c</a><a href="/oferte/a.pdf">d</a><a href="/altceva">e</a><a href="oferte/rel">f</a>'
        '<a href="/promo/1">g</a>'
    )
    df = pages(spark, html).select(F.lit("penny").alias("site"), F.col("page_id").alias("page_seq"), "url", "html")
    pattern, budget = links.SITES["penny"]
    got = links.page_links(df, pattern, budget).orderBy("link_no").collect()
    assert [r.link for r in got] == [
        "https://shop.example.com/oferte/lapte?x=1", "https://shop.example.com/Oferte/ou%C4%83", "https://shop.example.com/promo/1",
    ]
    assert links.page_links(df, pattern, 1).count() == 1


def test_merge_order(spark):
    def source(*rows):
        full = [("s", page, seq, ext, name, None, price, None, None, None, None, None) for page, seq, ext, name, price in rows]
        return spark.createDataFrame(full, "site string, page_seq bigint, item_seq bigint, " + HARVESTED)

    api = source((2, 0, "A", "Lapte", 5.0), (1, 0, "B", "Unt", 0.01))
    page = source((1, 0, "A", "Lapte", 6.0), (1, 1, None, "Suc Bun", 3.0), (1, 2, "suc-bun", "Suc", 4.0), (2, 0, "B", "Unt", 9.0))
    got = {r.product_key: r.price for r in merge_sources.merge_sources(api, page).collect()}
    assert got == {"A": 6.0, "suc-bun": 3.0, "B": 9.0}


def test_all_links_of_a_site(spark):
    htmls = ["".join(f'<a href="/oferte/{p}-{i}">x</a>' for i in range(30)) for p in range(3)]
    df = pages(spark, *htmls).select(F.when(F.col("page_id") < 2, "a").otherwise("b").alias("site"), F.col("page_id").alias("page_seq"), "url", "html")
    got = links.page_links(df, "(?i)/oferte", None).orderBy("site", "link_no").collect()
    want = [("a", p * 30 + i + 1, f"https://shop.example.com/oferte/{p}-{i}") for p in range(2) for i in range(30)]
    want += [("b", i + 1, f"https://shop.example.com/oferte/2-{i}") for i in range(30)]
    assert [tuple(r) for r in got] == want

    from shelfwise.plans import oracles, registry

    assert "page_links_all" in registry.QUERIES and "QUALIFY" not in oracles.page_links_all()


def test_profi_pages(spark):
    def card(name, price, tag="h3"):
        return f'<div class="product-card"><{tag}>{name}</{tag}><p>{price}</p></div>'

    ld = (
        '<script type="application/ld+json">[{"@type":"Product","sku":"7","name":"Lapte","brand":{"name":"Zuzu"},'
        '"offers":[{"price":"5,49"}]},{"@type":"Product","name":"Unt","offers":{"price":9.5}},'
        '{"@type":"Product","name":"Suc"}]</script>'
    )
    rows = [
        (1, "<title>Oferte</title>" + ld + card("Nu se vede", "3 lei")),
        (2, '<div class="offer-list">' + card("Pâine  albă", "4,5 lei") + card("Pâine  albă", "9 lei") + card("Ou", "1 leu")
            + card("Fără titlu", "2 lei", "b") + "<li><h3>Nu e card</h3> 5 lei</li></div>"),
        (3, "<title>Just a moment...</title>" + card("Provocare", "3 lei")),
        (4, '<script type="application/ld+json">{"@type":"Product","sku":"7","name":"Alt lapte","offers":{"price":1}}</script>'),
        (5, None),
    ]
    raw = spark.createDataFrame(rows, "payload_seq bigint, payload string")
    got = feeds.parse_feed("profi", raw).orderBy("seq").collect()
    assert [(r.external_id, r.name, r.brand, r.price) for r in got] == [
        ("7", "Lapte", "Zuzu", 5.49), ("Unt", "Unt", None, 9.5), ("pâine-albă", "Pâine albă", None, 4.5),
    ]
    assert all(r.supermarket_slug == "profi" and r.store_external_ids is None for r in got)
    assert feeds.parse_feed("profi", raw.limit(0)).count() == 0
