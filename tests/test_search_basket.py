"""Search and baskets: demo goldens, and a brute-force model on random catalogues."""

import random
import re
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.functions.categories import CATEGORY_RULES
from shelfwise.operators import basket
from shelfwise.operators.search import search_hits, search
from shelfwise.operators.upsert import save, save_increment
from shelfwise.sources.catalogue_csv import read_catalogue_csv, rows_to_batch
from shelfwise.sources.search_index import build_index
from shelfwise.sources.snapshot import Catalog, empty_catalog, read_snapshot, write_snapshot

DEMO = str(Path(__file__).parent / "fixtures" / "demo.csv")
AS_OF = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    batch = rows_to_batch(read_catalogue_csv(spark, DEMO))
    chains = spark.createDataFrame(
        [(s, 100 + i, n) for i, (s, n) in enumerate([("penny", "Penny"), ("metro", "Metro")])],
        schemas.SUPERMARKETS_IN,
    )
    cat = save(empty_catalog(spark), batch.supermarkets.unionByName(chains), batch.stores, batch.products, AS_OF).catalog
    root = str(tmp_path_factory.mktemp("demo"))
    write_snapshot(cat, root)
    return read_snapshot(spark, root)


def ask(spark, *rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "query_id bigint, q string, category string, county string"
    )


def test_demo_search(spark, demo):
    queries = ask(spark, ("lapte", None, None), ("fanta pere", None, None), ("apa", None, None), (None, "menaj", None))
    hits = search(demo, queries).orderBy("query_id", "hit_no").collect()
    by = {i: [(h.match_rank, h.price, h.supermarket_slug) for h in hits if h.query_id == i] for i in range(4)}
    assert by[0][:6] == [
        (6, 6.19, "profi"), (6, 6.49, "mega-image"), (7, 5.49, "lidl"), (8, 5.69, "auchan"),
        (11, 5.79, "kaufland"), (11, 5.99, "carrefour"),
    ]
    assert by[0][6] == (9999, 11.99, "kaufland")
    assert by[1] == [(1, 6.49, "kaufland"), (1, 6.99, "lidl"), (1, 7.29, "profi"), (1, 7.49, "mega-image")]
    assert by[2][:4] == [(1, 2.49, "profi"), (8, 2.09, "auchan"), (9, 1.99, "lidl"), (11, 2.19, "kaufland")]
    assert [(r, p) for r, p, _ in by[3]] == [(0, 34.99), (0, 36.49), (0, 49.99)]


def test_search_through_stored_parts(spark, demo, tmp_path):
    batch = rows_to_batch(read_catalogue_csv(spark, DEMO))
    root, first = str(tmp_path / "live"), F.crc32("external_id") % 2 == 0
    for part in (first, ~first):
        save_increment(spark, root, batch.supermarkets, batch.stores, batch.products.filter(part), AS_OF, buckets=2)
    live = read_snapshot(spark, root)
    assert live.index.several_parts and demo.index and not demo.with_tables(products=demo.products).index
    stored = live.index.postings.join(live.index.names.distinct(), "name_id")
    built = build_index(live.products)
    want = built.postings.join(built.names, "name_id")
    assert set(stored.collect()) == set(want.collect())
    shown = ["query_id", "hit_no", "match_rank", "price", "supermarket_slug", "name", "store_id"]
    queries = ask(spark, ("lapte", None, None), ("fanta pere", None, None), ("lap", None, None), ("nimic", None, None))
    for prefix in (False, True):
        asked = queries.withColumn("prefix", F.lit(prefix))
        plain = live.with_tables(products=live.products)  # no stored index
        got = [sorted(map(tuple, search(c, asked).select(*shown).collect())) for c in (live, plain)]
        assert got[0] == got[1] and got[0]


def test_missing_counts_equal_the_counts_of_items(spark, demo):
    data = lines(
        spark,
        (1, 1, "lapte", 2.0, None), (1, 2, "paine", 1.0, None), (1, 3, "sampanie veche", 1.0, None), (1, 4, "detergent", 1.0, None),
        (2, 1, "lapte zuzu", 1.0, "Cluj"), (2, 2, "bananele", 3.0, "Cluj"), (3, 1, "xyz", 1.0, None),
    )
    columns = ["basket_id", "supermarket_id", "missing_count", "alternative_count"]
    want = basket.missing_report(basket.compare_items(demo, data)).select(*columns).collect()
    got = basket.missing_counts(demo, data).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3 * demo.supermarkets.count()
    assert any(r.alternative_count for r in got) and any(0 < r.missing_count < 4 for r in got)


def lines(spark, *rows):
    return spark.createDataFrame([(*r[:4], None, r[4]) for r in rows], schemas.BASKET_LINES)


def test_demo_baskets(spark, demo):
    data = lines(
        spark,
        (1, 1, "lapte", 2.0, None), (1, 2, "paine", 1.0, None), (1, 3, "cafea boabe", 0.0, None), (1, 4, "detergent", 1.0, None),
        (2, 1, "lapte zuzu", 1.0, "Cluj"), (2, 2, "banane", 3.0, "Cluj"), (2, 3, "  ", 1.0, "Cluj"),
        *[(3, i, f"item {i}", 1.0, None) for i in range(51)],
    )
    rows = basket.compare_baskets(demo, data).orderBy("basket_id", "chain_rank").collect()
    got = {b: [(r.slug, r.found_count, r.total) for r in rows if r.basket_id == b] for b in (1, 2, 3)}
    assert got[1][:6] == [
        ("kaufland", 4, 104.05), ("lidl", 4, 104.25), ("profi", 3, 65.86), ("carrefour", 3, 73.16),
        ("auchan", 2, 14.47), ("mega-image", 1, 12.98),
    ]
    assert [s for s, _, _ in got[1][6:]] == ["metro", "penny"]
    assert got[2][:2] == [("profi", 2, 27.16), ("lidl", 1, 19.47)]
    assert all(n == 0 and t == 0 for _, n, t in got[2][2:])
    assert len(got[3]) == 8 and all(n == 0 for _, n, _ in got[3])  # a basket of any size is answered
    small = basket.compare_baskets(demo, data, max_items=50).select("basket_id").distinct().collect()
    assert {r.basket_id for r in small} == {1, 2}  # unless a bound is asked for
    items = basket.compare_items(demo, data).join(demo.supermarkets.select(F.col("id").alias("supermarket_id"), "slug"), "supermarket_id")
    missed = items.filter("basket_id = 2 and query = 'lapte zuzu' and slug = 'lidl'").first()
    alt = demo.products.filter(F.col("id") == missed.alt_product_id).first()
    assert missed.product_id is None and alt.external_id == "demo-lapte-1"
    arrays = basket.comparison_items(demo, data).filter("basket_id = 1").first()
    assert [i.query for i in arrays["items"]] == ["lapte", "paine", "cafea boabe", "detergent"]


def category(n):
    return next((c for p, c in CATEGORY_RULES if re.search(p, n)), "altele")


def model(products, prices, stores, q, prefix, strict, cat, chain, city, county, cap, limit, compat=True):
    """One query, row by row."""
    tokens = q.split()
    if not tokens and not cat:
        return []
    slug = category(q)
    out = []
    for p in products:
        padded = f" {p['normalized_name']} "
        if tokens:
            if not strict and len(tokens) == 1 and slug != "altele":
                word = (f"% {q}%" if compat else f" {q}") if prefix else f" {q} "
                hit = word in padded or p["category"] == slug
            elif prefix:
                hit = all(f" {t}" in padded for t in tokens)
            else:
                hit = all(f" {t} " in padded for t in tokens)
            pos = min(padded.find(f" {t}" if prefix else f" {t} ") + 1 for t in tokens) or 9999
            rank = pos + (1000 if slug != "altele" and p["category"] != slug else 0)
        else:
            hit, rank = True, 0
        if not hit or (cat and p["category"] != cat) or (chain and p["chain"] != chain):
            continue
        for r in prices.get(p["id"], []):
            st = stores.get(r["store_id"], {})
            if all(not w or r["store_id"] == 0 or st.get(k) == w for k, w in (("city", city), ("county", county))):
                out.append((rank, r["price"], p["id"], r["store_id"]))
    out = sorted(out)[:cap]
    best = {}
    for row in out:
        best.setdefault(row[2], row)
    return list(best.values())[:limit]


@pytest.fixture(scope="module")
def random_world(spark):
    rnd = random.Random(7)
    words = "lapte unt suc apa zuzu mere verde 3,5% pere iaurt lapticel untura sucuri lemon alb bio ton lapt% %".split()
    products, prices, seen = [], [], {}
    for i in range(1, 301):
        name = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
        chain = 1 if rnd.random() < 0.4 else rnd.randint(1, 4)
        products.append({"id": i, "normalized_name": name, "category": category(name), "chain": f"c{chain}", "chain_id": chain})
        rows = {0 if rnd.random() < 0.4 else rnd.randint(1, 13) for _ in range(rnd.randint(0, 4))}
        seen[i] = [{"store_id": s, "price": rnd.randint(1, 30) / 2} for s in rows]
        prices += [(i, r["store_id"], r["price"]) for r in seen[i]]
    stores = {s: {"city": rnd.choice("AB"), "county": rnd.choice(["X", "Y", None])} for s in range(1, 13)}  # 13 is unknown
    empty = empty_catalog(spark)

    def frame(rows, schema, table):
        df = spark.createDataFrame(rows, schema)
        missing = [c for c in getattr(empty, table).columns if c not in df.columns]
        types = dict(getattr(empty, table).dtypes)
        return df.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in missing])

    cat = Catalog(
        supermarkets=frame([(i, f"c{i}", f"C{i}") for i in range(1, 5)], "id bigint, slug string, name string", "supermarkets"),
        stores=frame([(s, v["city"], v["county"]) for s, v in stores.items()], "id bigint, city string, county string", "stores"),
        products=frame([(p["id"], p["chain_id"], p["normalized_name"], p["category"]) for p in products],
                       "id bigint, supermarket_id bigint, normalized_name string, category string", "products"),
        prices=frame(prices, "product_id bigint, store_id bigint, price double", "prices"),
        price_history=empty.price_history, scrape_runs=empty.scrape_runs,
    )
    return cat, products, seen, stores


@pytest.mark.parametrize("cap, compat", [(25, True), (None, True), (25, False)])
def test_search_equals_brute_force(spark, random_world, cap, compat):
    cat, products, prices, stores = random_world
    rnd = random.Random(cap or 1)
    texts = ["lapte", "unt", "lap", "la", "suc", "apa mere", "zuzu", "verde bio", "lapt", "untu", "su ap", "xyz", "", "3,5%", "ton"]
    rows = [
        (i, rnd.choice(texts), rnd.choice([None, None, "lactate-oua"]), rnd.choice([None, None, "A"]),
         rnd.choice([None, "X"]), rnd.choice([None, "c1", "c2"]), rnd.random() < 0.3, rnd.random() < 0.5)
        for i in range(80)
    ]
    got = {}
    hits = search_hits(cat, spark.createDataFrame(rows, schemas.QUERIES), limit=8, candidate_cap=cap, reference_compat=compat)
    for h in hits.orderBy("query_id", "hit_no").collect():
        got.setdefault(h.query_id, []).append((h.match_rank, h.price, h.product_id, h.store_id))
    for i, q, c, city, county, chain, strict, prefix in rows:
        want = model(products, prices, stores, q, prefix, strict, c, chain, city, county, cap, 8, compat)
        assert got.get(i, []) == want, (q, c, city, county, chain, strict, prefix)


def test_baskets_equal_brute_force(spark, random_world):
    cat, products, prices, stores = random_world
    rnd = random.Random(3)
    texts = ["lapte", "unt verde", "lapte zuzu", "suc", "sucuri mere", "apa", "xyzt", "untul", "ton alb"]
    rows = [
        (b, s, rnd.choice(texts) + " " * (s % 2), float(rnd.randint(-1, 3)), rnd.choice([None, "A"]), rnd.choice([None, "X"]))
        for b in range(6) for s in range(5)
    ]
    items = basket.compare_items(cat, spark.createDataFrame(rows, schemas.BASKET_LINES)).collect()
    got = {(r.basket_id, r.item_no, r.supermarket_id): r for r in items}
    assert len(got) == len(rows) * 4
    for b, s, q, qty, city, county in rows:
        for chain in range(1, 5):
            r = got[(b, s + 1, chain)]
            n = q.strip()
            found = model(products, prices, stores, n, False, True, None, f"c{chain}", city, county, 500, 1)
            if found:
                assert (r.price, r.product_id, r.store_id) == found[0][1:] and r.alt_product_id is None
                continue
            assert r.product_id is None
            longest = max((t for t in n.split() if len(t) >= 3), key=len, default="")
            stem = longest[: max(4, len(longest) - 2)]
            alt = model(products, prices, stores, stem, True, False, None, f"c{chain}", city, county, 500, 1) if stem else []
            assert (r.alt_price, r.alt_product_id, r.alt_store_id) == (alt[0][1:] if alt else (None, None, None)), (q, chain)


def test_assembly_keeps_first_spelling(spark):
    events = spark.createDataFrame(
        [(1, 3, "LAPTE", 1.0), (1, 1, "Lapte", 1.0), (1, 2, "unt", 2.0)], "basket_id bigint, seq bigint, query string, qty double"
    )
    got = basket.assemble_baskets(events).orderBy("seq").collect()
    assert [(r.query, r.qty) for r in got] == [("Lapte", 2.0), ("unt", 2.0)]
