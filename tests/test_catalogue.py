"""CSV rules, merge with history, edits, gates and the stream."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.operators import edits, gates, reports
from shelfwise.operators.keyed import assign_ids, with_previous
from shelfwise.operators.upsert import save, save_increment
from shelfwise.sources import catalogue_csv as csv
from shelfwise.sources.offers_csv import column_roles, read_offers_csv
from shelfwise.sources.snapshot import empty_catalog, last_batch, read_parts, read_snapshot, write_snapshot
from shelfwise.streaming.ingest import ingest_batch, ingest_stream

DAY1, DAY2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def write(path, content):
    path.write_bytes(content.encode("utf-8"))
    return str(path)


def test_csv_reading_and_store_rules(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        "﻿ Supermarket ,external_id,NAME,price,city,county,store_external_id,brand\r\n"
        'Mega-Image,1,"Lapte ""bio"", 1 l","6,49",,,s1,\r\n'  # id without place, before registration
        "mega-image,2,Unt,0,Cluj,,s1,Zuzu\r\n"  # registers although its price is invalid
        "mega-image,3,Suc,6.49 lei,,,s1\r\n"  # short row, after registration
        ",,,,,,,\r\n\r\n"
        'mega-image,,"Pâine\nalbă",3,,Iași,,\r\n'
        "mega-image,5,,3,,,,\r\n"
        "lidl,6,Apă,2,,,,\r\n",
    )
    batch = csv.rows_to_batch(csv.read_catalogue_csv(spark, path))
    got = {r.external_id: r for r in batch.products.collect()}
    assert set(got) == {"1", "3", "pâine-albă", "6"}
    assert got["1"].name == 'Lapte "bio", 1 l' and got["1"].price == 6.49 and got["1"].brand is None
    assert got["1"].store_external_ids is None
    assert got["3"].store_external_ids == ["s1"] and got["3"].price == 6.49
    assert got["pâine-albă"].store_external_ids == ["csv-iași"]
    stores = {r.external_id: (r.name, r.city, r.county) for r in batch.stores.collect()}
    assert stores == {"s1": ("Mega Image Cluj", "Cluj", None), "csv-iași": ("Mega Image Iași", "Iași", "Iași")}
    assert {r.name for r in batch.supermarkets.collect()} == {"Mega Image", "Lidl"}


def test_header_only_file_is_empty(spark, tmp_path):
    path = write(tmp_path / "b.csv", "supermarket,name,price\n")
    assert csv.rows_to_batch(csv.read_catalogue_csv(spark, path)).products.count() == 0


def test_loose_offers(spark, tmp_path):
    assert column_roles(["Pret_vechi", "Product_Name", "New_Price"]) == {
        "name": "Product_Name", "price": "New_Price", "old_price": "Pret_vechi",
    }
    path = write(
        tmp_path / "o.csv",
        "ID,Product_Name,New_Price,Old_Price,Poza\n1,Lapte 1 l,\"5,99\",7.5,x.png\n2,Unt,9,8,\n3,,5,,\n4,Scump,99999,,\n",
    )
    got = {r.external_id: r for r in read_offers_csv(spark, path).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"].price, got["1"].old_price, got["1"].unit_size, got["1"].image_url) == (5.99, 7.5, "1 l", "x.png")
    assert got["2"].old_price is None


def products_in(spark, *rows):
    """(slug, seq, external_id, name, brand, unit_size_text, price, store ids)"""
    full = [
        (slug, seq, ext, name, brand, None, size, price, None, None, None, None, None, None, None, refs)
        for slug, seq, ext, name, brand, size, price, refs in rows
    ]
    return spark.createDataFrame(full, schemas.PRODUCTS_IN)


def chains_in(spark, *slugs):
    return spark.createDataFrame([(s, i, s.title()) for i, s in enumerate(slugs)], schemas.SUPERMARKETS_IN)


def stores_in(spark, *rows):
    """(slug, seq, external_id, name, city, county, postal_code, address)"""
    return spark.createDataFrame([(*r, None, None) for r in rows], schemas.STORES_IN)


def prices_of(cat):
    named = cat.prices.join(cat.products.select(F.col("id").alias("product_id"), "external_id"), "product_id")
    return {(r.external_id, r.store_id): r for r in named.collect()}


def test_save_folds_and_history(spark):
    first = save(
        empty_catalog(spark),
        chains_in(spark, "lidl"),
        stores_in(spark, ("lidl", 1, "s1", "Unu", "Oradea", None, "410001", "Str. 1"), ("lidl", 2, "s2", "Doi", "Cluj", None, None, None)),
        products_in(
            spark,
            ("lidl", 1, "a", "Lapte 1 l", "Zuzu", None, 5.0, None),
            ("lidl", 2, "a", "Lapte 1 l", None, None, 5.0005, None),
            ("lidl", 3, "a", "Lapte proaspăt", None, None, 5.001, None),
            ("lidl", 4, "a", "Lapte proaspăt", None, None, 5.1, None),
            ("lidl", 5, "b", "Unt", "", "200 g", 9.0, ["s1", "s9"]),
            ("lidl", 6, "c", "Suc", None, None, 4.0, ["s9"]),
            ("lidl", 7, "", "Fără id", None, None, 4.0, None),
            ("lidl", 8, "d", "Fără preț", None, None, 0.0, None),
        ),
        DAY1,
    )
    cat = first.catalog
    a, b, c = cat.products.orderBy("id").collect()
    assert [p.external_id for p in (a, b, c)] == ["a", "b", "c"] and [p.id for p in (a, b, c)] == [1, 2, 3]
    assert (a.name, a.brand, a.normalized_name) == ("Lapte proaspăt", "Zuzu", "lapte proaspat")
    assert (a.quantity, a.unit, a.category) == (1.0, "l", "lactate-oua")
    stores = {s.external_id: s for s in cat.stores.collect()}
    assert stores["s1"].county == "Bihor" and stores["s2"].county is None
    prices = prices_of(cat)
    assert set(prices) == {("a", 0), ("b", stores["s1"].id)}
    assert prices[("b", stores["s1"].id)].price_per_unit == 45.0 and prices[("a", 0)].price_per_unit is None
    logged = sorted(r.price for r in cat.price_history.filter("product_id = 1").collect())
    assert logged == [5.0, 5.1]
    counts = first.counts.first()
    assert (counts.products, counts.prices) == (6, 5)

    again = save(
        cat,
        chains_in(spark, "lidl", "profi"),
        stores_in(spark, ("lidl", 1, "s1", "Unu nou", "Oradea", None, None, None)),
        products_in(
            spark,
            ("profi", 1, "a", "Lapte", None, None, 6.0, None),
            ("lidl", 2, "a", "Lapte proaspăt", None, None, 5.1004, None),
            ("lidl", 3, "b", "Unt", None, None, 9.5, ["s2"]),  # s2 is not in this batch
        ),
        DAY2,
    )
    cat2 = again.catalog
    s1 = cat2.stores.filter("external_id = 's1'").first()
    assert (s1.name, s1.county, s1.postal_code, s1.address) == ("Unu nou", "Bihor", "410001", None)
    assert cat2.stores.count() == 2 and cat2.products.count() == 4
    assert [r.price for r in again.new_history.collect()] == [6.0]
    assert cat2.products.filter("external_id = 'b'").first().brand == ""
    assert cat2.prices.filter("product_id = 1").first().updated_at == DAY2


def test_one_batch_or_many(spark):
    rows = [("lidl", i, f"p{i % 7}", f"Produs {i % 3}", None, None, 1.0 + (i * 37 % 11), None) for i in range(60)]
    chains, none = chains_in(spark, "lidl"), spark.createDataFrame([], schemas.STORES_IN)
    whole = save(empty_catalog(spark), chains, none, products_in(spark, *rows), DAY1).catalog
    parts = empty_catalog(spark)
    for cut in (rows[:13], rows[13:]):
        parts = save(parts, chains, none, products_in(spark, *cut), DAY1).catalog
    for table in ("products", "prices", "price_history"):
        left, right = ([tuple(r) for r in getattr(c, table).collect()] for c in (whole, parts))
        assert sorted(left, key=str) == sorted(right, key=str), table
    again = save(whole, chains, none, products_in(spark, *rows[-7:]), DAY1)
    assert again.new_history.count() == 0


def test_previous_across_chunks_and_dense_ids(spark):
    rows = [(k, s, float(s * 7 % 13)) for k in ("hot", "cold") for s in range(0, 500 if k == "hot" else 9)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v double").repartition(5)
    for parts in (1, 40):  # the hot key lies in one chunk, and in some forty
        got = with_previous(df, ["k"], "v", "seq", "prev", parts=parts).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.prev == (None if r.seq == 0 else float((r.seq - 1) * 7 % 13))
    ids = assign_ids(df.select("k", "seq"), 10, ["seq", "k"]).orderBy("seq", "k").collect()
    assert [r.id for r in ids] == list(range(11, 11 + len(rows)))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    cat = save(
        empty_catalog(spark),
        chains_in(spark, "lidl"),
        spark.createDataFrame([], schemas.STORES_IN),
        products_in(spark, ("lidl", 1, "a", "Lapte", "Zuzu", "1 l", 5.0, None), ("lidl", 2, "b", "Unt", None, "200 g", 9.0, None)),
        DAY1,
    ).catalog
    root = str(tmp_path_factory.mktemp("small"))
    write_snapshot(cat, root)
    return read_snapshot(spark, root)


def test_patches(spark, small):
    rows = [
        (1, 1, "Lapte bun", "Napolact", None, None, None),
        (2, 1, None, "", None, "2 l", None),
        (3, 1, None, None, None, None, 8.0),
        (4, 1, None, None, "bauturi", "4 l", None),
        (5, 2, "", None, None, None, None),  # an empty name alone changes nothing
        (6, 2, None, None, None, None, 9.0),  # same price: logged all the same
        (7, 99, "X", None, None, None, 1.0),  # unknown product
    ]
    changes = spark.createDataFrame(
        rows, "seq bigint, product_id bigint, name string, brand string, category string, unit_size string, price double"
    )
    new = edits.patch_products(small, changes, DAY2)
    a, b = new.products.orderBy("id").collect()
    assert (a.name, a.normalized_name, a.brand) == ("Lapte bun", "napolact lapte bun", "")
    assert (a.category, a.unit_size, a.quantity) == ("bauturi", "4 l", 4.0)
    assert (b.name, b.normalized_name) == ("Unt", "unt")
    prices = prices_of(new)
    assert prices[("a", 0)].price_per_unit == 4.0  # two litres when the price was set
    assert new.price_history.count() == small.price_history.count() + 2
    assert new.prices.count() == 2


def test_create_delete_recompute(spark, small):
    rows = [(1, "lidl", "Pâine albă", None, "", "500 g", 4.0), (2, "lidl", "PAINE ALBA", "X", "menaj", None, 5.0), (3, "nu", "Y", None, None, None, 1.0)]
    new = edits.create_products(
        small,
        spark.createDataFrame(rows, "seq bigint, supermarket_slug string, name string, brand string, category string, unit_size string, price double"),
        DAY2,
    )
    made = new.products.filter(F.startswith("external_id", F.lit("admin-"))).collect()
    assert [(p.id, p.external_id, p.name, p.category, p.quantity) for p in made] == [(3, "admin-paine-alba", "PAINE ALBA", "menaj", None)]
    assert new.price_history.count() == 2
    gone = edits.delete_products(new, spark.createDataFrame([(1,)], "product_id bigint"))
    assert (gone.products.count(), gone.prices.count(), gone.price_history.count()) == (2, 2, 1)
    fixed, report = edits.recompute_categories(new)
    assert tuple(report.first()) == (1, 3)
    assert fixed.products.filter("id = 3").first().category == "panificatie"
    more = edits.create_supermarkets(small, spark.createDataFrame([(1, " La Cocoș "), (2, "X")], "seq bigint, name string"))
    assert [(s.id, s.slug, s.name) for s in more.supermarkets.orderBy("id").collect()][1:] == [(2, "la-cocos", "La Cocoș")]


def test_gates_and_run_log(spark, small):
    batch = products_in(spark, *[("lidl", i, str(i), "x", None, None, 0.0, None) for i in range(3)])
    asked = gates.thresholds(spark, {"lidl": 3, "profi": 1})
    warnings = spark.createDataFrame([("lidl", list("abcdef")), ("profi", list("abcdef"))], "supermarket_slug string, warnings array<string>")
    runs = gates.check_runs(asked, batch, warnings)
    got = {r.supermarket_slug: (r.status, r.message) for r in runs.collect()}
    assert got["lidl"] == ("ok", "a | b | c | d | e")
    assert got["profi"][0] == "error" and got["profi"][1].endswith("a | b | c") and "doar 0 produse" in got["profi"][1]
    assert tuple(gates.overall(runs).first()) == (False, 1, 2)
    assert gates.passing(batch, runs).count() == 3
    saved = spark.createDataFrame([("lidl", 2)], "supermarket_slug string, products bigint")
    log = gates.append_runs(small.scrape_runs, runs, saved, DAY1, DAY2)
    rows = [(r.id, r.supermarket, r.products_found) for r in log.orderBy("id").collect()]
    assert rows == [(1, "lidl", 2), (2, "profi", 0)]
    last = reports.last_runs(small.with_tables(scrape_runs=log), 1).collect()
    assert [r.supermarket for r in last] == ["profi"]
    five = spark.createDataFrame([(f"s{i}",) for i in range(5)], "store_n string")
    assert gates.store_failures_ok(five, five.filter("store_n <> 's1'")).first().gate_ok
    assert not gates.store_failures_ok(five, five.filter("store_n > 's1'")).first().gate_ok


def test_stream_equals_batch_and_replays_once(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    header = ",".join(csv.READ_COLUMNS) + "\n"

    def row(slug, ext, price, city=""):
        return f"{slug},{ext},Lapte {ext},,lactate,1 l,{price},,{city},,,,,,\n"

    write(landing / "a.csv", header + row("lidl", 1, 5) + row("profi", 2, 6, "Cluj") + row("lidl", 3, 7))
    root, state = str(tmp_path / "live"), str(tmp_path / "state")
    ingest_stream(spark, str(landing), root, state, DAY1).awaitTermination()
    live = read_snapshot(spark, root)
    batch = csv.rows_to_batch(csv.read_catalogue_csv(spark, str(landing)))
    want = save(empty_catalog(spark), batch.supermarkets, batch.stores, batch.products, DAY1).catalog
    for table in ("supermarkets", "stores", "products", "prices", "price_history"):
        assert sorted(map(str, getattr(live, table).collect())) == sorted(map(str, getattr(want, table).collect()))
    assert last_batch(spark, root) == 0
    ingest_batch(spark.read.options(**csv.READ_OPTIONS).csv(str(landing)), 0, root, DAY2)  # replay
    assert read_snapshot(spark, root).prices.filter(F.col("updated_at") == DAY2).count() == 0
    write(landing / "b.csv", header + row("lidl", 1, 5.5) + row("profi", 9, 1))
    floors = gates.thresholds(spark, {"lidl": 1, "profi": 2})
    ingest_stream(spark, str(landing), root, state, DAY2, thresholds=floors).awaitTermination()
    after = read_snapshot(spark, root)
    assert after.price_history.count() == live.price_history.count() + 1
    assert after.products.filter("external_id = '9'").count() == 0
    write(landing / "c.csv", header + row("lidl", 3, 8))
    lost = str(tmp_path / "new_state")  # batch ids start at 0 again, the stream has another id
    ingest_stream(spark, str(landing), root, lost, DAY2).awaitTermination()
    last = read_snapshot(spark, root)
    assert [r.price for r in last.products.filter("external_id = '3'").join(last.prices, F.col("id") == F.col("product_id")).collect()] == [8.0]
    assert last.products.filter("external_id = '9'").count() == 1


def tables_of(cat):
    names = ("supermarkets", "stores", "products", "prices", "price_history")
    return {n: sorted(map(str, getattr(cat, n).collect())) for n in names}


def test_increments_leave_other_parts_untouched(spark, tmp_path):
    def batch(*rows):
        slugs = sorted({r[0] for r in rows})
        stores = [(s, 1, "st", "Magazin", "Cluj", None, None, None, None, None) for s in slugs]
        return chains_in(spark, *slugs), spark.createDataFrame(stores, schemas.STORES_IN), products_in(spark, *rows)

    first = batch(*[(s, i, str(i), f"Lapte {i}", None, "1 l", 5.0 + i, ["st"] if i % 2 else None) for s in ("lidl", "profi") for i in range(30)])
    second = batch(("lidl", 1, "3", "Lapte 3", None, "1 l", 9.0, None), ("lidl", 2, "new", "Unt", None, "200 g", 7.0, ["st"]))
    third = batch(("auchan", 1, "a", "Ulei", None, "1 l", 8.0, None), ("profi", 2, "2", "Lapte 2", None, None, 7.0, None))
    root, dealt = str(tmp_path / "live"), str(tmp_path / "dealt")
    whole = save(empty_catalog(spark), *first, DAY1).catalog
    write_snapshot(whole, dealt)  # undealt parts, as a whole snapshot has them
    save_increment(spark, root, *first, DAY1, buckets=4)
    assert tables_of(read_snapshot(spark, root)) == tables_of(whole)
    for step, day in ((second, DAY2), (third, DAY2)):
        before = set(read_parts(spark, root))
        files = {p: os.stat(p.path).st_mtime_ns for p in before}
        whole = save(whole, *step, day).catalog
        save_increment(spark, root, *step, day)
        save_increment(spark, dealt, *step, day)
        after = set(read_parts(spark, root))
        assert tables_of(read_snapshot(spark, root)) == tables_of(read_snapshot(spark, dealt)) == tables_of(whole)
        assert all(os.stat(p.path).st_mtime_ns == t for p, t in files.items())
        gone = before - after
        assert {p.table for p in gone} == {"supermarkets", "stores", "products", "prices"}
        if step is second:  # one chain, two products: no other part is written anew
            assert {p.chain for p in gone if p.table != "supermarkets"} == {1}
            assert sum(p.table == "products" for p in gone) <= 2
            assert sum(p.table == "price_history" for p in after) == 2
    assert read_snapshot(spark, root).products.filter("external_id = 'new'").first().id == 61
