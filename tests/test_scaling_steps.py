"""Shared steps do their heavy work once and where the rows already are."""

import os
import time
from datetime import datetime

from pyspark.sql import functions as F

from shelfwise.operators import basket, reports, search, upsert
from shelfwise.plans import registry, testbed
from shelfwise.session import materialize, settled, shared_dir, tasks_for
from shelfwise.sources import catalogue_csv

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_merged_products_are_derived_once(spark):
    cat = testbed.catalog(spark, SF)
    _, _, lines = registry.feed_batches(spark, SF)
    chain = cat.supermarkets.select(F.col("slug").alias("supermarket_slug"), F.col("id").alias("supermarket_id"))
    batch = upsert.with_sizes(upsert.valid_products(lines.drop("l_shipdate"))).join(chain, "supermarket_slug")
    out = upsert.upsert_products(cat.products, batch, F.lit(datetime(2000, 1, 1)))
    assert "FullOuter" not in plan(out)  # the merge ran again for each of its readers


def test_search_arms_give_one_row_a_product_and_no_more_than_asked(spark):
    cat = testbed.catalog(spark, SF)
    queries = spark.createDataFrame([(1, "lapte", None), (2, "ulei", None), (3, None, "bauturi")], "query_id bigint, q string, category string")
    q = search.prepare_queries(queries)
    arms = [search._name_arm(cat, q, None, True, 4), search._category_arm(cat, q, None, 4)]
    for rows in arms:  # every product and store before
        got = rows.collect()
        assert got and len(got) == len({(r["query_id"], r["product_id"]) for r in got})
        assert max(sum(r["query_id"] == i for r in got) for i in (1, 2, 3)) == 4
    # the cut of each arm loses none of the first hits
    whole = {(r["query_id"], r["hit_no"], r["product_id"], r["store_id"]) for r in search.search_hits(cat, queries).collect()}
    some = search.search_hits(cat, queries, limit=4).collect()
    assert {(r["query_id"], r["hit_no"], r["product_id"], r["store_id"]) for r in some} == {w for w in whole if w[1] <= 4}


def test_basket_lines_move_before_they_are_unfolded(spark):
    cat = testbed.catalog(spark, SF)
    lines = registry.basket_lines(spark, SF)
    shown = plan(basket.compare_baskets(cat, lines)).split("\n")
    moved = next(i for i, x in enumerate(shown) if "RepartitionByExpression [basket_id" in x)
    unfolded = next(i for i, x in enumerate(shown) if "Generate explode(concat" in x or "Generate explode(" in x and "chains" in x)
    assert unfolded < moved  # the plan reads upwards; nothing moved before the explosion otherwise


def test_page_reads_products_once(spark):
    cat = testbed.catalog(spark, SF)
    out = reports.product_page(cat, "Ring LAP", 10)
    assert "normalized_name" not in plan(out)  # the products were read and searched twice


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_alternatives_reduce_the_offers_once(spark, monkeypatch):
    made = []
    for module in (search, basket):
        def counted(df, label, write=module.materialize):
            made.append(label)
            return write(df, label)

        monkeypatch.setattr(module, "materialize", counted)
    registry.QUERIES["alternatives"](spark, SF)
    assert made.count("offers") == 1 and made.count("queries") == 2  # three passes over all prices before


def test_basket_tasks_grow_with_the_lines(spark):
    lines = testbed.table(spark, SF, "lineitem")
    assert tasks_for(lines, 100) == -(-lines.count() // 100) and tasks_for(lines) == spark.sparkContext.defaultParallelism
    shown = registry.QUERIES["basket_assembly"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in shown.split("\n") if "Exchange hashpartitioning(" in x]
    assert len(moved) == 1 and "l_orderkey" in moved[0]  # by basket and query, in a fixed number of tasks, before


def test_stored_parts_are_described_by_all_tasks_and_prices_hashed(spark):
    shown = plan(testbed.products(spark, SF)).split("\n")
    assert sum(x.strip(" :+-").startswith("Repartition ") for x in shown) == 2  # lines only before
    assert "SortAggregate" not in physical(testbed.prices(spark, SF))


def test_written_files_are_bounded_and_read_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f'n "{i}"\nx', 1.0 + i) for i in range(50)], "external_id string, name string, price double")
    for c in ("brand", "category", "unit_size", "image_url", "url"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.withColumn("old_price", F.lit(None).cast("double")).coalesce(1)
    path = str(tmp_path / "out")
    catalogue_csv.write_catalogue_csv(catalogue_csv.catalogue_csv_rows(rows, "metro"), path, file_rows=7)
    assert len(list((tmp_path / "out").glob("*.csv"))) == 8
    back = catalogue_csv.read_catalogue_csv(spark, path).orderBy("seq").collect()
    assert [r["external_id"] for r in back] == [str(i) for i in range(50)]


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_shuffles_of_a_stored_table_go_with_its_job(spark):
    before = shuffle_files(spark)
    stored = materialize(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    for _ in range(50):  # they go in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before  # all stayed until the driver collected its garbage
    assert stored.count() == 100 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_basket_lines_are_made_once(spark):
    cat = testbed.catalog(spark, SF)
    lines = registry.basket_lines(spark, SF)
    for out in (basket.compare_baskets(cat, lines), basket.missing_counts(cat, lines)):
        assert "l_orderkey" not in plan(out)  # joined and moved again for the sums


def test_stream_leaves_its_published_tables_only(spark):
    testbed.catalog(spark, SF)
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = registry.stream_ingest(spark, SF)
    made = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before)
    assert made == ["landing", "live", "stream"]  # and all tables of every batch
    assert rows.count() == testbed.catalog(spark, SF).prices.count() > 0


def test_a_settled_table_outlives_what_it_was_made_of(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = settled(spark, lambda: materialize(spark.range(5), "step").filter("id > 1"), "whole")
    assert [r["id"] for r in rows.orderBy("id").collect()] == [2, 3, 4]
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before] == ["whole"]
