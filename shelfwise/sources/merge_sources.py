"""Combining harvested products of several sources, the most trusted first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numbers import is_sane_price
from shelfwise.functions.text import dashed
from shelfwise.operators.keyed import first_per_key
from shelfwise.schemas import HARVESTED_COLUMNS


def product_key(external_id: Column, name: Column) -> Column:
    return F.when(external_id != "", external_id).otherwise(dashed(name))


def merge_sources(*sources: DataFrame) -> DataFrame:
    """Merge sources given in order of trust; the first occurrence of a product wins.

    Each source has site, page_seq, item_seq (bigint) and the harvested columns.
    Pages come in visiting order, and within a page sources by trust.
    """
    ranked = [
        s.select("site", "page_seq", F.lit(i).alias("source_rank"), "item_seq", *HARVESTED_COLUMNS)
        for i, s in enumerate(sources)
    ]
    rows = reduce(DataFrame.unionByName, ranked)
    rows = rows.filter((F.col("name") != "") & is_sane_price(F.col("price")))
    rows = rows.withColumn("product_key", product_key(F.col("external_id"), F.col("name")))
    return first_per_key(rows, ["site", "product_key"], ["page_seq", "source_rank", "item_seq"])
