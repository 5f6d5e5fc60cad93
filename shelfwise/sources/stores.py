"""Store lists: representative stores and store-level availability of offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.geo import county_from_postal_code
from shelfwise.functions.numbers import parse_float_prefix
from shelfwise.operators.keyed import first_per_key

STORE_LIST = "array<struct<n:string, cn:string, t:string, pc:string, sn:string, lat:string, lng:string>>"


def parse_store_list(raw: DataFrame) -> DataFrame:
    """``payload`` JSON store lists -> one row per store."""
    return raw.select(F.inline(F.from_json("payload", STORE_LIST)))


def select_stores(
    stores: DataFrame, cities: list[str] | None = None, everything: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Stores to follow, and warnings (one text column).

    Named cities win (one store each), then all stores if asked for, else one
    store per county. The lowest store number stands for its group; stores with
    an unknown postal code are left out of the county choice and counted.
    """
    if cities:
        wanted = [c.strip().lower() for c in cities]
        keyed = stores.withColumn("_city", F.lower("t")).filter(F.col("_city").isin(wanted))
        asked = stores.sparkSession.createDataFrame([(c,) for c in wanted], "_city string")
        missing = asked.join(keyed.select("_city"), "_city", "left_anti").select(
            F.concat(
                F.lit("Kaufland: niciun magazin în orașul „"), "_city", F.lit("”")
            ).alias("warning")
        )
        return first_per_key(keyed, ["_city"], ["n"]).drop("_city"), missing
    if everything:
        return stores, stores.sparkSession.createDataFrame([], "warning string")
    keyed = stores.withColumn("_county", county_from_postal_code(F.col("pc")))
    unknown = (
        keyed.filter(F.col("_county").isNull())
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 0)
        .select(
            F.format_string(
                "Kaufland: %d magazine cu cod poștal nerecunoscut (ignorate la selecția pe județe)",
                "n",
            ).alias("warning")
        )
    )
    chosen = first_per_key(keyed.filter(F.col("_county").isNotNull()), ["_county"], ["n"])
    return chosen.drop("_county"), unknown


def to_batch_stores(stores: DataFrame, slug: str) -> DataFrame:
    """Selected stores as STORES_IN rows."""
    return stores.select(
        F.lit(slug).alias("supermarket_slug"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("n").alias("external_id"),
        F.col("cn").alias("name"),
        F.col("t").alias("city"),
        F.lit(None).cast("string").alias("county"),
        F.col("pc").alias("postal_code"),
        F.col("sn").alias("address"),
        parse_float_prefix(F.col("lat")).alias("lat"),
        parse_float_prefix(F.col("lng")).alias("lng"),
    )


def attach_availability(offers: DataFrame, selected: DataFrame, lists: DataFrame) -> DataFrame:
    """Set ``store_external_ids`` of each offer: the selected stores that list its ``kl_nr``.

    An offer listed nowhere is national (NULL). ``lists``: store_n, kl_nr. A
    list holds each store once, so it is bounded by the number of stores.
    """
    have = (
        lists.filter(F.col("kl_nr") != "")
        .select("store_n", "kl_nr")
        .distinct()
        .join(selected.select(F.col("n").alias("store_n")), "store_n", "left_semi")
        .groupBy("kl_nr")
        .agg(F.array_sort(F.collect_list("store_n")).alias("listed_in"))
    )
    return (
        offers.drop("store_external_ids")
        .join(have, "kl_nr", "left")
        .withColumnRenamed("listed_in", "store_external_ids")
    )
