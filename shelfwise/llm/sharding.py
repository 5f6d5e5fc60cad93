"""Shards through fixed virtual slots.

Every record hashes into one of thousands of virtual slots, for good. Bytes are aggregated per
slot, and a versioned slot-to-shard table says where a slot lies; rebalancing edits that table
(a new version) and never the hash. The table has a fixed number of rows, so whole-table steps
on it are bounded whatever the data; everything per record is DataFrame functions only.

Law held: ``bytes`` - the sizes of the shards are near equal. Slots go, largest first, to the
shard with the least bytes.

Null text has size 1 and the CRC of the empty text. A null id, repeated rows and equal texts are
records like any other (the slot hashes id and text, and for rows equal in both their place in the
table, so no group shares a slot). An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfwise.session import broadcast_if_small, materialize, new_shared_path

SLOTS = 4096
LAW = "bytes"


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32) of every row; the text is read once and dropped."""
    text = F.coalesce(text_col, F.lit(""))
    return df.select(
        id_col, (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )


def records(df: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, virtual_slot) of every row.

    The slot follows from id and text. Rows that others equal in both cannot be told apart and would share
    a slot, a third of all rows perhaps: their place in the table goes into the hash as well.
    """
    sized = materialize(measured(df, id_col, text_col), "sizes")  # so that the text is read once
    same = [id_col, "text_crc32", "size"]
    repeated = sized.groupBy(*same).count().filter("count > 1").select(*[F.col(c).alias(f"_{c}") for c in same])
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    hashed = F.xxhash64(id_col, "text_crc32", "_place")
    alone = F.xxhash64(id_col, "text_crc32")
    return (
        sized.withColumn("_row", F.monotonically_increasing_id())
        .join(broadcast_if_small(repeated), equal, "left")
        .withColumn("_place", F.when(F.col("_size").isNotNull(), F.col("_row")))
        .withColumn("virtual_slot", F.pmod(F.when(F.col("_place").isNull(), alone).otherwise(hashed), F.lit(slots)).cast("int"))
        .select(id_col, "size", "text_crc32", "virtual_slot")
    )


def slot_loads(recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) of all slots, empty ones included."""
    loads = recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = recs.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(loads, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows")
    )


def _least(loads: Column) -> Column:
    return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")


def _placed(items: Column, loads: Column) -> Column:
    """Fold over (virtual_slot, bytes) items: each goes to the shard with the least bytes so far."""
    start = F.struct(
        loads.alias("loads"),
        F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("done"),
    )

    def step(state: Column, item: Column) -> Column:
        shard = _least(state["loads"])
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == shard, x + item["bytes"]).otherwise(x)).alias("loads"),
            F.concat(
                state["done"],
                F.array(F.struct(item["virtual_slot"].alias("virtual_slot"), shard.alias("shard"))),
            ).alias("done"),
        )

    return F.aggregate(items, start, step, lambda state: state["done"])


def _heaviest_first(loads: DataFrame) -> Column:
    """All slots as one array, most bytes first: as many entries as there are slots."""
    entry = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes")
    return F.sort_array(F.collect_list(entry))


def assign(loads: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the table: (version, virtual_slot, shard)."""
    zeros = F.array_repeat(F.lit(0).cast("long"), shards)
    placed = loads.agg(_placed(_heaviest_first(loads), zeros).alias("p"))
    return placed.select(F.inline("p")).select(F.lit(1).alias("version"), "virtual_slot", "shard")


def rebalance(table: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version: slots above a shard's fair share of bytes move to where the least lies.

    A slot stays if the bytes of its shard up to it, heaviest first, are within the fair share
    (and its shard still exists); only the others move.
    """
    version = table.agg(F.max("version")).first()[0]
    latest = table.filter(F.col("version") == version).select("virtual_slot", "shard").join(loads, "virtual_slot")
    # whole-table steps: as many rows as there are slots
    fair = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / F.lit(shards)
    up_to = F.sum("bytes").over(
        Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    )
    marked = latest.select("*", ((F.col("shard") < shards) & (up_to <= fair)).alias("stays"))
    kept = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.aggregate(
            F.col("stay"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["shard"] == s, x["bytes"]).otherwise(F.lit(0))
        ),
    )
    entry = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes")
    state = marked.agg(
        F.collect_list(F.when(F.col("stays"), F.struct("virtual_slot", "shard", "bytes"))).alias("stay"),
        F.sort_array(F.collect_list(F.when(~F.col("stays"), entry))).alias("move"),
    ).select("stay", "move", kept.alias("loads"))
    both = F.concat(
        F.transform("stay", lambda x: F.struct(x["virtual_slot"].alias("virtual_slot"), x["shard"].alias("shard"))),
        _placed(F.col("move"), F.col("loads")),
    )
    return state.select(F.inline(both)).select(F.lit(version + 1).alias("version"), "virtual_slot", "shard")


def store(table: DataFrame, root: str) -> str:
    """Write one version under ``root``; earlier versions stay, a version is never overwritten."""
    version = table.select("version").first()[0]
    path = f"{root}/version={version}"
    table.select("virtual_slot", "shard").write.parquet(path)
    return path


def load(spark: SparkSession, root: str, version: int) -> DataFrame:
    schema = T.StructType([T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{root}/version={version}").select(F.lit(version).alias("version"), "*")


def place(recs: DataFrame, table: DataFrame, loads: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Records with shard and ``slot``: the record's place in its shard, gapless from 0.

    Places count on from the rows of the shard's earlier virtual slots, so only the rows of one
    virtual slot are ordered together. Ties are rows equal in every column, in any order.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        table.select("virtual_slot", "shard")
        .join(loads, "virtual_slot")
        .select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size")
    ranked = recs.withColumn("rank", F.row_number().over(inside) - 1)
    # the table has a fixed number of rows
    return ranked.join(F.broadcast(offsets), "virtual_slot").withColumn("slot", (F.col("offset") + F.col("rank")).cast("long"))


def shard_documents(
    df: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", root: str | None = None
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version)."""
    spark = df.sparkSession
    root = root or new_shared_path(spark, "slot-map")
    recs = materialize(records(df, slots, id_col, text_col), "records")
    loads = slot_loads(recs, slots)
    store(assign(loads, shards), root)
    table = load(spark, root, 1)
    return place(recs, table, loads, id_col).select(
        id_col,
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(1).alias("map_version"),
    )
