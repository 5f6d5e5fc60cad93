"""Keyed folds, lags and dense ids that do not gather a hot key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import materialize


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key; Spark keeps one row per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def last_known(column: str, seq: str = "seq") -> Column:
    """Aggregate: last non-NULL value in arrival order, NULL when there is none."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(seq))).alias(column)


def with_previous(
    df: DataFrame, keys: list[str], value: str, seq: str, into: str, parts: int | None = None
) -> DataFrame:
    """``lag(value)`` per key in ``seq`` order, in chunks that hold a bounded share of the rows.

    Rows are range-partitioned by key and order, so a key with very many rows lies in
    several partitions; its rows in one of them are a chunk. Inside a chunk the lag is a
    plain window, and its first row takes the last value of the chunk before it. Only the
    first key of a partition can have a chunk before, so those values are at most one row
    per partition.
    """
    ranged = df.repartitionByRange(*([parts] if parts else []), *keys, seq)
    placed = materialize(ranged.withColumn("_part", F.spark_partition_id()), "chunks")
    chunks = Window.partitionBy(*keys).orderBy("_part")
    before = (
        placed.groupBy(*keys, "_part")
        .agg(F.max_by(value, seq).alias("_last"))
        .withColumns({"_before": F.lag("_last").over(chunks), "_chunk": F.row_number().over(chunks)})
        .filter(F.col("_chunk") > 1)
        .select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_of_{k}") for k in keys], "_before")
    )
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    inside = Window.partitionBy(*keys, "_part").orderBy(seq)
    previous = F.when(F.row_number().over(inside) == 1, F.col("_before")).otherwise(
        F.lag(value).over(inside)
    )
    return placed.join(F.broadcast(before), same, "left").select(
        *df.columns, previous.alias(into)
    )


def assign_ids(new: DataFrame, base: int, order: list[str], into: str = "id") -> DataFrame:
    """Dense ids ``base + 1 ...`` in the given total order, without a one-task window.

    Rows are range-partitioned and sorted, written out with their slot
    (partition, row), and each partition's offset is the size of those before it.
    """
    slot_bits = 33
    placed = materialize(
        new.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "ids",
    )
    part = F.shiftright(F.col("_slot"), slot_bits)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .select("_part", "_offset")
    )
    row = F.col("_slot").bitwiseAND(F.lit((1 << slot_bits) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(into, F.lit(base + 1) + F.col("_offset") + row)
        .drop("_slot", "_part", "_offset")
    )


def max_id(df: DataFrame) -> int:
    return df.agg(F.max("id").alias("m")).first()["m"] or 0
