"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of text Spark may put into one Arrow batch for a Python worker
BATCH_BYTES = 8 << 20
#: rows a worker turns into Python objects at a time
SLICE_ROWS = 256


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not only by rows; a bound the application was started with is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of at most :data:`SLICE_ROWS` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """True for rows held out: crc32 of the id as text falls in ``fold``, or the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(True))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_text_per_id(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text, ...) with one row of each id: that whose text hashes lowest.

    Only hashes are gathered by id, so an id that very many rows repeat costs no more than another.
    """
    placed = rows.withColumn("_of", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")))
    lowest = placed.groupBy("id").agg(F.min("_of").alias("_of"))
    return placed.join(lowest, ["id", "_of"], "left_semi").drop("_of").dropDuplicates(["id"])


def keep_rows(df: DataFrame, text_col: str, keep) -> DataFrame:
    """Rows of ``df``, with all their columns, for whose text ``keep(texts)`` says true."""
    bound_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for part in slices(batches):
            yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


class Recent(dict):
    """Bounded memo of a function: the entries used last stay, in two generations.

    ``memo[key]`` computes what is missing. At most ``2 * room`` entries are held.
    """

    def __init__(self, compute, room: int):
        super().__init__()
        self.compute, self.room, self.older = compute, room, {}

    def __missing__(self, key):
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value
