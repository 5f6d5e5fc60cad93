"""The catalogue as DataFrames, and its versioned Parquet snapshots."""

from __future__ import annotations

import uuid
from dataclasses import astuple, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.session import write_table
from shelfwise.sources.search_index import (
    INDEX_TABLES,
    SearchIndex,
    build_index,
    names_of,
    postings_of,
    vocabulary_of,
)


@dataclass(frozen=True)
class Catalog:
    supermarkets: DataFrame
    stores: DataFrame
    products: DataFrame
    prices: DataFrame
    price_history: DataFrame
    scrape_runs: DataFrame
    #: the stored search index of ``products``, if there is one
    index: SearchIndex | None = None

    def with_tables(self, **tables: DataFrame) -> Catalog:
        """Other tables in place of some; an index does not outlive the products it was made of."""
        return replace(self, **({"index": None} if "products" in tables else {}), **tables)

    def search_index(self) -> SearchIndex:
        return self.index or build_index(self.products)

    @property
    def spark(self) -> SparkSession:
        return self.products.sparkSession


def empty_catalog(spark: SparkSession) -> Catalog:
    return Catalog(**{n: spark.createDataFrame([], s) for n, s in schemas.TABLES.items()})


_POINTER = "_versions"
_POINTER_SCHEMA = "number bigint, version string, batch_id bigint, stream string"
_MANIFEST = "_manifest"
_MANIFEST_SCHEMA = "table string, chain bigint, bucket int, buckets int, path string, last_id bigint"

#: tables dealt over buckets of a chain
BY_BUCKET = ("products", "prices", *INDEX_TABLES)
#: buckets of a chain in a root that a batch is merged into for the first time
BUCKETS = 8


@dataclass(frozen=True)
class Part:
    """Files of one table that hold one bucket of one chain; without a chain, rows of any."""

    table: str
    chain: int | None
    bucket: int | None
    buckets: int | None
    path: str
    #: greatest id in it, if the table has ids
    last_id: int | None


def bucket_of(external_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(external_id), F.lit(buckets)).cast("int")


def write_snapshot(
    catalog: Catalog, root: str, batch_id: int | None = None, stream: str | None = None
) -> str:
    """Write every table whole under a new version; the pointer row is published last.

    Readers follow the pointer and the version's manifest of parts, so a job that dies half-way leaves
    the previous version in force, and files in use are never overwritten. The pointer row also names
    the stream and the batch it holds, if any. :func:`write_increment` replaces single parts.
    """
    spark = catalog.spark
    version = uuid.uuid4().hex
    parts = []

    def put(table: str, frame: DataFrame) -> DataFrame:
        path = f"{root}/{version}/{table}"
        write_table(frame, path)
        parts.append(Part(table, None, None, None, path, None))
        return spark.read.schema(_schema(table)).parquet(path)

    written = {name: put(name, getattr(catalog, name)) for name in schemas.TABLES}
    names = put("names", names_of(written["products"]))
    order = ["word", "name_id"]
    postings = put("postings", postings_of(names).repartitionByRange(*order).sortWithinPartitions(*order))
    put("vocabulary", vocabulary_of(postings))
    _publish(spark, root, version, parts, batch_id, stream)
    return version


def write_increment(
    root: str, old: list[Part], replaced: list[Part], new: Catalog, buckets: int,
    batch_id: int | None = None, stream: str | None = None,
) -> list[Part]:
    """A version in which the tables of ``new`` stand in place of the ``replaced`` parts; all others stay as they are.

    ``new.price_history`` and ``new.scrape_runs`` hold added rows only and become parts of their own.
    """
    spark = new.spark
    version = uuid.uuid4().hex
    base = f"{root}/{version}"
    home = new.products.select(
        F.col("id").alias("product_id"),
        F.col("supermarket_id").alias("chain"),
        bucket_of(F.col("external_id"), buckets).alias("bucket"),
    )
    frames = {
        "stores": new.stores.withColumn("chain", F.col("supermarket_id")),
        "products": new.products.withColumns(
            {"chain": F.col("supermarket_id"), "bucket": bucket_of(F.col("external_id"), buckets)}
        ),
        "prices": new.prices.join(home, "product_id"),
    }
    keys = ["chain", "bucket"]
    frames["names"] = names_of(frames["products"], *keys)
    frames["postings"] = postings_of(frames["names"], *keys)
    frames["vocabulary"] = vocabulary_of(frames["postings"], *keys)
    parts = [p for p in old if p not in replaced]
    for table in ("supermarkets", "price_history", "scrape_runs"):
        write_table(getattr(new, table), f"{base}/{table}")
        parts.append(Part(table, None, None, None, f"{base}/{table}", None))
    for table, frame in frames.items():
        keys = ["chain", "bucket"] if table in BY_BUCKET else ["chain"]
        path = f"{base}/{table}"
        # one file per part, more for a large one
        write_table(frame.hint("rebalance", *keys), path, *keys)
        types = ", ".join([_schema(table), *[f"{k} {'bigint' if k == 'chain' else 'int'}" for k in keys]])
        last = F.max("id") if table in ("stores", "products") else F.lit(None)
        written = spark.read.schema(types).parquet(path).groupBy(*keys).agg(last.cast("bigint").alias("last_id"))
        for r in written.collect():  # one row per part
            at = "/".join(f"{k}={r[k]}" for k in keys)
            parts.append(
                Part(table, r["chain"], r["bucket"] if len(keys) > 1 else None, buckets, f"{path}/{at}", r["last_id"])
            )
    _publish(spark, root, version, parts, batch_id, stream)
    return parts


def _publish(
    spark: SparkSession, root: str, version: str, parts: list[Part], batch_id: int | None, stream: str | None
) -> None:
    rows = spark.createDataFrame([astuple(p) for p in parts], _MANIFEST_SCHEMA)
    rows.coalesce(1).write.parquet(f"{root}/{_MANIFEST}/{version}")
    number = 1 + max((row["number"] for row in _top(spark, root)), default=0)
    pointer = spark.createDataFrame([(number, version, batch_id, stream)], _POINTER_SCHEMA)
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/{_POINTER}")


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{_POINTER}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _POINTER_SCHEMA)
    return spark.read.schema(_POINTER_SCHEMA).parquet(f"{root}/{_POINTER}")


def _top(spark: SparkSession, root: str) -> list:
    return _pointers(spark, root).orderBy(F.desc("number")).limit(1).collect()


def last_batch(spark: SparkSession, root: str, stream: str | None = None) -> int:
    """Highest batch published so far by ``stream`` (None: by any), -1 for none."""
    rows = _pointers(spark, root)
    if stream is not None:
        rows = rows.filter(F.col("stream") == stream)
    top = rows.agg(F.max("batch_id").alias("b")).first()["b"]
    return -1 if top is None else top


def read_parts(spark: SparkSession, root: str, version: str | None = None) -> list[Part]:
    """Parts of the last (or given) version: as many as there are buckets of chains, and added parts."""
    if version is None:
        top = _top(spark, root)
        if not top:
            return []
        version = top[0]["version"]
    rows = spark.read.schema(_MANIFEST_SCHEMA).parquet(f"{root}/{_MANIFEST}/{version}")
    return [Part(**r.asDict()) for r in rows.collect()]


def _schema(table: str) -> str:
    return schemas.TABLES.get(table) or INDEX_TABLES[table]


def catalog_of(spark: SparkSession, parts: list[Part]) -> Catalog:
    """The rows of some parts as a catalogue."""
    paths = {n: [p.path for p in parts if p.table == n] for n in (*schemas.TABLES, *INDEX_TABLES)}

    def rows(name: str) -> DataFrame:
        reader = spark.read.schema(_schema(name))
        return reader.parquet(*paths[name]) if paths[name] else spark.createDataFrame([], _schema(name))

    index = None
    if paths["postings"]:
        index = SearchIndex(*[rows(n) for n in INDEX_TABLES], several_parts=len(paths["names"]) > 1)
    return Catalog(**{n: rows(n) for n in schemas.TABLES}, index=index)


def read_snapshot(spark: SparkSession, root: str, version: str | None = None) -> Catalog:
    return catalog_of(spark, read_parts(spark, root, version))
