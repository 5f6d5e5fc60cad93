"""WARC archives by a deterministic sharded writer, and their reader.

Records are range-sorted by page id: a histogram of the ids (a fixed number of bins) gives shard
bounds of about equal bytes, a bin above a shard's size is split by hash. Each shard is written by
one task, which rolls to a new file once the compressed size passes the bound. Headers and digests
are made anew from the content alone, so a task that runs again writes the same bytes. A file is
written under a temporary name and renamed when complete; the manifest, written last by Spark,
lists what is committed, and the reader opens nothing else.

Of pages with equal payloads the smallest page id is the response, the others are revisits that
carry HTTP headers and a reference but no payload. Null html is the empty payload. Rows repeated
with one page id are all responses if that id is the smallest. A null page id is written without
an id, never becomes the one referred to unless no other has the payload, and reads back as null.
Null urls read back as null. An empty table gives an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfwise.llm.common import bound_batches
from shelfwise.session import materialize, new_shared_path

#: uncompressed bytes of a shard at most (but for one record), and the least number of shards aimed at
SHARD_BYTES = 1 << 30
MIN_SHARDS = 512
#: compressed bytes after which a file is closed
FILE_BYTES = 1 << 30
#: bins of the page id histogram
BINS = 1 << 13
#: every record of an archive carries this date: content alone decides the bytes
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("records", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("digest_ok", T.BooleanType()),
    ]
)


def _uri(root: str) -> str:
    """``root`` with the scheme that the file systems of the workers need."""
    if "://" in root:
        return root
    return "file://" + root.removeprefix("file:")


def b32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_id(page_id: int | None, digest: str) -> str:
    """A name-based UUID: the same page and payload always get the same record id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers and drops the payload."""
    digest = b32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{b32_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"Refers-To-Page-ID: {refers_to}")
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8") + block + b"\r\n\r\n"


class _Roller:
    """Files of one shard, one gzip member per record."""

    def __init__(self, root: str, shard: int, file_bytes: int):
        self.store, self.base = fs.FileSystem.from_uri(root)
        self.shard, self.file_bytes, self.part, self.sink = shard, file_bytes, 0, None

    def add(self, record: bytes) -> None:
        if self.sink is None:
            self.name = f"pages-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.base}/_temporary/{uuid.uuid4().hex}-{self.name}"
            self.sink = self.store.open_output_stream(self.temporary, compression=None)
            self.records, self.bytes, self.sha = 0, 0, hashlib.sha256()
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip with no name and no time
        data = packer.compress(record) + packer.flush()
        self.sink.write(data)
        self.sha.update(data)
        self.records, self.bytes = self.records + 1, self.bytes + len(data)

    def full(self) -> bool:
        return self.sink is not None and self.bytes >= self.file_bytes

    def commit(self) -> tuple[str, int, int, str]:
        self.sink.close()
        self.store.move(self.temporary, f"{self.base}/{self.name}")  # a second attempt brings the same bytes
        self.sink, self.part = None, self.part + 1
        return self.name, self.records, self.bytes, self.sha.hexdigest()


def _manifest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.name for f in MANIFEST])


def notices(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha, first): pages whose payload, of at least ``min_bytes``, a smaller page id has too."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.filter(F.octet_length(html) >= min_bytes).select("page_id", F.sha1(html.cast("binary")).alias("sha"))
    # copies only: most payloads are unique and need no entry in the join
    first = keyed.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    copies = keyed.join(first, "sha").filter(~F.col("first").eqNullSafe(F.col("page_id")))
    return copies.select("page_id", "sha", "first").distinct()


def shard_of(pages: DataFrame, shard_bytes: int = SHARD_BYTES, min_shards: int = MIN_SHARDS):
    """A function that adds ``shard`` to rows with page_id and sha, ascending with the page id.

    Only rows of a bin larger than a shard are dealt by hash among as many shards as it needs.
    """
    size = F.octet_length(F.coalesce("html", F.lit(""))) + 512
    sizes = pages.select("page_id", size.alias("size"))
    low, high, total = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("size")).first()
    if low is None:  # no page has an id
        low = high = 0
    width = (high - low) // BINS + 1
    aim = max(1, min(shard_bytes, (total or 0) // min_shards))

    def binned(df: DataFrame) -> DataFrame:
        return df.withColumn("bin", F.expr(f"coalesce((page_id - {low}L) div {width}L, {BINS}L)"))

    # a row per bin, BINS + 1 at most, whatever the data
    before = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = binned(sizes).groupBy("bin").agg(F.sum("size").alias("size"))
    splits = F.ceil(F.col("size") / F.lit(aim))
    bounds = bins.select("bin", F.coalesce(before, F.lit(0)).alias("before"), splits.alias("splits"))
    bounds = bounds.select("bin", F.expr(f"before div {aim}L").alias("start"), "splits")
    bounds = materialize(bounds, "shard-bounds")
    salt = F.pmod(F.xxhash64("page_id", "sha"), F.col("splits"))
    return lambda df: (
        binned(df).join(F.broadcast(bounds), "bin").withColumn("shard", F.col("start") + salt).drop("bin", "start", "splits")
    )


def write(
    pages: DataFrame, root: str, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, min_shards: int = MIN_SHARDS, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under the shared folder ``root``; returns the manifest.

    The pages are shuffled once, by shard. Which of them are revisits is worked out from ids and
    digests alone and travels as small notices that sort just before their pages.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    root = _uri(root)
    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(f"{base}/_temporary", recursive=True)
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"))
    add_shard = shard_of(pages, shard_bytes, min_shards)
    told = notices(pages, min_bytes).select("page_id", "sha", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    stored = pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.lit(None).cast("long").alias("first"), "url", "html")
    rows = (
        add_shard(told.union(stored))
        .select("shard", "page_id", "sha", "first", "url", "html")
        .repartition("shard")
        .sortWithinPartitions("shard", "page_id", F.col("html").isNotNull(), "sha", "url")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, of, known = None, None, {}
        for batch in batches:
            done = []
            for start in range(0, batch.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in batch.slice(start, 64).columns)):
                    shard, page_id, sha, first, url, page = row
                    if of != (shard, page_id):
                        of, known = (shard, page_id), {}
                    if page is None:
                        known[sha] = first
                        continue
                    if roller is not None and (roller.shard != shard or roller.full()) and roller.sink is not None:
                        done.append(roller.commit())
                    if roller is None or roller.shard != shard:
                        roller = _Roller(root, shard, file_bytes)
                    roller.add(record_bytes(page_id, url, page.encode("utf-8"), known.get(sha), sha in known))
            if done:
                yield _manifest_rows(done)
        if roller is not None and roller.sink is not None:
            yield _manifest_rows([roller.commit()])

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def parse(stream) -> Iterator[dict]:
    """Records of one archive: headers in lower case, and the block. Bounded by the largest record."""
    unzip, buffer = zlib.decompressobj(31), io.BytesIO()
    while True:
        data = stream.read(1 << 20)
        if not data:
            break
        while data:
            buffer.write(unzip.decompress(data))
            data = unzip.unused_data
            if unzip.eof:
                yield _record(buffer.getvalue())
                unzip, buffer = zlib.decompressobj(31), io.BytesIO()


def _record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return {"version": lines[0], "headers": headers, "block": rest[: int(headers["content-length"])]}


def _read_back(record: dict) -> tuple:
    headers, block = record["headers"], record["block"]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    stated = headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    ok = headers["warc-block-digest"] == f"sha1:{b32_sha1(block)}"
    if kind == "response":
        ok = ok and len(payload) == size and b32_sha1(payload) == stated
    number = lambda name: int(headers[name]) if name in headers else None
    return number("page-id"), headers.get("warc-target-uri"), kind, number("refers-to-page-id"), size, stated, ok


def read(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Records of the committed archives; digests are recomputed from the bytes (``digest_ok``)."""
    root = _uri(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for record in parse(stream):
                        rows.append(_read_back(record))
                        if len(rows) == 4096:
                            yield _rows(rows, kinds)
                            rows = []
                if rows:
                    yield _rows(rows, kinds)

    # a task per few files: names are few bytes, so Spark would else read them all in one task
    spread = manifest.select("file").repartition(max(spark.sparkContext.defaultParallelism, 32), "file")
    return spread.mapInArrow(run, RECORD)


def _rows(rows: list[tuple], kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.name for f in RECORD])


def archive_pages(pages: DataFrame, root: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` and read the archives back: one row per record, as :data:`RECORD`."""
    spark = pages.sparkSession
    root = root or new_shared_path(spark, "warc")
    return read(spark, root, write(pages, root, min_bytes))


#: the same rows in DuckDB; base32 from five hex digits at a time
ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS sha FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(sha, (5 * (k // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
