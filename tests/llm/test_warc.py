"""WARC archives: round trip, revisits, rolling, determinism."""

import gzip
import hashlib
import os

from pyspark.sql import types as T

from shelfwise.llm import warc

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        *[T.StructField(n, T.StringType()) for n in ("shard", "bin", "revisit", "sha")],
    ]
)


def pages(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], PAGES)


ROWS = [
    (5, "http://a.example/5", "<p>same é</p>"),
    (3, "http://a.example/3", "<p>same é</p>"),
    (9, "http://a.example/9", "<p>same é</p>"),
    (1, None, None),
    (2, "http://a.example/2", ""),
    (7, "http://a.example/\r\nX: y", "\r\n\r\nHTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n"),
    (8, "http://a.example/8", "z" * 100_000),
    (8, "http://a.example/8", "z" * 100_000),
    (None, "http://a.example/none", "<p>same é</p>"),
    (None, "http://a.example/other", "only here"),
    (-4, "http://a.example/-4", "negative id"),
]


def test_round_trip(spark):
    got = warc.archive_pages(pages(spark, ROWS)).collect()
    assert len(got) == len(ROWS) and all(r["digest_ok"] for r in got)
    seen = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"], r["payload_digest"]) for r in got)
    first = {}
    for i, _, html in ROWS:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        lead = first.get(html or "")
        revisit = lead is not None and lead != i
        want.append((i or 0, "revisit" if revisit else "response", lead if revisit else 0, len(data), warc.b32_sha1(data)))
    assert seen == sorted(want)


def test_files_are_valid_and_the_same_again(spark, tmp_path):
    source = pages(spark, [(i, f"http://a.example/{i}", f"page {i % 40} " * 50) for i in range(200)])
    digests = []
    for name, parts in (("one", 3), ("two", 7)):
        root = str(tmp_path / name)
        manifest = warc.write(source.repartition(parts), root, min_shards=8, file_bytes=2000).collect()
        files = sorted(f for f in os.listdir(root) if f.endswith(".warc.gz"))
        assert files == sorted(r["file"] for r in manifest) and sum(r["records"] for r in manifest) == 200
        assert len(files) > 8  # rolled within shards
        for r in manifest:
            with open(f"{root}/{r['file']}", "rb") as f:
                data = f.read()
            assert hashlib.sha256(data).hexdigest() == r["sha256"] and len(data) == r["bytes"]
            assert gzip.decompress(data).count(b"WARC/1.1\r\n") == r["records"]
        assert os.listdir(f"{root}/_temporary") == []
        digests.append(sorted((r["file"], r["sha256"]) for r in manifest))
    assert digests[0] == digests[1]


def test_only_committed_files_are_read(spark, tmp_path):
    root = str(tmp_path / "w")
    manifest = warc.write(pages(spark, ROWS[:3]), root)
    with open(f"{root}/pages-999999-00000.warc.gz", "wb") as f:
        f.write(b"left by a task that died")
    assert warc.read(spark, root, manifest).count() == 3


def test_records_are_range_sorted(spark, tmp_path):
    root = str(tmp_path / "r")
    warc.write(pages(spark, [(i, "u", str(i)) for i in range(100)]), root, min_shards=4)
    ids = []
    for name in sorted(f for f in os.listdir(root) if f.endswith(".gz")):
        with open(f"{root}/{name}", "rb") as f:
            ids += [int(r["headers"]["page-id"]) for r in warc.parse(f)]
    assert ids == list(range(100))


def test_a_damaged_payload_is_noticed():
    record = warc._record(warc.record_bytes(1, "u", b"payload", None, False))
    assert warc._read_back(record)[-1] is True
    record["block"] = record["block"].replace(b"payload", b"pay1oad")
    assert warc._read_back(record)[-1] is False


def test_empty_table(spark):
    assert warc.archive_pages(pages(spark, [])).count() == 0
