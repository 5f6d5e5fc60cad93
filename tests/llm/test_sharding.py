"""Virtual slots: shards near equal in bytes, gapless places, few moves on rebalancing."""

import random
import zlib

from shelfwise.llm import sharding
from tests.llm import cases


def many(spark, n=3000):
    rng = random.Random(4)
    return cases.documents(spark, ["t" * rng.choice([0, 10, 100, 1000, 3000]) + str(i % 7) for i in range(n)])


def test_bytes_are_near_equal_and_places_gapless(spark):
    rows = sharding.shard_documents(many(spark)).collect()
    sizes, slots = [0] * 16, [[] for _ in range(16)]
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 3000
    assert max(sizes) - min(sizes) <= 3000 and max(sizes) < 1.01 * min(sizes)
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_values(spark):
    rows = {r["doc_id"]: r for r in sharding.shard_documents(cases.documents(spark)).collect()}
    for i, text in enumerate(cases.TEXTS):
        data = (text or "").encode()
        assert (rows[i]["size"], rows[i]["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert rows[i]["law"] == "bytes" and rows[i]["grown_shard"] is None and 0 <= rows[i]["shard"] < 16


def test_equal_texts_are_spread(spark):
    rows = sharding.shard_documents(cases.documents(spark, ["the same text"] * 2000)).collect()
    assert {r["shard"] for r in rows} == set(range(16))


def test_equal_rows_are_spread(spark):
    one = cases.documents(spark, ["the same row " * 10]).crossJoin(spark.range(1024).select())
    docs = cases.documents(spark, [f"another {i}" for i in range(1000)], first=10)
    rows = sharding.shard_documents(docs.union(one)).collect()
    sizes, places = [0] * 16, [[] for _ in range(16)]
    for r in rows:
        sizes[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert len(rows) == 2024 and max(sizes) - min(sizes) <= 200
    assert all(sorted(p) == list(range(len(p))) for p in places)


def test_rebalancing_edits_the_table_only(spark, tmp_path):
    recs = sharding.records(many(spark), 256)
    loads = sharding.slot_loads(recs, 256)
    root = str(tmp_path / "map")
    sharding.store(sharding.assign(loads, 8), root)
    first = sharding.load(spark, root, 1)
    grown = sharding.rebalance(first, loads, 9)
    sharding.store(grown, root)
    second = {r["virtual_slot"]: r["shard"] for r in sharding.load(spark, root, 2).collect()}
    before = {r["virtual_slot"]: r["shard"] for r in sharding.load(spark, root, 1).collect()}
    size = {r["virtual_slot"]: r["bytes"] for r in loads.collect()}
    assert set(before) == set(second) == set(range(256))
    moved = [s for s in before if before[s] != second[s]]
    total = sum(size.values())
    assert total / 12 < sum(size[s] for s in moved) < total / 5  # about a ninth of the bytes
    totals = [sum(size[s] for s in second if second[s] == k) for k in range(9)]
    assert max(totals) < 1.1 * min(totals)
    # and back to fewer shards: nothing is left on the removed one
    shrunk = {r["virtual_slot"]: r["shard"] for r in sharding.rebalance(sharding.load(spark, root, 2), loads, 7).collect()}
    assert set(shrunk.values()) == set(range(7)) and set(shrunk) == set(range(256))


def test_same_map_whatever_the_partitions(spark):
    docs = many(spark, 500)
    got = [
        sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_documents(docs.repartition(n)).collect())
        for n in (1, 7)
    ]
    assert got[0] == got[1]


def test_odd_rows_and_empty_table(spark):
    docs = cases.with_odd_ids(spark)
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count() and all(r["slot"] is not None for r in rows)
    assert sharding.shard_documents(cases.documents(spark, [])).count() == 0
