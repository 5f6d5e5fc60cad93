"""Benchmark passages against a full alignment of every item with every document."""

import random

import numpy as np
from pyspark.sql import types as T

from shelfwise.llm import decontaminate
from tests.llm import cases

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])


def plain_distance(item, text):
    """Least edits of the whole item against any stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    b = np.frombuffer(text, np.uint8)
    for i, c in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (b != c), row[1:] + 1)
        steps = np.arange(len(best))
        row = np.minimum.accumulate(best - steps) + steps
    return int(row.min())


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abcdefgh")
        elif kind == 1:
            out.insert(at, rng.choice("abcdefgh"))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


def world(seed=8, n=70):
    rng = random.Random(seed)
    syllables = "the an er ing ou tion re es ha st nd ea".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    items = [prose(rng.randrange(12, 45)) for _ in range(12)]
    texts = []
    for i in range(n):
        body = prose(rng.randrange(5, 120))
        if i % 2:
            item = rng.choice(items)
            share = rng.choice([0.0, 0.02, 0.06, 0.1, 0.14, 0.2])
            passage = edited(rng, item, int(len(item) * share))
            body = f"{body}. {passage.upper() if i % 3 else passage}! {prose(rng.randrange(0, 60))}"
        texts.append(body)
    return items, texts


def benchmark(spark, items):
    return spark.createDataFrame([(100 + i, x, "clash") for i, x in enumerate(items)], ITEMS)


def test_exactly_what_a_full_alignment_finds(spark):
    items, texts = world()
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            a, b = decontaminate.normalise(item), decontaminate.normalise(text)
            edits = plain_distance(a, b)
            if edits <= decontaminate.budget(len(a)):
                want[d, 100 + i] = edits
    assert len(want) > 15 and max(want.values()) > 3
    rows = decontaminate.contaminated(cases.documents(spark, texts), benchmark(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in rows} == want
    assert len(rows) == len(want)


def test_short_items_have_the_whole_budget(spark):
    rng = random.Random(5)
    items = ["cat 1", "a", "7b", "xyzzy", "night train", "seventeen bytes x", "an item of some thirty bytes ok", "one of forty three bytes exactly as it is!!"]
    texts = [f"some {edited(rng, x, rng.randrange(4))} words" for x in items for _ in range(12)]
    texts += [f"so {x} is" for x in items] + ["the cat 1 sat", "zq"]
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            a, b = decontaminate.normalise(item), decontaminate.normalise(text)
            edits = plain_distance(a, b)
            if edits <= int(0.12 * len(a)):
                want[d, 100 + i] = edits
    assert {i for _, i in want} == {100 + i for i in range(len(items))} and max(want.values()) >= 2
    rows = decontaminate.contaminated(cases.documents(spark, texts), benchmark(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in rows} == want


def test_blocks_give_the_same(spark, monkeypatch):
    items, texts = world(3, 30)
    docs, bench = cases.documents(spark, texts), benchmark(spark, items)
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).select("doc_id", "item_id", "edits").collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert len(list(decontaminate.blocks(bench, "item_id", "text", decontaminate.RATE, decontaminate.Q))) > 3
    parts = sorted(map(tuple, decontaminate.contaminated(docs, bench).select("doc_id", "item_id", "edits").collect()))
    assert whole == parts and whole
    bad = {r[0] for r in whole}
    kept = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert kept == set(range(30)) - bad


def test_passage_in_a_very_long_text(spark):
    item = "sphinx of black quartz judge my vow before the pale moon climbs over seven silent hills"
    long = "some other words that fill " * 60_000
    rows = decontaminate.contaminated(cases.documents(spark, [long + item + long, item, long]), benchmark(spark, [item, item, None, "", "abc"])).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in rows) == [(0, 100, 0), (0, 101, 0), (1, 100, 0), (1, 101, 0)]
    assert {r["passage"] for r in rows} == {item}


def test_odd_rows_and_empty_tables(spark):
    bench = benchmark(spark, [cases.SENTENCE])
    rows = decontaminate.contaminated(cases.with_odd_ids(spark), bench).collect()
    assert sorted(r["doc_id"] for r in rows) == [0, 0, 6, 7]  # repeated rows each, upper case too
    docs = cases.with_odd_ids(spark)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    none = benchmark(spark, [])
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == docs.count()
    assert decontaminate.contaminated(cases.documents(spark, []), bench).count() == 0
