"""Periodic runs against a brute-force search, on drawn word lists, whole texts and odd rows."""

import hashlib
import random
import zlib

import pytest

from shelfwise.llm import periodic_runs
from shelfwise.llm.common import read_table
from shelfwise.llm.queries import op12_periodic_runs, with_planted_run
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length < max(12, 2 * q):
                continue
            part = words[start : start + length]
            if not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(seed):
    draw = random.Random(seed)
    for _ in range(400):
        n = draw.randint(0, 150)
        words = [draw.randrange(draw.choice([1, 2, 3, 30])) for _ in range(n)]
        for _ in range(draw.randint(0, 3)):
            if n > 20:
                s, p = draw.randrange(n), draw.randint(1, 40)
                for i in range(s + p, min(n, s + p * draw.randint(2, 9) + draw.randint(0, 5))):
                    words[i] = words[i - p]
        assert periodic_runs.runs(words) == plain_runs(words)


def test_shortest_runs_and_longer_ones_around_them():
    word = [f"w{i}" for i in range(40)]
    assert periodic_runs.runs(word[:6] * 2) == [(0, 12, 6)]
    assert periodic_runs.runs(word[:5] * 2 + word[:1]) == []  # 11 words
    assert periodic_runs.runs(word[:5] * 2 + word[:2]) == [(0, 12, 5)]
    assert periodic_runs.runs(word[:20] * 2) == [(0, 40, 20)]
    assert periodic_runs.runs(word[:20] * 2 + ["x"]) == [(0, 40, 20)]
    assert periodic_runs.runs((["a"] * 15 + ["b"]) * 3) == sorted([(0, 48, 16), (0, 15, 1), (16, 15, 1), (32, 15, 1)], key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("words", [["a"] * 50_000, ["a", "b"] * 25_000, (["a"] * 100 + ["b"]) * 300])
def test_very_long_texts_of_few_words(words):
    found = periodic_runs.runs(words)
    assert found[0][1] in (len(words), 100) and max(r[1] for r in found) == len(words)


def plain_row(doc_id, text, words):
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return {
        "doc_id": doc_id, "n_words": len(words), "n_runs": len(found),
        "start": best and best[0], "length": best and best[1], "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(left).hexdigest(),
    }


def plain_words(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    a = (h // 10) % n
    p = 1 + (n - a) // (3 + (h // 10) % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_against_brute_force(spark):
    rows = read_table(spark, SF, "documents").select("doc_id", "text").collect()
    short = [r for r in rows if len((r["text"] or "").split()) < 1500]
    want = {r["doc_id"]: plain_row(r["doc_id"], r["text"], plain_words(r["doc_id"], r["text"])) for r in short}
    got = {r["doc_id"]: r.asDict() for r in op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows) and any(r["n_runs"] for r in want.values())
    assert {i: got[i] for i in want} == want


def test_odd_rows(spark):
    docs = cases.with_odd_ids(spark)
    found = periodic_runs.with_digests(periodic_runs.find_runs(docs, words_of=with_planted_run)).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    for r in docs.collect():
        assert by_id[r["doc_id"]].asDict() == plain_row(r["doc_id"], r["text"], plain_words(r["doc_id"], r["text"])) or r["text"].startswith("very")
    long = [r for r in found if r["n_words"] == 3001]
    assert len(long) == 1 and long[0]["n_runs"] >= 1
    empty = by_id[1]
    assert empty["n_words"] == 0 and empty["n_runs"] == 0 and empty["start"] is None
    assert empty["runs_sha256"] == empty["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    found = periodic_runs.find_runs(cases.documents(spark, []))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"] and found.count() == 0
