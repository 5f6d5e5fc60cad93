"""The prefix trie against a plain one, built from whole rebuilt conversations."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from shelfwise.llm import prefix_trie
from shelfwise.llm.common import read_table
from shelfwise.llm.queries import op11_prefix_trie

SF = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, rank string, conv string"


def plain_trie(rows, rebuilt=True):
    """The contract, over (conv_id, turn, role, text) rows; conversations stay as they are if not ``rebuilt``."""
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            given[conv].append((turn is not None, turn or 0, role, tie, text))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in given.items()}
    members = defaultdict(list)
    lengths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuilt else 0
        turns = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
        lengths[c] = len(turns)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        convs = members[node]
        saved[node] = (len(convs) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in children[node])
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        ends = ",".join(str(c) for c in sorted(convs) if lengths[c] == len(node))
        out.append(
            (
                min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
                leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=lambda r: r[:2])


def trie_rows(found):
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.select(*COLUMNS).collect()), key=lambda r: r[:2])


def rebuilt_trie(df):
    conv = F.col("conv")
    return prefix_trie.prefix_trie(df, base=conv - conv % 100, head=F.crc32(conv.cast("string")) % 6)


def test_query_against_the_plain_trie(spark):
    rows = read_table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()
    assert trie_rows(op11_prefix_trie(spark, SF)) == plain_trie([tuple(r) for r in rows])


def test_ties_nulls_repeats_and_a_long_conversation(spark):
    draw = random.Random(2)
    rows = [
        (
            draw.choice([0, 1, 2, 5, 100, 103, -7, -105, None, draw.randrange(400)]),
            draw.choice([None, 0, 1, 2, 3, 50]),
            draw.choice([None, "", "user", "a"]),
            draw.choice([None, "", "x", "yé🙂"]),
        )
        for _ in range(1200)
    ]
    rows += [(7, i, "user", "same") for i in range(400)] + [(8, i, "user", "same") for i in range(300)]
    rows += rows[:50]  # repeated rows
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    assert trie_rows(rebuilt_trie(df)) == plain_trie(rows)
    assert trie_rows(prefix_trie.prefix_trie(df)) == plain_trie(rows, rebuilt=False)


def test_paths_that_hang_on_one_another(spark):
    rows = [(c, t, "u", "a" if t < 40 - c else f"b{c}") for c in range(30) for t in range(41)]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    assert trie_rows(prefix_trie.prefix_trie(df)) == plain_trie(rows, rebuilt=False)


def test_colliding_fingerprints_are_noticed_and_drawn_again(spark, monkeypatch):
    real = prefix_trie.multipliers
    asked = []

    def weak_first(attempt):
        asked.append(attempt)
        return [1] * 4 if attempt == 0 else real(attempt)  # the order of turns then counts for nothing

    monkeypatch.setattr(prefix_trie, "multipliers", weak_first)
    rows = [(c, t, "u", f"{(c + t) % 3}") for c in range(9) for t in range(3)]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    assert trie_rows(prefix_trie.prefix_trie(df)) == plain_trie(rows, rebuilt=False)
    assert asked == [0, 1]


def test_turn_references_lead_to_stored_turns(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a")]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    got = {(r["conv_id"], r["depth"]): r["turn_ref"] for r in prefix_trie.prefix_trie(df).collect()}
    assert got == {(1, 0): None, (1, 1): 0, (1, 2): 1}


def test_empty_table(spark):
    assert rebuilt_trie(spark.createDataFrame([], SCHEMA)).collect() == []
