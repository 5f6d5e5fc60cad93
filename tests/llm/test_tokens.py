"""Token counts and BPE against the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from shelfwise.llm import bpe, token_counts
from tests.llm import cases


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(cases.vocabulary())


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(cases.vocabulary())


def random_texts(n):
    rng = random.Random(7)
    white = [0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0x1C, 0x1F, 0x200B]

    def letter():
        kind = rng.randrange(5)
        if kind < 2:
            return rng.choice("abcthe in'sdllre  \n\t.,!<|>")
        if kind == 2:
            return chr(rng.choice(white))
        return chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x20000)]))

    return ["".join(letter() for _ in range(rng.randrange(50))) for _ in range(n)]


def test_encode_decode_and_count_as_the_library(library, vocab):
    counter = token_counts.Counter(vocab)
    for text in [x or "" for x in cases.TEXTS] + random_texts(1500):
        ids = library.encode(text, add_special_tokens=False).ids
        assert vocab.encode(text) == ids, repr(text)
        assert counter.count(text) == len(ids)
        assert vocab.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_partial_characters_decode_as_the_library(library, vocab):
    ids = vocab.encode("日本語🙂")
    for i in range(len(ids)):
        assert vocab.decode(ids[i:]) == library.decode(ids[i:], skip_special_tokens=False)


def test_merges_are_those_of_a_plain_search(vocab):
    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.choice(b"aaaabthein \xc3\xa9") for _ in range(rng.randrange(1, 40)))
        ids = [vocab.byte_ids[b] for b in data]
        while True:
            ranked = [(vocab.ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in vocab.ranks]
            if not ranked:
                break
            rank, i = min(ranked)
            ids[i : i + 2] = [vocab.merged[rank]]
        assert vocab.merge(data) == ids


def test_proven_tokens_encode_alone_as_one(library, vocab):
    proven = token_counts.proven_tokens(vocab)
    assert len(proven) > 49_000
    for text in sorted(proven)[::97]:
        assert len(library.encode(text, add_special_tokens=False).ids) == 1
    # a piece of a character is never proven, nor one that the split would cut
    assert all(text == "" or bpe.pre_tokens(text) == [text] for text in proven)


def test_count_query_on_odd_rows(spark, library):
    got = token_counts.count_tokens(cases.with_odd_ids(spark), cases.vocabulary())
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert len(rows) == len(cases.TEXTS) + 2
    by = {r["doc_id"]: r for r in rows}
    for i, text in enumerate(cases.TEXTS):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (by[i]["n_bytes"], by[i]["n_tokens"], by[i]["over_limit"]) == (len((text or "").encode()), n, n > 512)


def test_round_trip_on_odd_rows(spark, library):
    docs = cases.with_odd_ids(spark)
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs, cases.vocabulary(), with_ids=True).collect()}
    for i, text in enumerate(cases.TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == ids and rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    decoded = bpe.decode(bpe.encode(docs, cases.vocabulary()), cases.vocabulary())
    assert {r["doc_id"]: r["text"] for r in decoded.collect() if r["doc_id"]} == {i: x or "" for i, x in enumerate(cases.TEXTS) if i}


def test_empty_tables(spark):
    none = cases.documents(spark, [])
    assert token_counts.count_tokens(none, cases.vocabulary()).count() == 0
    assert bpe.round_trip(none, cases.vocabulary()).count() == 0


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_memo_is_bounded_and_right():
    from shelfwise.llm.common import Recent

    memo = Recent(lambda k: k * 2, 3)
    assert [memo[k % 5] for k in range(40)] == [(k % 5) * 2 for k in range(40)]
    assert len(memo) + len(memo.older) <= 6
