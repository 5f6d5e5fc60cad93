"""BPE encoding and decoding: merges found by a segment tree over adjacent pair ranks.

The leaves of the tree hold the rank of each pair of neighbouring symbols (and its position),
so the root is the leftmost merge of the lowest rank. A merge changes three leaves, each in
logarithmic time, until no pair of the vocabulary is left; one very long pre-token therefore
costs ``n log n``. Pre-tokens repeat, so each worker remembers the ones it met last.

Null text is the empty text: no ids, and the empty string decoded. Rows are independent:
repeated rows, ties and clashing extra columns do not matter, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfwise.llm.common import Recent, bound_batches, slices

#: pre-tokens each worker remembers per generation
MEMO = 250_000

# Letters, numbers and white space up to U+00FF, and Unicode's white space
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LATIN_NUMBERS = "0-9²³¹¼-¾"
WHITE = "\t-\r \x85\xa0"
ALL_WHITE = WHITE + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _pattern(letters: str, numbers: str, white: str) -> str:
    """The byte-level split: contractions, words, numbers, other signs, white space."""
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+"
        rf"|[{white}]+(?![^{white}])|[{white}]+"
    )


_LATIN = re.compile(_pattern(LATIN_LETTERS, LATIN_NUMBERS, WHITE))
_ANY = regex.compile(_pattern(r"\p{L}", r"\p{N}", ALL_WHITE))


def pre_tokens(text: str) -> list[str]:
    """Split as the byte-level pre-tokenizer does; texts up to U+00FF take the faster pattern."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ANY.findall(text)
    return _LATIN.findall(text)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Pieces, merge ranks and special strings of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.pieces = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        self.byte_ids = [0] * 256
        for i, piece in self.pieces.items():
            if len(piece) == 1:
                self.byte_ids[piece[0]] = i
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = (
            re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
            if self.specials
            else None
        )
        self.memo: Recent | None = None

    def __getstate__(self):
        return self.__dict__ | {"memo": None}

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special, string) in order; special strings in a text are special tokens."""
        if self.special_split is None or not any(s in text for s in self.specials):
            yield False, text
            return
        for i, part in enumerate(self.special_split.split(text)):
            if part:
                yield bool(i % 2), part

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte_ids[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        rank_of, merged = self.ranks.get, self.merged
        bits, size, none = n.bit_length(), 1 << (n - 2).bit_length(), 1 << 62
        here = (1 << bits) - 1
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = rank_of(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[size + i] = rank << bits | i
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            i = size + leaf
            tree[i] = value
            i >>= 1
            while i:
                left, right = tree[2 * i], tree[2 * i + 1]
                least = left if left < right else right
                if tree[i] == least:
                    return
                tree[i] = least
                i >>= 1

        def pair(i: int, j: int) -> int:
            rank = rank_of(ids[i] << 32 | ids[j])
            return none if rank is None else rank << bits | i

        while tree[1] != none:
            i = tree[1] & here
            ids[i] = merged[tree[1] >> bits]
            j = after[i]
            k = after[i] = after[j]
            ids[j] = -1
            if j < n - 1:
                put(j, none)
            if k < n:
                before[k] = i
            put(i, pair(i, k) if k < n else none)
            if before[i] >= 0:
                put(before[i], pair(before[i], i))
        return [x for x in ids if x >= 0]

    def remembered(self, token: str) -> tuple[int, str, bytes, bytes]:
        """Number of ids, ids as text, decoded bytes and ids (four bytes each) of a pre-token."""
        ids = self.merge(token.encode("utf-8"))
        return len(ids), ",".join(map(str, ids)), self.join(ids), array("i", ids).tobytes()

    def join(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def tokens(self, text: str) -> list[tuple[int, str, bytes, bytes]]:
        """One entry per pre-token or special string of ``text``."""
        if self.memo is None:
            self.memo = Recent(self.remembered, MEMO)
        out = []
        for special, part in self.parts(text):
            if special:
                i = self.specials[part]
                out.append((1, str(i), part.encode("utf-8"), array("i", [i]).tobytes()))
            else:
                out.extend(map(self.memo.__getitem__, pre_tokens(part)))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join([e[3] for e in self.tokens(text)]), np.int32).tolist()

    def decode(self, ids) -> str:
        """Text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        special = {i: s.encode("utf-8") for s, i in self.specials.items()}
        return b"".join(special[i] if i in special else self.pieces.get(i, b"") for i in ids).decode("utf-8", "replace")


def share(df: DataFrame, vocabulary: str):
    """The vocabulary as a broadcast; its size is that of the vocabulary file, whatever the data."""
    bound_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of every whole text."""
    shared = share(df, vocabulary)
    schema = T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        vocab = shared.value
        for part in slices(batches):
            ids = [vocab.encode(x or "") for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each row's ids; null ids give the empty text, unknown ids nothing."""
    shared = share(df, vocabulary)
    schema = T.StructType([df.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches):
        vocab = shared.value
        for part in slices(batches):
            texts = [vocab.decode(x or ()) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, schema)


def round_trip(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]): encode every text and decode its ids.

    One pass: the digests are taken where the ids are, so the ids cross to Spark only if asked for.
    """
    shared = share(df, vocabulary)
    fields = [
        df.schema[id_col],
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(batches):
        vocab = shared.value
        for part in slices(batches):
            counts, of_ids, of_text, ids = [], [], [], []
            for text in part.column(1).to_pylist():
                entries = vocab.tokens(text or "")
                counts.append(sum(e[0] for e in entries))
                of_ids.append(hashlib.sha256(",".join([e[1] for e in entries]).encode("ascii")).hexdigest())
                data = b"".join([e[2] for e in entries]).decode("utf-8", "replace")
                of_text.append(hashlib.sha256(data.encode("utf-8")).hexdigest())
                if with_ids:
                    ids.append(b"".join([e[3] for e in entries]))
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            if with_ids:
                ends = pa.array(np.cumsum([0, *counts]), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return df.select(id_col, text_col).mapInArrow(run, schema)
